"""The quality table over regenerated conversations."""


def test_the_view_shows_what_is_needed_and_nothing_stale_or_restricted(spark):
    from ctxspark.quality import conversations, quality_table

    raw, asked, needed = conversations(spark, 50, 80)
    assert raw.count() == 4000 and asked.count() == 50 and raw.select("message_id").distinct().count() == 4000
    got = {r.method: r for r in quality_table(spark).collect()}
    view = got["context view"]
    assert (view.recall, view.stale_excluded, view.restricted_excluded) == (100.0, 100.0, 100.0) and view.tokens < 40
    full, recent = got["full history"], got["recency window"]
    assert full.stale_excluded == full.restricted_excluded == 0.0 and full.recall == 87.5 and full.tokens > 1000
    assert (recent.recall, recent.stale_excluded, recent.restricted_excluded) == (0.0, 100.0, 100.0)
    assert all(r.tokens <= 192 for name, r in got.items() if name != "full history")
