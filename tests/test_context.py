import pytest

from ctxspark.context import extract as E
from ctxspark.context import view as V
from ctxspark.sources.catalog import CatalogError


@pytest.fixture
def talk(engine):
    engine.execute("manifest-context c")
    return engine


def say(engine, *messages):
    for n, text, *tab in messages:
        where = f" vibe-tab {tab[0] if tab[0] == 'auto' else repr(tab[0])}" if tab else ""
        engine.execute(f"yeet-memory c drip ({n}, 'user', '{text}'){where}")


def report(engine, text):
    out = {}
    for r in engine.sql(text).collect():
        out.setdefault(r.field, []).append(r.value)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def test_relocation(talk):
    say(talk, (1, "I live in Seattle."), (88, "Actually I moved to NYC."))
    got = report(talk, "spill-context c only-if 'restaurants near me' token-budget 200")
    assert "user_location=NYC" in got["current_context"] and "Seattle" not in got["current_context"]
    assert got["invalidated"] == "user_location=Seattle @message_1 invalidated_by=message_88"
    got = report(talk, "explain-context c only-if 'near me' token-budget 200")
    assert (got["scan_messages"], got["scan_atoms"], got["pruned_invalidated_atoms"], got["rendered_if_spilled"]) == ("2/2", "2/2", "1", "1")


def test_redaction(talk):
    say(talk, (1, "Never share passwords."))
    objects = talk.sql("show-context-objects c").collect()
    assert all("passwords" not in r.value and "passwords" not in r.original_snippet for r in objects) and len(objects) == 2
    assert "CONFIDENTIAL_CUSTOMER_DATA" in objects[0].access_labels
    got = report(talk, "spill-context c only-if 'share' token-budget 200")
    assert got["redacted_atoms"] == "1" and "passwords" not in got["current_context"]


def test_retag_restores(talk):
    say(talk, (1, "My dog likes salmon.", "convo about dog"), (2, "I live in Seattle."), (3, "I moved to NYC."))
    assert report(talk, "vibe-tab c message 3 'convo about dog'")["retagged_atoms"] == "1"
    got = report(talk, "spill-context c vibe-tab 'main' only-if 'where' receipts off")
    assert "Seattle" in got["current_context"] and "NYC" not in got["current_context"]
    with pytest.raises(CatalogError):
        talk.execute("vibe-tab c message 9 'x'")


def test_alias_and_merge(talk):
    talk.execute("alias-tab c 'dog' to 'convo about dog'")
    say(talk, (1, "My dog likes salmon.", "auto"), (2, "I like cat cafes.", "pet stuff"))
    got = report(talk, "merge-tabs c 'pet stuff' into 'dog'")
    assert got == {"context": "c", "from_tab": "pet stuff", "to_tab": "convo about dog", "moved_messages": "1", "moved_atoms": "1"}
    (row,) = talk.sql("show-tabs c").collect()
    assert (row.tab, row.messages, row.atoms, row.last_message, row.aliases) == ("convo about dog", "2", "2", "2", "dog,pet stuff")


def test_merge_recomputes(talk):
    say(talk, (1, "I live in Seattle.", "where"), (2, "I moved to NYC.", "travel"))
    assert {r.status for r in talk.contexts.atoms("c").collect()} == {"active"}
    talk.execute("merge-tabs c 'where' into 'travel'")
    assert {(r.value, r.status) for r in talk.contexts.atoms("c").collect()} == {("Seattle", "invalidated"), ("NYC", "active")}


def test_alias_chain():
    assert E.resolve_aliases({"puppy": "dog", "dog": "convo about dog", "a": "b", "b": "a"}) == {"puppy": "convo about dog", "dog": "convo about dog", "a": "a", "b": "b"}


def test_auto_tabs(talk):
    texts = ["My dog likes salmon", "investigate the slow join", "roadmap for the project", "What is next?", "Never push on Friday", "I prefer tea", "I want a nap"]
    say(talk, *[(i, t, "auto") for i, t in enumerate(texts, 1)])
    assert [r.tab for r in talk.contexts.messages("c").orderBy("ordinal").collect()] == ["convo about dog", "debug this later", "project roadmap", "open questions", "constraints", "preferences", "current tasks"]
    with pytest.raises(CatalogError, match="Duplicate"):
        say(talk, (1, "again"))


def test_atom_rules(spark):
    texts = ["Decision: use parquet for 41.5 tokens. Later.", "Should we shard it?", "TODO: fix the läck here; now", "Always use api key rotation", "i like tea because warm", "whenever x", None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[(a.key, a.value, a.rule, a.start, a.end) for a in (r[0] or [])] for r in frame.select(E.atoms(E.F.coalesce("t", E.F.lit("")))).collect()]
    assert got[0] == [("decision.parquet_tokens", "use parquet for 41.5 tokens", "marker:decision: ", 10, 37)]
    assert got[1] == [("open_question.shard", "Should we shard it", "punctuation:question_mark", 0, 19)]
    assert got[2] == [("debug_followup.fix_ck_here".replace("_ck", ""), "fix the läck here", "marker:todo: ", 6, 24)]
    assert got[3] == [("user_constraint.security", "always use api key rotation", "marker:always ", 7, 27)]
    assert got[4] == [("user_preference", "tea", "marker:i like ", 7, 23)]
    assert got[5:] == [[("user_constraint.never", "never x", "marker:never ", 9, 10)], [], []]


def naive_status(atoms):
    out = [["active", None] for _ in atoms]
    for i, (key, tab, value, source) in enumerate(atoms):
        for j in range(i):
            if out[j][0] == "active" and atoms[j][:2] == (key, tab) and atoms[j][2] != value:
                out[j] = ["invalidated", source]
    return [tuple(x) for x in out]


def test_status_against_pairwise_model(spark):
    import random

    r = random.Random(3)
    atoms = [(r.choice("kl"), r.choice("tu"), r.choice("xyz"), f"m{i}") for i in range(120)]
    frame = spark.createDataFrame([("c", i, 0, *a) for i, a in enumerate(atoms)], "context string, ordinal bigint, place int, key string, tab string, value string, source string")
    got = [(x.status, x.invalidated_by) for x in V.with_status(frame).orderBy("ordinal").collect()]
    assert got == naive_status(atoms)


def test_budget_skips_what_does_not_fit(spark):
    import random

    r = random.Random(5)
    costs = [r.randint(1, 30) for _ in range(300)]
    frame = spark.createDataFrame([("c", i + 1, c) for i, c in enumerate(costs)], "context string, rank int, cost bigint")
    for budget in (1, 40, 100):
        want, left = [], budget
        for i, c in enumerate(costs):
            if c <= left:
                want.append(i + 1)
                left -= c
        assert [x.rank for x in V.fill_budget(frame, budget).orderBy("rank").collect()] == want


def test_schemas_and_cache(talk):
    assert [r.schema for r in talk.sql("show-context-schemas").collect()] == ["ConversationMessage", "ContextAtom", "TaskState", "ToolInvocationLog", "UserProfile"]
    say(talk, (1, "My dog likes salmon.", "auto"))
    q = "spill-context c only-if 'dog' token-budget 500"
    first = talk.sql(q)
    assert talk.sql(q) is first
    say(talk, (2, "I like cat cafes.", "convo about dog"))
    assert report(talk, q)["active_atoms"] == "2"


def test_streamed_messages(talk, spark, tmp_path):
    from ctxspark.context.store import RAW
    from ctxspark.streaming.messages import merge_into, read_messages, stream_atoms

    rows = [("c", 0, 1, "u", "I live in Rome.", "", False), ("c", 1, 2, "u", "I moved to Oslo.", "", False)]
    spark.createDataFrame(rows, RAW).write.parquet(str(tmp_path / "in"))
    assert stream_atoms(read_messages(spark, str(tmp_path / "in"))).isStreaming
    for k in range(2):
        merge_into(talk.contexts, read_messages(spark, str(tmp_path / "in")), "c", str(tmp_path / f"cp{k}")).awaitTermination()
    assert [(r.value, r.status) for r in talk.contexts.atoms("c").orderBy("ordinal").collect()] == [("Rome", "invalidated"), ("Oslo", "active")]


def test_retrieval(spark):
    from ctxspark import retrieval as R

    texts = ["I live in Rome", "dog dog dog", "nothing", "we decided on tea", "the dog sleeps"]
    m = spark.createDataFrame([("c", i, "u", t) for i, t in enumerate(texts)], "context string, ordinal bigint, speaker string, text string")
    ids = lambda df: sorted(r.ordinal for r in df.collect())
    assert ids(R.full_history(m)) == [0, 1, 2, 3, 4]
    assert ids(R.recency_window(m, 10)) == [3, 4]
    assert ids(R.keyword_scan(m, "find the dog", 100)) == [1, 4] and ids(R.lexical_rag(m, "dog", 4)) == [1]
    assert ids(R.extractive_summary(m, 100)) == [0, 3]
    shown = R.full_history(m)
    needed = spark.createDataFrame([("c", "required", "rome"), ("c", "required", "oslo"), ("c", "stale", "x y z")], "context string, kind string, needle string")
    assert [tuple(r) for r in R.quality(shown, needed).collect()] == [("c", 0.5, 1.0, None)]


def plain_atoms(text):
    """A plain model of the extraction rules, over bytes."""
    import re

    from ctxspark.context import rules as R
    from ctxspark.functions.text import SLUG_STOP

    space = " \t\n\x0b\f\r"
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    def clean(s):
        s = s.strip(space)
        for stop in (" but ", " because "):
            if stop in low(s):
                s = s[: low(s).index(stop)]
                break
        return s.rstrip(".!?,;").strip(space)

    def named(base, value):
        if base == "user_constraint" and any(t in low(value) for t in R.SECURITY_TERMS):
            return "user_constraint.security"
        words = [t for t in re.findall("[a-z0-9]+", low(value)) if len(t) >= 3 and t not in SLUG_STOP][:4]
        return f"{base}.{'_'.join(words) or 'general'}" if base in R.SLUGGED else base

    out = []
    for key, kind, markers, with_marker in R.MARKERS:
        for m in markers:
            if m not in low(text):
                continue
            begin = low(text).index(m) + len(m)
            rest, end = text[begin:], None
            for k, c in enumerate(rest):
                if c in "\n\r!?;" or c == "." and (k + 1 == len(rest) or rest[k + 1] in space):
                    end = k
                    break
            value = rest if end is None else rest[:end]
            snippet = value.strip(space)
            if not clean(value):
                continue
            start = len(text[:begin].encode())
            stop = start + len((snippet if end is None else value).encode())
            full = clean(m + clean(value)) if with_marker else clean(value)
            shown = clean(m + snippet) if with_marker else snippet
            rule = "marker:remember that" if m == "remember that " else f"marker:{m}"
            out.append((named(key, full), full, kind, rule, "0.92", start, stop, shown))
            break
    if "?" in text and clean(text):
        out.append((named("open_question", clean(text)), clean(text), "question", "punctuation:question_mark", "0.75", 0, len(text.encode()), text))
    return out


def test_atoms_against_plain_model(spark):
    import random

    from ctxspark.context import rules as R

    r = random.Random(11)
    bits = [m for _, _, ms, _ in R.MARKERS for m in ms] + ["Rome", "a secret api key", "läck 41.5", ".", ". ", "?", "! ", ";\n", " but ", " because ", "x", "The plan of it", "  ", ",", "\r\n", "UPPER I LIKE tea"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 7))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in frame.select("i", E.atoms(E.F.col("t")).alias("a")).collect():
        assert [tuple(a) for a in row.a] == plain_atoms(texts[row.i]), repr(texts[row.i])
