import pytest

from ctxspark.functions.sem import EvalError
from ctxspark.plans.session import Engine
from ctxspark.sources.catalog import CatalogError


def rows(engine, text):
    return [tuple(r) for r in engine.sql(text).collect()]


@pytest.fixture
def users(engine):
    engine.execute("manifest users (id INTEGER main-character, name TEXT no-cap-not ghosted, score REAL); yeet-into users drip (1,'Ada',9.5),(2,'Grace',8.0),(3,'Linus',7.0);")
    return engine


def test_crud(users):
    assert rows(users, "slay name no-cap users only-if score > 7.5 hits-different score down-bad cap-at 1") == [("Ada",)]
    assert users.execute("glow-up users be-like score = score + 1, name = name || '!' only-if id = 2")[0].message == "updated 1 row(s)"
    assert rows(users, "slay name, score no-cap users only-if id = 2") == [("Grace!", 9.0)]
    assert users.execute("ratio users only-if id > 2")[0].affected == 1
    assert rows(users, "slay headcount(*) no-cap users") == [(2,)]


def test_constraints(users):
    with pytest.raises(CatalogError, match="Duplicate primary key"):
        users.execute("yeet-into users drip (4,'x',1.0),(1,'y',2.0)")
    with pytest.raises(CatalogError, match="cannot be NULL"):
        users.execute("yeet-into users (id) drip (9)")
    assert rows(users, "slay headcount(*) no-cap users") == [(3,)]
    with pytest.raises(CatalogError):
        users.execute("manifest users (id INTEGER)")
    with pytest.raises(CatalogError, match="Unsupported type"):
        users.execute("manifest d (x DATE)")


def test_foreign_keys(users):
    users.execute("manifest orders (id INTEGER main-character, user_id INTEGER side-character references users(id)); yeet-into orders drip (10,1),(11,ghosted)")
    for text in ("yeet-into orders drip (12,99)", "ratio users only-if id = 1", "glow-up users be-like id = 50 only-if id = 1", "rizz-down users"):
        with pytest.raises(CatalogError):
            users.execute(text)
    assert users.execute("ratio users only-if id = 2")[0].affected == 1


def test_join_group_having(users):
    users.execute("manifest orders (id INTEGER main-character, user_id INTEGER, total REAL); yeet-into orders drip (10,1,25),(11,1,50),(12,2,5)")
    q = "slay u.name, stack(o.total) lowkey total no-cap users lowkey u link-up orders lowkey o fr-fr u.id = o.user_id vibe-check u.name bussin-only stack(o.total) > 10"
    assert rows(users, q) == [("Ada", 75.0)]
    left = "slay u.name, o.total no-cap users lowkey u left-link-up orders lowkey o fr-fr u.id = o.user_id plus o.total > 30 hits-different u.id"
    assert rows(users, left) == [("Ada", 50.0), ("Grace", None), ("Linus", None)]
    with pytest.raises(EvalError, match="Ambiguous"):
        users.sql("slay id no-cap users lowkey u link-up orders lowkey o fr-fr u.id = o.user_id")


def test_persistence_and_transactions(users, spark):
    users.begin()
    users.execute("ratio users")
    users.rollback()
    assert rows(users, "slay headcount(*) no-cap users") == [(3,)]
    users.begin()
    users.execute("ratio users only-if id = 3")
    users.commit()
    assert rows(Engine(spark, str(users.catalog.root)), "slay headcount(*) no-cap users") == [(2,)]


def test_values(engine):
    engine.execute("manifest t (id INTEGER, a INTEGER, x TEXT); yeet-into t drip (1, ghosted, 'p'), (2, 5, ''), (3, 0, ghosted)")
    one = "slay {} lowkey v no-cap t only-if id = 2"
    for text, value in (("7 / 2", 3), ("a / 0", None), ("7 / 2.0", 3.5), ("x = 1", False), ("x != 1", True), ("a < x", True), ("a || 1.5 || ghosted", "51.5NULL"), ("-a", -5), ("250.0 || ''", "250")):
        assert rows(engine, one.format(text)) == [(value,)], text
    assert rows(engine, "slay id no-cap t only-if no-cap-not (a = ghosted) hits-different id") == [(1,), (2,), (3,)]
    assert rows(engine, "slay id no-cap t only-if no-cap-not a = 5 hits-different id") == [(1,), (3,)]
    assert rows(engine, "slay id no-cap t only-if x hits-different id") == [(1,)]
    assert rows(engine, "slay id no-cap t hits-different a, id") == [(1,), (3,), (2,)]
    assert rows(engine, "slay id no-cap t hits-different id cap-at 1 + 1 skip 1") == [(2,), (3,)]
    assert rows(engine, "slay id no-cap t cap-at id") == []
    assert sorted(rows(engine, "slay id no-cap t bussin-only id > 99")) == [(1,), (2,), (3,)]
    with pytest.raises(EvalError):
        engine.sql("slay x + 1 no-cap t")
    with pytest.raises(EvalError, match="Unsupported function"):
        engine.sql("slay upper(x) no-cap t")


def test_aggregates(engine):
    engine.execute("manifest s (id INTEGER, c TEXT, v REAL, n INTEGER)")
    data = [(i, "wolf", 0.0, i) for i in range(10)] + [(10, "wolf", 100.0, None)] + [(20 + i, "pack", float(i), i) for i in range(1, 6)]
    engine.execute("yeet-into s drip " + ",".join(f"({i},'{c}',{v},{'ghosted' if n is None else n})" for i, c, v, n in data))
    assert rows(engine, "slay LONE-WOLF(v) no-cap s only-if c = 'wolf'") == [(1,)]
    assert sorted(rows(engine, "slay c, lone-wolf(v) no-cap s vibe-check c")) == [("pack", 0), ("wolf", 1)]
    assert sorted(rows(engine, "slay c, mid-fr(v), percent-check(n, 75), percent-check(v, 0), headcount(n), headcount(unique-fr v), stack(n), goat(v), L(v), mid(v) no-cap s vibe-check c")) == [("pack", 3.0, 4, 1.0, 5, 5, 15, 5.0, 1.0, 3.0), ("wolf", 0.0, 7, 0.0, 10, 2, 45, 100.0, 0.0, pytest.approx(100 / 11))]
    assert rows(engine, "slay mid-fr(c) no-cap s") == [("wolf",)]
    assert rows(engine, "slay biggest-W(v) no-cap s") == [(10, "wolf", 100.0, None)]
    assert rows(engine, "slay biggest-L(n) no-cap s") == [(10, "wolf", 100.0, None)]
    assert rows(engine, "slay headcount(*), stack(v), mid-fr(v), LONE-WOLF(v) no-cap s only-if id = 99") in ([(0, None, None, 0)], [(0, None, None, None)])
    assert rows(engine, "slay stack(v) / headcount(*) lowkey m, n no-cap s vibe-check c hits-different m cap-at 1") == [(3.0, 1)]


def test_rank_and_distinct(engine):
    engine.execute("manifest p (id INTEGER, g TEXT, v INTEGER); yeet-into p drip (1,'a',5),(2,'a',5),(3,'a',1),(4,ghosted,9),(5,ghosted,ghosted)")
    assert rows(engine, "slay id, era split-by g hits-different v down-bad lowkey r no-cap p hits-different id") == [(1, 1), (2, 1), (3, 3), (4, 1), (5, 2)]
    assert rows(engine, "slay unique-fr g, v no-cap p hits-different g, v") == [(None, None), (None, 9), ("a", 1), ("a", 5)]
    with pytest.raises(EvalError):
        engine.sql("slay g, era hits-different v lowkey r, headcount(*) no-cap p vibe-check g")


def test_snapshot(engine):
    engine.execute("manifest clicks (id INTEGER main-character, user_id INTEGER, age INTEGER, country TEXT, clicked INTEGER, ts TEXT); yeet-into clicks drip (1,101,20,'DE',1,'a'),(2,101,21,'DE',0,'b'),(3,202,30,'FR',1,'c'),(4,303,40,'FR',0,'d')")
    got = dict(rows(engine, "manifest-snapshot s lowkey slay age, country, clicked no-cap clicks split-by user_id with-seed 42 features (age NORMALIZE, country) label clicked"))
    assert (got["rows"], got["train_rows"], got["features"], got["label"]) == ("4", "4", "age,country", "clicked")
    got = dict(rows(engine, "ship-torch s batch-size 3 shuffle"))
    assert (got["samples"], got["batches"], got["shuffle"]) == ("4", "2", "deterministic")
    got = dict(rows(engine, "spill-batch s batch-size 4 batch 0"))
    assert got["label_distribution"] == "0=2,1=2" and got["samples"] == "4" and got["resume_token"] == "s:epoch=0:batch=0:rank=0"
    ranks = [dict(rows(engine, f"spill-batch s batch-size 9 rank {r} world-size 2"))["source_rows"].split(",") for r in (0, 1)]
    assert sorted(sum(ranks, [])) == sorted(r[0] for r in engine.snapshots.members("s").select("rowid").collect())
    from ctxspark.operators.snapshot import BatchReader

    batches = list(BatchReader(engine, "s", batch_size=3))
    assert [len(b["country"]) for b in batches] == [3, 1] and len(BatchReader(engine, "s", batch_size=3)) == 2
    with pytest.raises(CatalogError):
        engine.execute("manifest-snapshot s lowkey slay * no-cap clicks")


def test_leakage_warning_and_filter(engine):
    engine.execute("manifest leak (id INTEGER main-character, user_id INTEGER, age INTEGER, clicked INTEGER); yeet-into leak drip " + ",".join(f"({i},7,{20 + i},{i % 2})" for i in range(40)))
    got = dict(rows(engine, "manifest-snapshot l lowkey slay age, clicked no-cap leak only-if id >= 0 split-by row with-seed 42"))
    assert "user_id '7'" in got["warning"] and got["rows"] == "40"
    got = dict(rows(engine, "manifest-snapshot m lowkey slay age, clicked no-cap leak only-if age < 30"))
    assert got["rows"] == "10"


def test_external_tables(engine):
    engine.register("nation", "/root/testdata/sf0.001/nation.parquet")
    assert rows(engine, "slay headcount(*) no-cap nation") == [(25,)]
    with pytest.raises(CatalogError, match="read-only"):
        engine.execute("ratio nation")
