"""Importers, stores, symbols, regions, gates against plain Python."""

import random

from pyspark.sql import functions as F


def test_scopes_with_corrupt_lines(spark, tmp_path):
    from tessera.sources.stores import read_scopes, write_scopes

    path = f"{tmp_path}/facts"
    facts = spark.createDataFrame([(1, "a", "global"), (2, None, "project")], "fact_id long, body string, scope string")
    write_scopes(facts, path)
    write_scopes(facts.where("scope = 'project'").withColumn("body", F.lit("new")), path)
    (tmp_path / "facts" / "scope=global" / "x.json").write_text('{"fact_id": 7, "body": "b"}\n{"fact_id": \n')
    good, bad = read_scopes(spark, path, "fact_id long, body string, scope string")
    assert sorted((r.fact_id, r.body, r.scope) for r in good.collect()) == [(1, "a", "global"), (2, "new", "project"), (7, "b", "global")]
    assert [r.line for r in bad.collect()] == ['{"fact_id": ']


def test_sources_fail_alone(spark):
    from tessera.sources.stores import union_sources

    def broken():
        raise OSError("gone")

    rows, errors = union_sources(("a", lambda: spark.range(2)), ("b", broken), ("c", lambda: spark.read.parquet("/no/such/table")), ("d", lambda: spark.range(1).withColumn("x", F.lit("y"))))
    assert sorted((r.id, r.source_name, r.x) for r in rows.collect()) == [(0, "a", None), (0, "d", "y"), (1, "a", None)]
    assert set(errors) == {"b", "c"} and errors["b"] == "gone"


def test_rules_are_ingested_once(spark):
    from tessera.sources.stores import ingest_rules

    files = spark.createDataFrame([("r1", "## a\nbody\n## b\n \n"), ("r2", "## c\nx"), ("r3", None)], "path string, text string")
    facts = spark.createDataFrame([(1, "r1", "constraint", True), (2, "r1", "pattern", True), (3, "r2", "constraint", True), (4, "r1", "constraint", False)], "fact_id long, source_file string, kind string, is_valid boolean")
    none = spark.createDataFrame([], "path string, checksum string")
    new, old, sums = ingest_rules(files, none, facts)
    assert sorted((r.source_file, r.subject, r.body) for r in new.collect()) == [("r1", "a", "body"), ("r2", "c", "x")]
    assert sorted(r.fact_id for r in old.collect()) == [1, 3] and sums.count() == 3
    new, old, _ = ingest_rules(files.withColumn("text", F.when(F.col("path") == "r2", "## c\ny").otherwise(F.col("text"))), sums, facts)
    assert [(r.subject, r.body) for r in new.collect()] == [("c", "y")] and [r.fact_id for r in old.collect()] == [3]


def test_entry_store_and_times(spark, tmp_path):
    from tessera.sources.stores import EntryStore, modified_since

    store = EntryStore(spark, f"file://{tmp_path}/store")
    assert store.load("a/b", "id long").count() == 0
    store.save("a/b", spark.range(3))
    store.save("a/b", store.load("a/b", "id long").where("id > 0"))
    assert sorted(r.id for r in store.load("a/b", "id long").collect()) == [1, 2]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("hi\n")
    assert modified_since(spark, f"{tmp_path}/t", "2001-01-01T00:00:00").count() == 1
    assert modified_since(spark, f"{tmp_path}/t", "2999-01-01T00:00:00").count() == 0


def test_symbols(spark):
    from tessera.operators.code import python_symbols

    text = '''
class A:
    """doc"""
    async def f(self):
        "doc"
        ...
    def g(self):
        raise NotImplementedError("x")
if True:
    def h():
        for i in x:
            while i:
                def inner():
                    with a: pass
                    return 2
        return 1
def only_doc():
    "doc"
def p(): pass
'''
    rows = spark.createDataFrame([("a.py", text), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    got = {(r.path, r.name): (r.kind, r.depth, r.stub) for r in python_symbols(rows).collect()}
    assert got == {
        ("a.py", "A"): ("class", 0, None), ("a.py", "A.f"): ("function", 0, "ellipsis"), ("a.py", "A.g"): ("function", 0, "not implemented"), ("a.py", "h"): ("function", 2, None),
        ("a.py", "only_doc"): ("function", 0, None), ("a.py", "p"): ("function", 0, "pass"), ("b.py", None): ("unreadable", None, None), ("a.py", "h.inner"): ("function", 1, None),
    }


def test_regions():
    from tessera.operators.code import regions

    rng = random.Random(3)
    lines = [f"the line {i} " + "x" * rng.randint(0, 30) for i in range(900)]
    lines[700] += " special_function"
    lines[705] += " special"
    lines[100] += " special"
    text = "\n".join(lines)
    got = regions(text, ["the", "special_function", "special"], 4_000)
    assert got[0][0] <= 701 <= got[0][1] and sum(len("\n".join(lines[a - 1 : b])) for a, b in got) <= 8_000
    assert regions(text, ["nowhere"], 4_000) == [(1, 200)]
    assert regions("a\nb", ["a"], 4_000) == [(1, 2)] and regions("", ["a"]) == [(1, 0)]
    assert all(b - a < 200 for a, b in regions(text, ["line 1", "line 2"], 20_000)) and len(text) > 20_000


def test_gates(spark):
    from tessera.operators.code import gates

    m = spark.createDataFrame([("a", 0.5), ("b", float("nan")), ("c", None)], "metric string, value double")
    limits = spark.createDataFrame([("a", 0.4, 0.6), ("a2", None, 1.0), ("b", None, 1.0), ("c", 0.0, None)], "metric string, at_least double, at_most double")
    assert {r.metric: r.passed for r in gates(m, limits).collect()} == {"a": True, "a2": False, "b": False, "c": False}


def test_consolidation_observations_and_batch_change(spark):
    from tessera.operators.clusters import consolidate, due
    from tessera.operators.memory import batch_change, observations

    assert [due(29, 0), due(30, 0), due(39, 30), due(40, 30)] == [False, True, False, True]
    rows = [(i, 0.1 * (i % 9), [1.0, 0.0] if i < 4 else [0.0, 1.0] if i < 6 else [-1.0, 0.1 * i], i, 1, 1.0, 2.0, [str(i % 2)]) for i in range(12)]
    table = spark.createDataFrame(rows, "k long, confidence double, v array<double>, success_count int, access_count int, created_at double, last_accessed double, tags array<string>")
    got = {r.cluster: r.members for r in consolidate(table, "k", "v").collect()}
    assert got[0] == 4 and got[4] == 2 and sum(got.values()) == 12
    assert consolidate(table.where("k < 5"), "k", "v").count() == 5
    facts = spark.createDataFrame([(1, True), (2, False)], "fact_id long, is_valid boolean")
    assert [(r.fact_id, r.authority) for r in observations(facts, spark.createDataFrame([(1,), (2,), (3,)], "fact_id long")).collect()] == [(1, "observation_only")]
    names = "project string, ts double, god_files int, cycles int, depth int, covered boolean, files int"
    sessions = spark.createDataFrame([("a", 1.0, None, None, None, None, None), ("a", 2.0, 1, 2, 3, True, 5), ("a", 3.0, 9, 9, 9, True, 5), ("b", 1.0, 1, 1, 1, True, 0)], names)
    now = spark.createDataFrame([("a", 0.0, 2, 2, 1, False, 4), ("b", 0.0, 1, 1, 1, True, 4), ("c", 0.0, 1, 1, 1, True, 4)], names).drop("ts")
    assert [tuple(r) for r in batch_change(sessions, now).collect()] == [("a", 1, 0, -2, False)]


def test_runs_are_identical(spark):
    """The benchmark of scenarios runs twice and must give the same rows."""
    import os

    import pytest
    from tessera import catalog

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the test tables are not here")
    for name in ("validation_gates", "loop_decision", "hypothesis_states"):
        a, b = (sorted(map(str, catalog.QUERIES[name](spark, data).collect())) for _ in range(2))
        assert a == b


def test_dataset_import_orders_no_texts_in_one_task(spark):
    from tessera.sources import stores as S

    rows = spark.createDataFrame([(k, f"p{k % 7}", f"s{k % 3}", f"c{-k}") for k in range(1, 41)] + [(None, "p0", "s9", "c")], "k long, p string, s string, context string")
    none = spark.createDataFrame([], "hash string")
    mapping = {"pattern": "p", "suggestion": "s", "context": "context"}
    whole = S.import_dataset(rows, mapping, none, "k", 1 << 30)
    plan = whole._jdf.queryExecution().toString()
    assert "GlobalLimit" not in plan and "TakeOrdered" not in plan
    assert {(r.k, r.pattern, r.suggestion, r.context) for r in whole.where("k is not null").collect()} == {(k, f"p{k % 7}", f"s{k % 3}", f"c{-k}") for k in range(1, 22)}
    some = S.import_dataset(rows, mapping, whole.where("k = 2").select("hash"), "k", 5).collect()
    assert {r.k for r in some} == {None, 1, 3, 4}
