"""Overlaps, entries and pattern stores against plain Python."""

from pyspark.sql import functions as F


def test_overlaps_of_empty_and_signed_lines(spark):
    from tessera.functions import diffs as D

    rows = [("+a\n-b\n c", "+a\n+b\n c", "a\nb"), ("", "", ""), (None, "+a", None), ("--- x\n+++ y\n@@ 1 @@", " a", "z"), ("  +a ", "+a", " a \n\n")]
    got = spark.createDataFrame(rows, "s string, a string, c string").select(D.diff_overlap(F.col("s"), F.col("a")).alias("d"), D.code_overlap(F.col("c"), F.col("a")).alias("c"), D.verdict(F.col("s"), F.col("c"), F.col("a")).alias("v")).collect()
    assert [(round(r.d, 6), r.c, r.v) for r in got] == [(round(1 / 3, 6), 1.0, "accepted"), (1.0, 1.0, "accepted"), (0.0, 0.0, "modified"), (1.0, 0.0, "accepted"), (1.0, 1.0, "accepted")]


def test_pattern_store_folds_in_order(spark):
    from tessera.operators.patterns import applicable, entry_counts, pattern_store

    rows = [
        (2, "a", ["x", "y"], "rule", "m", 0.4, "e2"), (1, "a", ["p", "q"], "rule", "m", 0.8, "e1"), (3, "a", ["x", "z"], "rule", "m", 0.2, "e3"), (4, "a", [], "rule", "m", 0.9, "e4"),
        (5, "b", ["x"], " ** ", "m", 0.9, "e5"), (6, "b", ["x"], "rule", None, 0.9, "e6"), (7, "b", ["only"], "rule", "m", 0.5, "e7"),
    ]
    store = pattern_store(spark.createDataFrame(rows, "ordinal int, category string, keywords array<string>, rule string, mistake string, confidence double, example string"))
    got = {(r.category, r.size): (r.keywords, round(r.confidence, 6), r.examples) for r in store.collect()}
    assert got == {("a", 2): (["p", "q"], 0.4, ["e1", "e2", "e3"]), ("b", 1): (["only"], 0.5, ["e7"])}
    texts = spark.createDataFrame([(1, "Q and ONLY"), (2, "nothing"), (3, None)], "i int, t string")
    assert sorted((r.i, r.category, r.hits) for r in applicable(texts, F.col("t"), store).collect()) == [(1, "a", 1), (1, "b", 1)]
    assert applicable(texts, F.col("t"), store.where("false")).count() == 0
    kb = spark.createDataFrame([("score", "p"), ("score", "q"), ("pattern", None)], "entry_type string, project string")
    assert {r.entry_type: (r.entries, r.projects) for r in entry_counts(kb).collect()} == {"score": (2, 2), "pattern": (1, 0)}


def test_effectiveness_entries(spark):
    from tessera.functions.prompts import FLAGS
    from tessera.operators.patterns import analysis, effectiveness_entries

    flag = lambda *on: [f in on for f in FLAGS]
    rows = [(1, "a", 0.4, 1, *flag("commit_made")), (2, "a", 0.8, 3, *flag("tests_passed", "claude_confused")), (3, "b", -0.5, 2, *flag("claude_confused"))]
    table = spark.createDataFrame(rows, "turn int, text string, score double, iterations int, " + ", ".join(f"{f} boolean" for f in FLAGS))
    got = sorted((round(r.score, 6), r.samples, r.confidence, r.signals, r.iterations) for r in effectiveness_entries(table, "turn").collect())
    assert got == [(-0.5, 1, 0.5, ["claude_confused"], 2), (0.6, 2, 0.6, ["claude_confused", "commit_made", "tests_passed"], 3)]
    assert [(r.signal, r.prompts) for r in analysis(table).collect()] == [("claude_confused", 2)]
