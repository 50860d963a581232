"""Walk, index refresh, front door and ledgers against plain Python."""

import random

import pytest


def test_walk_and_text(spark, tmp_path):
    from pyspark.sql import functions as F
    from tessera.operators.index import text_of, walk

    for name, data in {"a.py": b"x", "sub/b.PY": b"yy", "sub/c.md": b"z", "node_modules/d.py": b"w", "big.py": b"q" * 500, "bin.py": b"a\0b", "bad.py": b"\xff\xfeok", ".py": b"n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = walk(spark, str(tmp_path), ["py"], ["node_modules/"], 400)
    got = [(r.path, r.size, r.t) for r in rows.withColumn("t", text_of(F.col("content"), 5)).collect()]
    assert [g[:2] for g in got] == [("a.py", 1), ("bad.py", 4), ("bin.py", 3), ("sub/b.PY", 2)]
    assert [g[2] for g in got] == ["x", "��ok", "", "yy"]


def test_refresh_states(spark):
    from tessera.operators.index import refresh

    stored = [("a", 1, 1, "ha"), ("b", 2, 1, "hb"), ("c", 3, 1, "hc"), ("d", 4, 1, "hd")]
    postings = [("a", "old", 1), ("b", "old", 1), ("c", "old", 1), ("d", "old", 1)]
    current = [("a", 1, 1, "ha", "oneTwo"), ("b", 2, 9, "hb", "x"), ("c", 5, 9, "hz", "new new"), ("e", 1, 1, "he", None)]
    f = spark.createDataFrame(stored, "path string, size long, mtime long, hash string")
    p = spark.createDataFrame(postings, "path string, term string, tf long")
    c = spark.createDataFrame(current, "path string, size long, mtime long, hash string, text string")
    files, terms, report = refresh(f, p, c, "v1", "v1")
    assert {r.state: (r.files, r["mode"]) for r in report.collect()} == {"unchanged": (1, "incremental"), "touched": (1, "incremental"), "changed": (1, "incremental"), "added": (1, "incremental"), "removed": (1, "incremental")}
    assert sorted((r.path, r.term, r.tf) for r in terms.collect()) == [("a", "old", 1), ("b", "old", 1), ("c", "c", 3), ("c", "new", 2), ("e", "e", 3)]
    assert sorted(r.path for r in files.collect()) == ["a", "b", "c", "e"]
    again = refresh(files, terms, c, "v1", "v1")[2].collect()
    assert [(r.state, r["mode"]) for r in again] == [("unchanged", "warm")]
    assert {(r.state, r["mode"]) for r in refresh(f, p, c, "v0", "v1")[2].collect()} == {("added", "rebuilt")}
    assert {(r.state, r["mode"]) for r in refresh(f.limit(0), p.limit(0), c, "", "v1")[2].collect()} == {("added", "cold")}


def test_front_door(spark):
    from tessera.operators.frontdoor import matches_any, place_of, select_files

    rows = [
        ("src/pay.py", 4000, "charge the invoice invoice total", False), ("src/ship.py", 3000, "parcel label", True), ("tests/test_pay.py", 900, "invoice invoice charge test", False),
        ("docs/pay.md", 500, "invoice guide", False), ("src/old/pay.py", 100, "invoice", False), ("vendor/x.py", 100, "invoice charge total", False), ("src/zip.py", 50, "nothing here", False), ("lib/deep/a/b/c.py", 70, "nothing", False),
    ]
    files = spark.createDataFrame(rows, "path string, size long, text string, recent boolean")
    history = spark.createDataFrame([("src/zip.py", 0.3), ("src/zip.py", 0.15)], "path string, boost double")
    got = place_of(select_files(files, "why is the invoice total in Src/ship.py charged twice after refund", 3, 6000, excludes=["vendor/"], boosts=[history])).orderBy("place").collect()
    assert [(r.path, r.pinned) for r in got][:2] == [("src/ship.py", True), ("src/pay.py", False)]
    assert {r.path: r.share for r in got}["src/ship.py"] == 3000 and sum(r.share for r in got) <= 6000
    assert "vendor/x.py" not in {r.path for r in got} and len(got) == 4
    rank = [r.path for r in got]
    assert "tests/test_pay.py" not in rank[:2] and rank.index("docs/pay.md") > 0
    inc = select_files(files, "invoice", 5, 10_000, includes=["src/*"], exts=["py"]).collect()
    assert {r.path for r in inc if r.pinned} == {"src/pay.py", "src/ship.py", "src/old/pay.py", "src/zip.py"} and not [r for r in inc if not r.pinned]
    hits = files.where(matches_any(files["path"], ["*/pay.*", "[!s]*md"])).select("path").collect()
    assert {r.path for r in hits} == {"src/pay.py", "docs/pay.md", "src/old/pay.py"}


def test_boosts(spark):
    from pyspark.sql import functions as F

    from tessera.operators import frontdoor as D

    hits = spark.createDataFrame([("a.py", 0.5), ("a.py", 0.9), ("tests/test_a.py", 1.0), ("b.py", -0.3)], "path string, similarity double")
    assert {r.path: round(r.boost, 6) for r in D.semantic_boost(hits, F.lit(True), 3.0).collect()} == {"a.py": 2.7, "tests/test_a.py": 1.2, "b.py": 0.0}
    assert {r.path: r.boost for r in D.semantic_boost(hits, F.lit(False)).collect()}["tests/test_a.py"] == 1.0
    facts = spark.createDataFrame([(["file:a.py", "x"],), (["file:a.py", "file:b.py"],), (None,), *[(["file:c.py"],)] * 9], "tags array<string>")
    assert {r.path: round(r.boost, 6) for r in D.history_boost(facts).collect()} == {"a.py": 0.3, "b.py": 0.15, "c.py": 0.5}
    code = [("u.py", "def decode_response(x):\n    return x\nclass Simulator:\n    pass\n"), ("v.ts", "import { q } from 'invoices'\nfunction go() { }"), ("w.py", "x = 1"), ("far.py", " " * 60_000 + "\ndef decode(): pass")]
    files = spark.createDataFrame(code, "path string, text string")
    got = {r.path: round(r.boost, 6) for r in D.symbol_boost(files, ["decode", "simulator_runs", "response", "sim", "invoice", "gone"]).collect()}
    assert got == {"u.py": 1.2, "v.ts": 0.8}  # "gone" holds "go"


def test_names_in_code_lift_a_file(spark):
    from tessera.operators.frontdoor import select_files

    rows = [(f"src/n{i}.py", 100, "refund refund", False) for i in range(6)] + [("src/z.py", 100, "refund\ndef charge_refund(): pass", False)]
    files = spark.createDataFrame(rows, "path string, size long, text string, recent boolean")
    got = select_files(files, "where does charge make a refund happen for them", 1, 1000).collect()
    assert [r.path for r in got] == ["src/z.py"]


def test_stratified_and_imports(spark):
    from tessera.operators.index import edges_of, import_edges, stratified

    rng = random.Random(1)
    rows = [("/".join(["d"] * rng.randint(0, 3) + [f"f{i}.{rng.choice(['py', 'go', 'zz'])}"]), f"h{rng.randint(0, 40)}") for i in range(80)]
    got = stratified(spark.createDataFrame(rows, "path string, hash string"), 12).collect()
    first = {}
    for p, h in sorted(rows):
        first.setdefault(h, p)
    assert len(got) == 12 and {r.path for r in got} <= set(first.values())
    for lang, ext in (("python", "py"), ("go", "go")):
        mine = sorted((p for p in first.values() if p.endswith("." + ext)), key=lambda p: (p.count("/"), p))
        chosen = [r.path for r in sorted(got, key=lambda r: r.place) if r.language == lang]
        assert chosen == mine[: len(chosen)]
    text = "import os, a.b as c\n  from x.y import (k, l as m)  # n\nfrom pkg import *\nimportant = 1\nimport me\nfrom . import z\n"
    edges = import_edges(spark.createDataFrame([("me", text), ("q", None)], "module string, text string"))
    want = {("me", "os"), ("me", "a.b"), ("me", "x.y"), ("me", "x.y.k"), ("me", "x.y.l"), ("me", "pkg")}
    assert {(r.source, r.target) for r in edges.collect()} - {("me", "."), ("me", "..z")} == want
    assert edges_of(edges, "os").count() == 1


def test_ledgers(spark):
    from pyspark.sql import functions as F
    from tessera.operators import ledger as L

    assert [r.path for r in L.project_roots(spark.createDataFrame([("/a/b",), ("/a/b/",), ("/a",), ("/a/c/d",), ("/ab",), ("",)], "path string")).collect()] == ["/a/b", "/a/c/d", "/ab"]
    log = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "session string, n int")
    kept = log.where("session = 's2'")
    assert sorted(r.session for r in L.rewritten(log, log.where("n < 3"), kept, "session").collect()) == ["s2", "s3"]
    c = spark.createDataFrame([(1, None, "s"), (2, 7, "t"), (3, 8, "u")], "candidate_id long, promoted_fact_id long, signature string")
    facts = spark.createDataFrame([(9, "s", True), (5, "s", True), (4, "t", False), (3, "", True)], "fact_id long, signature string, is_valid boolean")
    assert [(r.candidate_id, r.fact_id) for r in L.by_signature(c, facts).collect()] == [(1, 5)]
    linked = L.relinked(c, L.by_signature(c, facts), spark.createDataFrame([(7,)], "fact_id long"))
    assert {r.candidate_id: r.promoted_fact_id for r in linked.collect()} == {1: 5, 2: None, 3: 8}
    s = spark.createDataFrame([("x", 100.0, "docs/a", False), ("x", 100.0, "src/a", False), ("x", 100.0, "src/b", True), ("y", 100.0, "src/c", False), ("z", -2e6, "src/d", False)], "session string, ts double, path string, resolved boolean").withColumn("normalized", F.col("path"))
    assert [(r.session, r.waiting) for r in L.pending(s, spark.createDataFrame([("src/c",)], "path string"), 200.0).collect()] == [("x", 1)]
    assert [(r.session, r.path) for r in L.unverified(s).collect()] == [("x", "docs/a")]
    commits = spark.createDataFrame([(1.0, "a"), (5.0, "b"), (6.0, "b")], "ts double, path string")
    assert sorted(r.path for r in L.changed_since(commits, spark.createDataFrame([("w",), ("b",)], "path string"), 5.0).collect()) == ["b", "w"]
    one = spark.range(1).select(L.ordered_union(F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("c"))).alias("u"), L.unified_diff(F.lit("a\nb"), F.lit("a\nc")).alias("d"), L.unified_diff(F.lit(None).cast("string"), F.lit("")).alias("e")).first()
    assert one.u == ["b", "a", "c"] and one.d.split("\n")[-2:] == ["-b", "+c"] and one.e == ""
    pytest.importorskip("pandas")


def test_lines_without_imports_become_no_rows(spark):
    from tessera.operators.index import import_edges

    files = spark.createDataFrame([("m", "x = 1\n" * 50 + "import a, b.c as d  # why\nfrom e import (f, g)\nreimport = 2\n")], "module string, text string")
    edges = import_edges(files)
    assert "contains(" in edges._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.target for r in edges.collect()} == {"a", "b.c", "e", "e.f", "e.g"}


def test_terms_of_a_file_are_counted_in_its_task(spark):
    from tessera.operators import index as I

    texts = [(f"f{k}.py", 1, 1, f"h{k}", " ".join(f"w{j % 5}" for j in range(k % 9))) for k in range(600)] + [("f1.py", 1, 1, "h1", "w0 more")]
    schema = "path string, size long, mtime int, hash string, text string"
    empty = spark.createDataFrame([], schema)
    none = empty.selectExpr("path", "'' as term", "0L as tf")
    for some, rows in ((texts[:-1], 600), (texts, 601)):
        _, postings, _ = I.refresh(empty.drop("text"), none, spark.createDataFrame(some, schema), "", "v")
        if rows == 600:
            assert "HashAggregate" not in postings._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
        want = {}
        for path, _, _, _, text in some:
            for t in [path[:-3], "py"] * 3 + text.split():
                want[path, t] = want.get((path, t), 0) + 1
        got = postings.collect()
        assert {(r.path, r.term): r.tf for r in got} == want and len(got) == len(want)
