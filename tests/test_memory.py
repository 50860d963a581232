"""The write side and the rules against plain Python."""

import random
import re

import numpy as np
import pytest


def test_redaction_and_abstraction(spark):
    from pyspark.sql import functions as F
    from tessera.functions import text as T

    texts = [
        "key sk-" + "a1" * 12 + " end", "sk-short", "xoxb-1234567890-ab x", "ghp_" + "Z9" * 12, "AKIA" + "ABCD" * 4, "AKIAABCD", "password = hunter2; x", "API-KEY:abc,def", "my_secret=12", "Secret: a b",
        "v1.2.3-rc.1+b2 and 10.0", "log in and post 123456 to /usr/lib/x.py", "Get 0123abcd9 or deadbeef", "`quoted` \"text\"  here\n x", "a.b@c.de sign in", "12345é 12345", "getter gets get_x GET",
        "3f2504e0-4f89-11d3-9a0c-0305e82cc301 done",
    ]
    secrets = [r"\bsk-[A-Za-z0-9_-]{20,}\b", r"\bAKIA[A-Z0-9]{16}\b", r"\bghp_[A-Za-z0-9]{20,}\b", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"]

    def redact(t):
        for p in secrets:
            t = re.sub(p, "[REDACTED]", t)
        return re.sub(r"(?i)\b(password|passwd|api[_-]?key|access[_-]?token|secret)\s*[:=]\s*([^\s,;]+)", r"\1=[REDACTED]", t)

    verbs = {w: k for k, ws in T.VERBS.items() for w in ws}

    def generalize(t):
        for p, m in (
            (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"), (r"(?:[A-Za-z]:)?(?:[\\/][\w.-]+){2,}", "<path>"),
            (r"\b[0-9a-f]{7,64}\b", "<hash>"), (r"\bv?\d+(?:\.\d+){1,3}(?:-[\w.+-]+)?\b", "<version>"), (r"\b\d{5,}\b", "<n>"), (r"(?i)\b(log in|sign in)\b", "authenticate"),
        ):
            t = re.sub(p, m, t)
        t = re.sub(r"\b[A-Za-z]+\b", lambda m: verbs.get(m[0].lower(), m[0]), t)
        return re.sub(r"\s+", " ", re.sub(r"`[^`]*`|\"[^\"]*\"", "<q>", t)).strip()

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.redact(F.col("t")).alias("r"), T.generalize(F.col("t")).alias("g")).collect()
    got = {r.i: (r.r, r.g) for r in rows}
    assert got == {i: (redact(t), generalize(t)) for i, t in enumerate(texts)}


def test_paths_times_and_gates(spark):
    from pyspark.sql import functions as F
    from tessera.functions import rules as R

    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert get(R.language_of(lit("src/a.b.PYI"))) == "python" and get(R.language_of(lit("src/.py"))) is None and get(R.language_of(lit("x/Makefile"))) is None
    assert [get(R.language_name(lit(x))) for x in ("C#", "golang", "Zig", None)] == ["c_sharp", "go", "zig", ""]
    assert [get(R.targets_tests(lit(x))) for x in ("Run pytest", "the inspector of latest spec", "inspector", "latest", None)] == [True, True, False, False, False]
    assert get(R.explicit_paths(lit("see ./src\\A.py, src/a.py and 0.42.0 e.g. /abs/x.TS"))) == ["src/a.py", "e.g", "abs/x.ts"]
    named = lambda p, *t: get(R.names_path(lit(p), F.array(*map(lit, t))))
    assert named("src/app/sub.py", "sub.py") and named("src/sub.py", "/home/me/src/sub.py") and not named("tests/test_sub.py", "sub.py") and not named("", "x")
    assert [get(R.since_seconds(lit(x))) for x in ("14d", " 1.5H", "90", "all", "0", "", None)] == [1209600, 5400, 90, None, None, None, None]
    with pytest.raises(Exception, match="invalid window"):
        get(R.since_seconds(lit("soon")))
    assert [get(R.epoch(lit(x))) for x in ("1700000000.5", "1970-01-01T00:01:00.5Z", "1970-01-01T01:00:00+01:00", "never", None)] == [1700000000.5, 60.5, 0, None, None]
    verifiable = lambda *a: get(R.is_verifiable(*map(lit, a)))
    assert verifiable("a.py", True, True, False, True) and verifiable("new.py", True, False, False, True) and not verifiable("x", True, False, True, True) and not verifiable("a.py", False, True, False, True)
    assert get(F.size(R.actionable(F.array(F.struct(lit("Info").alias("severity")), F.struct(lit("error").alias("severity")), F.struct(lit(None).cast("string").alias("severity"))), ["info"]))) == 2


def test_added_facts_in_order(spark):
    from tessera.operators.memory import added

    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = []
    for i in range(120):
        v = base[rng.integers(6)] + rng.normal(size=8) * 0.35
        kind, scope = rng.choice(["pattern", "failure", "episode"]), rng.choice(["project", "global"])
        rows.append((i, f"subject {rng.integers(100)}", str(kind), str(scope), float(rng.integers(1, 10) / 10), str(rng.choice(["structural", "observed", "inferred"])), float(rng.integers(20)), [float(x) for x in v], i % 9 > 0))
    names = "fact_id long, subject string, kind string, scope string, confidence double, provenance string, event_time double, embedding array<double>, is_valid boolean"
    table = spark.createDataFrame(rows, names)
    from pyspark.sql import functions as F

    got = {r.fact_id: r[1:] for r in added(table.where("fact_id < 50"), table.where("fact_id >= 50").withColumn("seq", F.col("fact_id")).drop("is_valid")).collect()}
    rank = {"structural": 2, "observed": 1, "inferred": 0}
    unit = {r[0]: np.array(r[7]) / np.linalg.norm(r[7]) for r in rows}
    live, heads, want = [], {}, {}
    for r in rows:
        f, subject, kind, scope, conf, prov, when, _, valid = r
        if f < 50 and not valid:
            continue
        key = (scope, subject) if kind != "episode" else None
        if f >= 50 and key in heads:
            want[f] = ("bumped", heads[key], None, conf)
            continue
        best = None
        if f >= 50 and key:
            near = [(o[2], rank[o[3]], unit[o[0]] @ unit[f], o) for o in live if o[1] == (scope, kind) and unit[o[0]] @ unit[f] > 0.85]
            best = min(near, key=lambda x: x[:3])[3] if near else None
            if best:
                live.remove(best)
                conf = max(conf, min(1.0, best[4] + 0.05))
            want[f] = ("added", None, best and best[0], conf)
        elif f >= 50:
            want[f] = ("added", None, None, conf)
        if key:
            heads.setdefault(key, f)
            if not any(o[0] == f for o in live):
                live.append((f, (scope, kind), when, prov, conf))
    assert {k: (a, t, s, round(c, 9)) for k, (a, t, s, c) in got.items()} == {k: (a, t, s, round(c, 9)) for k, (a, t, s, c) in want.items()}
    assert sum(w[0] == "bumped" for w in want.values()) > 3 and sum(w[2] is not None for w in want.values()) > 10


def test_invalidated(spark):
    from tessera.operators.memory import invalidated

    facts = spark.createDataFrame([(1, True, [], False, [1.0], "t"), (2, True, [1], False, [1.0], "t"), (3, False, [1], False, None, None), (4, True, [9], False, [2.0], "u")], "fact_id long, is_valid boolean, depends_on array<long>, needs_review boolean, embedding array<double>, body string")
    got = {r.fact_id: tuple(r[1:]) for r in invalidated(facts, facts.where("fact_id = 1").select("fact_id")).collect()}
    assert got == {1: (False, [], False, None, None), 2: (True, [1], True, [1.0], "t"), 3: (False, [1], False, None, None), 4: (True, [9], False, [2.0], "u")}


def test_band_pairs_in_blocks(spark):
    from tessera.operators import vectors

    rng = random.Random(2)
    rows = [(i, i % 2, [1.0, rng.random(), rng.random()]) for i in range(60)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = [(a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and 0.8 <= unit[a] @ unit[b] < 0.93]
    block, vectors.BLOCK = vectors.BLOCK, 8
    try:
        table = spark.createDataFrame(rows, "id long, grp int, vector array<double>")
        assert [(r.a, r.b) for r in vectors.band_pairs(table, 0.8, 0.93, 25).orderBy("a", "b").collect()] == want[:25]
        assert len(vectors.band_pairs(table, 0.8, 0.93, 10_000).collect()) == len(want) > 25
    finally:
        vectors.BLOCK = block


def test_test_paths(spark):
    from pyspark.sql import functions as F
    from tessera.functions.text import is_test_path

    yes = ["tests/a.py", "a/Spec/b.rb", "Foo.Tests/x.cs", "a/test_b.py", "b_test.go", "u_spec.rb", "a.test.ts", "b.spec.ts", "TestFoo.java", "FooTests.cs", "FooTest.cs", "a\\tests\\b.py"]
    no = ["testdata/a.py", "testing/x", "latest.py", "contest.txt", "tests", "inspector.py", "a/Testing.java", ""]
    rows = spark.createDataFrame([(p,) for p in yes + no], "p string").select("p", is_test_path(F.col("p")).alias("t")).collect()
    assert {r.p for r in rows if r.t} == set(yes)


def test_outcomes_of_a_hot_entry_are_folded_in_parts(spark):
    import random

    from tessera.operators.memory import recorded

    rng = random.Random(8)
    rows = [(7 if rng.random() < 0.9 else rng.randint(1, 5), rng.randint(0, 900), rng.random() < 0.52) for _ in range(4000)] + [(None, 1, True), (7, 3, None)]
    starts = {1: 0.0, 2: 1.0, 3: 0.35, 4: 1.7, 5: -0.4, 7: 0.5, 9: 0.2}
    entries = spark.createDataFrame(list(starts.items()), "entry_id long, confidence double")
    outcomes = spark.createDataFrame(rows, "entry_id long, at long, success boolean").repartition(4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.entry_id: (r.success_signals, r.failure_signals, round(r.confidence, 6)) for r in recorded(entries, outcomes).collect()}
        spread = outcomes.where("entry_id = 7").repartitionByRange("entry_id", "at", "success").selectExpr("spark_partition_id() as p").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {}
    for entry in {e for e, _, s in rows if e is not None and s is not None}:
        mine = sorted((at, s) for e, at, s in rows if e == entry and s is not None)
        x = starts[entry]
        for _, s in mine:
            x = min(1.0, max(0.0, x + (0.1 if s else -0.1)))
        want[entry] = (sum(s for _, s in mine), sum(not s for _, s in mine), round(x, 6))
    assert got == want and spread > 8
