"""Unit tests of operators on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F


def test_components(spark):
    from tessera.operators.graph import connected_components

    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_cycles(spark):
    from tessera.operators.cycles import cycle_groups

    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)]
    got = {r.node: r.component for r in cycle_groups(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def brute_cycles(edges):
    onward = {}
    for u, v in edges:
        onward.setdefault(u, set()).add(v)

    def reach(node):
        seen, todo = set(), [node]
        while todo:
            new = onward.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    closure = {n: reach(n) for n in onward}
    groups = {n: {m for m in closure[n] if n in closure.get(m, ())} for n in closure}
    return {n: min(g | {n}) for n, g in groups.items() if len(g | {n}) > 1}


def test_cycles_of_nodes_with_one_way_in(spark, monkeypatch):
    from tessera.operators import cycles

    def whole(*_):
        raise AssertionError("loops of single ways in need no components")

    monkeypatch.setattr(cycles, "connected_components", whole)
    rng = random.Random(8)
    path = [(i, i + 1) for i in range(1, 300)] + [(900, 1)]  # hangs on nothing but a node without a way in
    loop = [(400 + i, 400 + (i + 1) % 37) for i in range(37)] + [(411, 500), (500, 501), (501, 502), (421, 503)]
    pair = [(601, 600), (600, 601), (600, 602), (602, 602), (602, 603)]
    drawn = [(1000 + rng.randrange(150), 1000 + i) for i in range(400)]
    for edges in (path, path + loop + pair + loop, drawn, []):
        got = {r.node: r.component for r in cycles.cycle_groups(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == brute_cycles(edges)


@pytest.mark.parametrize("small", [0, 500_000])
def test_cycles_of_mixed_nodes(spark, monkeypatch, small):
    from tessera.operators import cycles

    monkeypatch.setattr(cycles, "SMALL", small)
    rng = random.Random(9)
    loop = [(i, (i + 1) % 11) for i in range(11)] + [(3, 40), (40, 41)]
    edges = loop + [(rng.randrange(50, 110), rng.randrange(50, 110)) for _ in range(70)] + [(41, 50), (None, 3)]
    rows = cycles.cycle_groups(spark.createDataFrame(edges, "src long, dst long")).collect()
    want = brute_cycles(edges[:-1])
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want) > 11


def test_chain(spark):
    from tessera.operators.chains import chain_ends

    links = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8)], "node long, next long")
    assert {r.node: (r.root, r.depth) for r in chain_ends(links).collect()} == {5: (1, 3), 4: (1, 2), 3: (1, 1), 9: (8, 1)}


def test_fair_shares_equal_rounds(spark):
    from tessera.operators.budget import fair_shares

    def rounds(sizes, budget):
        pending, out, rest = {k: v for k, v in sizes.items() if v > 0}, {}, budget
        while pending:
            share = rest // len(pending)
            done = {k: v for k, v in pending.items() if v <= share}
            if not done:
                return out | {k: share for k in pending}
            out |= done
            rest -= sum(done.values())
            pending = {k: v for k, v in pending.items() if k not in done}
        return out

    rng = random.Random(0)
    groups = {g: {k: rng.randint(0, 300) for k in range(rng.randint(1, 9))} for g in range(30)}
    rows = [(g, k, v) for g, s in groups.items() for k, v in s.items()]
    got = {}
    for r in fair_shares(spark.createDataFrame(rows, "g int, k int, size long"), "g", "size", 700, "k").collect():
        got.setdefault(r.g, {})[r.k] = r.share
    for g, sizes in groups.items():
        assert got.get(g, {}) == rounds(sizes, 700)


@pytest.mark.parametrize("budget", [2, 3, 10, 57, 1000])
def test_slots(spark, budget):
    from tessera.operators.budget import slots

    counts = {"a": 40, "b": 10, "c": 1, "z": 0}
    got = {r.name: r.slots for r in slots(spark.createDataFrame(list(counts.items()), "name string, n long"), "name", "n", budget).collect()}
    assert sum(got.values()) == min(budget, 51)
    assert all(0 <= s <= counts[n] for n, s in got.items())


def test_jaccard_pairs(spark):
    from tessera.operators.similarity import jaccard_pairs

    rng = random.Random(3)
    sets = {i: rng.sample(range(30), rng.randint(1, 12)) for i in range(60)}
    sets |= {100 + i: s + [99] for i, s in list(sets.items())[:20]}
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    got = jaccard_pairs(spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, tokens array<string>"), 0.8)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_bm25_against_plain(spark):
    import math

    from tessera.functions.text import tokenize
    from tessera.operators.retrieval import bm25

    docs = {1: "The cat sat", 2: "the dog and the cat and the bird", 3: "", 4: "Ärger über Öl", 5: None}
    table = spark.createDataFrame(list(docs.items()), "id long, text string")
    query = ["the", "cat", "the", "öl"]
    toks = {i: (t or "").lower().split() for i, t in docs.items()}
    avg = sum(map(len, toks.values())) / len(toks)
    want = {}
    for i, t in toks.items():
        s = 0
        for q in query:
            df, tf = sum(q in x for x in toks.values()), t.count(q)
            if tf:
                s += math.log((len(toks) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s:
            want[i] = pytest.approx(s)
    assert {r.doc: r.score for r in bm25(table, "id", tokenize(F.col("text")), query).collect()} == want
    assert bm25(table, "id", tokenize(F.col("text")), []).count() == 0


def test_cosine_defaults(spark):
    from tessera.functions.scores import cosine

    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 0.0])]
    got = [r.c for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(cosine(F.col("a"), F.col("b"), 0.5).alias("c")).collect()]
    assert got == [1.0, 0.5, 0.5, 0.5]


def test_generalize(spark):
    from tessera.functions.text import generalize

    rows = [("Get user 123456 from a@b.co  at /var/log/app v1.2.3",), ('Log in and remove `x` "y"',)]
    got = [r.g for r in spark.createDataFrame(rows, "t string").select(generalize(F.col("t")).alias("g")).collect()]
    assert got == ["fetch user <n> from <email> at <path> <version>", "authenticate and delete <q> <q>"]


def test_ignore(spark):
    from tessera.operators.ignore import ignored

    rules = ["*.log", "!keep.log", "build/", "/top.txt", "a/**/z", "# x", ""]
    paths = {"x.log": True, "d/x.log": True, "keep.log": False, "build/a": True, "src/build/b": True, "top.txt": True, "d/top.txt": False, "a/z": True, "a/b/c/z": True, "ab/z": False}
    got = {r.p: r.i for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", ignored(F.col("p"), rules).alias("i")).collect()}
    assert got == paths


def test_complete_link(spark):
    from tessera.operators.clusters import complete_link

    rows = [("g", 1, [1.0, 0.0]), ("g", 2, [0.9, 0.1]), ("g", 3, [0.0, 1.0]), ("h", 4, [1.0, 0.0]), ("h", 5, None)]
    got = {r.k: r.cluster for r in complete_link(spark.createDataFrame(rows, "g string, k long, v array<double>"), "g", "k", "v", 0.9).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_redaction_and_truncation(spark):
    from tessera.functions.text import elide_middle, redact, truncate_marked

    row = spark.createDataFrame([("password = hunter2x", "token: 'abcdef99'", "a" * 100)], "a string, b string, c string").select(
        redact(F.col("a")).alias("a"), redact(F.col("b")).alias("b"), truncate_marked(F.col("c"), 50).alias("t"), elide_middle(F.col("c"), 50).alias("e")
    ).first()
    assert row.a == "password=[REDACTED]" and row.b == "token: 'abcdef99'"
    assert len(row.t) == len(row.e) == 50


def test_ranks_of_a_hot_group_over_many_tasks(spark):
    import random

    from pyspark.sql import functions as F

    from tessera.operators.ranking import ranked

    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), rng.randint(0, 40), i) for i in range(3000)] + [("single", 1, 9000)]
    table = spark.createDataFrame(rows, "g string, score int, id long").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.id: r.place for r in ranked(table, ["g"], [F.col("score").desc(), F.col("id")], "place").collect()}
        assert ranked(table.where("false"), ["g"], [F.col("id")], "place").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {}
    for g in {g for g, _, _ in rows}:
        for place, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[i] = place
    assert got == want


def test_tfidf_writes_a_row_for_each_document(spark, monkeypatch):
    import math
    from collections import Counter

    from tessera.operators import retrieval as R

    texts = [(1, "Red fox red fox jumps"), (2, "a red dog"), (2, "fox jumps"), (3, None), (4, ""), (5, "blue sky over the red fox"), (None, "red fox")]
    docs = spark.createDataFrame(texts, "id long, t string")
    sizes, materialize = [], R.materialize

    def counted(df, name, *rest):
        out = materialize(df, name, *rest)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(R, "materialize", counted)
    got = {r.id: r.score for r in R.tfidf_search(docs, "id", "t", "the red fox jumps", 10, 0.0, 6).collect()}
    assert max(sizes) <= len(texts)  # counts of a document stay in its row

    def terms(t):
        ws = [w for w in (t or "").lower().split() if len(w) > 1 and w not in R.STOP_WORDS]
        return Counter(ws + [f"{x} {y}" for x, y in zip(ws, ws[1:])])

    per, total = {}, Counter()
    for k, t in texts:
        per[k] = per.get(k, Counter()) + terms(t)
        total += terms(t)
    kept = sorted(total, key=lambda t: (-total[t], t))[:6]
    idf = {t: math.log((1 + len(texts)) / (1 + sum(t in c for c in per.values()))) + 1 for t in kept}
    vector = lambda c: {t: c[t] * idf[t] for t in kept if c[t]}
    q = vector(terms("the red fox jumps"))
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {k: round(sum(x * q.get(t, 0) for t, x in vector(c).items()) / (norm(vector(c)) * norm(q)), 6) for k, c in per.items() if k is not None and any(t in q for t in vector(c))}
    assert got == want
