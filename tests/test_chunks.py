"""The chunk index: the cap, recall of the cells against the flat scan, and a refresh that equals a rebuild."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks as C


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(2)) for _ in range(n))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    themes = [[say(rng, 1) for _ in range(40)] for _ in range(30)]
    rows = [(i, " ".join(rng.choice(themes[i % 30]) for _ in range(40))) for i in range(1500)] + [(5000 + i, "same words here") for i in range(700)] + [(9000, ""), (9001, None)]
    return C.embed(spark.createDataFrame(rows, "id long, content string").repartition(4)).cache()


def flat(vectors, queries, k):
    x = {r.id: np.array(r.vector, float) for r in vectors.collect()}
    out = {}
    for q in queries.collect():
        v = np.array(q.vector, float)
        cos = lambda y: y @ v / np.sqrt((y @ y) * (v @ v)) if (y @ y) * (v @ v) else 0.0
        out[q["query"]] = sorted(((-cos(y), i) for i, y in x.items()))[:k]
    return out


def test_search(spark, vectors):
    queries = vectors.where("id % 50 = 0 or id in (5001, 9000)").select(F.col("id").alias("query"), "vector")
    centroids = C.train(vectors, cells=30)
    placed = C.place(vectors, centroids).cache()
    want = flat(vectors, queries, 10)
    block, C.BLOCK, asked, C.QUERIES = C.BLOCK, 64, C.QUERIES, 8
    try:
        exact = C.search(placed, centroids, queries, k=10, probes=2, exact=True).collect()
        near = C.search(placed, centroids, queries, k=10, probes=8).collect()
    finally:
        C.BLOCK, C.QUERIES = block, asked
    got = {}
    for r in sorted(exact, key=lambda r: r.place):
        got.setdefault(r["query"], []).append((-r.similarity, r.id))
    assert {q: [i for _, i in hits] for q, hits in got.items()} == {q: [i for _, i in hits] for q, hits in want.items()}
    found = {(r["query"], r.id) for r in near}
    least = {q: hits[-1][0] for q, hits in want.items()}
    good = sum(-r.similarity <= least[r["query"]] + 1e-12 for r in near)
    assert good / sum(map(len, want.values())) >= 0.95 and len(found) == len(near)


def test_search_of_nothing(spark, vectors):
    none = vectors.where("false")
    centroids = C.train(none, cells=4)
    assert C.search(C.place(none, centroids), centroids, vectors.limit(2).select(F.col("id").alias("query"), "vector"), 3, 2, True).count() == 0


def slots(counts, budget):
    """Slots by the rule: seats for the largest, else one each, shares rounded down, and what is left in rounds."""
    if budget <= len(counts):
        return {n: 1 for n in sorted(counts, key=lambda n: (-counts[n], n))[:budget]}
    total, shared = sum(counts.values()), budget - len(counts)
    got = {n: min(c, 1 + int(c / total * shared)) for n, c in counts.items()}
    free = budget - sum(got.values())
    while free and (hungry := sorted((n for n in got if got[n] < counts[n]), key=lambda n: (-counts[n], n))):
        for n in hungry[:free]:
            got[n] += 1
            free -= 1
    return got


def test_cut_and_cap(spark):
    rng = random.Random(1)
    texts = {f"f{i}": "\n".join(say(rng, rng.randint(0, 9)) if rng.random() < 0.8 else " " for _ in range(rng.randint(0, 40))) for i in range(25)} | {"long": "x" * 4500 + "\n\ny", "null": None}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    want = {}
    for path, text in texts.items():
        lines = [(k + 1, line[a : a + 2000]) for k, line in enumerate((text or "").split("\n")) if line.strip(" ") for a in range(0, len(line), 2000)]
        want[path] = lines
    got = {}
    for r in sorted(C.cut(files).collect(), key=lambda r: r.place):
        got.setdefault(r.path, []).append((r["first"], r.content))
    assert got == {p: c for p, c in want.items() if c}
    for most in (10, 25, 60, 200, 5000):
        kept = {}
        for r in sorted(C.capped(C.cut(files), most).collect(), key=lambda r: r.place):
            kept.setdefault(r.path, []).append((r["first"], r.content))
        given = slots({p: len(c) for p, c in got.items()}, most)
        assert kept == {p: got[p][:n] for p, n in given.items()}


def test_refresh_equals_rebuild(spark):
    rng = random.Random(2)
    old = {f"f{i:02}": "\n".join(say(rng, 6) for _ in range(rng.randint(1, 6))) for i in range(30)}
    new = {p: t + "\nmore" if i % 4 == 0 else "" if i == 7 else t for i, (p, t) in enumerate(old.items()) if i % 9}
    table = lambda texts: spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("hash", F.sha2("text", 256))
    rows = lambda df: sorted((r.path, r.place, r["first"], r.content, tuple(r.vector)) for r in df.collect())
    files, chunks = table(old).select("path", "hash"), C.embed(C.cut(table(old)))
    changed = sorted(p for p in new if new[p] != old[p])
    hashes, after, embedded = C.refresh(files, chunks, table(new), most=10_000)
    assert rows(after) == rows(C.embed(C.cut(table(new))))
    assert rows(embedded) == rows(C.embed(C.cut(table({p: new[p] for p in changed}))))
    assert sorted(map(tuple, hashes.collect())) == sorted(map(tuple, table(new).select("path", "hash").collect()))
    rounds = 0
    while True:  # a small budget gets there in several calls
        files, chunks, embedded = C.refresh(files, chunks, table(new), most=4)
        made = embedded.groupBy("path").count().collect()
        if not made:
            break
        assert sum(r["count"] for r in made) - max(r["count"] for r in made) < 4 and {r.path for r in made} <= set(changed)
        rounds += 1
    assert rounds > 2 and rows(chunks) == rows(after)


def test_search_compares_the_first_copies_only(spark, monkeypatch):
    from tessera.operators import chunks as C

    monkeypatch.setattr(C, "AT_ONCE", 2)
    seen, compared = [], C._compared
    monkeypatch.setattr(C, "_compared", lambda vectors, *rest: seen.append(vectors.count()) or compared(vectors, *rest))
    texts = ["alpha beta"] * 40 + ["alpha beta gamma", "gamma", "", "delta alpha"]
    vectors = C.embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")).select("id", "vector")
    queries = C.embed(spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "gamma", "", "alpha", "delta"])], "query long, content string"))
    centroids = C.train(vectors, 2)
    rows = C.search(C.place(vectors, centroids), centroids, queries, k=3, probes=1, exact=True).collect()
    x, q = [[C.hashed(t).astype(float) for t in ts] for ts in (texts, ["alpha beta", "gamma", "", "alpha", "delta"])]
    for i, v in enumerate(q):
        cos = [float(v @ w / ((v @ v) * (w @ w)) ** 0.5) if (v @ v) * (w @ w) else 0.0 for w in x]
        want = sorted(range(len(x)), key=lambda j: (-cos[j], j))[:3]
        assert [r.id for r in sorted((r for r in rows if r.query == i), key=lambda r: r.place)] == want
    assert seen and max(seen) == 7


def test_the_nearest_chunks_are_found_where_texts_lie(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 7)
    texts = ["lose the thing\n\n   \nthe other ring", "\tthe ring\r\n_the_ Ring", "é thing " * 700 + "\nring", None, "", "lose the thing\nlose the thing", "-- ..\nnothing here", *(f"line {i}\nthe thing {i}" for i in range(40))]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)] + [(None, "the thing"), (None, "the thing")], "path string, text string")
    asked = "lose the thing and the other ring"
    want = C.similar(C.embed(C.cut(files.where("path is not null"))), asked).select("path", "place", "similarity")
    best = C.nearest(files.where("path is not null"), asked, 25)
    order = [F.col("similarity").desc(), F.col("path"), F.col("place")]
    assert best.orderBy(*order).collect() == want.orderBy(*order).limit(25).collect()
    assert C.nearest(files.where("path is not null"), asked, 1000).count() == want.count() > 90
    assert sum(r.path is None for r in C.nearest(files, asked, 1000).collect()) == 2
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # no text is shuffled


def test_a_query_is_sent_once_a_group_of_cells(spark, vectors, monkeypatch):
    sent, compared = [], C._compared
    monkeypatch.setattr(C, "_compared", lambda vectors, visits, *rest: sent.append(visits.count()) or compared(vectors, visits, *rest))
    some = vectors.where("id % 50 = 0").select(F.col("id").alias("query"), "vector")
    queries = some.union(some.selectExpr("query + 100000", "vector"))  # each is asked twice
    centroids = C.train(vectors, cells=60)
    got = C.search(C.place(vectors, centroids), centroids, queries, k=5, probes=2, exact=True).collect()
    want = flat(vectors, queries, 5)
    assert {(r["query"], r.place): r.id for r in got} == {(q, n): i for q, hits in want.items() for n, (_, i) in enumerate(hits, 1)}
    assert len(sent) == 2 and max(sent) <= queries.select("vector").distinct().count()  # all cells here are one group


def test_the_best_of_a_group_are_found_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    x, q = rng.integers(-2, 3, (400, C.DIMS)).astype(np.int32), rng.integers(-2, 3, (30, C.DIMS)).astype(np.int32)
    x[::7], x[3::50], q[5] = x[0], 0, 0  # ties and zero vectors
    q[9] = 3 * x[0]
    centres = C._units(rng.normal(size=(4, C.DIMS)))
    cell = (C._units(x) @ centres.T).argmax(1)
    angle = np.arccos((C._units(x) * centres[cell]).sum(1))
    cells = C._Cells(np.array([2, 5, 6, 9]), centres, np.array([angle[cell == c].max() for c in range(4)]), np.zeros(4, int), np.ones(4, int))
    one = pa.table({"id": np.arange(400) * 3, "vector": pa.array(list(x)), "cell": cells.number[cell], "angle": angle})
    norm = np.sqrt((q.astype(float) ** 2).sum(1)[:, None] * (x.astype(float) ** 2).sum(1))
    cos = np.where(norm > 0, q @ x.T / np.where(norm > 0, norm, 1), 0.0)
    want = {i: sorted(range(400), key=lambda j: (-cos[i, j], j))[:3] for i in range(30)}
    monkeypatch.setattr(C, "AT_ONCE", 4)
    for numbers in (40, 1 << 20):
        monkeypatch.setattr(C, "NUMBERS", numbers)
        for least in (np.full(30, -2.0), np.array([cos[i, want[i][2]] for i in range(30)])):
            two = pa.table({"query": np.arange(30), "vector": pa.array(list(q)), "least": least, "reach": np.full(30, np.pi)})
            got = {}
            for i, j, s in sorted(zip(*(C._matched(one, two, cells, 3)[c].to_pylist() for c in ("query", "id", "similarity"))), key=lambda r: (r[0], -r[2], r[1])):
                got.setdefault(i, []).append(j // 3)
            assert got == want
