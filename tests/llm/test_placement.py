"""Ball k-means, the co-bucketed pair and sharding against brute-force versions and their contracts."""

import datetime
import hashlib
import os
import random
import zlib

import brute
import numpy as np
import pytest


def kmeans(rows, k, rounds, dims):
    """rows: [(vec_id, embedding)] -> sorted rows as the operator gives them, from the contract, in Python integers."""
    kept = []
    for v, e in rows:
        if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e):
            kept.append((v, [int(np.floor(64 * float(np.float32(x)))) for x in e]))
    digest = lambda v: hashlib.sha256(f"1:{'' if v is None else v}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: digest(r[0]))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min((far(x, c), i) for i, c in enumerate(centroids)) for _, x in kept]
    for _ in range(rounds):
        of = assign()
        for i in range(len(centroids)):
            mine = [x for (_, x), (_, c) in zip(kept, of, strict=True) if c == i]
            if mine:
                centroids[i] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    of = assign()
    inertia = {}
    for d, c in of:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((v, c, d, inertia[c], sum(inertia.values()), sha[c]) for (v, _), (d, c) in zip(kept, of, strict=True)), key=str)


def test_ball_kmeans(spark):
    from tessera.llm.ball_kmeans import cluster

    rng = random.Random(2)
    rows = []
    for i in range(300):
        centre = [float((-1) ** (i % 3)), i % 7 / 4, -(i % 5) / 3, 0.5]
        rows.append((i * 3 - 40, [c + rng.choice([0, 0.01, -0.02, rng.random()]) for c in centre]))
    rows += [(1000, rows[5][1]), (1000, rows[6][1]), (None, rows[7][1]), (1001, None), (1002, [1.0, None, 2.0, 3.0]), (1003, [1.0, float("nan"), 0.0, 0.0]), (1004, [1.0]), (1005, []), (1006, [float("inf")] * 4), (1007, [0.0] * 4), (1007, [0.0] * 4)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, vector string").repartition(5)
    for k in (1, 3, 16):
        got = sorted((tuple(r) for r in cluster(table, k=k, rounds=3, dims=4).collect()), key=str)
        assert got == kmeans(rows, k, 3, 4)
    assert cluster(table.where("false"), k=4, rounds=2, dims=4).count() == 0
    few = table.where("vec_id in (-40, -37)")
    assert sorted((tuple(r) for r in cluster(few, k=16, rounds=3, dims=4).collect()), key=str) == kmeans(rows[:2], 16, 3, 4)


def test_balls_compare_fewer_and_equal_all():
    from tessera.llm import ball_kmeans as B

    rng = np.random.default_rng(3)
    centroids = rng.integers(-40, 40, (16, 6)).astype(np.int64)
    centroids[9] = centroids[2]
    x = (centroids[rng.integers(0, 16, 4000)] + rng.integers(-9, 9, (4000, 6))).astype(np.int64)
    x[:50] = (centroids[0] + centroids[1]) // 2
    apart = np.stack([B.squared(centroids, c) for c in centroids])
    want = B.all_centroids(x, centroids)
    compared, plain = [], B.squared
    B.squared = lambda v, c: compared.append(len(v)) or plain(v, c)
    try:
        for start in (want[0], rng.integers(0, 16, len(x))):
            compared.clear()
            best, least = B.in_balls(x, start.astype(np.int64), centroids, apart)
            assert (best == want[0]).all() and (least == want[1]).all()
            if start is want[0]:
                assert sum(compared) < 6 * len(x)
    finally:
        B.squared = plain


def test_shards(spark):
    from tessera.llm.sharding import shard, write_shards

    rows = [(i % 90 if i % 7 else None, None if i % 11 == 0 else "" if i % 13 == 0 else f"t{i % 50} ä", i, "p") for i in range(400)] + [(5, "same", -1, "p")] * 300
    table = spark.createDataFrame(rows, "doc_id long, text string, slot int, part string").repartition(6)
    out = shard(table, shards=7)
    assert out.columns == ["doc_id", "text", "slot", "part", "shard", "slot_"]
    got = out.collect()
    key = lambda r: str(tuple(r)[:4])
    assert sorted(map(key, got)) == sorted(map(str, rows))
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot_"])
    assert sorted(len(s) for s in slots.values()) == [100] * 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, shard(table, shards=7).collect())) == sorted(map(str, got))
    assert shard(table.where("false"), shards=4).count() == 0
    few = shard(table.limit(3), shards=5).collect()
    assert sorted((r["shard"], r["slot_"]) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_written_shards(spark, tmp_path):
    from tessera.llm.sharding import write_shards

    table = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text").repartition(4)
    write_shards(table, 3, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted(r.doc_id for r in back) == list(range(500))
    assert sorted((r["shard"], r.slot) for r in back) == [(s, k) for s in range(3) for k in range(167 if s < 2 else 166)]


def test_communication_matrix():
    from tessera.llm.sharding import communication, hypergeometric

    for counts, sizes in (([5, 0, 9, 100], [38, 38, 38]), ([1], [1, 0]), ([], [0, 0]), ([4 * 10**9, 3 * 10**9, 10**9], [4 * 10**9] * 2), ([7] * 33, [77] * 3)):
        m = communication(counts, sizes, 1)
        assert m.sum(1).tolist() == counts and m.sum(0).tolist() == (sizes if counts else [0, 0]) and (m >= 0).all()
    rng = np.random.default_rng(5)
    drawn = np.bincount([hypergeometric(rng, 6, 9, 5) for _ in range(20000)], minlength=6)
    from math import comb

    want = [comb(6, x) * comb(9, 5 - x) / comb(15, 5) * 20000 for x in range(6)]
    assert sum((a - b) ** 2 / b for a, b in zip(drawn, want, strict=True)) < 25
    big = np.array([hypergeometric(rng, 3 * 10**9, 10**9, 10**9) for _ in range(50)])
    assert abs(big.mean() - 0.75e9) < 4 * 12e3


def test_shards_are_uniform(spark):
    """Over seeds, every row meets every slot about equally often."""
    from tessera.llm.sharding import communication

    pairs = np.zeros((3, 3))
    for seed in range(600):
        pairs += communication([4, 4, 4], [4, 4, 4], seed)
    assert np.abs(pairs / 600 - 4 / 3).max() < 0.15


SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, bucket int"
LINES = "sale_id long, line_no int, item_id long, flag string, came_from string"


def order(rows, columns, key):
    """Rows by the key descending, the rest ascending, nulls first, strings by bytes."""
    at = columns.index(key)
    value = lambda x: (0,) if x is None else (1, x.encode() if isinstance(x, str) else x)
    rows = sorted(rows, key=lambda r: [value(x) for i, x in enumerate(r) if i != at])
    return sorted(rows, key=lambda r: (1, 0) if r[at] is None else (0, r[at]), reverse=True)


def described(sales, lines, buckets):
    """What the contract asks for: {(table, bucket): (rows in order, ids_sha256, lineage_sha256, n_joined, rewritten)}."""
    crc = lambda text, n: zlib.crc32(text.encode()) % n
    known = {r[0] for r in sales if r[0] is not None}
    own = lambda v: buckets + 1 if v is None else crc(f"s{v}", buckets)
    start = {"sales": lambda r: own(r[0]) - (own(r[0]) % 4 == 1), "sale_lines": lambda r: 0 if r[2] is None else crc(str(r[2]), buckets)}
    end = {"sales": lambda r: own(r[0]), "sale_lines": lambda r: own(r[0]) if r[0] is None or r[0] in known else buckets}
    out = {}
    for table, rows, columns in (("sales", sales, SALES), ("sale_lines", lines, LINES)):
        names = [c.split()[0] for c in columns.split(", ")]
        for b in {end[table](r) for r in rows}:
            mine = order([r for r in rows if end[table](r) == b], names, "sale_id")
            old = {}
            for r in mine:
                old[start[table](r)] = old.get(start[table](r), 0) + 1
            stays = len(old) == 1 and all(end[table](r) == b for r in rows if start[table](r) == next(iter(old)))
            sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
            joined = sum(1 for p in sales for c in lines if p[0] == c[0] and p[0] is not None and own(p[0]) == b) if b < buckets else 0
            out[table, b] = (mine, sha("" if r[0] is None else str(r[0]) for r in mine), sha(f"{s}:{n}" for s, n in sorted(old.items())), joined, not stays)
    return out


def write_and_rewrite(spark, path, sales, lines, buckets):
    from pyspark.sql import functions as F

    from tessera.llm.bucketed import crc_bucket, rewrite_pair, write_numbered

    s, c = spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES)
    b = F.coalesce(crc_bucket(F.col("sale_id"), buckets, "s"), F.lit(buckets + 1))
    write_numbered(s, b - F.when(b % 4 == 1, 1).otherwise(0), buckets + 2, "sale_id", f"{path}/sales")
    write_numbered(c, F.coalesce(crc_bucket(F.col("item_id"), buckets), F.lit(0)), buckets, "sale_id", f"{path}/sale_lines")
    before = {t: set(files(f"{path}/{t}")) for t in ("sales", "sale_lines")}
    return before, rewrite_pair(spark, path, "sales", "sale_lines", {"sales": s.schema, "sale_lines": c.schema}, "sale_id", buckets, "s").collect()


def files(folder):
    return sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))


def shop(seed, n):
    rng = random.Random(seed)
    when = lambda: rng.choice([None, datetime.datetime(2024, 1, rng.randint(1, 28), rng.randint(0, 23), 5, 6, 7)])
    some = lambda *values: rng.choice([None, *values])
    sales = [(rng.choice([i, i, -i]), some(1, 2), some("done", "öpen", "", "Z", "\U0001f600", "￮"), some(1.5, -2.0, 3.25), when(), when(), some(1)) for i in range(n)]
    sales += [(None, 1, None, None, None, None, None)] * 2 + sales[:3]
    lines = [(rng.choice([rng.randint(-5, n + 9), 4, None]), some(1, 2), rng.choice([None, 7, rng.randint(0, 30)]), some("kept", "ä"), some("q")) for _ in range(3 * n)]
    return sales, lines + lines[:5]


@pytest.mark.parametrize("buckets", [5, 12])
def test_bucketed_pair(spark, tmp_path, buckets):
    import pyarrow.parquet as pq

    sales, lines = shop(buckets, 40)
    before, got = write_and_rewrite(spark, str(tmp_path), sales, lines, buckets)
    want = described(sales, lines, buckets)
    assert sorted((r.table_name, r.bucket) for r in got) == sorted(want)
    assert {r.rewritten for r in got if r.table_name == "sales"} == {True, False}
    for r in got:
        rows, ids, lineage, joined, rewritten = want[r.table_name, r.bucket]
        assert (r.ids_sha256, r.lineage_sha256, r.n_joined, r.rewritten, r.n_rows) == (ids, lineage, joined, rewritten, len(rows))
        name = r.path.rsplit("/", 1)[1]
        assert (name in before[r.table_name]) == (not rewritten)
        table = pq.read_table(r.path.removeprefix("file://"))
        assert ",".join(table.column_names) == r.columns
        assert [tuple(x.values()) for x in table.to_pylist()] == rows
    for t in ("sales", "sale_lines"):
        assert files(f"{tmp_path}/{t}") == sorted(r.path.rsplit("/", 1)[1] for r in got if r.table_name == t)


def test_bucketed_pair_without_rows_or_parents(spark, tmp_path):
    sales, lines = shop(1, 6)
    for name, s, c in (("none", [], []), ("lines", [], lines), ("sales", sales, []), ("one", sales[:1], [(sales[0][0], 1, 7, "x", None)])):
        _, got = write_and_rewrite(spark, f"{tmp_path}/{name}", s, c, 6)
        want = described(s, c, 6)
        assert sorted((r.table_name, r.bucket, r.ids_sha256, r.lineage_sha256, r.n_joined, r.rewritten) for r in got) == sorted((*k, v[1], v[2], v[3], v[4]) for k, v in want.items())
    assert [r.rewritten for r in got if r.table_name == "sale_lines"] == [False]
