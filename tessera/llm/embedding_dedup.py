"""Near-duplicate vectors by Euclidean p-stable hashing, confirmed by exact cosine in double precision.

Vectors are normalised; each of L tables hashes them by K quantised Gaussian projections of width ``WIDTH``. At unit
length a cosine is a distance, so collision chances follow from the threshold: K is chosen so that a bucket holds about one
unrelated vector (from the largest label's size) and L so that a pair at the threshold meets in some table but for
``MISS``. Only vectors of equal label and length are compared. Equal vectors collapse to one with a multiplicity first.

Buckets are compared in memory, in blocks: one of more than ``BLOCK`` members is cut into blocks whose pairs go to
different tasks, so a hot bucket is shared out whole. A block sends on links that join its members into components, never all
its links; the first ``FIRST`` tables are compared first, and of the others only buckets that still span components. Links are
then counted within the components, where every link has both ends, again in blocks and by exact cosine: so each pair is counted once,
also one that met in no table, and rows grow with the vectors. Cosines within rounding of the threshold are computed again in plain order.

Null labels and vectors that are null, zero, empty or hold null or non-finite components link with nothing; null ids
neither. Rows of an equal ``vec_id`` are vectors of their own; a class has its smallest ``vec_id``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.words import U, grouped, mix, powers, small_batches, trim
from tessera.operators.graph import connected_components
from tessera.scratch import materialize

LEFT, RIGHT, ALL = 0, 1, 2
WIDTH, MISS, BLOCK, SEED, FIRST = 2.0, 1e-3, 1024, 93, 6
FEW, HASHED = 6, 1 << 22  # projections of a batch at once


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection agrees for two points at ``distance``."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(largest: int, threshold: float) -> tuple[int, int]:
    """(K projections a table, L tables) for ``largest`` vectors of one label."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(2, largest)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as float64 bytes with a 128-bit hash; others with none."""
    for batch in batches:
        raw, h1, h2 = [], [], []
        for values in batch.column("embedding"):
            x = None
            if values.is_valid and len(values.values) and not values.values.null_count:
                x = values.values.to_numpy().astype(np.float64)
                x = x if np.isfinite(x).all() and x.any() else None
            if x is None:
                raw.append(None)
                h1.append(None)
                h2.append(None)
            else:
                bits = mix(x.view(U) + powers(0x2545F4914F6CDD1D, len(x)))
                raw.append(x.tobytes())
                h1.append(int(np.add.reduce(bits).view(np.int64)))
                h2.append(int(np.add.reduce(mix(bits ^ U(0xABCD)) * powers(0x9E3779B97F4A7C15, len(x))).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array([len(r) // 8 if r else None for r in raw], pa.int32()),
             pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(raw, pa.binary())],
            ["vec_id", "label", "dim", "h1", "h2", "vector"],
        )


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hasher(k: int, tables: int):
    def run(batches):
        planes: dict[int, tuple] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                same = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if dim not in planes:
                    rng = np.random.default_rng((SEED, dim))
                    planes[dim] = rng.standard_normal((dim, tables * k)), rng.uniform(0, WIDTH, tables * k)
                a, b = planes[dim]
                step = max(1, HASHED // (tables * k))
                for at in range(0, same.num_rows, step):
                    some = same.slice(at, step)
                    x = _units(_matrix(some.column("vector")))
                    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(U).reshape(len(x), tables, k)
                    keys = np.broadcast_to(np.arange(tables, dtype=U) + U(dim << 20), (len(x), tables))
                    for i in range(k):
                        keys = mix(keys * U(31) + cells[:, :, i])
                    flat = pa.ListArray.from_arrays(
                        pa.array(np.arange(0, (len(x) + 1) * tables, tables, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))
                    )
                    yield pa.RecordBatch.from_arrays([some.column("node"), some.column("label"), flat], ["node", "label", "keys"])
        trim()

    return run


def _linked(raw: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows reach the threshold (a row with itself does not)."""
    x = _units(raw)
    similar = x @ x.T
    out = similar >= threshold
    for i, j in np.argwhere(np.abs(similar - threshold) < 1e-12).tolist():
        p, q = raw[i].tolist(), raw[j].tolist()
        dot = lambda u, v: sum(a * b for a, b in zip(u, v, strict=True))
        out[i, j] = dot(p, q) / (math.sqrt(dot(p, p)) * math.sqrt(dot(q, q))) >= threshold
    np.fill_diagonal(out, False)
    return out


def _worth(table: pa.Table, cuts: np.ndarray, threshold: float) -> np.ndarray:
    """Groups of two rows and more, but for those of up to ``FEW`` rows of which no two come near the threshold."""
    size = np.diff(cuts)
    small = np.repeat(size <= FEW, size)
    vectors = table["vector"].to_pylist()
    if len({len(v) for v in vectors}) != 1:
        return size > 1
    x, group = _units(np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)), np.repeat(np.arange(len(size)), size)
    near = np.zeros(len(size), bool)
    for step in range(1, FEW):
        at = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
        hit = np.einsum("ij,ij->i", x[at], x[at + step]) >= threshold - 1e-9
        near[group[at[hit]]] = True
    return (size > FEW) | near


def _by_group(batches, judge, names, threshold: float | None = None):
    for table in grouped(batches, "grp", 4 * BLOCK):
        group = table["grp"].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        good = np.diff(cuts) > 1 if threshold is None else _worth(table, cuts, threshold)
        found = [judge(table.slice(a, b - a)) for a, b in zip(cuts[:-1][good].tolist(), cuts[1:][good].tolist(), strict=True)]
        found = [f for f in found if len(f[0])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in range(2)], names)
    trim()


def _joiner(threshold: float):
    """Members of a block, or of two, sorted by group -> links (a, b) that join those of different ``comp``: a star for each component."""

    def judge(table: pa.Table):
        nodes, comp = table["node"].to_numpy(), table["comp"].to_numpy()
        linked = _linked(_matrix(table["vector"]), threshold) & (comp[:, None] != comp[None, :])
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        found = np.flatnonzero(label != np.arange(len(label)))
        return nodes[label[found]], nodes[found]

    return lambda batches: _by_group(batches, judge, ["a", "b"], threshold)


def _counter(threshold: float):
    """Members of a block of a component, or of two, sorted by group -> (node, n): linked vectors of the other side or of the one block."""

    def judge(table: pa.Table):
        nodes, side, copies = (table[c].to_numpy() for c in ("node", "side", "copies"))
        linked = _linked(_matrix(table["vector"]), threshold)
        if (side != ALL).any():
            linked &= side[:, None] != side[None, :]
        return nodes, linked @ copies

    return lambda batches: _by_group(batches, judge, ["node", "n"])


def _blocks(members: DataFrame, key: str) -> DataFrame:
    """Rows (``key``, node, members, ...) dealt to the pairs of their group's blocks: adds grp and side."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = members.withColumns({"mine": F.pmod(F.xxhash64("node"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    side = F.when(F.col("mine") == F.col("other"), ALL).when(F.col("mine") < F.col("other"), LEFT).otherwise(RIGHT)
    return placed.withColumns({"grp": F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other")), "side": side}).drop("mine", "other", "members", key)


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    rows = small_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"))
    ready = materialize(rows.mapInArrow(_prepare, "vec_id long, label string, dim int, h1 long, h2 long, vector binary"), "vectors")
    usable = ready.where("label is not null and vector is not null and vec_id is not null")
    same = ["label", "dim", "h1", "h2"]
    nodes = usable.groupBy(*same).agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    k, tables = plan(largest, threshold)
    hashed = nodes.select("node", "label", "dim", "vector").mapInArrow(_hasher(k, tables), "node long, label string, keys array<long>")
    cells = hashed.select("node", "label", F.posexplode("keys").alias("t", "key")).select("node", "t", F.xxhash64("label", "key").alias("bucket"))
    cells = materialize(cells, "cells")

    def joined(placed: DataFrame) -> DataFrame:
        """Links between members (node, bucket, comp) of a bucket and of different components."""
        shared = placed.groupBy("bucket").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        open_ = placed.join(materialize(shared.select("bucket", "members"), "shared"), "bucket")
        sides = _blocks(open_, "bucket").join(nodes.select("node", "vector"), "node").select("grp", "node", "comp", "vector")
        links = sides.repartition("grp").sortWithinPartitions("grp").mapInArrow(_joiner(threshold), "a long, b long")
        return materialize(links.distinct(), "links")

    links = joined(cells.where(F.col("t") < FIRST).select("node", "bucket", F.col("node").alias("comp")))
    labels = connected_components(links, "a", "b")
    rest = cells.where(F.col("t") >= FIRST).join(labels, "node", "left")
    more = joined(materialize(rest.select("node", "bucket", F.coalesce("component", "node").alias("comp")), "placed"))
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more), "a", "b")

    sizes = materialize(labels.groupBy("component").agg(F.count("*").alias("members")), "sizes")
    sides = _blocks(labels.join(sizes, "component"), "component").join(nodes.select("node", "copies", "vector"), "node")
    counted = sides.select("grp", "node", "side", "copies", "vector").repartition("grp").sortWithinPartitions("grp").mapInArrow(_counter(threshold), "node long, n long")
    counted = materialize(counted.groupBy("node").agg(F.sum("n").alias("near")), "counted")
    least = materialize(labels.join(nodes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least")), "least")
    classes = (
        nodes.select(*same, "node", "low", "copies")
        .join(counted, "node", "left")
        .join(labels, "node", "left")
        .join(least, "component", "left")
        .select(*same, F.coalesce("least", "low").alias("component"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n"))
    )
    out = ready.drop("vector").join(materialize(classes, "classes"), same, "left")
    linkable = F.col("vec_id").isNotNull() & F.col("component").isNotNull()
    component = F.when(linkable, F.col("component")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.when(linkable, F.col("n")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
