"""Near-duplicate classes of token sets: MinHash bands find candidates, exact sets confirm them.

1. Equal sets collapse to their smallest id. The others get 128 MinHash values, cut into bands of rows so that a pair at the threshold
   shares a band but for a chance of ``MISS``.
2. Each set is compared with one other: the smallest id of a bucket, the one that it shares most buckets with.
3. Buckets that still hold more than one component are cut into blocks; each block and pair of blocks compares the sets of different
   components and sends on links that join two, never pairs.

So k near copies give rows in proportion to k at every step. Rows of a null id or without a token link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.operators.graph import connected_components
from tessera.scratch import materialize

VALUES, MISS, BLOCK = 128, 1e-4, 512
U = np.uint64
_rng = np.random.default_rng(128)
_A, _B = _rng.integers(0, 2**63, (2, VALUES), dtype=np.uint64)
_A = _A * U(2) + U(1)


def rows_of(threshold: float) -> int:
    """The most values a band at which a pair at the threshold shares none of the bands with chance ``MISS`` at most."""
    return max((r for r in range(1, VALUES + 1) if (1 - threshold**r) ** (VALUES // r) <= MISS), default=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(28))


def bands(tokens: np.ndarray, bounds: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) keys of sets of hashes, one after another; none may be empty."""
    lowest = np.empty((len(bounds) - 1, VALUES), U)
    for k in range(VALUES):
        lowest[:, k] = np.minimum.reduceat(_mixed(tokens * _A[k] + _B[k]), bounds[:-1])
    keys = []
    for band in range(VALUES // rows):
        key = np.full(len(lowest), band, U)
        for r in range(band * rows, (band + 1) * rows):
            key = _mixed(key * U(0x100000001B3) + lowest[:, r])
        keys.append(key)
    return np.stack(keys, 1)


def _banded(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("tokens")
            bounds = column.offsets.to_numpy().astype(np.int64)
            if not len(column):
                continue
            tokens = column.values.to_numpy()[bounds[0] : bounds[-1]].view(U)
            keys = bands(tokens, bounds - bounds[0], rows)
            flat = pa.array(keys.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), flat)], ["id", "keys"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int = 4 * BLOCK) -> Iterator[pa.Table]:
    """Batches sorted by ``grp`` as tables of whole groups."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            table = pa.Table.from_batches(held)
            groups = table["grp"].to_numpy()
            whole = int(np.searchsorted(groups, groups[-1]))
            if whole:
                yield table.slice(0, whole)
                held, n = table.slice(whole).to_batches(), n - whole
    if n:
        yield pa.Table.from_batches(held)


def _linker(threshold: float):
    """Groups of members (grp, side, id, comp, tokens) -> links (a, b) that join two components of the group."""

    def links(table: pa.Table) -> list[tuple[int, int]]:
        ids, side, label = (table[c].to_numpy().copy() for c in ("id", "side", "comp"))
        column = table["tokens"].combine_chunks()
        sets = [set(s.tolist()) for s in np.split(column.flatten().to_numpy(), np.cumsum(np.diff(column.offsets.to_numpy()))[:-1])]
        order, out = sorted(range(len(ids)), key=lambda i: len(sets[i])), []
        for at, i in enumerate(order):
            for j in order[at + 1 :]:
                if threshold * len(sets[j]) > len(sets[i]) + 1e-9:
                    break
                if label[i] != label[j] and (side[i] == side[j] == 2 or side[i] != side[j]):
                    both = len(sets[i] & sets[j])
                    if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                        out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                        label[label == label[j]] = label[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            groups = table["grp"].to_numpy()
            cuts = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1, append=groups[-1] + 1)).tolist()
            found = [link for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1 for link in links(table.slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def near_classes(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, class_id) for each row of ``sets`` (id, tokens: distinct strings): the smallest id reached by links of a Jaccard similarity of ``threshold`` and more."""
    rows = sets.select(F.col("id").cast("long").alias("id"), F.array_sort(F.transform(F.coalesce("tokens", F.array()), lambda t: F.xxhash64(t))).alias("tokens"))
    rows = materialize(rows.withColumn("digest", F.sha2(F.array_join("tokens", ","), 256)), "token_sets")
    known = rows.where("id is not null and size(tokens) > 0")
    first = materialize(known.groupBy("digest").agg(F.min("id").alias("rep")), "first_of_set")
    members = rows.select("id", "digest", (F.size("tokens") > 0).alias("some")).join(first, "digest", "left").select("id", F.when(F.col("some"), F.col("rep")).otherwise(F.col("id")).alias("rep"))
    distinct = materialize(known.join(first.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "tokens").dropDuplicates(["id"]), "distinct_sets")
    banded = distinct.mapInArrow(_banded(rows_of(threshold)), "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    banded = materialize(banded, "bands")
    shared = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(banded.join(shared, "key"), "buckets")

    best = buckets.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("bands")).groupBy("id").agg(F.max(F.struct("bands", (-F.col("pivot")).alias("p"))).alias("b"))
    pairs = best.select(F.col("id").alias("b"), (-F.col("b.p")).alias("a"))
    full = pairs.join(distinct.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b").join(distinct.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    both = F.size(F.array_intersect("ta", "tb"))
    links = materialize(full.select("a", "b", both.alias("c"), (F.size("ta") + F.size("tb")).alias("s")).where(F.col("c") >= threshold * (F.col("s") - F.col("c"))).select("a", "b"), "links")
    labels = connected_components(links, "a", "b")

    placed = materialize(buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp")), "placed")
    open_ = materialize(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "open")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = placed.join(open_, "key").withColumns({"mine": F.pmod(F.xxhash64("id"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    grp = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = cut.select(grp.alias("grp"), side.alias("side"), "id", "comp").join(distinct, "id").select("grp", "side", "id", "comp", "tokens")
    more = dealt.repartition("grp").sortWithinPartitions("grp", "id").mapInArrow(_linker(threshold), "a long, b long")
    more = materialize(more.distinct(), "more_links")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more), "a", "b")
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
