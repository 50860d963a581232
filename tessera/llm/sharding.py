"""Shards by a uniform shuffle with exact sizes: a hypergeometric communication matrix.

1. Every partition of the input permutes its rows on its own: they are sorted by random numbers and written with the partition's
   number and their place in it, so that everything after is repeatable, also when executors are lost.
2. The driver draws the communication matrix: how many rows each partition sends to each shard. Its rows sum to the partitions'
   counts and its columns to the shards' sizes, and it has the distribution that a uniform permutation of all rows gives (a
   multivariate hypergeometric one, drawn by halving the partitions, exactly at any size). A partition's first rows go to shard 0, the next to shard 1, and so on.
3. Shards permute again what they receive: a hash of (partition, place) orders a shard's rows. Its low digits name one of the shard's
   blocks, all blocks are counted, and one exchange sends each block to a partition of its own, where the place in the sorted block
   after the rows of earlier blocks is the slot. No task has a whole shard.

Rows are shuffled over the network once. The matrix and the blocks' counts are bounded: at most ``MAX_PARTITIONS`` x shards and
``MAX_BLOCKS`` numbers, whatever the input; they are all that is broadcast or seen by the driver.

Law of sizes: shards' row counts are at most one apart. Rows are independent of each other: equal texts and repeated rows are rows of their own, null
ids and texts are rows like others. An empty table gives no rows. Added columns are ``shard`` and ``slot``, with underscores behind
them where the input has columns of these names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.bucketed import fresh, quoted
from tessera.scratch import materialize

MAX_PARTITIONS, MAX_BLOCKS, BLOCK_ROWS = 1 << 16, 1 << 16, 1 << 20
_PLACE = (1 << 33) - 1  # monotonically_increasing_id has the place in the partition in its low 33 bits
_NUMPY_MOST = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows without replacement are good, by inversion over all outcomes that have a chance above 1e-30."""
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    whole = good + bad
    spread = (draws / whole * good * bad / whole * (whole - draws) / max(1, whole - 1)) ** 0.5 if whole else 0.0
    reach = int(14 * spread) + 60
    x = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    up = np.log(good - x[:-1]) + np.log(draws - x[:-1]) - np.log(x[1:]) - np.log(bad - draws + x[1:])
    weight = np.concatenate(([0.0], np.cumsum(up)))
    total = np.cumsum(np.exp(weight - weight.max()))
    return int(x[min(len(x) - 1, int(np.searchsorted(total, rng.random() * total[-1], "right")))])


def _share(rng: np.random.Generator, of: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate hypergeometric draw: how many of ``draws`` rows come from each of the classes that have ``of`` rows."""
    whole = int(of.sum())
    if whole < _NUMPY_MOST:
        return rng.multivariate_hypergeometric(of, draws, method="marginals")
    out = np.zeros_like(of)
    for k, good in enumerate(of.tolist()):
        whole -= good
        out[k] = hypergeometric(rng, good, whole, draws)
        draws -= int(out[k])
    return out


def communication(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """The matrix (partition, shard) of a uniform permutation; ``counts`` and ``sizes`` have the same sum."""
    rng, ends = np.random.default_rng(seed), np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    out = np.zeros((len(counts), len(sizes)), np.int64)
    todo = [(0, len(counts), np.array(sizes, np.int64))] if counts else []
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
        else:
            middle = (a + b) // 2
            left = _share(rng, have, int(ends[middle] - ends[a]))
            todo += [(a, middle, left), (middle, b, have - left)]
    return out


def _permuted(docs: DataFrame, seed: int, part: str, place: str) -> DataFrame:
    """``docs`` with each partition's rows in a random order, written with their partition and place."""
    order, at = fresh([*docs.columns, part, place], "order", "at")
    mixed = docs.coalesce(MAX_PARTITIONS).withColumn(order, F.rand(seed)).sortWithinPartitions(order).withColumn(at, F.monotonically_increasing_id())
    columns = [*map(quoted, docs.columns), F.shiftright(quoted(at), 33).cast("int").alias(part), quoted(at).bitwiseAND(F.lit(_PLACE)).alias(place)]
    return materialize(mixed.select(*columns), "permuted")


def shard(docs: DataFrame, shards: int, seed: int = 11) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard); rows of a block lie together, in order of slots."""
    spark, columns = docs.sparkSession, docs.columns
    shard_name, slot_name, part, place, block, key, first, upto = fresh(columns, "shard", "slot", "part", "place", "block", "key", "first", "upto")
    rows = _permuted(docs, seed, part, place)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())  # at most MAX_PARTITIONS
    n = sum(c for _, c in counts)
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication([c for _, c in counts], sizes, seed).cumsum(1).tolist()
    sent = spark.createDataFrame([(p, row) for (p, _), row in zip(counts, matrix, strict=True)], f"`{part}` int, `{upto}` array<long>")
    blocks = max(1, min(MAX_BLOCKS // shards, max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards), -(-n // (shards * BLOCK_ROWS)))))

    def dealt(some: DataFrame) -> DataFrame:
        """With the number of the block: the blocks of shard 0, then those of shard 1, and so on."""
        random = F.xxhash64(F.lit(seed), quoted(part), quoted(place))
        to = F.size(F.filter(quoted(upto), lambda end: end <= quoted(place)))
        number = (to * blocks + F.pmod(random, F.lit(blocks))).cast("int")
        return some.join(F.broadcast(sent), part).select(*map(quoted, some.columns), random.alias(key), number.alias(block))

    filled = dealt(rows.select(quoted(part), quoted(place))).groupBy(block).agg(F.count("*").alias("n"))
    shard_of = F.floor(quoted(block) / blocks).cast("int")
    earlier = F.sum("n").over(Window.partitionBy(shard_of).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(filled.select(quoted(block), F.coalesce(earlier, F.lit(0)).alias(first)), "blocks")  # at most MAX_BLOCKS
    placed = dealt(rows).repartitionById(shards * blocks, block).sortWithinPartitions(key, part, place).withColumn(slot_name, F.monotonically_increasing_id())
    slot: Column = quoted(first) + quoted(slot_name).bitwiseAND(F.lit(_PLACE))
    return placed.join(F.broadcast(starts), block).select(*map(quoted, columns), shard_of.alias(shard_name), slot.alias(slot_name))


def write_shards(docs: DataFrame, shards: int, path: str, seed: int = 11) -> None:
    """Whole rows as Parquet files in a folder for each shard; each file is one block, in order of slots."""
    shard_name, _ = fresh(docs.columns, "shard", "slot")
    shard(docs, shards, seed).write.partitionBy(shard_name).parquet(path)
