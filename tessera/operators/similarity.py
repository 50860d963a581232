"""Exact set-similarity join by prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.scratch import materialize

#: So many of the most frequent tokens are ranked by their counts; all others count as rare, in the order of their hashes.
RANKED = 100_000


def _prefixes(ranked, threshold: float):
    """(id, tokens sorted) -> (id, n, prefix): the first n - ceil(threshold * n) + 1 tokens from rare to frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = ranked.value
        for batch in batches:
            column = batch.column("tokens")
            offsets = column.offsets.to_numpy()
            tokens = column.values.to_numpy()[offsets[0] : offsets[-1]]
            n = np.diff(offsets).astype(np.int64)
            at = np.minimum(np.searchsorted(names, tokens), max(0, len(names) - 1))
            often = np.where(names[at] == tokens, counts[at], 0) if len(names) else np.zeros(len(tokens), np.int64)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((tokens, often, row))
            keep = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            first = np.cumsum(n) - n
            inside = np.arange(len(tokens)) - np.repeat(first, n) < np.repeat(keep, n)
            ends = np.concatenate(([0], np.cumsum(np.minimum(keep, n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[order][inside]))], ["id", "n", "prefix"])

    return run


def jaccard_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of ids (long) whose ``tokens`` (distinct) reach the threshold.

    Tokens are compared by their 64-bit hashes and ordered from rare to frequent, any one order for all sets; two sets that reach the threshold
    share a token among the first ``n - ceil(threshold * n) + 1`` of each, so only these prefixes are joined (no loss), with the length filter
    in the join. Tokens themselves are only counted, with partial sums; sets travel where a candidate needs them.
    """
    spark = sets.sparkSession
    hashed = sets.where("size(tokens) > 0").select(F.col("id").cast("long").alias("id"), F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t))).alias("tokens"))
    hashed = materialize(hashed, "token_hashes")
    top = hashed.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("f")).orderBy(F.col("f").desc(), "t").limit(RANKED).collect()  # at most RANKED rows
    names = np.array([r.t for r in top], np.int64)
    order = np.argsort(names)
    ranked = spark.sparkContext.broadcast((names[order], np.array([r.f for r in top], np.int64)[order]))
    keyed = hashed.mapInArrow(_prefixes(ranked, threshold), "id long, n long, prefix array<long>").select("id", "n", F.explode("prefix").alias("t"))
    keyed = materialize(keyed, "prefixes")
    left, right = keyed.withColumnsRenamed({"id": "a", "n": "na"}), keyed.withColumnsRenamed({"id": "b", "n": "nb"})
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    pairs = left.join(right, "t").where(fits).select("a", "b").distinct()
    full = pairs.join(hashed.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(hashed.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    out = full.withColumn("c", common).withColumn("u", F.size("ta") + F.size("tb") - F.col("c"))
    return out.where(F.col("c") >= threshold * F.col("u")).select("a", "b", F.round(F.col("c") / F.col("u"), 6).alias("jaccard"))
