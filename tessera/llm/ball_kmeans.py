"""Ball k-means: clusters as balls, neighbours by radii, and only relevant neighbours compared exactly.

Vectors are integers (floor of 64 times each component), so every distance, comparison and mean is exact. Each round, a vector's
distance to its own new centroid is known first. The members of a cluster in a batch form a ball, whose radius is the largest of
these distances. A centroid is a neighbour if half its distance to the ball's centroid is no more than the radius; neighbours are sorted by distance.
A member nearer than half the distance to the nearest neighbour is in the stable core and stays. The others lie in annuli
between the halves of successive neighbours' distances, and a member of the k-th annulus is compared with the first k neighbours only.
A member exactly half way counts to the outer annulus, as ties go to the smaller number.

A round is one pass without a shuffle: it reads the vectors and their clusters, assigns them anew, and writes both with the sums
and counts of each task's clusters beside them. Only these sums (k rows a task, combined by Spark) make the next centroids, of which the driver has k.

Kept are vectors with exactly ``dims`` components, none null or non-finite, and within +-2**21 (beyond, squared distances leave a long);
other rows are left out. Rows of an equal id are vectors of their own. A null id is hashed as an empty one. Of equal hashes the
smaller id, then the smaller vector comes first. With fewer kept vectors than ``k`` there are as many centroids as vectors; an
empty table has no rows. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.words import small_batches, trim
from tessera.scratch import materialize

SCALE, LARGEST = 64, 1 << 21
_STATE = "vec_id long, vector binary, cluster int, distance long, n long, total array<long>"
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])


def _quantiser(dims: int):
    """(vec_id, embedding) -> (vec_id, vector) for the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            lengths = np.diff(column.offsets.to_numpy())
            some = np.flatnonzero((lengths == dims) & column.is_valid().to_numpy(zero_copy_only=False))
            values = column.take(pa.array(some)).flatten().cast(pa.float64())
            x = values.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(some), dims)
            good = (np.abs(np.nan_to_num(x, nan=np.inf)) < LARGEST).all(1)
            q = np.floor(SCALE * x[good]).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(some[good])), pa.array([row.tobytes() for row in q], pa.binary())], ["vec_id", "vector"])
        trim()

    return run


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = x - centre
    return (d * d).sum(1)


def all_centroids(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each vector, by comparing all."""
    near = np.stack([squared(x, c) for c in centroids], 1)
    best = near.argmin(1)
    return best, near[np.arange(len(x)), best]


def in_balls(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``all_centroids`` for vectors that were in ``cluster``; ``apart`` holds the centroids' squared distances."""
    best, least = cluster.copy(), squared(x, centroids[cluster])
    for ball in np.unique(cluster).tolist():
        members = np.flatnonzero(cluster == ball)
        own = least[members]
        others = np.flatnonzero(apart[ball] <= 4 * own.max())
        others = others[others != ball]
        others = others[np.argsort(apart[ball][others], kind="stable")]
        annulus = np.searchsorted(apart[ball][others], 4 * own, "right")
        for k, other in enumerate(others.tolist()):
            out = members[annulus > k]
            d = squared(x[out], centroids[other])
            nearer = (d < least[out]) | ((d == least[out]) & (other < best[out]))
            best[out[nearer]], least[out[nearer]] = other, d[nearer]
    return best, least


def _assigner(centroids: np.ndarray, first: bool):
    """One pass: vectors with their new cluster and distance, and at the end a row with count and sums for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        apart = np.stack([squared(centroids, c) for c in centroids])
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            raw = batch.column("vector")
            if not len(raw):
                continue
            x = np.frombuffer(b"".join(raw.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
            best, least = all_centroids(x, centroids) if first else in_balls(x, batch.column("cluster").to_numpy().astype(np.int64), centroids, apart)
            n += np.bincount(best, minlength=k)
            np.add.at(total, best, x)
            nothing = pa.nulls(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), raw, pa.array(best, pa.int32()), pa.array(least), nothing.cast(pa.int64()), nothing.cast(pa.list_(pa.int64()))], schema=_SCHEMA)
        some = np.flatnonzero(n).tolist()
        yield pa.RecordBatch.from_pylist([{"cluster": c, "n": int(n[c]), "total": total[c].tolist()} for c in some], schema=_SCHEMA)
        trim()

    return run


def _start(vectors: DataFrame, k: int, dims: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``1:<vec_id>``, in that order."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(order, "vec_id", F.hex("vector")).limit(k).select("vector").collect()
    return np.array([np.frombuffer(r.vector, "<i4") for r in first], np.int64).reshape(-1, dims)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of the clusters' vectors; an empty cluster's centroid stays."""
    sums = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.where("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # k rows
        out[r.cluster] = [r[f"t{i}"] // r.n for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept row of ``vectors`` (vec_id, embedding, ...).

    ``distance`` is squared, inertias are its sums over the cluster and over all, ``centroid_sha256`` is the hash of the final
    centroid's components in decimal, joined by commas.
    """
    rows = small_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    spark: SparkSession = rows.sparkSession
    state = materialize(rows.mapInArrow(_quantiser(dims), "vec_id long, vector binary"), "vectors")
    centroids = _start(state, k, dims)
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], result)
    for step in range(rounds + 1):
        passed = materialize(state.mapInArrow(_assigner(centroids, step == 0), _STATE), f"clusters{step}")
        if step < rounds:
            centroids = _moved(passed, centroids)
        state = passed.where("vector is not null").select("vec_id", "vector", "cluster", "distance")
    inertia = {r.cluster: r.inertia for r in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    whole = sum(inertia.values())
    digests = {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(centroids.tolist())}
    of = spark.createDataFrame([(c, n, whole, digests[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
