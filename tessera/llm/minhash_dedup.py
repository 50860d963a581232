"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Every document's set of distinct word shingles is hashed (64 bits); equal sets collapse to the smallest
   ``doc_id`` at once, so groups of copies cost one row each from here on.
2. Bands of MinHash values give candidates. Every document is first compared with one bucket's smallest member only,
   the one that it shares most buckets with; members of buckets that this leaves in more than one component are
   then compared across components in blocks, each pair in the first band that it shares, so every banded candidate
   between components is judged once.
3. Signatures are compared in batches. After each batch the posterior probability that the similarity reaches
   the threshold (uniform prior, Beta posterior) is bounded from below by ``MISS``; pairs under it are pruned.
4. A block hands on the members that have a survivor, never pairs. Their texts meet in the same block again, where
   survivors are confirmed on the full shingle sets with the integer test ``100 * intersection >= percent * union``
   and a link is sent on only if it joins two components; connected components of these links are the classes.
   Rows and bytes grow with the members of a bucket, whatever the number of its pairs; blocks are bounded in rows and shingles.

Chance to miss a pair at the threshold: (1 - threshold**rows)**bands < ``BAND_MISS`` for banding, below MISS per batch
for pruning. A text of fewer than five words is one shingle; null or blank texts are linked with nothing.
Rows of an equal ``doc_id`` are documents of their own where their texts differ: they are compared under surrogate keys
and get the smallest ``doc_id`` of their class; rows equal in id and text are one document. A null ``doc_id`` links with nothing.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.words import U, grouped, mix, shingle_sets, slices, small_batches, strings, trim
from tessera.operators.graph import connected_components
from tessera.scratch import materialize

PERMUTATIONS, BATCH, MISS, BAND_MISS = 196, 28, 1e-7, 1e-4
#: A block of a bucket has about so many members and shingles at most; a longer document stands with its block alone.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
PAIRS = 1 << 17
LEFT, RIGHT, ALL = 0, 1, 2
_rng = np.random.default_rng(85)
_A = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary"
_MEMBER = "grp long, band int, side int, id long, comp long, n_shingles long, sig binary"


def bands_of(threshold: float) -> tuple[int, int]:
    """(rows, bands): the most rows a band at which a pair at the threshold is missed with chance ``BAND_MISS`` at most."""
    for rows in range(PERMUTATIONS, 1, -1):
        if (1 - threshold**rows) ** (PERMUTATIONS // rows) <= BAND_MISS:
            return rows, PERMUTATIONS // rows
    return 1, PERMUTATIONS


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, PERMUTATIONS) minima of 32-bit multiply-shift hashes; no row may be empty."""
    out = np.empty((len(bounds) - 1, PERMUTATIONS), np.uint32)
    starts, work = bounds[:-1], np.empty_like(sets)
    for k in range(PERMUTATIONS):
        np.multiply(sets, _A[k], out=work)
        work += _B[k]
        out[:, k] = np.minimum.reduceat(work, starts) >> U(32)
    return out


def _signer(rows: int, bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in slices(offsets, 1 << 19):
                sets, bounds = shingle_sets(data, offsets[a : b + 1])
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                short = np.zeros((b - a, PERMUTATIONS), np.uint16)
                keys = np.zeros((b - a, bands), U)
                h1, h2 = np.zeros(b - a, U), np.zeros(b - a, U)
                if len(some):
                    starts = np.append(bounds[some], bounds[-1])
                    short[some] = signatures(sets, starts).astype(np.uint16)
                    h1[some] = np.add.reduceat(mix(sets ^ U(0x51ED)), starts[:-1])
                    h2[some] = np.add.reduceat(mix(sets ^ U(0xC0FFEE)), starts[:-1])
                    for k in range(bands):
                        key = np.full(b - a, k, U)
                        for r in range(k * rows, (k + 1) * rows):
                            key = mix(key * U(31) + short[:, r])
                        keys[:, k] = key
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))
                )
                raw, w = short.tobytes(), PERMUTATIONS * 2
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), flat,
                     pa.array([raw[i * w : (i + 1) * w] for i in range(b - a)], pa.binary())],
                    ["doc_id", "n_shingles", "h1", "h2", "bands", "sig"],
                )
        trim()

    return sign


@functools.cache
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """After each batch: the fewest matches m of n at which P(similarity >= threshold | m, n) is still >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail equals
    P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def plausible(sig: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (rows ``x``, ``y`` of the uint16 signatures) pass every batch; later batches are compared for survivors only."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for step, least in enumerate(least_matches(threshold)):
        part = sig[:, step * BATCH : (step + 1) * BATCH]
        matches = matches + (part[x[alive]] == part[y[alive]]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def _pairs(side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one group's rows, some rows at a time: left with right, or all with all."""
    every = side[0] == ALL
    left, right = (np.arange(len(side)),) * 2 if every else (np.flatnonzero(side == LEFT), np.flatnonzero(side == RIGHT))
    step = max(1, PAIRS // max(1, len(side)))
    for a in range(0, len(left) if len(right) else 0, step):
        some = left[a : a + step]
        x, y = np.repeat(some, len(right)), np.tile(right, len(some))
        yield (x[x < y], y[x < y]) if every else (x, y)


def _survivors(table: pa.Table, threshold: float, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``table`` (whole groups, in order) that are judged there and pass the posterior bounds."""
    comp, size, side = (table[c].to_numpy() for c in ("comp", "n_shingles", "side"))
    band = table["band"].to_numpy()
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
    cuts = _cuts(table["grp"].to_numpy())
    held_x, held_y, held = [], [], 0

    def judge():
        x, y = np.concatenate(held_x), np.concatenate(held_y)
        keep = (comp[x] != comp[y]) & (np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9)
        x, y = x[keep], y[keep]
        keep = plausible(sig, x, y, threshold)
        x, y = x[keep], y[keep]
        earlier = np.zeros(len(x), bool)
        for k in range(int(band.max(initial=0))):
            at = slice(k * rows, (k + 1) * rows)
            undecided = np.flatnonzero(~earlier & (band[x] > k))
            earlier[undecided] = (sig[x[undecided], at] == sig[y[undecided], at]).all(1)
        return x[~earlier], y[~earlier]

    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            for x, y in _pairs(side[a:b]):
                held_x.append(x + a)
                held_y.append(y + a)
                held += len(x)
                if held >= PAIRS:
                    yield judge()
                    held_x, held_y, held = [], [], 0
    if held:
        yield judge()


def _cuts(group: np.ndarray) -> list[int]:
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))).tolist()


def _pruner(threshold: float, rows: int):
    """Groups of members -> the members that have a surviving pair in their group."""

    def run(batches):
        for table in grouped(batches, "grp", 4 * BLOCK):
            wanted = np.zeros(table.num_rows, bool)
            for x, y in _survivors(table, threshold, rows):
                wanted[x] = wanted[y] = True
            if wanted.any():
                yield from table.filter(pa.array(wanted)).combine_chunks().to_batches()
        trim()

    return run


def words_of(text: bytes) -> frozenset[bytes]:
    """The shingles of a text themselves, their words joined by a space."""
    words = text.lower().split()  # A-Z only, at the separators of the contract
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _confirmer(percent: int, rows: int):
    """Groups of members with their texts -> links (a, b) that hold on the full sets and join two components of the group.

    Sets of hashes are counted first; what they would link is compared once more by the words themselves.
    """

    def run(batches):
        for table in grouped(batches, "grp", 2 * BLOCK):
            ids, lab = table["id"].to_numpy(), table["comp"].to_numpy().copy()
            data, offsets = strings(table["text"])
            text = lambda row: data[offsets[row] : offsets[row + 1]].tobytes()
            sets, bounds = shingle_sets(data, offsets)
            names, code = np.unique(sets, return_inverse=True)
            size = np.diff(bounds)
            mark = np.zeros(len(names), bool)
            out_a, out_b = [], []
            for x, y in _survivors(table, percent / 100, rows):
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                cuts = _cuts(x) if len(x) else [0]
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    one, others = x[s], y[s:e]
                    others = others[lab[others] != lab[one]]
                    if not len(others):
                        continue
                    mine = code[bounds[one] : bounds[one + 1]]
                    mark[mine] = True
                    n = size[others]
                    ends = np.cumsum(n)
                    flat = np.arange(ends[-1]) + np.repeat(bounds[others] - (ends - n), n)
                    common = np.add.reduceat(mark[code[flat]].astype(np.int64), ends - n)
                    mark[mine] = False
                    good = others[100 * common >= percent * (size[one] + n - common)]
                    own = None
                    for other in good.tolist():
                        if lab[other] != lab[one]:
                            own, theirs = own or words_of(text(one)), words_of(text(other))
                            both = len(own & theirs)
                            if 100 * both < percent * (len(own) + len(theirs) - both):
                                continue
                            out_a.append(min(ids[one], ids[other]))
                            out_b.append(max(ids[one], ids[other]))
                            lab[lab == lab[other]] = lab[one]
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
        trim()

    return run


def _classes(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for rows whose texts are equal wherever their non-null ids are."""
    threshold = percent / 100
    rows, bands = bands_of(threshold)
    docs = small_batches(docs)
    signed = materialize(docs.mapInArrow(_signer(rows, bands), _SIGNED), "signed")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    alike = known.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    alike = materialize(alike.drop("copies"), "copies")
    members = materialize(
        signed.select("doc_id", "n_shingles", "h1", "h2").join(alike, ["h1", "h2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "members",
    )
    only = known.join(members.where("doc_id <> rep").select("doc_id").distinct(), "doc_id", "left_anti")

    banded = only.select(F.col("doc_id").alias("id"), "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    shared = materialize(shared.where("members > 1"), "shared")
    buckets = materialize(banded.join(shared, "key"), "buckets")
    signature = known.select(F.col("doc_id").alias("id"), "n_shingles", "sig")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")

    def confirmed(groups: DataFrame) -> DataFrame:
        """Links among the members (grp, band, side, id, comp) of the same group."""
        order = ["grp", "side", "id"]
        full = groups.join(signature, "id").select("grp", "band", "side", "id", "comp", "n_shingles", "sig")
        need = materialize(full.repartition("grp").sortWithinPartitions(*order).mapInArrow(_pruner(threshold, rows), _MEMBER), "survivors")
        texts = need.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
        texts = texts.select("grp", "band", "side", "id", "comp", "n_shingles", "sig", "text").repartition("grp").sortWithinPartitions(*order)
        return materialize(texts.mapInArrow(_confirmer(percent, rows), "a long, b long"), "links")

    together = buckets.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("n"), F.min("n_shingles").alias("size"))
    nearest = together.groupBy("id").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"))).alias("best"), F.min("size").alias("size"))
    nearest = materialize(nearest.select((-F.col("best.p")).alias("pivot"), "id", "size"), "nearest")
    stars = materialize(nearest.groupBy("pivot").agg(F.count("*").alias("members"), F.sum("size").alias("shingles")), "stars")
    rays = nearest.join(stars, "pivot").select(F.xxhash64("pivot", mine).alias("grp"), F.lit(RIGHT).alias("side"), "id", "pivot")
    hubs = rays.groupBy("grp").agg(F.min("pivot").alias("id")).select("grp", F.lit(LEFT).alias("side"), "id")
    links = confirmed(rays.drop("pivot").unionByName(hubs).withColumns({"band": F.lit(0), "comp": F.col("id")}))
    labels = connected_components(links, "a", "b")

    placed = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left")
    placed = materialize(placed.select("key", "band", "id", "members", "shingles", F.coalesce("component", "id").alias("comp")), "placed")
    opened = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    opened = placed.join(materialize(opened, "open"), "key").withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    grp = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), ALL).when(F.col("mine") < F.col("other"), LEFT).otherwise(RIGHT)
    more = confirmed(opened.select(grp.alias("grp"), "band", side.alias("side"), "id", "comp"))
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more), "a", "b")
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )


def _version():
    return F.xxhash64("text").alias("version")


def _surrogates(docs: DataFrame) -> DataFrame | None:
    """(doc_id, version, key): a key beyond all ids for each text of every id that several rows have; None if ids are unique."""
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = materialize(again, "again")
    if again.isEmpty():
        return None
    top = docs.agg(F.max("doc_id")).first()[0]
    texts = docs.select("doc_id", _version()).join(again, "doc_id", "left_semi").distinct()
    return materialize(texts.withColumn("key", F.lit(top + 1) + F.monotonically_increasing_id()), "surrogates")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = _surrogates(docs)
    if names is None:
        out = _classes(docs, percent)
    else:
        keyed = docs.withColumn("version", _version()).join(names, ["doc_id", "version"], "left")
        classes = _classes(keyed.select(F.coalesce("key", "doc_id").alias("doc_id"), "text"), percent)
        back = names.select(F.col("key").alias("doc_id"), F.col("doc_id").alias("own"))
        classes = materialize(classes.join(back, "doc_id", "left").withColumn("own", F.coalesce("own", "doc_id")), "classes")
        least = classes.groupBy("component_id").agg(F.min("own").alias("least"))
        out = classes.join(least, "component_id", "left").select(F.col("own").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest id (of its texts, under an id that several rows have, any one).

    Rows equal in id and text are one document, of which one row stays. Rows with a null id stay.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = _surrogates(ids)
    if names is None:
        gone = _classes(ids, percent).where("doc_id <> component_id").select("doc_id")
        return docs.join(materialize(gone, "gone"), "doc_id", "left_anti").select(docs.columns)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _version())
    keyed = rows.join(names, ["doc_id", "version"], "left").select("row", F.coalesce("key", "doc_id").alias("key"))
    classes = _classes(keyed.select(F.col("key").alias("doc_id"), "row.text"), percent).where("component_id is not null")
    back = names.select(F.col("key").alias("doc_id"), F.col("doc_id").alias("own"))
    classes = materialize(classes.join(back, "doc_id", "left").withColumn("own", F.coalesce("own", "doc_id")).distinct(), "classes")
    chosen = classes.groupBy("component_id").agg(F.min(F.struct("own", "doc_id")).alias("best")).select("best.doc_id")
    gone = classes.join(materialize(chosen, "chosen"), "doc_id", "left_anti").select(F.col("doc_id").alias("key"))
    left = keyed.join(materialize(gone, "gone"), "key", "left_anti")
    renamed = names.select("key")
    alone = left.join(renamed, "key", "left_anti")
    return alone.unionByName(left.join(renamed, "key", "left_semi").dropDuplicates(["key"])).select("row.*")
