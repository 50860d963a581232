"""A semantic index of files as tables: chunks, their share of a cap, embeddings, coarse cells, search and incremental refresh.

* ``cut`` gives the chunks of text files; ``operators.structure`` those of code. ``capped`` keeps each file's first chunks by its slots.
* ``embed`` turns a chunk's head into counts of hashed tokens (integers, so similarities are exact to the last digit).
* ``train`` fits unit centroids on a bounded sample of the vectors; ``place`` puts every vector into the cell of its nearest
  centroid, with the angle to it. Cells' radii are the largest angles.
* ``search`` visits each query's nearest cells first. ``exact`` then visits those other cells that the triangle inequality of angles
  does not exclude: no vector of a cell is nearer to the query than the angle to the centroid less the radius. Within a cell, rows
  whose own angle excludes them are left out before anything is multiplied.
* ``refresh`` embeds only chunks of changed files again, under a work budget, and merges them by key into the next version.

Cells are put together, or cut, into groups of about ``BLOCK`` vectors. A group meets blocks of the queries that visit any of its cells, a task each: a
query's vector is sent once a group, not once a cell, and a task sends on k rows a query, never pairs. Candidates are found in single precision
with room for its error, and their similarities computed in double.
Null and blank texts have no chunks; a chunk without a token has a zero vector, similarity 0 to all.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.budget import slots
from tessera.scratch import materialize

DIMS, HEAD, LONGEST, CAP = 128, 600, 2000, 1000
#: Bounds: vectors that centroids are fitted on, cells, rows of a group of vectors and of a block of queries, queries multiplied at once, numbers of a
#: product held at once.
SAMPLE, MOST_CELLS, BLOCK, QUERIES, AT_ONCE, NUMBERS = 20_000, 4096, 32_768, 32_768, 256, 1 << 20
#: What single precision may be off by in the product of two unit vectors, and double precision in an angle.
ROUGH, FINE = 2e-5, 1e-7
_TOKEN = re.compile(r"[^\W_]+")


def cut(files: DataFrame, most: int = LONGEST) -> DataFrame:
    """(path, place, first, content): the lines of each file (path, text) that are not blank, numbered from 1; longer ones in pieces of ``most`` characters."""
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "content")).where(F.trim("content") != "")
    pieces = F.sequence(F.lit(0), F.floor((F.length("content") - 1) / most).cast("int"))
    pieces = lines.select("path", (F.col("line") + 1).alias("first"), "content", F.explode(pieces).alias("piece"))
    pieces = pieces.select("path", "first", "piece", F.substr("content", F.col("piece") * most + 1, F.lit(most)).alias("content"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("first", "piece"))
    return pieces.select("path", place.alias("place"), "first", "content")


def capped(chunks: DataFrame, most: int = CAP) -> DataFrame:
    """The first chunks of each file: one for each file and the rest by its share of all chunks, ``most`` in all; with more files than that, one of each of those with the most chunks."""
    counts = materialize(chunks.groupBy("path").agg(F.count("*").alias("n")), "chunk_counts")
    if counts.count() > most:
        given = counts.orderBy(F.col("n").desc(), "path").limit(most).select("path", F.lit(1).cast("long").alias("slots"))
    else:
        given = slots(counts, "path", "n", most).select("path", "slots")  # at most ``most`` rows
    return chunks.join(F.broadcast(materialize(given, "slots")), "path").where("place <= slots").drop("slots")


def _slot(token: str) -> tuple[int, int]:
    h = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(h[:2]) % DIMS, 1 if h[2] % 2 == 0 else -1


class _Slots(dict):
    """Twice a token's place, and one more if it takes; forgets all when it is full."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        at, sign = _slot(token)
        self[token] = code = 2 * at + (sign < 0)
        return code


def hashed(text: str) -> np.ndarray:
    """Counts of the tokens of a text: each adds or takes one at the place that its hash names."""
    out = np.zeros(DIMS, np.int32)
    for token in _TOKEN.findall(text.lower()):
        at, sign = _slot(token)
        out[at] += sign
    return out


def _counts(texts: list[str], known: _Slots) -> np.ndarray:
    """``hashed`` of many texts at once, a row each."""
    tokens = [_TOKEN.findall(t.lower()) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
    slot = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.int64, len(row))
    return np.bincount(row * DIMS + slot // 2, 1.0 - slot % 2 * 2, len(texts) * DIMS).reshape(-1, DIMS)


def embed(rows: DataFrame, content: str = "content", head: int = HEAD) -> DataFrame:
    """``rows`` with ``vector``: the hashed tokens of the first ``head`` characters of the column ``content`` (the head is the feature)."""
    names, at = rows.columns, rows.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Slots()
        for batch in batches:
            flat = pa.array(_counts([(t or "")[:head] for t in batch.column(at).to_pylist()], known).astype(np.int32).ravel())
            bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * DIMS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(bounds, flat)], [*names, "vector"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, vector array<int>")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose products with ``width`` vectors stay within ``NUMBERS``."""
    most = max(1, NUMBERS // max(1, width))
    return (batch.slice(at, most) for at in range(0, batch.num_rows, most))


def train(vectors: DataFrame, cells: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids (cells, dims) by spherical k-means over at most ``SAMPLE`` vectors, those with the smallest hashes, in rounds of Spark."""
    spread = F.xxhash64("vector")
    sample = materialize(vectors.select("vector").orderBy(spread).limit(SAMPLE), "sample")
    first = sample.orderBy(F.xxhash64("vector", F.lit(1))).dropDuplicates(["vector"]).limit(min(cells, MOST_CELLS)).toArrow()
    centroids = _units(_matrix(first["vector"])) if first.num_rows else np.zeros((1, DIMS))
    for _ in range(rounds):

        def sums(batches, centroids=centroids):
            for batch in batches:
                total, taken = np.zeros_like(centroids), np.zeros(len(centroids), bool)
                for piece in _pieces(batch, len(centroids)):
                    x = _units(_matrix(piece.column("vector")))
                    best = (x @ centroids.T).argmax(1)
                    np.add.at(total, best, x)
                    taken[best] = True
                some = np.flatnonzero(taken)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["cell", "total"])

        parts = sample.mapInArrow(sums, "cell long, total array<double>").toArrow()  # of the bounded sample
        total = np.zeros_like(centroids)
        if parts.num_rows:
            np.add.at(total, parts["cell"].to_numpy(), _matrix(parts["total"]))
        filled = (total != 0).any(1)
        centroids = np.where(filled[:, None], _units(total), centroids)
    return centroids


def place(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` with ``cell`` and ``angle``, the angle to the cell's centroid in radians."""
    names = vectors.columns
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CELLS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        rough = np.ascontiguousarray(centres.T, np.float32)
        for batch in batches:
            cells, angles = [np.empty(0, np.int64)], [np.empty(0)]
            for piece in _pieces(batch, len(centres)):
                x = _units(_matrix(piece.column(names.index("vector"))))
                cells.append((x.astype(np.float32) @ rough).argmax(1))
                angles.append(np.arccos(np.clip((x * centres[cells[-1]]).sum(1), -1, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(angles))], [*names, "cell", "angle"])

    schema = ", ".join(f"`{n}` {t}" for n, t in vectors.dtypes)
    return vectors.mapInArrow(run, f"{schema}, cell int, angle double")


class _Cells(NamedTuple):
    """Filled cells, a place each: their numbers, unit centroids and radii, the group that each begins at and how many it takes."""

    number: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    parts: np.ndarray


def _grouped(sizes: list, centroids: np.ndarray) -> _Cells:
    """Cells (cell, n, radius), at most ``MOST_CELLS``, in groups of about ``BLOCK`` vectors: small ones share a group, a large one takes several."""
    start, parts, group, room = [], [], -1, 0
    for r in sizes:
        parts.append(-(-r.n // BLOCK))
        if r.n > room:
            start.append(group + 1)
            group, room = group + parts[-1], BLOCK - r.n if parts[-1] == 1 else 0
        else:
            start.append(group)
            room -= r.n
    number = np.array([r.cell for r in sizes], np.int64)
    return _Cells(number, centroids[number], np.array([r.radius for r in sizes], float), np.array(start, np.int64), np.array(parts, np.int64))


def _entered(angle: np.ndarray, radius: np.ndarray, least: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which cells (angle: a row a query, a column a cell) lie within ``reach`` and may hold something as similar as ``least``."""
    return (angle <= reach[:, None] + FINE) & (np.cos(np.maximum(0, angle - radius)) >= least[:, None] - FINE)


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def _visits(queries: DataFrame, shared, probes: int, first: bool) -> DataFrame:
    """(query, vector, group, least, reach): the groups that a query goes to, as they hold a cell that it enters.

    At first its ``probes`` nearest cells, ``reach`` being the angle to the last; later all that could hold something as similar as ``least``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        if not len(cells.number):
            return
        groups = int((cells.start + cells.parts).max())
        for whole in batches:
            for batch in _pieces(whole, max(len(cells.number), 16 * groups)):  # rows go on with their vectors, so they are fewer
                angle = _angles(_units(_matrix(batch.column("vector"))), cells.centre)
                least = batch.column("least").to_numpy(zero_copy_only=False)
                last = min(probes, len(cells.number)) - 1
                reach = np.partition(angle, last, 1)[:, last] if first else np.full(len(angle), np.pi)
                row, cell = np.nonzero(_entered(angle, cells.radius, least, reach))
                parts = cells.parts[cell]
                within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                gone = np.unique(np.repeat(row * groups + cells.start[cell], parts) + within)
                row, take = gone // groups, pa.array(gone // groups)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query").take(take), batch.column("vector").take(take), pa.array(gone % groups, pa.int64()), pa.array(least[row]), pa.array(reach[row])],
                    ["query", "vector", "group", "least", "reach"],
                )

    return queries.select("query", "vector", "least").mapInArrow(run, "query long, vector array<int>, group long, least double, reach double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query, hits): the ``k`` most similar ids of each query, ties by id."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "id")))
    return found.groupBy("query").agg(F.slice(ordered, 1, k).alias("hits"))


def _firsts(query: np.ndarray, id_: np.ndarray, similarity: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` most similar rows of each query, ties by id, ordered by query."""
    order = np.lexsort((id_, -similarity, query))
    by = query[order]
    new = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.empty(0, np.int64)
    rank = np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by))))
    return order[rank < k]


def _matched(one: pa.Table, two: pa.Table, cells: _Cells, k: int) -> pa.Table:
    """(query, id, similarity): the best ``k`` of the vectors ``one`` of a group for each of the queries ``two``, if as similar as its ``least``."""
    asked, held = [np.empty(0, np.int64)], [(np.empty(0, np.int64), np.empty(0))]
    if one.num_rows and two.num_rows:
        at = np.searchsorted(cells.number, one["cell"].to_numpy())
        order = np.lexsort((one["angle"].to_numpy(), at))
        ids, angle, at = one["id"].to_numpy()[order], one["angle"].to_numpy()[order], at[order]
        x, q = _matrix(one["vector"])[order], _matrix(two["vector"])
        unit = _units(q)
        unit_x, unit_q = _units(x).astype(np.float32), unit.astype(np.float32)
        size_x, size_q = (np.einsum("ij,ij->i", y, y, dtype=np.float64) for y in (x, q))
        least, reach = two["least"].to_numpy().copy(), two["reach"].to_numpy()
        present, begin = np.unique(at, return_index=True)
        for cell, lo, hi in zip(present.tolist(), begin.tolist(), [*begin[1:].tolist(), len(at)]):
            near = _angles(unit, cells.centre[[cell]])
            some = np.flatnonzero(_entered(near, cells.radius[[cell]], least, reach)[:, 0])
            some = some[np.argsort(near[some, 0], kind="stable")]
            for part in (some[i : i + AT_ONCE] for i in range(0, len(some), AT_ONCE)):
                # Rows whose angle to the centroid is as far from every one of these queries as excludes them.
                room = np.arccos(np.clip(least[part].min() - FINE, -1, 1)) + FINE
                rows = slice(lo + np.searchsorted(angle[lo:hi], near[part[0], 0] - room), lo + np.searchsorted(angle[lo:hi], near[part[-1], 0] + room, "right"))
                width = max(1, NUMBERS // len(part))
                for a in range(rows.start, rows.stop, width):
                    b = min(a + width, rows.stop)
                    s = unit_q[part] @ unit_x[a:b].T
                    hit = s >= (least[part] - ROUGH)[:, None].astype(np.float32)
                    if np.count_nonzero(hit) > 2 * k * len(part) and b - a > k:
                        hit &= s >= np.partition(s, b - a - k, 1)[:, b - a - k, None] - np.float32(2 * ROUGH)
                    i, j = np.divmod(np.flatnonzero(hit), b - a)
                    if not len(i):
                        continue
                    i, j = part[i], j + a
                    dot = np.concatenate([np.einsum("ij,ij->i", q[i[c : c + BLOCK]], x[j[c : c + BLOCK]], dtype=np.float64) for c in range(0, len(i), BLOCK)])
                    both = size_q[i] * size_x[j]
                    exact = np.where(both > 0, dot / np.sqrt(np.where(both > 0, both, 1)), 0.0)
                    best = _firsts(i, ids[j], exact, k)
                    i, j, exact = i[best], j[best], exact[best]
                    full = np.flatnonzero(i[k - 1 :] == i[: max(0, len(i) - k + 1)])
                    least[i[full]] = np.maximum(least[i[full]], exact[full + k - 1])
                    good = exact >= least[i] - FINE
                    asked.append(i[good])
                    held.append((ids[j[good]], exact[good]))
    i, id_, s = np.concatenate(asked), np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    best = _firsts(i, id_, s, k)
    return pa.table({"query": pa.array(two["query"].to_numpy()[i[best]] if len(best) else [], pa.int64()), "id": pa.array(id_[best], pa.int64()), "similarity": pa.array(s[best], pa.float64())})


def _compared(vectors: DataFrame, visits: DataFrame, places: DataFrame, shared, k: int) -> DataFrame:
    """(query, id, similarity): the best ``k`` of each query in each group that it visits."""
    of = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = visits.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("askers"))
    known = F.broadcast(materialize(known, "groups"))  # a row a group: at most MOST_CELLS and one for each BLOCK of vectors
    left = vectors.join(F.broadcast(places), "cell").withColumn("group", F.col("start") + of("id", F.col("parts"))).join(known, "group")
    left = left.select("group", "id", "vector", "cell", "angle", every("askers").alias("asker"))
    right = visits.join(known, "group").select("group", "query", "vector", "least", "reach", of("query", F.col("askers")).alias("asker"))
    match = lambda one, two: _matched(one, two, shared.value, k)
    return left.groupBy("group", "asker").cogroup(right.groupBy("group", "asker")).applyInArrow(match, "query long, id long, similarity double")


def search(vectors: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int, exact: bool = False) -> DataFrame:
    """(query, id, similarity, place): the ``k`` nearest of the placed ``vectors`` (id, vector, cell, angle) to each of ``queries`` (query, vector).

    Rows with a similarity no better than that of ``k`` others are not all looked at; with ``exact`` none of the best is missed. Of equal vectors
    only the ``k`` smallest ids can be among the best, so others are left out first. Equal queries are asked once.
    """
    spark = vectors.sparkSession
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    vectors = materialize(vectors.withColumn("copy", copy).where(F.col("copy") <= k).drop("copy"), "first_copies")
    sizes = vectors.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).orderBy("cell").collect()  # at most MOST_CELLS
    cells = _grouped(sizes, centroids)
    places = spark.createDataFrame(list(zip(cells.number.tolist(), cells.start.tolist(), cells.parts.tolist())), "cell int, start long, parts int")
    shared = spark.sparkContext.broadcast(cells)
    queries = materialize(queries.select("query", "vector"), "queries")
    asked = materialize(queries.groupBy("vector").agg(F.min("query").alias("query")).select("query", "vector", F.lit(-2.0).alias("least")), "asked")
    found = materialize(_compared(vectors, materialize(_visits(asked, shared, probes, True), "visits"), places, shared, k), "found")
    if exact:
        kth = _best(found, k).select("query", F.when(F.size("hits") == k, -F.element_at("hits", -1)["far"]).otherwise(-2.0).alias("least"))
        again = asked.drop("least").join(kth, "query", "left").fillna(-2.0, ["least"])
        found = materialize(_compared(vectors, materialize(_visits(again, shared, probes, False), "more_visits"), places, shared, k), "more_found")
    ranked = _best(found, k).join(asked.select("query", "vector"), "query").select("vector", F.posexplode("hits").alias("place", "hit"))
    ranked = queries.join(ranked, "vector")
    return ranked.select("query", "hit.id", (-F.col("hit.far")).alias("similarity"), (F.col("place") + 1).alias("place"))


def similar(vectors: DataFrame, text: str) -> DataFrame:
    """``vectors`` with ``similarity``, the cosine with one text, by a flat scan."""
    names, query = vectors.columns, hashed(text[:HEAD]).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(names.index("vector"))).astype(np.float64) if batch.num_rows else np.zeros((0, DIMS))
            both = (x * x).sum(1) * (query @ query)
            cos = np.where(both > 0, (x @ query) / np.sqrt(np.where(both > 0, both, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cos)], [*names, "similarity"])

    schema = ", ".join(f"`{n}` {t}" for n, t in vectors.dtypes)
    return vectors.mapInArrow(run, f"{schema}, similarity double")


def nearest(files: DataFrame, text: str, k: int, most: int = LONGEST) -> DataFrame:
    """(path, place, similarity) of the ``k`` chunks of ``files`` (path, text) most like one text, then by path and place.

    As ``cut``, ``embed`` and ``similar``, but a file is cut, embedded and compared where it is read: neither texts nor vectors leave their task, which
    sends on ``k`` rows a batch. Each row of ``files`` is a file, so rows of an equal path are numbered apart.
    """
    query = hashed(text[:HEAD]).astype(np.float64)

    def chunks_of(batch: pa.RecordBatch) -> Iterator[tuple[str | None, int, str]]:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = (line for line in (content or "").split("\n") if line.strip(" "))
            for n, head in enumerate((line[at : at + min(HEAD, most)] for line in lines for at in range(0, len(line), most)), 1):
                yield path, n, head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Slots()
        for batch in batches:
            best, cut = [], chunks_of(batch)
            while some := list(islice(cut, min(BLOCK, 4096))):
                x = _counts([head for _, _, head in some], known)
                both = (x * x).sum(1) * (query @ query)
                near = np.where(both > 0, (x @ query) / np.sqrt(np.where(both > 0, both, 1)), 0.0)
                bar = np.sort(near)[-min(k, len(near))]
                found = [(-near[i], some[i][0] is not None, some[i][0] or "", some[i][1]) for i in np.flatnonzero(near >= bar).tolist()]
                best = heapq.nsmallest(k, best + found)
            columns = [pa.array([p if there else None for _, there, p, _ in best], pa.string()), pa.array([b[3] for b in best], pa.int32()), pa.array([-b[0] for b in best], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "place", "similarity"])

    return files.select("path", "text").mapInArrow(run, "path string, place int, similarity double").orderBy(F.col("similarity").desc(), "path", "place").limit(k)


def changed(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state): files of ``stored`` (path, hash) whose content is another in ``current`` (path, hash), or that are gone."""
    both = stored.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "left")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.when(F.col("new").isNull(), "removed").otherwise("changed").alias("state"))


def refresh(files: DataFrame, chunks: DataFrame, current: DataFrame, most: int = 100, cutter=cut) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, chunks, embedded) of the next version: only chunks of changed files are embedded again.

    ``files`` (path, hash) and ``chunks`` (path, place, first, content, vector) are stored, ``current`` is (path, hash, text). Changed
    files are taken by path until ``most`` chunks are made (the file that crosses the budget is whole); later ones stay as they
    are stored, to be taken by the next call. Files that are gone lose their chunks. New files are no business of a refresh. ``embedded`` holds the new chunks.
    """
    states = materialize(changed(files, current), "changed")
    cuts = materialize(cutter(current.join(states.where("state = 'changed'").select("path"), "path", "left_semi")), "cuts")
    first = cuts.groupBy("path").agg(F.count("*").alias("n")).orderBy("path").limit(most)  # the budget ends within them, as each has a chunk
    before = F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    stop = first.withColumn("before", before).where(F.col("before") >= most).agg(F.min("path").alias("stop"))
    done = states.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("path") < F.col("stop"))).select("path", "state")  # one row
    done = materialize(done, "done")
    embedded = materialize(embed(cuts.join(done.select("path"), "path", "left_semi")), "embedded")
    kept = chunks.join(done.select("path"), "path", "left_anti").select(*embedded.columns)
    hashes = current.select("path", F.col("hash").alias("new")).join(done.where("state = 'changed'").select("path"), "path", "left_semi")
    left = files.join(done.where("state = 'removed'").select("path"), "path", "left_anti").join(hashes, "path", "left")
    return left.select("path", F.coalesce("new", "hash").alias("hash")), kept.unionByName(embedded), embedded
