"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are counted over all documents and numbered by falling frequency (ties: smaller id first), so that frequent ids
take one byte. Each block of documents holds its control bytes (two bits an id: bytes used less one, four ids a byte) apart
from its data bytes; decoding is table lookup in numpy. Blocks are rows of Parquet files in the shared store, ordered by
(part, block): ascending ``doc_id`` over the whole table. Next to ``blocks`` lie the ``ranks``.

Null texts are empty; an empty document is its end id alone. Rows of a null id come first (in the files their id is
``NO_ID``); rows of an equal id follow each other, by their ids' crc32. An empty table gives no blocks.

Documents are put in order range by range of (doc_id, crc32): ranges hold about ``RANGE_IDS`` ids (there are about ``MAX_RANGES`` at most, whose
bounds and totals the driver sees), many to a task, settled one after another. The bounds are integers from the documents' ids and
sizes, sorted by Spark; an id that many rows have spans ranges by crc32, and rows equal in both are dealt to all ranges between equal bounds.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.tokens import encoded, forget
from tessera.llm.words import small_batches, trim
from tessera.scratch import drop_path, materialize, new_path

BLOCK_IDS, RANGE_IDS, MAX_RANGES = 1 << 19, 4_000_000, 1 << 20
NO_ID = -(1 << 63)
_LENGTHS = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values back, by lookup of each control byte's four lengths."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    value = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        value |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    return value & _MASKS[size]


def _shrink(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unshrink(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1)


def _chunk(part: int, docs: np.ndarray, lengths: np.ndarray, crcs: np.ndarray, values: np.ndarray) -> dict:
    return {
        "part": part, "n": len(values), "docs": docs.astype("<i8").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "crcs": crcs.astype("<u4").tobytes(), "ids": _shrink(values)
    }


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    docs, lengths, crcs = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["lengths"], "<u4").astype(np.int64), np.frombuffer(row["crcs"], "<u4")
    return docs, lengths, crcs, _unshrink(row["ids"], row["n"])


_CHUNK = "part int, n long, docs binary, lengths binary, crcs binary, ids binary"
_CHUNK_TYPE = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("crcs", pa.binary()), ("ids", pa.binary())])
_BLOCK = "part int, block int, n_ids long, docs binary, lengths binary, control binary, data binary"


def _crcs(ids: np.ndarray, bounds: np.ndarray) -> list[int]:
    raw, at = memoryview(ids.tobytes()), (4 * bounds).tolist()
    return [zlib.crc32(raw[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]


def _tokeniser(path: str, end_id: int):
    """Texts -> chunks of documents (part 0)."""

    def run(batches):
        for batch in batches:
            docs = batch.column("doc_id").to_numpy()
            for a, b, ids, bounds in encoded(path, batch.column("text"), end_id):
                yield pa.RecordBatch.from_pylist([_chunk(0, docs[a:b], np.diff(bounds), np.array(_crcs(ids, bounds), np.uint32), ids)], schema=_CHUNK_TYPE)
        trim()

    return run


def _counter(batches):
    forget()
    total = np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            got = np.bincount(_unshrink(row["ids"], row["n"]), minlength=len(total)).astype(np.int64)
            got[: len(total)] += total
            total = got
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])
    trim()


def _sizes(batches):
    """Chunks without their ids -> (doc_id, crc, n) of each document."""
    for batch in batches:
        columns = [np.concatenate([np.frombuffer(x, kind) for x in batch.column(c).to_pylist()] or [np.empty(0, kind)]) for c, kind in (("docs", "<i8"), ("crcs", "<u4"), ("lengths", "<u4"))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc_id", "crc", "n"])


def _bounder(step: int):
    """Documents in order -> the last (doc_id, crc) of every ``step`` ids."""

    def run(batches):
        held = 0
        for batch in batches:
            ends = held + np.cumsum(batch.column("n").to_numpy())
            full = np.flatnonzero(np.diff(ends // step, prepend=held // step))
            held = int(ends[-1]) if len(ends) else held
            yield batch.select(["doc_id", "crc"]).take(pa.array(full))

    return run


def _bounds(coded: DataFrame, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (doc_id, crc) in order, about ``step`` ids apart: at most the ids / ``step``."""
    sizes = coded.select("docs", "crcs", "lengths").mapInArrow(_sizes, "doc_id long, crc long, n long")
    ordered = materialize(sizes, "sizes").repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    table = ordered.mapInArrow(_bounder(step), "doc_id long, crc long").toArrow().sort_by([("doc_id", "ascending"), ("crc", "ascending")])
    return table["doc_id"].to_numpy(), table["crc"].to_numpy()


def _range_of(docs: np.ndarray, crcs: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], turn: int) -> np.ndarray:
    """Range of each document: how many bounds are before it; documents equal to several take the ranges between them by turns."""
    low, high = (np.searchsorted(bounds[0], docs, side) for side in ("left", "right"))
    for doc in np.unique(docs[low < high]).tolist():
        some = np.flatnonzero(docs == doc)
        a, b = low[some[0]], high[some[0]]
        low[some], high[some] = (a + np.searchsorted(bounds[1][a:b], crcs[some], side) for side in ("left", "right"))
    return low + (turn + np.arange(len(docs))) % (high - low + 1)


def _ranked(ranks, bounds):
    """Ids -> ranks, and each chunk cut by the range that its documents belong to."""

    def run(batches):
        forget()
        turn = 0
        for batch in batches:
            for row in batch.to_pylist():
                docs, lengths, crcs, ids = _open(row)
                values, ends = ranks.value[ids], np.cumsum(lengths)
                part = _range_of(docs, crcs.astype(np.int64), bounds.value, turn)
                turn += len(docs)
                out = []
                for p in np.unique(part).tolist():
                    some = np.flatnonzero(part == p)
                    pieces = [values[e - n : e] for e, n in zip(ends[some].tolist(), lengths[some].tolist(), strict=True)]
                    out.append(_chunk(p, docs[some], lengths[some], crcs[some], np.concatenate(pieces)))
                yield pa.RecordBatch.from_pylist(out, schema=_CHUNK_TYPE)
        trim()

    return run


def _blocks(batches):
    """Chunks sorted by part -> blocks of about ``BLOCK_IDS`` ids in the order of (doc_id, crc32)."""

    def settle(part: int, rows: list):
        opened = [_open(r) for r in rows]
        docs, lengths, crcs = (np.concatenate([o[i] for o in opened]) for i in range(3))
        values, ends = np.concatenate([o[3] for o in opened]), np.cumsum(lengths)
        order = np.lexsort((crcs, docs))
        block = start = 0
        filled = np.cumsum(lengths[order])
        while start < len(order):
            before = filled[start - 1] if start else 0
            stop = min(len(order), int(np.searchsorted(filled, before + BLOCK_IDS)) + 1)
            some = order[start:stop]
            ids = np.concatenate([values[e - n : e] for e, n in zip(ends[some].tolist(), lengths[some].tolist(), strict=True)])
            control, data = encode_ranks(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([docs[some].astype("<i8").tobytes()], pa.binary()),
                 pa.array([lengths[some].astype("<u4").tobytes()], pa.binary()), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["part", "block", "n_ids", "docs", "lengths", "control", "data"],
            )
            block, start = block + 1, stop

    forget()
    part, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["part"] != part:
                yield from settle(part, rows)
                rows = []
            part = row["part"]
            rows.append(row)
    if rows:
        yield from settle(part, rows)
    trim()


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """Tokenise ``docs`` (doc_id, text), append ``end_id`` to each and write ``path``/blocks and ``path``/ranks."""
    rows = small_batches(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text"))
    spark = rows.sparkSession
    token_path = new_path(spark, "token_ids")
    rows.mapInArrow(_tokeniser(vocabulary, end_id), _CHUNK).write.parquet(token_path)
    coded = spark.read.schema(_CHUNK).parquet(token_path)
    counts = coded.mapInArrow(_counter, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted = sorted((-r.n, r.id) for r in counts.collect())  # at most the vocabulary
    ids = np.array([i for _, i in counted], np.int64)
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    total = -sum(n for n, _ in counted)
    step = max(RANGE_IDS, -(-total // MAX_RANGES))
    bounds = _bounds(coded, step) if total > step else (np.empty(0, np.int64), np.empty(0, np.int64))
    ranges = len(bounds[0]) + 1
    share = spark.sparkContext.broadcast
    cut = coded.mapInArrow(_ranked(share(rank_of), share(bounds)), _CHUNK)
    tasks = max(1, min(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = cut.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part")
    ordered.mapInArrow(_blocks, _BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    drop_path(spark, token_path)


def _reader(ids, with_ids: bool):
    def run(batches):
        forget()
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                values = ids.value[decode_ranks(row["control"], row["data"], row["n_ids"])]
                cuts = np.concatenate(([0], np.cumsum(lengths)))
                raw = values.tobytes() if with_ids else b""
                pieces = [raw[4 * a : 4 * b] if with_ids else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                docs = np.frombuffer(row["docs"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=docs == NO_ID), pa.array(row["start"] + cuts[:-1]), pa.array(lengths), pa.array(_crcs(values, cuts), pa.int64()), pa.array(pieces, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )
        trim()

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]): start counts the ids of all documents before."""
    from pyspark.sql import Window

    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    ranks = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()  # at most the vocabulary
    ids = spark.sparkContext.broadcast(np.array([r.id for r in ranks], "<u4"))
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a range
    bases, base = [], 0
    for r in totals:
        bases.append((r.part, base))
        base += r.n
    first = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("part", "block", (F.coalesce(before, F.lit(0))).alias("inner")).join(first, "part")
    starts = materialize(starts.select("part", "block", (F.col("inner") + F.col("base")).alias("start")), "starts")
    out = blocks.join(starts, ["part", "block"]).mapInArrow(
        _reader(ids, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )
    return out if with_ids else out.drop("ids")
