"""Packing into training sequences: first-fit decreasing over a tournament tree of bin capacities.

Each document's ids plus an end id are cut into full sequences and one remainder. Remainders are dealt into
randomised groups (by a random number that is written with each piece, so equal rows spread like others; about ``GROUP`` remainders each, however many there are) and each group
is packed on its own: largest first into the first open sequence with room, found in O(log n) by descending a
tournament tree whose inner nodes hold the largest room below. A group's last sequence is trimmed to a power of two where it holds exactly one.

Null texts are empty; an empty document is its end id alone. Rows are packed one by one, so repeated rows and ids
each get their pieces; ties in size go by document id. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.tokens import encoded, forget
from tessera.llm.words import small_batches, trim
from tessera.scratch import materialize

LENGTH, GROUP = 4096, 8192
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _cutter(path: str, end_id: int, length: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            docs = batch.column("doc_id")
            for a, b, ids, bounds in encoded(path, batch.column("text"), end_id):
                n = np.diff(bounds)
                count = -(-n // length)
                row = np.repeat(np.arange(b - a), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * length
                size = np.minimum(length, n[row] - start)
                raw, at = memoryview(ids.tobytes()), (4 * (bounds[row] + start)).tolist()
                pieces = [raw[s : s + 4 * k] for s, k in zip(at, size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(a, b - a).take(pa.array(row)), pa.array(start), pa.array(size), pa.array(list(map(zlib.crc32, pieces)), pa.int64()), pa.array(n[row]),
                     pa.array([bytes(p) for p in pieces] if with_ids else [None] * len(pieces), pa.binary())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )
        trim()

    return run


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size, given in decreasing order; no size exceeds ``capacity``."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * n, [0] * n
    for item, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item] = node - leaves
        offsets[item] = capacity - room[node]
        room[node] -= size
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def _packer(length: int):
    def pack(key, table):
        forget()
        sizes = table["length"].to_numpy()
        order = np.lexsort((table["ids_crc32"].to_numpy(), table["doc_id"].fill_null(-1).to_numpy(), -sizes))
        bins, offsets = first_fit_decreasing(sizes[order], length)
        table = table.take(pa.array(order)).drop_columns(["grp"])
        sequence = (np.int64(key[0].as_py()) << np.int64(32)) + bins
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    return pack


def pack(docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset.

    ``with_ids`` adds each piece's ids (little-endian unsigned 32-bit). A sequence is padded to ``length``
    unless its pieces fill exactly a power of two.
    """
    docs = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    pieces = docs.mapInArrow(_cutter(vocabulary, end_id, length, with_ids), _PIECES)
    pieces = materialize((pieces if with_ids else pieces.drop("ids")).withColumn("deal", F.rand(17)), "pieces")
    full = pieces.where(F.col("length") == length).drop("deal")
    rest = pieces.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    rest = rest.withColumn("grp", F.floor(F.col("deal") * groups).cast("int")).drop("deal")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.schema) + ", sequence_id long, offset long"
    packed = rest.groupBy("grp").applyInArrow(_packer(length), schema)
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return alone.unionByName(packed)
