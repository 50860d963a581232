"""Exact substring dedup: every window of ``WIDTH`` words is hashed (Rabin-Karp), repeats become removal intervals.

A window is repeated if its word sequence also starts earlier: in a document of smaller ``doc_id`` or earlier in
the same one. Map tasks sort the windows of a stretch of documents, settle repeats within it and send each other
window once, packed in binary columns by hash range (about 10 bytes a window, not a row); reducers settle one range after
another and send back positions only. Windows of one passage fall into many hash ranges, and a stretch sends a passage
once however often it has it, so a hot passage overloads no task. Overlapping repeated windows merge into maximal
intervals. The number of ranges follows from the bytes of all texts (about ``RANGE_WINDOWS`` windows in each at most) and ranges
are dealt evenly to the shuffle partitions; the more ranges, the shorter the packed rows (beyond 10 TB of text some 40 bytes a window).

Windows are compared by two Rabin-Karp hashes of different word values. A window carries as many bits of them as the corpus needs: seven bytes within one of
64 ranges, one more for every eight doublings of the ranges, so the chance that any two different windows of the whole
corpus are taken for one stays under 1/250 at every size.

Null and blank texts have no words; shorter texts than a window lose nothing. Rows of an equal ``doc_id`` are kept apart by a
hash of their texts: an equal start is not an earlier one, so equal rows lose nothing to each other, and what other rows
lose by them stays the same. Rows of a null id are kept whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.words import SECOND, U, mix, rolling, slices, small_batches, strings, trim, word_hashes

WIDTH = 20
STRETCH_WINDOWS, RANGE_WINDOWS = 700_000, 2_000_000
_BINARY = ["docs", "tags", "counts", "at", "hashes"]
_PACKED = "slot int, part int, " + ", ".join(f"{c} binary" for c in _BINARY)


def _planes(x: np.ndarray, size: int) -> bytes:
    """Little-endian bytes, plane by plane: the high planes are mostly zero and compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unplanes(raw: bytes, size: int) -> np.ndarray:
    n = len(raw) // size
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, n).T
    return out.reshape(-1).view("<u8")


def _runs(docs: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal (doc, tag) begin, and their lengths."""
    change = np.flatnonzero(np.concatenate((np.ones(min(1, len(docs)), bool), (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1]))))
    return change, np.diff(change, append=len(docs))


def _pack(slots: int, part: int, docs: np.ndarray, tags: np.ndarray, at: np.ndarray, keys: bytes) -> dict:
    """Windows sorted by (doc, tag, position)."""
    first, counts = _runs(docs, tags)
    return {
        "slot": part % slots, "part": part, "docs": _planes(np.diff(docs[first].view(U), prepend=U(0)), 8), "tags": tags[first].astype("<i8").tobytes(),
        "counts": _planes(counts, 4), "at": _planes(at, 4), "hashes": keys,
    }


def _unpack(docs: bytes, tags: bytes, counts: bytes, at: bytes, hashes: bytes) -> tuple[np.ndarray, ...]:
    times = _unplanes(counts, 4).astype(np.int64)
    d = np.repeat(np.cumsum(_unplanes(docs, 8)).view(np.int64), times)
    return d, np.repeat(np.frombuffer(tags, "<i8"), times), _unplanes(at, 4).astype(np.int64), hashes


def key_bytes(bits: int) -> int:
    """Bytes of a window's hashes within one of ``2**bits`` ranges: with 2**(bits + 21) windows at most, 2**-8 wrong pairs are expected."""
    return max(7, -(-(bits + 49) // 8))


def _keys(h: np.ndarray, g: np.ndarray, bits: int) -> bytes:
    """The ``key_bytes`` of two hashes that follow the first ``bits`` of ``h``."""
    size = key_bytes(bits)
    first = h << U(bits) | g >> U(64 - bits)
    return _planes(first >> U(64 - 8 * size), size) if size <= 8 else _planes(first, 8) + _planes(g, size - 8)


def _unkeys(raw: bytes, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    size = key_bytes(bits)
    return _unplanes(raw[: n * min(size, 8)], min(size, 8)), _unplanes(raw[n * 8 :], size - 8) if size > 8 else np.zeros(n, U)


def _settled(d: np.ndarray, t: np.ndarray, p: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by hashes, whether a window there is its hashes' earliest start, whether it is the first row of them)."""
    order = np.argsort(h)
    alike = h[order][1:] == h[order][:-1]
    same = alike & (g[order][1:] == g[order][:-1])
    if (alike != same).any():
        order = np.lexsort((g, h))
        same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    some = order[shared]
    order[shared] = some[np.lexsort((t[some], p[some], d[some], g[some], h[some]))]
    new = np.concatenate((np.ones(min(1, len(h)), bool), ~same))
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return order, (d[order] == d[head]) & (p[order] == p[head]), new


def _windows(bits: int, slots: int, width: int):
    """Stretches of documents -> packed distinct windows (part >= 0) and repeats already settled (part < 0)."""
    binary = pa.schema([("slot", pa.int32()), ("part", pa.int32())] + [(n, pa.binary()) for n in _BINARY])

    def flush(ids: list, tags: list, counts: list, hashes: list, seconds: list) -> Iterator[pa.RecordBatch]:
        i, t, n, h, g = (np.concatenate(x) for x in (ids, tags, counts, hashes, seconds))
        begin = np.cumsum(n) - n
        by = np.lexsort((t, i))
        by = by[np.concatenate(([True], (i[by][1:] != i[by][:-1]) | (t[by][1:] != t[by][:-1])))]
        n, begin = n[by], begin[by]
        d, t = np.repeat(i[by], n), np.repeat(t[by], n)
        p = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begin, n) + p
        h, g = h[at], g[at]
        order, earliest, _ = _settled(d, t, p, h, g)
        rows = []
        if not earliest.all():
            again = np.sort(order[~earliest])
            rows.append(_pack(slots, -1 - int(h[0] >> U(40)) % (1 << bits), d[again], t[again], p[again], b""))
            order = order[earliest]
        parts = (h[order] >> U(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(parts, prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            o = np.sort(order[a:b])
            rows.append(_pack(slots, int(parts[a]), d[o], t[o], p[o], _keys(h[o], g[o], bits)))
        yield pa.RecordBatch.from_pylist(rows, schema=binary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = ([], [], [], [], []), 0
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            for a, b in slices(offsets):
                words, first = word_hashes(data, offsets[a : b + 1])
                n = np.maximum(np.diff(first) - width + 1, 0)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(first[:-1], n) + within
                for column, values in zip(held, (ids[a:b], tags[a:b], n, rolling(words, width)[at], rolling(mix(words ^ SECOND), width)[at]), strict=True):
                    column.append(values)
                windows += len(within)
                if windows >= STRETCH_WINDOWS:
                    yield from flush(*held)
                    held, windows = ([], [], [], [], []), 0
        if windows:
            yield from flush(*held)
        trim()

    return run


def _settle(part: int, rows: list[dict], bits: int) -> pa.RecordBatch:
    """One hash range: every window but the earliest of its hash, as positions."""
    got = [_unpack(*(row[c] for c in _BINARY)) for row in rows]
    d, t, p = (np.concatenate([x[k] for x in got]) for k in range(3))
    if part >= 0:
        h, g = (np.concatenate(x) for x in zip(*(_unkeys(x[3], len(x[0]), bits) for x in got), strict=True))
        order, earliest, _ = _settled(d, t, p, h, g)
        order = order[~earliest]
        d, t, p = d[order], t[order], p[order]
    order = np.lexsort((p, t, d))
    d, t, p = d[order], t[order], p[order]
    first, counts = _runs(d, t)
    cuts = np.append(first, len(d)).tolist()
    at = [_planes(p[a:b], 4) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(d[first], pa.int64()), pa.array(t[first], pa.int64()), pa.array(at, pa.binary())], ["doc_id", "tag", "at"])


def _settle_parts(bits: int):
    """Rows sorted by part, one part after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["part"] != part:
                    yield _settle(part, rows, bits)
                    rows = []
                part = row["part"]
                rows.append(row)
        if rows:
            yield _settle(part, rows, bits)
        trim()

    return run


def _tag(docs: DataFrame) -> Column:
    """What tells rows of an equal id apart: a hash of the text, or nothing where ids are unique."""
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return F.lit(0).cast("long")
    return F.xxhash64("text")


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, tag, ats) for rows (doc_id, tag, text): for each with repeated windows, packed start positions (first word = 0)."""
    docs = small_batches(docs.where("doc_id is not null and text is not null"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (size // (2 * RANGE_WINDOWS)).bit_length() - 1)  # at most a window in two bytes, mostly in six
    slots = min(1 << bits, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = docs.select("doc_id", "tag", "text").mapInArrow(_windows(bits, slots, width), _PACKED)
    dealt = packed.repartitionById(slots, "slot").sortWithinPartitions("part")
    return dealt.mapInArrow(_settle_parts(bits), "doc_id long, tag long, at binary").groupBy("doc_id", "tag").agg(F.collect_list("at").alias("ats"))


def _remover(width: int, texts: bool, carried: int, names: list[str]):
    def run(batches):
        for batch in batches:
            column, ats = batch.column(carried).cast(pa.binary()), batch.column(carried + 1)
            kept, n_words, n_removed, intervals = [], [], [], []
            for text, blobs in zip(column, ats, strict=True):
                raw = text.as_py() or b""
                words = raw.split()
                n_words.append(len(words))
                spans = []
                if blobs.is_valid:
                    delta = np.zeros(len(words) + 1, np.int64)
                    for blob in blobs.as_py():
                        at = _unplanes(blob, 4).astype(np.int64)
                        delta[at] += 1
                        delta[at + width] -= 1
                    gone = np.cumsum(delta[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    spans = edge.reshape(-1, 2).tolist()
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
                intervals.append([{"first": a, "last": b - 1} for a, b in spans])
            if texts:
                last = pa.array(kept, pa.binary()).cast(pa.string())
            else:
                last = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            added = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last, pa.array(intervals, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *added], names)
        trim()

    return run


def _removed(docs: DataFrame, width: int, carry: list[str], texts: bool) -> DataFrame:
    """Columns ``carry`` as _c0, _c1, ...; then _words, _gone, _kept, _spans. One row for every row of ``docs``."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = small_batches(rows.withColumn("tag", _tag(rows)))
    found = repeated_windows(rows.select("doc_id", "tag", "text"), width)
    kinds = dict(rows.dtypes)
    names = [f"_c{i}" for i in range(len(carry))]
    schema = ", ".join([f"{c} {kinds[c]}" for c in names] + ["_words long, _gone long, _kept string, _spans array<struct<first:long,last:long>>"])
    joined = rows.join(found, ["doc_id", "tag"], "left").select(*names, "text", "ats")
    return joined.mapInArrow(_remover(width, texts, len(carry), [*names, "_words", "_gone", "_kept", "_spans"]), schema)


def remove_repeats(docs: DataFrame, width: int = WIDTH, carry: list[str] | None = None, texts: bool = True) -> DataFrame:
    """``carry`` columns (doc_id alone if not given), then n_words, n_removed, kept_text, removed intervals.

    Without ``texts`` the kept words come as ``kept_sha256`` (joined by one space) instead of ``kept_text``.
    One row for every row of ``docs``; carried columns come first, whatever their names.
    """
    carry = carry or ["doc_id"]
    out = _removed(docs, width, carry, texts)
    return out.toDF(*carry, "n_words", "n_removed", "kept_text" if texts else "kept_sha256", "removed")


def drop_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated windows cut from the texts.

    A text that loses words becomes its kept words joined by one space and ``n_chars`` follows, where there is
    such a column; documents left without a word go. Other rows stay as they are.
    """
    out = _removed(docs, width, docs.columns, True).where("_gone < _words or _words = 0")
    new = {"text": F.col("_kept"), "n_chars": F.length("_kept")}
    return out.select(
        *[F.when(F.col("_gone") > 0, new[c]).otherwise(F.col(f"_c{i}")).cast(t).alias(c) if c in new else F.col(f"_c{i}").alias(c) for i, (c, t) in enumerate(docs.dtypes)]
    )
