"""Whole-text tokenisation with the ``tokenizers`` library and a table of known stretches per worker.

Both public vocabularies cut texts at white space before anything else, so a text's ids are the ids of its
``white space + word`` stretches one after another; punctuation at the end of a stretch stands apart where a Latin letter or
digit comes before it, since both vocabularies cut there, too. Stretches are found and hashed (64 bits) on Arrow buffers
in numpy and looked up in an open-addressing table; ids of known ones are gathered at once. New stretches go through the
library, joined: plain words by a space, as their tokens show where a word begins or ends, others by a special token's
string, at which the library always cuts and which no stretch contains. Stretches of over ``LONG`` bytes, and texts with
white space or separators outside plain ASCII or with a special token's string, are encoded by the library each on its own. The
table is bounded: beyond ``KNOWN`` stretches it starts anew.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm.words import BASE, BASE_INV, Table, U, mix, powers, slices, strings

KNOWN, LONG, JOINED, CHUNK = 1_000_000, 64, 256, 1 << 19
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x0A, 0x0D, 0x09]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Characters that may be white space or break words for one of the vocabularies.
ODD = [*map(chr, [0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])]
_rng = np.random.default_rng(50)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


class Encoder:
    """Ids of whole texts, as the library gives them without special tokens added."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in special.values()]
        self.cut_id, token = next(iter(special.items()))
        self.cut = token.content
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether words end in tokens of their own, or begin in such that start with a space.
        self.ends = self.tokenizer.normalizer is not None
        self.edge = np.zeros(max(names.values()) + 1, bool)
        self.edge[[i for name, i in names.items() if (name.endswith("</w>") if self.ends else name.startswith("Ġ"))]] = True
        self.table = Table(KNOWN)
        self._clear()

    def _clear(self) -> None:
        self.table.clear()
        self.known = self.used = 0
        self.start, self.size, self.pool = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, stretches: list[str], joint: str, sizes_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(stretches), JOINED * 16):
            some = stretches[a : a + JOINED * 16]
            groups = [some[i : i + JOINED] for i in range(0, len(some), JOINED)]
            for group, ids in zip(groups, self._library([joint.join(g) for g in groups]), strict=True):
                ids, sizes = sizes_of(ids)
                if len(sizes) != len(group):
                    raise ValueError("stretches and tokens disagree")
                yield ids, sizes

    def _words(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Plain words (Latin letters, for vocabularies without word ends behind one space)."""

        def sizes_of(ids):
            at = np.flatnonzero(self.edge[ids])
            return ids, np.diff(at, prepend=-1) if self.ends else np.diff(at, append=len(ids))

        return self._joined(words, " " if self.ends else "", sizes_of)

    def _others(self, stretches: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        def sizes_of(ids):
            cut = ids == self.cut_id
            return ids[~cut], np.diff(np.flatnonzero(cut), prepend=-1, append=len(ids)) - 1

        return self._joined(stretches, self.cut, sizes_of)

    def _plain(self, stretch: str) -> bool:
        word = stretch.strip(" \n\r\t") if self.ends else stretch[1:] if stretch[0] == " " else ""
        return word.isalpha() and (word.isascii() or max(word) < "ɐ" and "İ" not in word)

    def _append(self, pieces: list[tuple[np.ndarray, np.ndarray]], first: int, used: int) -> int:
        """Put (ids, sizes) behind ``used`` in the pool under numbers from ``first``; the end of the pool then."""
        if not pieces:
            return used
        ids, sizes = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
        last, end = first + len(sizes), used + len(ids)
        for name, need in (("start", last), ("size", last), ("pool", end)):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate((have, np.zeros(max(need - len(have), len(have)), have.dtype))))
        self.start[first:last] = used + np.cumsum(sizes) - sizes
        self.size[first:last] = sizes
        self.pool[used:end] = ids
        return end

    def _odd(self, data: np.ndarray, raw: bytes, off: np.ndarray) -> np.ndarray:
        """Rows that the library has to encode whole."""
        odd = np.zeros(len(off) - 1, bool)
        at = np.flatnonzero(_LEADS[data])
        if len(at):
            padded = np.concatenate((data, np.zeros(2, np.uint8)))
            code = padded[at].astype(np.int64) << 16 | padded[at + 1].astype(np.int64) << 8 | padded[at + 2]
            at = at[np.isin(code >> 16, _ODD_CODES[1]) | np.isin(code >> 8, _ODD_CODES[2]) | np.isin(code, _ODD_CODES[3])]
            odd[np.searchsorted(off, at, "right") - 1] = True
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(off, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        return odd

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, bounds of each row) for UTF-8 rows of an Arrow buffer."""
        data = data[offsets[0] : offsets[-1]]
        off, n = offsets - offsets[0], len(data)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        raw = data.tobytes()
        odd = self._odd(data, raw, off)
        space, mark = SPACES[data], PUNCTUATION[data]
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[off[off < n]] = True
        # Punctuation that runs to the end of its stretch stands apart behind a Latin letter (but U+0130, whose lower case ends in a mark) or digit.
        stretch_end = np.flatnonzero(np.concatenate((begin[1:], [True])))
        other = np.maximum.accumulate(np.where(mark, -1, np.arange(n)))
        tail = other[stretch_end] + 1
        tail = tail[(tail > 0) & (tail <= stretch_end)]
        before = data[tail - 1]
        latin = (before >= 0x80) & (before < 0xC0) & (tail > 1)
        lead = data[tail - 2]
        latin &= (lead >= 0xC5) & (lead <= 0xC8) | (lead == 0xC4) & (before != 0xB0) | (lead == 0xC3) & (before != 0x97) & (before != 0xB7)
        begin[tail[ALNUM[before] | latin]] = True
        if odd.any():
            for a, b in zip(off[:-1][odd].tolist(), off[1:][odd].tolist(), strict=True):
                begin[a + 1 : b] = False
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data] * powers(BASE, n), out=total[1:])
        h = mix((total[ends] - total[starts]) * powers(BASE_INV, n)[starts] + (ends - starts).astype(U))
        h[h == 0] = 1
        alone = ends - starts > LONG
        if odd.any():
            alone |= odd[np.searchsorted(off, starts, "right") - 1]
        unit = self.table.find(h)
        fresh = np.flatnonzero((unit < 0) & ~alone)
        new, at = np.unique(h[fresh], return_index=True)
        if self.known + len(new) > KNOWN:
            self._clear()
            fresh = np.flatnonzero(~alone)
            new, at = np.unique(h[fresh], return_index=True)
        at = fresh[at]
        texts = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        plain = np.fromiter(map(self._plain, texts), bool, len(texts))
        end = self._append([*self._words([t for t, p in zip(texts, plain, strict=True) if p])], self.known, self.used)
        end = self._append([*self._others([t for t, p in zip(texts, plain, strict=True) if not p])], self.known + int(plain.sum()), end)
        number = np.empty(len(new), np.int64)
        number[np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))] = self.known + np.arange(len(new))
        unit[fresh] = number[np.searchsorted(new, h[fresh])]
        past = self.known + len(new)
        if len(new) <= KNOWN:
            self.table.add(new, number.astype(np.int32))
            self.known, self.used = past, end
        lone = np.flatnonzero(alone)
        whole = [self._library([raw[a:b].decode()])[0] for a, b in zip(starts[lone].tolist(), ends[lone].tolist(), strict=True)]
        self._append([(x, np.array([len(x)])) for x in whole], past, end)
        unit[lone] = past + np.arange(len(lone))
        size = self.size[unit]
        filled = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        ids = self.pool[np.repeat(self.start[unit] - filled[:-1], size) + np.arange(filled[-1])]
        return ids, filled[np.searchsorted(starts, off)]


def _codes() -> tuple[np.ndarray, dict[int, np.ndarray]]:
    leads, codes = np.zeros(256, bool), {1: [], 2: [], 3: []}
    for c in ODD:
        b = c.encode()
        leads[b[0]] = True
        codes[len(b)].append(int.from_bytes(b, "big"))
    return leads, {k: np.array(v) for k, v in codes.items()}


_LEADS, _ODD_CODES = _codes()


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> None:
    """Free the encoders of this worker: stages after tokenisation do not need them."""
    encoder.cache_clear()


def encoded(path: str, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ids, bounds) for stretches of rows; every row's ids end with ``end_id``."""
    data, offsets = strings(column)
    for a, b in slices(offsets, CHUNK):
        ids, bounds = encoder(path).encode(data, offsets[a : b + 1])
        yield a, b, np.insert(ids, bounds[1:], end_id).astype("<u4"), bounds + np.arange(b - a + 1)
