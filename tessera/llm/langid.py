"""Language identification by segmentation-marginalised unigram models.

Every language has a probability for each piece of a fixed public vocabulary (a SentencePiece model file); the
probability of a word (a run between ASCII white space, of any length) is the sum over all its segmentations into pieces,
by the forward algorithm in log space, so no single segmentation is chosen and no word is too long or too rare. Piece
probabilities come from expectation maximisation (forward-backward) on word counts
of a bounded, hash-chosen sample of the labelled training texts: about ``sample_chars`` characters a language.
Scoring reads whole texts: words are hashed (64 bits) and looked up in a table per worker; a new word's score is computed once, and
beyond ``KNOWN_CELLS`` numbers the table starts anew.

Null labels are not learned. A text that is null or has no letter is ``und`` with score 0. The prediction is the most probable
language under equal priors; the score is its posterior at the text's mean evidence per word, so it does not run to 1 with the
length of a text (1 / languages: no evidence).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.words import Table, slices, small_batches, strings, trim, word_spans

WORD_START = "▁"
KNOWN_CELLS, LATTICE_CELLS = 2_000_000, 150_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class _Trie:
    """The vocabulary's pieces as sorted (node, character) transitions for vectorised walks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = list(dict.fromkeys(model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))))
        steps: dict[tuple[int, str], int] = {}
        piece_at = {}
        for k, piece in enumerate(self.pieces):
            node = 0
            for c in piece:
                node = steps.setdefault((node, c), len(steps) + 1)
            piece_at[node] = k
        keys = np.array([(node << 21) | ord(c) for node, c in steps], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.to = np.fromiter(steps.values(), np.int64, len(steps))[order]
        self.piece = np.full(len(steps) + 1, -1, np.int64)
        self.piece[list(piece_at)] = list(piece_at.values())

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Next node, or 0 where there is none."""
        key = (nodes << 21) | chars
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0)


@functools.cache
def _trie(path: str) -> _Trie:
    return _Trie(path)


class _Lattice:
    """Every way to begin a piece in many strings at once: arcs (begin, end, rows, pieces), begins ascending."""

    def __init__(self, texts: list[str], trie: _Trie):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.n, self.width = len(texts), int(lengths.max(initial=0))
        chars = np.array(texts, f"<U{max(1, self.width)}").view(np.uint32).reshape(self.n, -1).astype(np.int64)[self.order]
        other = len(trie.pieces)
        self.arcs = []
        for i in range(self.width):
            rows = np.arange(np.searchsorted(-self.lengths, -i, "left"))
            nodes, end = np.zeros(len(rows), np.int64), i
            while len(rows):
                nodes = trie.step(nodes, chars[rows, end])
                end += 1
                piece = np.where(nodes > 0, trie.piece[nodes], -1)
                if end == i + 1:
                    piece = np.where(piece < 0, other, piece)
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    self.arcs.append((i, end, rows[hit], piece[hit]))
                alive = (nodes > 0) & (self.lengths[rows] > end)
                rows, nodes = rows[alive], nodes[alive]

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """alpha[position, row, language]: log probability of all segmentations of the first ``position`` characters."""
        alpha = np.full((self.width + 1, self.n, logs.shape[1]), -np.inf)
        alpha[0] = 0
        for i, j, rows, piece in self.arcs:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + logs[piece])
        return alpha

    def score(self, logs: np.ndarray) -> np.ndarray:
        out = np.empty((self.n, logs.shape[1]))
        out[self.order] = self.forward(logs)[self.lengths, np.arange(self.n)]
        return out

    def expected(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (rows) by language (columns) under counts[text, language]."""
        alpha = self.forward(logs)
        whole = alpha[self.lengths, np.arange(self.n)]
        weight = counts[self.order]
        beta = np.full_like(alpha, -np.inf)
        beta[self.lengths, np.arange(self.n)] = 0
        out = np.zeros_like(logs)
        for i, j, rows, piece in reversed(self.arcs):
            onward = beta[j, rows] + logs[piece]
            beta[i, rows] = np.logaddexp(beta[i, rows], onward)
            np.add.at(out, piece, np.exp(alpha[i, rows] + onward - whole[rows]) * weight[rows])
        return out


def _lattices(texts: list[str], trie: _Trie) -> Iterator[tuple[np.ndarray, _Lattice]]:
    """(indexes, lattice) of texts of similar lengths, about ``LATTICE_CELLS`` characters at a time; a longer text stands alone."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(lengths, kind="stable")
    a = 0
    while a < len(order):
        area = lengths[order[a:]] * np.arange(1, len(order) - a + 1)
        b = a + max(1, int(np.searchsorted(area, LATTICE_CELLS, "right")))
        yield order[a:b], _Lattice([texts[i] for i in order[a:b].tolist()], trie)
        a = b


@dataclass
class LanguageModel:
    """probabilities: one row for each piece (the last: any character that is no piece), one column a language."""

    languages: list[str]
    vocabulary: str
    probabilities: np.ndarray

    @functools.cached_property
    def _logs(self) -> np.ndarray:
        return np.log(self.probabilities)

    @functools.cached_property
    def _known(self) -> Table:
        return Table(max(10_000, KNOWN_CELLS // max(1, len(self.languages))))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for at, lattice in _lattices([WORD_START + w for w in words], _trie(self.vocabulary)):
            out[at] = lattice.score(self._logs)
        return out

    def text_scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each whole text in each language, its words) for UTF-8 rows of an Arrow buffer."""
        hashes, first, starts, ends = word_spans(data, offsets)
        words = np.diff(first)
        if not len(hashes):
            return np.zeros((len(words), len(self.languages))), words
        hashes[hashes == 0] = 1
        known, state = self._known, self.__dict__
        raw = data[offsets[0] : offsets[-1]].tobytes()
        table, n = state.get("_scores", np.zeros((1 << 12, len(self.languages)))), state.get("_held", 0)
        unit = known.find(hashes)
        fresh = np.flatnonzero(unit < 0)
        new, at = np.unique(hashes[fresh], return_index=True)
        if n + len(new) > known.slots // 2:
            known.clear()
            n, fresh = 0, np.arange(len(hashes))
            new, at = np.unique(hashes, return_index=True)
        at = fresh[at]
        scores = self.word_scores([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        if n + len(new) > len(table):
            table = np.concatenate((table, np.zeros((max(n + len(new) - len(table), len(table)), len(self.languages)))))
        table[n : n + len(new)] = scores
        unit[fresh] = n + np.searchsorted(new, hashes[fresh])
        if n + len(new) <= known.slots // 2:
            known.add(new, (n + np.arange(len(new))).astype(np.int32))
            n += len(new)
        state["_scores"], state["_held"] = table, n
        out = np.zeros((len(words), len(self.languages)))
        some = np.flatnonzero(words)
        out[some] = np.add.reduceat(table[unit], first[some], axis=0)
        return out, words


def fit(
    docs: DataFrame, vocabulary: str, lang: str = "lang", sample_chars: int = 400_000, rounds: int = 3, smoothing: float = 0.01
) -> LanguageModel:
    """Learn from rows of ``docs`` (doc_id, text, ``lang``); ``sample_chars`` bounds the text read per language."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(lang).alias("lang"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], vocabulary, np.ones((len(_trie(vocabulary).pieces) + 1, 0)))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, float(min(1.0, sample_chars / max(1, sizes[name]))))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < share[F.col("lang")])
    words = (
        sample.select("lang", F.explode(F.split("text", "[ \\t\\n\\x0B\\f\\r]+")).alias("word"))
        .where("word <> ''")
        .groupBy("lang", "word")
        .count()
        .toPandas()
    )
    trie = _trie(vocabulary)
    column = {name: i for i, name in enumerate(languages)}
    totals: dict[str, np.ndarray] = {}
    for name, word, count in words.itertuples(index=False):
        totals.setdefault(WORD_START + word, np.zeros(len(languages)))[column[name]] += count
    texts = list(totals)
    counts = np.stack(list(totals.values())) if texts else np.zeros((0, len(languages)))
    length = np.array([len(p) for p in trie.pieces] + [1])
    probabilities = np.repeat((0.5**length / np.sum(0.5**length))[:, None], len(languages), 1)
    blocks = [(lattice, counts[at]) for at, lattice in _lattices(texts, trie)]
    for _ in range(rounds):
        uses = sum((x.expected(np.log(probabilities), c) for x, c in blocks), np.zeros_like(probabilities)) + smoothing
        probabilities = uses / uses.sum(0)
    return LanguageModel(languages, vocabulary, probabilities)


def _guesser(docs: DataFrame, model: LanguageModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def guess(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        names = pa.array([*m.languages, "und"], pa.string())
        for column in texts:
            data, offsets = strings(column)
            best, score = np.full(len(column), len(m.languages)), np.zeros(len(column))
            for a, b in slices(offsets, 1 << 19) if m.languages else ():
                s, words = m.text_scores(data, offsets[a : b + 1])
                counted = np.concatenate(([0], np.cumsum(_LETTER[data[offsets[a] : offsets[b]]])))
                off = offsets[a : b + 1] - offsets[a]
                lettered = counted[off[1:]] > counted[off[:-1]]
                for i in np.flatnonzero(~lettered & (words > 0)).tolist():
                    lettered[i] = any(map(str.isalpha, column[a + i].as_py()))
                some = np.flatnonzero(lettered)
                best[a + some] = s[some].argmax(1)
                mean = (s[some] - s[some].max(1, keepdims=True)) / words[some, None]
                score[a + some] = 1 / np.exp(mean).sum(1)
            yield pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(score)], ["lang_pred", "score"])
        trim()

    return guess


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, from the text alone."""
    docs = small_batches(docs)
    return docs.select("doc_id", _guesser(docs, model)("text").alias("g")).select("doc_id", "g.lang_pred", "g.score")


def keep_languages(docs: DataFrame, model: LanguageModel, languages: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """Rows of ``docs`` in one of ``languages`` (all that the model knows, if not given) at ``min_score`` or more; ``und`` goes."""
    wanted = model.languages if languages is None else languages
    rows = small_batches(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"))
    judged = rows.select("row", _guesser(docs, model)("text").alias("guess"))
    return judged.where(F.col("guess.lang_pred").isin(wanted) & (F.col("guess.score") >= min_score)).select("row.*")


def held_out() -> Column:
    """Rows never used in training: crc32 of the id as text leaves remainder 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
