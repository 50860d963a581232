"""Each operator against its brute-force version on small tables with nulls, blanks, ties, copies, long texts and clashing columns."""

import random

import brute
import numpy as np
import pytest


def vocabulary(name):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path(name)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "er", "on", "ing", "ä", "ción", "X"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = say(60)
    out = [None, "", " \t\n ", "one", "one two three four", "ONE two three four", "123 456", "a b c", "x" * 3000, say(9000)]
    for i in range(60):
        text = say(rng.randint(5, 150))
        out.append(text)
        if i % 4 == 0:
            out += [text, text.upper(), text + " end", text.replace(" ", "\n", 3)]
        if i % 5 == 0:
            out.append(say(10) + " " + shared + "\n" + say(5))
    return [(i * 3 - 4, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, ["en", "de", None][d % 3], "s", len(t or ""), 1, "k") for d, t in texts]
    names = "doc_id long, text string, lang string, source string, n_chars long, rep int, key string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_near_duplicates(docs, texts, none):
    from tessera.llm.minhash_dedup import drop_near_duplicates, near_duplicates

    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == brute.near_duplicates(texts)
    assert near_duplicates(none).count() == 0
    assert {r.doc_id for r in drop_near_duplicates(docs).collect()} == {d for d, x in got.items() if x[2]}


def test_posterior_bounds():
    from tessera.llm.minhash_dedup import BATCH, least_matches, plausible

    bounds = least_matches(0.85)
    assert list(bounds) == sorted(bounds)
    assert all(m < 0.85 * BATCH * (i + 1) for i, m in enumerate(bounds))
    x = np.arange(196, dtype=np.uint16)
    sig = np.stack((x, x, x + 1))
    assert plausible(sig, np.array([0, 0, 1]), np.array([1, 2, 2]), 0.85).tolist() == [0]


def test_bands_meet_their_bound():
    from tessera.llm.minhash_dedup import BAND_MISS, PERMUTATIONS, bands_of

    for t in (0.5, 0.8, 0.85, 0.95):
        rows, bands = bands_of(t)
        assert rows * bands <= PERMUTATIONS and (1 - t**rows) ** bands <= BAND_MISS


def test_near_duplicates_repeated_and_null_ids(spark):
    from tessera.llm.minhash_dedup import drop_near_duplicates, near_duplicates

    say = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(5, say(1), "a"), (5, say(1), "b"), (5, say(2), "c"), (3, say(2) + " end", "d"), (7, say(1) + " end", "e"), (None, say(1), "f"), (None, say(1), "g"), (9, None, "h"), (9, "", "i"), (9, say(3), "j")]
    table = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(table).collect())
    assert got == [(-1, 36, None, False)] * 2 + [(3, 37, 3, True), (5, 36, 3, False), (5, 36, 5, True), (5, 36, 5, True), (7, 37, 5, False), (9, 0, 9, True), (9, 0, 9, True), (9, 36, 9, True)]
    kept = sorted(r.rep for r in drop_near_duplicates(table).collect())
    assert kept[-6:] == ["d", "f", "g", "h", "i", "j"] and kept[:-6] in (["a"], ["b"])


def test_near_duplicates_of_a_large_bucket(spark):
    """Many near copies that are no links, in blocks: one bucket of more than a block's members."""
    from tessera.llm import minhash_dedup

    rng = random.Random(4)
    common = [f"c{i}" for i in range(300)]
    rows = []
    for d in range(90):
        words = list(common)
        for at in rng.sample(range(300), 5):
            words[at] = f"d{d % 70}x{at}"
        rows.append((d, " ".join(words)))
    block, minhash_dedup.BLOCK = minhash_dedup.BLOCK, 16
    try:
        table = spark.createDataFrame(rows, "doc_id long, text string")
        for percent in (80, 85, 88):
            got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(table, percent).collect()}
            assert got == brute.near_duplicates(rows, percent)
    finally:
        minhash_dedup.BLOCK = block


def test_repeats(docs, texts, none):
    from tessera.llm.substring_dedup import drop_repeats, remove_repeats

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, texts=False).collect()}
    assert got == brute.remove_repeats(texts)
    assert remove_repeats(none).count() == 0
    kept = {r.doc_id: r for r in drop_repeats(docs).collect()}
    assert set(kept) == {d for d, x in got.items() if x[1] < x[0] or x[0] == 0}
    assert drop_repeats(docs).columns == docs.columns
    for d, t in texts:
        if d in kept and got[d][1] == 0:
            assert kept[d].text == t
    assert all(len(r.text) == r.n_chars for r in kept.values() if got[r.doc_id][1])


def test_repeats_of_equal_and_null_ids(spark):
    from tessera.llm.substring_dedup import drop_repeats, remove_repeats

    say = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(5, say(1), "a"), (5, say(1), "b"), (6, say(2), "c"), (8, say(2), "d"), (8, say(3, 60), "e"), (8, "go " + say(3, 60), "f"), (9, say(1) + " end", "g"), (None, say(1), "h"), (None, None, "i")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {r[0]: (r[1], r.n_removed) for r in remove_repeats(table, carry=["n_words"], texts=False).collect()}
    assert got == {"a": (40, 0), "b": (40, 0), "c": (40, 0), "d": (40, 40), "e": (60, 0), "f": (61, 60), "g": (41, 40), "h": (40, 0), "i": (0, 0)}
    kept = {r.n_words: r.text for r in drop_repeats(table).collect()}
    assert kept == {"a": say(1), "b": say(1), "c": say(2), "e": say(3, 60), "f": "go", "g": "end", "h": say(1), "i": None}


def test_packing(docs, texts, none):
    from tessera.llm.packing import first_fit_decreasing, pack

    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in texts}
    rows = pack(docs, path, end_id=2).collect()
    seen = {d: [] for d in ids}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(piece), brute.ids_crc32(piece), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        seen[r.doc_id].append((r.start, r.length))
    for d, spans in seen.items():
        assert sum(n for _, n in spans) == len(ids[d])
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 4096
    assert pack(none, path, end_id=2).count() == 0
    sizes = np.sort(np.random.default_rng(1).integers(1, 100, 500))[::-1]
    bins, offsets = first_fit_decreasing(sizes, 100)
    room = []
    for s, b in zip(sizes, bins):
        first = next((i for i, r in enumerate(room) if r >= s), len(room))
        room += [100] if first == len(room) else []
        assert b == first
        room[b] -= s


def test_packing_of_equal_and_null_ids_with_little_padding(spark):
    from tessera.llm import packing

    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["one", "two", "three", "vier", "cinq"]) for _ in range(n))
    odd = "a\u00a0b\u3000c \x0b<|endoftext|> \u0130, \u0301" * 2000
    rows = [(None, say(5), 1), (None, None, 1), (4, say(9), 1), (4, say(9000), 1), (4, say(9000), 1), (5, odd, 1)] + [(100 + i, say(rng.randint(1, 900)), 1) for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length long"), path, end_id=2, with_ids=True).collect()
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows]
    want = sorted((d if d is not None else -1, len(x), s, brute.ids_crc32(x[s : s + 4096])) for d, x in ids for s in range(0, len(x), 4096))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.doc_tokens, r.start, r.ids_crc32) for r in got) == want
    assert all(len(r.ids) == 4 * r.length for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]
    filled = sum(n for spans in by.values() for _, n in spans)
    padded = sum(0 if (f := sum(n for _, n in spans)) & (f - 1) == 0 else 4096 - f for spans in by.values())
    assert padded / (filled + padded) < 0.03


def test_token_files(spark, docs, texts, none):
    from tessera.llm.token_files import decode_ranks, encode_ranks, read_token_files, write_token_files
    from tessera.scratch import new_path

    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    values = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], np.uint32)
    assert (decode_ranks(*encode_ranks(values), len(values)) == values).all()
    for table, expected in ((docs, sorted(texts)), (none, [])):
        target = new_path(spark, "test_ids")
        write_token_files(table, path, 0, target)
        got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, target).collect()}
        start, want = 0, {}
        for d, t in expected:
            ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
            want[d] = (start, len(ids), brute.ids_crc32(ids))
            start += len(ids)
        assert got == want


def test_token_files_of_equal_and_null_ids(spark):
    from tessera.llm import token_files
    from tessera.scratch import new_path

    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    odd = "a\u00a0b\u3000c \x0b<|endoftext|> \u0130, " * 3000
    rows = [(None, "none"), (None, None), *[(7, f"seven {i}") for i in range(400)], (-3, odd), (9, "nine"), (9, "nine")]
    ids = sorted((d if d is not None else token_files.NO_ID, brute.ids_crc32(x), len(x)) for d, t in rows for x in [tok.encode(t or "", add_special_tokens=False).ids + [0]])
    small, token_files.RANGE_IDS = token_files.RANGE_IDS, 50
    try:
        target = new_path(spark, "test_ids")
        token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, 0, target)
        got = sorted((r.start, r.doc_id if r.doc_id is not None else token_files.NO_ID, r.ids_crc32, r.n_tokens) for r in token_files.read_token_files(spark, target).collect())
    finally:
        token_files.RANGE_IDS = small
    assert [r[1:] for r in got] == ids
    assert [r[0] for r in got] == [sum(n for _, _, n in ids[:k]) for k in range(len(ids))]


def test_encoder_agrees_with_the_library():
    import pyarrow as pa

    tokenizers = pytest.importorskip("tokenizers")
    from tessera.llm import tokens

    rng = random.Random(1)
    bits = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "don't", ".", ",", "!?", "12", "\u00e9", "\u00d1", "\u0130", "\u017f", "\u2026", "\u4e16\u754c", "\u0301", "\u00a0", "<|endoftext|>", "<|", "\x0b", "\u00d7", "\u03a3", "\U0001f600", "\r\n", "word", "x" * 70, "9,5", "\u200b", "\ufeff", "\u00aa", "\x00", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    known, tokens.KNOWN = tokens.KNOWN, 700
    tokens.forget()
    try:
        for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
            tok, n = tokenizers.Tokenizer.from_file(vocabulary(name)), 0
            for k in range(0, 1500, 100):
                for a, b, ids, bounds in tokens.encoded(vocabulary(name), pa.array(texts[k : k + 100]), 7):
                    for i in range(a, b):
                        assert ids[bounds[i - a] : bounds[i - a + 1]].tolist() == [*tok.encode(texts[k + i], add_special_tokens=False).ids, 7]
                        n += 1
            assert n == 1500
    finally:
        tokens.KNOWN = known
        tokens.forget()


def test_language(spark, none):
    from tessera.llm.langid import fit, held_out, keep_languages, predict

    rng = random.Random(2)
    sounds = {"en": ["the", "ing", "and"], "de": ["der", "sch", "ung"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(2)) for _ in range(30)), lang) for i in range(120) for lang in ["en" if i % 2 else "de"]]
    extra = [(900, None, "en"), (901, "", None), (902, "123 ...", "de"), (903, "theand " * 30_000, None), (None, "derung " * 9, "de"), (904, "theing and", None), (904, "theing and", None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + extra], "doc_id long, text string, lang string, _language_guess string, score int")
    model = fit(table.where(~held_out()), vocabulary("piece_bpe_32k.model"), sample_chars=20_000)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in predict(table, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert (got[None].lang_pred, got[904].lang_pred) == ("de", "en")
    kept = keep_languages(table, model)
    assert kept.columns == table.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([r[0] or -1 for r in rows] + [-1, 903, 904, 904])
    empty = fit(none, vocabulary("piece_bpe_32k.model"))
    assert {r.lang_pred for r in predict(table, empty).collect()} == {"und"}


def test_segmentations_are_summed():
    from tessera.llm.langid import _Lattice, _trie

    trie = _trie(vocabulary("piece_bpe_32k.model"))
    p = np.full((len(trie.pieces) + 1, 1), 1e-3)
    index = {x: i for i, x in enumerate(trie.pieces)}

    def brute_sum(word):
        ways = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(end):
                known = word[begin:end] in index
                if known or end == begin + 1:
                    ways[end] += ways[begin] * 1e-3
        return np.log(ways[-1])

    words = ["▁the", "▁hello", "▁a", "zzzz", "▁straße", "世"]
    assert np.allclose(_Lattice(words, trie).score(np.log(p))[:, 0], [brute_sum(w) for w in words])


def test_long_and_rare_words_are_scored_whole():
    from tessera.llm.langid import LanguageModel, _trie
    from tessera.llm.words import strings

    import pyarrow as pa

    path = vocabulary("piece_bpe_32k.model")
    trie = _trie(path)
    rng = np.random.default_rng(2)
    p = rng.random((len(trie.pieces) + 1, 2)) * 1e-9
    m = LanguageModel(["x", "y"], path, p)
    index = {x: i for i, x in enumerate(trie.pieces)}
    longest = max(map(len, trie.pieces))

    def brute_sum(word, lang):
        ways = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - longest), end):
                k = index.get(word[begin:end], len(trie.pieces) if end == begin + 1 else -1)
                if k >= 0:
                    ways[end] = np.logaddexp(ways[end], ways[begin] + np.log(p[k, lang]))
        return ways[-1]

    words = ["the" * 100, "\u4e16\u754c\u306e" * 60, "a", "\u1234" * 90, "x\u00a0y"]
    assert np.allclose(m.word_scores(words), [[brute_sum("\u2581" + w, k) for k in range(2)] for w in words])
    texts = ["a  the\tthe", "", None, words[0] + "\n" + words[1], "a"]
    scores, n = m.text_scores(*strings(pa.array(texts)))
    assert n.tolist() == [3, 0, 0, 2, 1]
    each = dict(zip(["a", "the", words[0], words[1]], m.word_scores(["a", "the", words[0], words[1]])))
    assert np.allclose(scores, [each["a"] + 2 * each["the"], [0, 0], [0, 0], each[words[0]] + each[words[1]], each["a"]])


def test_quality(spark, none):
    from tessera.llm.quality import boost, classify

    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((boost(x, y).score(x) >= 0.5) == y).mean() > 0.95
    assert np.allclose(boost(x, np.ones(600)).score(x), 1, atol=1e-3)
    good = [(i, " ".join(f"w{(i * j) % 97}." for j in range(40))) for i in range(100)]
    bad = [(1000 + i, f"junk{i} " * 60) for i in range(100)]
    table = spark.createDataFrame([*good, *bad, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(5000, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classify(table, labels).collect()}
    assert len(got) == 202
    assert np.mean([got[i].predicted == 1 for i, _ in good] + [got[i].predicted == 0 for i, _ in bad]) > 0.95
    assert classify(none, labels).count() == 0
    assert {r.score for r in classify(table, labels.where("false")).collect()} == {0.5}


def test_boosting_against_brute_force():
    """Every split found by trying all cuts of all features on the node's rows, and every row walked node by node."""
    from tessera.llm.quality import BINS, boost

    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(150, 4)), 1)
    x[:, 3] = 1
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    rounds, depth, rate, penalty = 5, 3, 0.3, 1.0
    trees = boost(x, y, rounds, depth, rate, penalty)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(4)]
    total = np.full(150, np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))

    def grow(rows, level, g, h):
        """{row: leaf value}"""
        if level == depth:
            return dict.fromkeys(rows, rate * sum(g[r] for r in rows) / (sum(h[r] for r in rows) + penalty))
        best, cut = 1e-9, None
        for f in range(4):
            for at in edges[f]:
                left = [r for r in rows if x[r, f] <= at]
                gl, hl, gt, ht = (sum(v[r] for r in some) for some in (left, rows) for v in (g, h))
                if hl >= 1e-3 and ht - hl >= 1e-3:
                    gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                    if gain > best + 1e-12:
                        best, cut = gain, (f, at)
        if cut is None:
            return grow(rows, level + 1, g, h)
        left = [r for r in rows if x[r, cut[0]] <= cut[1]]
        return grow(left, level + 1, g, h) | grow([r for r in rows if x[r, cut[0]] > cut[1]], level + 1, g, h)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        values = grow(list(range(150)), 0, y - p, p * (1 - p))
        total = total + np.array([values[r] for r in range(150)])
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-total)))

    def walk(row):
        out = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            out += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-out))

    assert np.allclose(trees.score(x), [walk(r) for r in x])


def test_quality_of_equal_and_null_ids(spark):
    from tessera.llm.quality import classify

    rows = [(i, f"good number {i}. " * (5 + i % 7), "a", 0.5) for i in range(40)] + [(100 + i, f"junk{i} " * 60, "b", 0.1) for i in range(40)]
    rows += [(None, "good one. " * 9, "c", None), (None, None, "c", None), (3, "junk3 " * 60, "d", 1.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, x string, score double")
    labels = spark.createDataFrame([(i, int(i < 100), "l") for i in [*range(40), *range(100, 140)]] + [(None, 1, "l"), (5, None, "l"), (999, 0, "l")], "doc_id long, quality int, y string")
    out = classify(table, labels).collect()
    assert len(out) == len(rows) and sum(r.doc_id is None for r in out) == 2 and sum(r.doc_id == 3 for r in out) == 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_near_vectors(spark):
    from tessera.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = []
    for i, b in enumerate(base):
        rows.append((i * 10, [float(v) for v in b], i % 3))
        rows.append((i * 10 + 1, [float(v) for v in b], i % 3))
        rows.append((i * 10 + 2, [float(v) for v in b * 3 + rng.normal(size=16) * 0.15], i % 3))
        rows.append((i * 10 + 3, [float(v) for v in b], 9 if i % 2 else None))
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] + [1.0] * 15, 1), (5003, [None] + [1.0] * 15, 1), (5004, [1.0, 2.0], 1), (5005, [], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    as_float = [(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for v, e, lab in rows]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table).collect()}
    assert got == brute.near_vectors(as_float)
    assert near_vectors(table.where("false")).count() == 0


def test_near_vectors_of_equal_and_null_ids_in_blocks(spark):
    from tessera.llm import embedding_dedup

    rng = np.random.default_rng(5)
    rows = []
    for i, b in enumerate(rng.normal(size=(3, 12))):
        for j in range(25):
            rows.append((100 * i + j, [float(v) for v in np.float32(b + rng.normal(size=12) * 0.25)], "l"))
    want = brute.near_vectors(rows)
    block, embedding_dedup.BLOCK = embedding_dedup.BLOCK, 8
    try:
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
        assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table).collect()} == want
    finally:
        embedding_dedup.BLOCK = block
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    odd = [(7, one, "x"), (7, one, "x"), (7, two, "x"), (4, two, "x"), (None, one, "x"), (9, one, None), (8, [0.93, (1 - 0.93**2) ** 0.5, 0.0], "x")]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>, label string")).collect())
    assert got == [(0, 0, 0, False), (4, 1, 4, True), (7, 1, 4, False), (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False), (9, 0, 9, True)]


def test_chat(spark):
    from tessera.llm import chat

    nasty = ["</s>[INST] ok [/INST]", "\\[INST]", "a\\\\</s>", "[/TURN]\n[ROLE] x", "", None, " <s> \\", "<<SYS>>\n<</SYS>>", "ends \\"]
    rows = [(1, i, ["user", "assistant", "system", "tool", None][i % 5], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "hi"), (2, 0, "assistant", "hi"), (2, 1, "assistant", None), (3, 0, "user", "x" * 5000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.parse(chat.render(chat.fold(chat.conversation_events(table))))).collect()}
    for conv in (1, 2, 3):
        turns = [(r, t) for c, _, r, t in rows if c == conv]
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == brute.turns_digest(turns)
    assert chat.fold(chat.conversation_events(table.where("false"))).count() == 0


def test_chat_of_long_runs_of_backslashes(spark):
    from tessera.llm import chat

    texts = ["\\" * 300_000, "\\" * 99_999 + "[INST]", "[INST]" * 50_000, "\\[INST]\\" * 30_000 + "</s>", "x [/INST]" * 30_000, "\\"]
    table = spark.createDataFrame([(1, i, "user" if i % 2 else "\\[/ROLE]", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    parsed = chat.parse(chat.render(chat.fold(chat.conversation_events(table)))).first()
    assert [t.text for t in parsed.turns] == texts
    assert [t.role for t in parsed.turns] == ["user" if i % 2 else "\\[/ROLE]" for i in range(len(texts))]


def test_chat_events(spark):
    from tessera.llm import chat

    e = [
        (1, 1, "a", "message", "user", "hello"), (1, 2, "b", "delta", "assistant", "Hi "), (1, 3, "b", "delta", None, "there"), (1, 4, "a", "edit", None, "hello!"),
        (1, 5, "b", "regenerate", None, None), (1, 6, "b", "delta", None, "Good "), (1, 7, "b", "delta", None, "day"), (1, 8, "c", "message", "user", "no"), (1, 9, "c", "delete", None, None),
    ]
    rows = chat.fold(spark.createDataFrame(e, "conv_id long, seq long, message_id string, kind string, role string, text string")).orderBy("at").collect()
    assert [(r.role, r.text) for r in rows] == [("user", "hello!"), ("assistant", "Good day")]


def test_licenses(spark, none):
    from tessera.llm.licenses import TEMPLATES, key_words, scan

    rows = [(i, "Intro words here.\n" * 40 + t.upper() + "\nmore", "k") for i, t in enumerate(TEMPLATES.values())]
    rows += [(100, "no licence at all, version two", "k"), (101, None, "k"), (102, "", "k"), (103, "public version redistribution conditions general software", "k")]
    got = {}
    for r in scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert all(name in got.get(i, ()) for i, name in enumerate(TEMPLATES))
    assert not {100, 101, 102, 103} & set(got)
    assert scan(none).count() == 0
    assert key_words("a bb ccc dddd".split())


def test_licenses_against_brute_force(spark):
    """Edited notices: what the bands retrieve of all windows that reach the containment, and nothing else."""
    from tessera.llm import licenses as L

    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i, text in enumerate(L.TEMPLATES.values()):
        for k in range(4):
            w = text.split()
            for _ in range(len(w) * k // 40):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(words)], [w[at], rng.choice(words)]])
            rows.append((i * 10 + k, " ".join([*rng.choices(words, k=rng.randint(0, 40)), *w, *rng.choices(words, k=20)])))
    rows += [(9000, "merchantability warranties software license license reserved"), (None, "All rights reserved. Licensed under the MIT License"), (None, "All rights reserved."), (7, "x"), (7, "All rights reserved")]
    grams = lambda w: {tuple(w[i : i + L.SHINGLE]) for i in range(len(w) - L.SHINGLE + 1)}
    want = {}
    for doc, text in rows:
        w = L._words(text)
        for name, template in L.TEMPLATES.items():
            t = grams(L._words(template))
            size = L._size(L._words(template))
            windows = [w[a : a + size + L.stride(size)] for a in range(0, max(1, len(w)), L.stride(size))]
            best = max(len(t & grams(x)) / len(t) for x in windows)
            if best >= L.CONTAINMENT:
                want[doc, text, name] = best
    by = {}
    for (doc, _, name), best in want.items():
        by.setdefault((doc, name), []).append(round(best, 9))
    got = {}
    for r in L.scan(spark.createDataFrame([(*r, "v") for r in rows], "doc_id long, text string, version string")).collect():
        got.setdefault((r.doc_id, r.license), []).append(round(r.containment, 9))
    assert set(got) <= set(by) and len(by) > 60
    assert sum(sorted(got.get(k, [])) == sorted(v) for k, v in by.items()) >= 0.95 * len(by)
    assert len(got[None, "all-rights-reserved"]) == 2 and len(got[7, "all-rights-reserved"]) == 1


def test_leaks(spark, none):
    from tessera.llm.decontamination import drop_leaks, leaks

    item = "Alice has 12 apples and then Alice gives 5 apples to Robert, how many apples does Alice keep after that?"
    plain = "the quick engine turns over the long road while nobody listens to the small voice of the sea"
    items = spark.createDataFrame([(1, item), (2, plain), (3, None), (4, "too short")], "item_id long, text string")
    changed = item.replace("12", "31").replace("5", "9")
    broken = item.replace("then Alice", "then Martha")
    rows = [(1, "x y z. " + plain + " and more"), (2, "Some intro. " + changed + " The end"), (3, "Look: " + broken), (4, plain[:40]), (5, None), (6, ""), (7, plain.upper())]
    table = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, shift string")
    got = {(r.doc_id, r.item_id): r.kind for r in leaks(table, items).collect()}
    assert got[1, 2] == "exact"
    assert got[2, 1] == "reparameterised"
    assert (3, 1) not in got
    assert not {4, 5, 6} & {d for d, _ in got}
    assert {r.doc_id for r in drop_leaks(table, items).collect()} == {r[0] for r in rows} - {d for d, _ in got}
    assert leaks(none, items).count() == 0
    assert leaks(table, items.where("false")).count() == 0


def test_word_hashes_agree_with_words():
    from tessera.llm.words import word_hashes

    text = ["Ab\x0bc d", "", "  ", "ab", "d", "é d"]
    data = "".join(text).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in text])))
    h, first = word_hashes(np.frombuffer(data, np.uint8), offsets, lower=True)
    assert np.diff(first).tolist() == [3, 0, 0, 1, 1, 2]
    assert h[0] == h[3] and h[2] == h[4] == h[6] and len(set(h.tolist())) == 4




def test_leaks_by_neighbouring_shifts(spark):
    from tessera.llm.decontamination import leaks

    item = "Alice has 12 apples and then Alice gives 5 apples to Robert, how many apples does Alice keep after that?"
    long = "the quick engine turns over the long road while nobody listens to the small voice of the sea"
    items = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    rows = {
        1: item.replace("gives 5", "gives 1,250"), 2: item.replace("12", "7.5").replace("5 apples to", "2.5 apples to"), 3: item.replace("5 apples", "5 red apples"),
        4: long.replace("over", "slowly over"), 5: item.replace("then Alice", "then Martha").replace("5 apples", "5 red apples"),
        6: item.replace("12", "31") + " " + item.replace("12", "44"), 7: "engine long road " * 9,
        8: item.replace("apples does Alice", "plums does Martha"),
    }
    got = {(r.doc_id, r.item_id): r.kind for r in leaks(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), items).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 2), (6, 1), (8, 1)} <= set(got)
    assert got[1, 1] == "reparameterised" and got[3, 1] == got[4, 2] == "exact"
    assert (5, 1) not in got and not [d for d, _ in got if d == 7]


def test_leaks_of_short_items_and_repeated_ids(spark):
    from tessera.llm.decontamination import drop_leaks, leaks

    items = [(1, "What is 2 plus 2?"), (2, "the river runs past seven grey mills"), (3, "hello"), (4, ""), (5, "Anna buys 3 pens and 4 books at the market, what do 3 pens cost her?")]
    items += [(6, "name every moon of the large planet that has rings"), (6, "why do small birds fly south before the long winter comes")]
    rows = [
        (1, "What is 2 plus 2?"), (2, "What is 7 plus 7?"), (3, "What is 7 plus 8?"), (4, "So what is 2 plus 2? Nobody asks."), (5, "far away the river runs past seven grey mills, he said"),
        (6, "he said hello"), (7, None), (8, "Anna buys 3 pens and 4 books at the market, what do 3 pens cost her?"), (8, "Anna buys 3 pens and 4 books at the market, what do 5 pens cost her?"),
        (None, "name every moon of the large planet that has rings"), (None, "some other text of no concern to anyone here at all"), (9, "why do small birds fly south before the long winter comes"),
    ]
    table = spark.createDataFrame([(*r, "v") for r in rows], "doc_id long, text string, version string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.kind) for r in leaks(table, benchmark).collect()}
    assert got == {(1, 1): (1, "exact"), (2, 1): (1, "reparameterised"), (5, 2): (1, "exact"), (8, 5): (1, "exact"), (None, 6): (1, "exact"), (9, 6): (1, "exact")}
    left = sorted((r.doc_id or 0, r.text or "") for r in drop_leaks(table, benchmark).collect())
    assert left == sorted([(0, rows[10][1]), (3, rows[2][1]), (4, rows[3][1]), (6, rows[5][1]), (7, ""), (8, rows[8][1])])


def test_leaks_against_brute_force(spark):
    """Items that share an instruction, found by coverage over neighbouring shifts; plain words only, so no slots."""
    from tessera.llm import decontamination as D

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    vocabulary = [w for w in vocabulary if w not in D.UNITS]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    lead = say(14)
    items = {i: (lead if i % 2 else []) + say(rng.randint(9, 30)) for i in range(30)}
    docs = {}
    for d in range(120):
        words = say(rng.randint(0, 40))
        for i in rng.sample(range(30), rng.randint(0, 2)):
            part = items[i]
            a = rng.randint(0, len(part) // 2)
            piece = part[a : a + rng.randint(4, 40)]
            if rng.random() < 0.4 and len(piece) > 3:
                piece = piece[: len(piece) // 2] + say(rng.randint(1, 3)) + piece[len(piece) // 2 :]
            words += piece + say(rng.randint(0, 20))
        docs[d] = words + (lead if d % 5 == 0 else [])
    want = {}
    for d, w in docs.items():
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        for i, t in items.items():
            hits = [(k - p, p) for p in range(len(t) - 7) for k in at.get(tuple(t[p : p + 8]), ())]
            best = 0
            for shift, _ in hits:
                best = max(best, len({p for s, p in hits if abs(s - shift) <= D.DRIFT}))
            if best >= D.COVERAGE * (len(t) - 7) - 1e-9:
                want[d, i] = round(best / (len(t) - 7), 9)
    table = lambda rows, key: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{key} long, text string")
    got = {(r.doc_id, r.item_id): round(r.coverage, 9) for r in D.leaks(table(docs, "doc_id"), table(items, "item_id")).collect()}
    assert got == want and len(want) > 30
    few, D.BROADCAST_WINDOWS = D.BROADCAST_WINDOWS, 0
    try:
        assert {(r.doc_id, r.item_id): round(r.coverage, 9) for r in D.leaks(table(docs, "doc_id"), table(items, "item_id")).collect()} == want
    finally:
        D.BROADCAST_WINDOWS = few


def test_results_belong_to_the_callers_session(spark, tmp_path):
    from tessera.llm.queries import QUERIES

    pytest.importorskip("public_tokenizers")
    rows = [(i, " ".join(f"w{(i * j) % 31}" for j in range(30)), "en", "s", 90) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("op1_minhash_dedup", "op5_substring_dedup", "op6_packing", "op7_language_id", "op9_token_files"):
        got = QUERIES[name](spark, str(tmp_path))
        assert got.sparkSession is spark
        got.createOrReplaceTempView("result")
        assert spark.sql("select count(distinct doc_id) as n from result").first().n == 12
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_near_vectors_recall(spark):
    """Pairs from just over the threshold on, among unrelated vectors: links found against brute force."""
    from tessera.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(21)
    base = rng.normal(size=(1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=(1500, 32))
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.9305, 0.96, size=(1500, 1))
    x = np.concatenate((base, cos * base + np.sqrt(1 - cos**2) * away))
    similar = np.triu(x @ x.T >= 0.93, 1)
    table = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in near_vectors(table).select("n_links").collect()) / 2
    assert similar.sum() >= 1500 and found >= 0.99 * similar.sum()


def test_token_files_of_ids_beyond_doubles(spark, tmp_path):
    """Ids that share a double are still written in order, range by range; a hot id and hot equal rows span ranges."""
    from tessera.llm import token_files

    rows = [(2**60 + i, f"text number {i} of many", "x") for i in range(64)] + [(2**60 + 7, "again " * (i % 5), "y") for i in range(60)] + [(2**62, None, "z")] * 40
    random.Random(1).shuffle(rows)
    small, token_files.RANGE_IDS = token_files.RANGE_IDS, 60
    try:
        target = str(tmp_path / "files")
        token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string, docs string").repartition(5), vocabulary("byte_bpe_50k.json"), 0, target)
        got = sorted((r.start, r.doc_id, r.ids_crc32, r.n_tokens) for r in token_files.read_token_files(spark, target).collect())
        parts = [r.n for r in spark.read.parquet(f"{target}/blocks").groupBy("part").agg({"n_ids": "sum"}).withColumnRenamed("sum(n_ids)", "n").collect()]
    finally:
        token_files.RANGE_IDS = small
    assert [(d, c) for _, d, c, _ in got] == sorted((d, c) for _, d, c, _ in got)
    assert [s for s, *_ in got] == list(np.cumsum([0] + [n for *_, n in got])[:-1])
    assert len(got) == len(rows) and len(parts) > 5 and max(parts) < 200


def thue_morse(n, letters):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_long_words_of_two_letters_are_not_equal(spark):
    """Thue-Morse words have equal polynomial hashes modulo 2**64, whatever the base."""
    from tessera.llm.minhash_dedup import near_duplicates
    from tessera.llm.substring_dedup import remove_repeats

    pairs = [thue_morse(2048, letters) for letters in ("ab", "cd", "xy", "01")]
    one, other = (" ".join(p[k] + str(i) for i in range(5) for p in pairs) for k in (0, 1))
    table = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(table).collect()) == [(1, 1), (2, 2), (3, 1)]
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(table, texts=False).collect()) == [(1, 0), (2, 0), (3, 20)]


def test_word_hashes_are_of_the_words():
    from tessera.llm.words import strings, word_hashes
    import pyarrow as pa

    rng = random.Random(6)
    words = list({"".join(rng.choice("abAB é") for _ in range(rng.randint(1, 40))).replace(" ", "") for _ in range(3000)} - {""})
    words += ["a" * n for n in range(60, 90)] + ["a" * 8 + "b" * 8, "b" * 8 + "a" * 8, "\0", "\0\0"]
    data, offsets = strings(pa.array([" ".join(words), None, "\t".join(reversed(words)) + "\n"]))
    hashes, first = word_hashes(data, offsets)
    assert first.tolist() == [0, len(words), len(words), 2 * len(words)]
    assert hashes[: len(words)].tolist() == hashes[len(words) :][::-1].tolist()
    assert len(set(hashes.tolist())) == len(set(words))
    folded, _ = word_hashes(data, offsets, lower=True)
    assert len(set(folded.tolist())) == len({brute.lower(w) for w in words})


def test_window_keys_grow_with_the_corpus():
    from tessera.llm import substring_dedup as S

    assert [S.key_bytes(b) for b in (6, 7, 8, 15, 16, 23, 24)] == [7, 7, 8, 8, 9, 9, 10]
    rng = np.random.default_rng(1)
    h, g = rng.integers(0, 2**64, (2, 500), dtype=np.uint64)
    h[1], g[3], h[3] = h[0], g[2], h[2]
    for bits in (6, 14, 23, 31):
        a, b = S._unkeys(S._keys(h, g, bits), len(h), bits)
        pairs = list(zip((h >> S.U(64 - bits)).tolist(), a.tolist(), b.tolist()))
        assert pairs[2] == pairs[3] and len(set(pairs)) == len(h) - (2 if bits < 7 else 1), bits


def test_two_hashes_settle_windows():
    from tessera.llm.substring_dedup import _settled

    d = np.array([3, 1, 2, 1]); t = np.zeros(4, np.int64); p = np.array([0, 5, 0, 9])
    h = np.array([7, 7, 7, 7], np.uint64); g = np.array([1, 1, 2, 1], np.uint64)
    order, earliest, _ = _settled(d, t, p, h, g)
    assert {int(o): bool(e) for o, e in zip(order, earliest)} == {0: False, 1: True, 2: True, 3: False}


def test_names_at_starts_of_sentences(spark):
    from tessera.llm.decontamination import leaks

    items = [
        (1, "Alice buys 3 apples. Alice eats 2 apples. How many apples does Alice have left?"),
        (2, "Marta paints 12 fences. Marta sells 5 fences at the market. How many fences are there in the end?"),
    ]
    docs = [
        (10, "Robert buys 7 apples. Robert eats 4 apples. How many apples does Robert have left?"),
        (11, "Before. Robert buys 7 apples. Alice eats 4 apples. How many apples does Paul have left? After that."),
        (12, "Some words first\nIgor paints 40 fences. Igor sells 6 fences at the market. How many fences are there in the end? And some more."),
        (13, items[0][1].lower()),
        (14, "Apples are red. How many apples are there in the box that we have left on the table?"),
        (15, items[1][1]),
    ]
    table = spark.createDataFrame([(*d, "k", "v") for d in docs], "doc_id long, text string, _names string, _clean string")
    got = {(r.doc_id, r.item_id): r.kind for r in leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[10, 1] == got[12, 2] == "reparameterised" and got[15, 2] == "exact"
    assert not [k for k in got if k[0] in (11, 14)]


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns named like the operators' own, where ids repeat."""
    from tessera.llm.decontamination import drop_leaks
    from tessera.llm.minhash_dedup import drop_near_duplicates

    say = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    names = "_doc _version _key version key row doc _tokens component_id item seen".split()
    rows = [(1, say(1)), (1, say(2)), (2, say(1) + " end"), (3, say(4)), (None, say(5)), (3, say(4))]
    table = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = drop_near_duplicates(table, 80)
    assert kept.columns == table.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(d), t) for d, t in (rows[0], rows[1], rows[3], rows[4]))
    left = drop_leaks(table, spark.createDataFrame([(9, say(4))], "item_id long, text string"))
    assert left.columns == table.columns
    assert sorted((str(r.doc_id), r.text, r.key) for r in left.collect()) == sorted((str(d), t, 4) for d, t in rows if t != say(4))


def test_packing_deals_equal_rows_to_many_groups(spark):
    from tessera.llm.packing import pack

    rows = [(1, "the same words")] * 200 + [(None, None)] * 200
    out = pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json"), 2, group=20)
    sizes = [r["count"] for r in out.groupBy((out.sequence_id.bitwiseAND(-(1 << 32))).alias("grp")).count().collect()]
    assert out.count() == 400 and len(sizes) > 12 and max(sizes) < 45
