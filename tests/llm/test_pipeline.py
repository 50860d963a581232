"""The pipeline against its stages' brute-force versions."""

import random

import brute
import pytest


def test_run(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline

    rng = random.Random(1)
    sounds = {"en": ["the", "ing", "and", "er"], "de": ["der", "sch", "ung", "ei"]}
    word = lambda lang: "".join(rng.choice(sounds[lang]) for _ in range(rng.randint(2, 6)))
    say = lambda lang, n: " ".join(word(lang) for _ in range(n))
    item, shared = say("en", 30), say("en", 40)
    texts = [(i, say("en" if i % 2 else "de", 80), "en" if i % 2 else "de") for i in range(60)]
    texts += [(100, texts[3][1], "en"), (101, texts[3][1] + " tail", "en"), (102, "12 34", "en"), (103, None, None), (104, say("en", 20) + " " + item, "en")]
    texts += [(110 + i, say("en", 30) + " " + shared, "en") for i in range(3)]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t, _ in texts if i not in (102, 103)]
    near = brute.near_duplicates(left, 80)
    left = [(i, t) for i, t in left if near[i][2]]
    seen, cleaned = set(), []
    for i, t in sorted(left):
        w = brute.WORD.findall(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(key)
        cleaned.append((i, " ".join(x for x, g in zip(w, gone) if not g)))
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: brute.ids_crc32(tok.encode(t, add_special_tokens=False).ids + [2]) for i, t in cleaned if i != 104}
    got = {r.doc_id: r.ids_crc32 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "MinHash near-dedup"


def test_repeated_rows_null_ids_and_empty_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["the", "and", "thing", "ring", "other"]) + rng.choice(["er", "ing", "s", "y"]) + str(i % 7) for i in range(n))
    texts = [say(60) for _ in range(8)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(2, texts[2], "en"), (3, say(60), "en"), (None, say(60), "en"), (None, say(60), None), (None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, version string, doc_id_key long"
    whole = spark.createDataFrame([(*r, "s", len(r[1] or ""), "v", 1) for r in rows], names)
    for name, table, want in (("some", whole, [*range(8), 3, None, None]), ("none", whole.where("false"), [])):
        folder = tmp_path / name
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, say(30))] if want else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = [r.doc_id for r in corpus_pipeline.run(spark, str(folder)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
