"""Ranked retrieval: BM25 over stored postings, vector top-k, dense + sparse fusion, half-and-half selection, branch merge."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.scores import cosine
from tessera.scratch import materialize

K1, B = 1.5, 0.75


def postings(docs: DataFrame, doc: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(term, doc, tf) and (doc, dl): the inverted index of a token column."""
    held = docs.select(F.col(doc).alias("doc"), tokens.alias("tokens"))
    terms = held.select("doc", F.explode("tokens").alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"))
    return terms, held.select("doc", F.size("tokens").alias("dl"))


def bm25(docs: DataFrame, doc: str, tokens: Column, query_terms: list[str]) -> DataFrame:
    """(doc, score) of documents with a query term; the rows given are the corpus of all statistics.

    Texts are read once: lengths and counts of the query's terms (a few numbers a document) are written, and read again for
    the statistics and the scores.
    A term asked twice counts twice. The query's terms are a handful, so they are literals, not a join.
    """
    wanted: dict[str, int] = {}
    for t in query_terms:
        wanted[t] = wanted.get(t, 0) + 1
    if not wanted:
        return docs.select(F.col(doc).alias("doc"), F.lit(0.0).alias("score")).where(F.lit(False))
    asked = F.array(*map(F.lit, wanted))
    # Bound to a lambda variable, the tokens are computed once.
    counted = F.transform(F.array(tokens), lambda ts: F.struct(F.size(ts).alias("dl"), F.filter(ts, lambda t: F.array_contains(asked, t)).alias("hits")))[0]
    rows = docs.select(F.col(doc).alias("doc"), counted.alias("c"))
    times = lambda word: F.size(F.filter("c.hits", lambda t: t == word))
    rows = rows.select("doc", "c.dl", *[times(w).alias(f"tf{i}") for i, w in enumerate(wanted)])
    rows = materialize(rows, "term_counts")
    sums = rows.agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(wanted))]
    )
    joined = rows.where(" or ".join(f"tf{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(sums))  # one row of sums
    score = F.lit(0.0)
    for i, times in enumerate(wanted.values()):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(tf > 0, times * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return joined.select("doc", score.alias("score"))


def normalized(scores: DataFrame, ceiling: float = 1.0) -> DataFrame:
    """Scores scaled by the largest; nothing if that is not positive."""
    top = scores.agg(F.max("score").alias("top"))
    return scores.crossJoin(F.broadcast(top)).where("top > 0").withColumn("score", F.col("score") / F.col("top") * ceiling).drop("top")


def top_k(rows: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k best rows with their rank (total order by ``ties``)."""
    best = rows.orderBy(F.col(score).desc(), *ties).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), *ties)))


def vector_top_k(vectors: DataFrame, query: list[float], k: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return top_k(vectors.select(F.col(key), F.round(cosine(F.col(vec), q), 6).alias("score")), "score", k, key)


def fuse(dense: Column, sparse: Column, top: Column) -> Column:
    """0.7 of the cosine mapped to [0, 1] and 0.3 of the scaled keyword score; the plain cosine without keyword evidence."""
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dense + 1) / 2))
    return F.when(F.coalesce(top, F.lit(0.0)) <= 0, dense).otherwise(0.7 * unit + 0.3 * sparse / top)


def half_and_half(rows: DataFrame, k: int, score: str, similarity: str, *ties: str) -> DataFrame:
    """ceil(k/2) rows by ``score``, then floor(k/2) of the rest by ``similarity``; ranked by ``score``."""
    by_score = rows.orderBy(F.col(score).desc(), *ties).limit((k + 1) // 2)
    rest = rows.join(F.broadcast(by_score.select(*ties)), list(ties), "left_anti")
    chosen = by_score.unionByName(rest.orderBy(F.col(similarity).desc(), *ties).limit(k // 2))
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), *ties)))


# Words without weight.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "by", "for", "from", "with", "as", "is", "are", "was", "were", "be", "been", "it", "its", "this", "that", "these", "those", "not", "no",
]


def _feature_counts(batches: Iterator[pa.RecordBatch], names: list[str], features: list[str]) -> Iterator[pa.RecordBatch]:
    """(key, f) of (key, words): how often each feature is among the words and pairs of neighbours, as (place in ``features``, times)."""
    known = pa.array(features, pa.string())
    for batch in batches:
        words = batch.column(1)
        flat, row = words.flatten().cast(pa.string()), pc.list_parent_indices(words)
        near = pc.equal(row[:-1], row[1:])
        pairs = pc.binary_join_element_wise(flat[:-1], flat[1:], " ").filter(near)
        place = pc.index_in(pa.chunked_array([flat, pairs]), value_set=known)
        both = pa.table({"row": pa.chunked_array([row, row[:-1].filter(near)]), "i": place}).filter(pc.is_valid(place))
        counts = both.group_by(["row", "i"]).aggregate([([], "count_all")]).sort_by([("row", "ascending"), ("i", "ascending")]).combine_chunks()
        held = pa.StructArray.from_arrays([counts["i"].combine_chunks().cast(pa.int32()), counts["count_all"].combine_chunks().cast(pa.int64())], ["i", "tf"])
        ends = np.searchsorted(counts["row"].to_numpy(), np.arange(len(batch) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), held)], names)


def tfidf_search(docs: DataFrame, key: str, text: str, query: str, k: int = 3, least: float = 0.1, features: int = 1000, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(key, score, rank) of the ``k`` rows most like ``query`` by TF-IDF cosine of words and word pairs, at ``least`` or more.

    Words have two characters and more, without ``stop``; the features are the most frequent terms of the rows; idf is smoothed and vectors have
    unit length. Terms are added up before they are shuffled, without their documents; then each text is counted in place, for the features only
    (at most ``features`` numbers a row). Rows of one key are one document.
    """
    spark = docs.sparkSession

    def cut(column: Column) -> Column:
        found = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*stop))

    def terms(column: Column) -> Column:
        pairs = lambda ws: F.zip_with(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.transform(F.array(cut(column)), lambda ws: F.concat(ws, pairs(ws)))[0]

    totals = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("total"))
    kept = [r.term for r in totals.orderBy(F.col("total").desc(), "term").limit(features).collect()]  # at most ``features`` rows
    words = docs.select(key, cut(F.col(text)).alias("words"))
    schema = f"`{key}` {dict(docs.dtypes)[key]}, f array<struct<i: int, tf: bigint>>"
    counts = materialize(words.mapInArrow(lambda batches: _feature_counts(batches, [key, "f"], kept), schema), "feature_counts")
    several = materialize(counts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("_k")), "repeated")
    if not several.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_k"))
        added = counts.join(several, same, "left_semi").select(key, F.explode("f").alias("f")).groupBy(key, F.col("f.i").alias("i")).agg(F.sum("f.tf").alias("tf"))
        added = added.groupBy(key).agg(F.collect_list(F.struct("i", "tf")).alias("f"))
        counts = materialize(counts.join(several, same, "left_anti").unionByName(added), "feature_counts")
    df = dict(counts.select(F.explode("f.i").alias("i")).groupBy("i").agg(F.count("*").alias("df")).collect())  # of the features
    n = docs.count()
    idf = [math.log((1 + n) / (1 + df.get(i, 0))) + 1 for i in range(len(kept))]
    place = {t: i for i, t in enumerate(kept)}
    asked = [0.0] * len(kept)
    for t in spark.range(1).select(terms(F.lit(query)).alias("terms")).first().terms:
        if t in place:
            asked[place[t]] += idf[place[t]]
    length = math.sqrt(sum(q * q for q in asked)) or 1.0
    at = lambda values, f: F.get(F.array(*map(F.lit, values)), f["i"])
    total = lambda value: F.aggregate("f", F.lit(0.0), lambda a, f: a + value(f))
    dot = total(lambda f: f["tf"] * at(idf, f) * at(asked, f))
    norm = F.sqrt(total(lambda f: f["tf"] * at(idf, f) * f["tf"] * at(idf, f)))
    near = counts.where(F.exists("f", lambda f: at(asked, f) > 0)).where(F.col(key).isNotNull())
    scored = near.select(key, F.round(dot / (norm * length), 6).alias("score"))
    return top_k(scored.where(F.col("score") >= least), "score", k, key)
