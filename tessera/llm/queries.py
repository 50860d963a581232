"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.oracles import ORACLES  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    from tessera.llm.words import own_session

    return own_session(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), texts=False).drop("removed")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import fit, held_out, predict

    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()), vocabulary("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import chat

    said = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    events = chat.conversation_events(rows.unionByName(extra))
    return chat.digests(chat.parse(chat.render(chat.fold(events))))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import held_out
    from tessera.llm.quality import fit, measure, score
    from tessera.scratch import materialize

    measured = materialize(measure(read_table(spark, sf_dir, "documents")), "statistics")
    trees = fit(measured, read_table(spark, sf_dir, "labels").where(~held_out()))
    return score(measured, trees).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_dedup import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_files import read_token_files, write_token_files
    from tessera.scratch import kept_path

    path = kept_path(spark, "token_files")
    write_token_files(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0, path)
    return read_token_files(spark, path)


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ball_kmeans import cluster

    return cluster(read_table(spark, sf_dir, "embeddings"), k=16, rounds=3)


def op12_bucketed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bucketed import BUCKETS, crc_bucket, rewrite_pair, write_numbered
    from tessera.scratch import kept_path

    path = kept_path(spark, "bucketed")
    sales, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "sale_lines"))
    bucket = F.coalesce(crc_bucket(F.col("sale_id"), BUCKETS, "s"), F.lit(BUCKETS + 1))
    write_numbered(sales, bucket - F.when(bucket % 4 == 1, 1).otherwise(0), BUCKETS + 2, "sale_id", f"{path}/sales")
    write_numbered(lines, F.coalesce(crc_bucket(F.col("item_id"), BUCKETS), F.lit(0)), BUCKETS, "sale_id", f"{path}/sale_lines")
    schemas = {"sales": sales.schema, "sale_lines": lines.schema}
    return rewrite_pair(spark, path, "sales", "sale_lines", schemas, "sale_id", salt="s")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard

    out = shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    text = F.coalesce("text", F.lit(""))
    digest = [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]
    return out.select("doc_id", *digest, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _returned(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query's result in the caller's session, whatever session its operator worked in."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessera.llm.words import in_session

        return in_session(query(spark, sf_dir), spark)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _returned(f)
    for f in (
        op1_minhash_dedup,
        op2_chat_formatting,
        op3_quality,
        op4_license_scan,
        op5_substring_dedup,
        op6_packing,
        op7_language_id,
        op8_embedding_dedup,
        op9_token_files,
        op10_decontamination,
        op11_ball_kmeans,
        op12_bucketed_pair,
        op13_sharding,
    )
}
