"""Queries of the semantic chunk index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import chunks as C
from tessera.scratch import materialize
from tessera.sources.tables import read

_BITS = 24


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.format_string("f%012d", "doc_id").alias("path"), "text")


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that each file keeps of the 1000 of an index, with the characters in them."""
    kept = C.capped(C.cut(_files(spark, sf_dir)))
    return kept.groupBy("path").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


_CHUNKS = """l as (select {key}, unnest(string_split(coalesce(text, ''), chr(10))) as content, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as line from {of}),
z as (select {key}, line, p, substring(content, p * 2000 + 1, 2000) as content from (select *, unnest(range((length(content) - 1) // 2000 + 1)) as p from l where trim(content) <> '')),
k as (select {key}, content, row_number() over (partition by {key} order by line, p) as place from z)"""
CHUNK_INDEX = f"""with f as (select format('f{{:012d}}', doc_id) as path, text from documents), {_CHUNKS.format(key="path", of="f")},
c as (select path as name, count(*) as n from k group by 1),
b as (select *, sum(n) over () as total, count(*) over () as names, row_number() over (order by n desc, name) as seat from c),
x as (select name, n, names, case when names >= 1000 then (seat <= 1000)::bigint else least(n, 1 + floor(n / total * (1000 - names)))::bigint end as base from b),
o as (select 1000 - sum(base) as free from x),
r as (select name, n, unnest(range(1, least(n - base, free)::bigint + 1)) as round from x, o where free > 0 and names < 1000),
g as (select name, count(*) as extra from (select *, row_number() over (order by round, n desc, name) as turn from r), o where turn <= free group by 1),
s as (select name, base + coalesce(extra, 0) as slots from x left join g using (name))
select path, count(*) as chunks, sum(length(content))::bigint as chars from k join s on name = path where place <= slots group by 1"""


def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest chunks of all documents, to the head of each document whose id is divisible by 100."""
    files = _files(spark, sf_dir)
    cuts = C.cut(files.drop("path").withColumnRenamed("doc_id", "path"))
    chunk = F.shiftleft(F.col("path"), _BITS) + F.col("place")
    vectors = materialize(C.embed(cuts.select(chunk.alias("id"), "content")).select("id", "vector"), "vectors")
    n = vectors.count()
    centroids = C.train(vectors, cells=max(1, min(C.MOST_CELLS, int(n**0.5))))
    queries = C.embed(files.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "text"), "text")
    found = C.search(materialize(C.place(vectors, centroids), "placed"), centroids, queries, k=3, probes=8, exact=True)
    return found.select(
        F.col("query").alias("doc_id"), "place", F.shiftright("id", _BITS).alias("found_doc"), (F.col("id") % (1 << _BITS)).alias("found_place"), F.round("similarity", 9).alias("similarity")
    )


def _sparse(name: str, of: str, key: str) -> str:
    return f"""{name}t as (select {key}, sha256(unnest(regexp_extract_all(lower(substring(content, 1, 600)), '[\\p{{L}}\\p{{N}}]+'))) as h from {of}),
{name} as (select {key}, ('0x' || substring(h, 1, 4))::int % 128 as dim, sum(case when ('0x' || substring(h, 5, 2))::int % 2 = 0 then 1 else -1 end) as x from {name}t group by all),
{name}n as (select {key}, sum(x * x) as size from {name} group by all)"""


CHUNK_SEARCH = f"""with {_CHUNKS.format(key="doc_id", of="documents")}, {_sparse("v", "k", "doc_id, place")},
a as (select doc_id as query, text as content from documents where doc_id % 100 = 0), {_sparse("q", "a", "query")},
d as (select query, doc_id, place, sum(v.x * q.x) as dot from v join q using (dim) group by all),
s as (select query, doc_id as found_doc, place as found_place, dot::double / sqrt((vn.size * qn.size)::double) as similarity from d join vn using (doc_id, place) join qn using (query)),
r as (select *, row_number() over (partition by query order by similarity desc, found_doc, found_place) as place from s)
select query as doc_id, place, found_doc, found_place, round(similarity, 9) as similarity from r where place <= 3"""


def chunk_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each file after stored files met a newer state: some have another last line, some are gone; 5000 chunks may be embedded anew."""
    files = _files(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    new = files.where("doc_id % 13 > 0").select("path", F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit("\nadded line"))).otherwise(text).alias("text"))
    stored = materialize(C.embed(C.cut(files)), "stored")
    old = files.select("path", F.sha2(text, 256).alias("hash"))
    hashes, chunks, embedded = C.refresh(old, stored, new.withColumn("hash", F.sha2("text", 256)), most=5000)
    fresh = embedded.groupBy("path").agg(F.count("*").alias("embedded"))
    counted = chunks.groupBy("path").agg(F.count("*").alias("chunks"))
    return hashes.join(counted, "path", "left").join(fresh, "path", "left").select("path", "hash", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("embedded", F.lit(0)).alias("embedded"))


CHUNK_REFRESH = f"""with f as (select doc_id, format('f{{:012d}}', doc_id) as path, coalesce(text, '') as old, case when doc_id % 3 = 0 then coalesce(text, '') || chr(10) || 'added line' else coalesce(text, '') end as text from documents),
{_CHUNKS.format(key="path", of="f")}, n as (select path, count(*) as n from k group by 1),
lo as (select path, unnest(string_split(old, chr(10))) as content from f), o as (select path, sum((length(content) - 1) // 2000 + 1) filter (trim(content) <> '') as n from lo group by 1),
w as (select path, n, sum(n) over (order by path) - n as before from f join n using (path) where doc_id % 13 > 0 and doc_id % 3 = 0),
s as (select min(path) as stop from w where before >= 5000)
select f.path, sha256(case when doc_id % 3 = 0 and done then text else old end) as hash, (case when doc_id % 3 = 0 and done then n.n else coalesce(o.n, 0) end)::bigint as chunks,
  case when doc_id % 3 = 0 and done then n.n else 0 end as embedded
from (select f.*, stop is null or path < stop as done from f, s) f left join n using (path) left join o using (path) where not (doc_id % 13 = 0 and done)"""

QUERIES = {"chunk_index": (chunk_index, CHUNK_INDEX), "chunk_search": (chunk_search, CHUNK_SEARCH), "chunk_refresh": (chunk_refresh, CHUNK_REFRESH)}
