"""Queries of the file index, the front door and the ledgers, with their SQL."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import chunks, frontdoor, includes, index as I, ledger as L, patches as P
from tessera.plans.search import _CODE
from tessera.sources.tables import read

_TOP = ["docs", "src/app", "src/old", "tests", "lib/core/util"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    folder = F.element_at(F.array(*map(F.lit, _TOP)), (F.col("doc_id") % 5 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, ["py", "md", "ts", "go"])), (F.floor(F.col("doc_id") / 5) % 4 + 1).cast("int"))
    path = F.concat(folder, F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return d.select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def walk_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet files under the folder of the tables, by name and size."""
    return I.walk(spark, sf_dir, ["parquet"], ["_temporary/", "!*.parquet"]).select("path", "size")


def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and length of every file after a stored index was brought level with changed, new and removed files."""
    files, postings, _ = _refreshed(spark, sf_dir)
    return files.select("path").join(postings, "path").groupBy("path").agg(F.count("*").alias("terms"), F.sum("tf").alias("length"))


def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)[2]


def _refreshed(spark: SparkSession, sf_dir: str):
    f = _files(spark, sf_dir)
    n = F.col("doc_id")
    old = f.where("doc_id % 11 > 0").select("path", F.length("text").alias("size"), F.lit(1).alias("mtime"), F.sha2("text", 256).alias("hash"), "text")
    text = F.when(n % 5 == 0, F.concat("text", F.lit(" newTerm"))).otherwise(F.col("text"))
    new = f.where("doc_id % 13 > 0").select("path", F.length(text).alias("size"), F.when(n % 5 < 2, 2).otherwise(1).alias("mtime"), F.sha2(text, 256).alias("hash"), text.alias("text"))
    empty = old.where(F.lit(False))
    files, postings, _ = I.refresh(empty.drop("text"), empty.select("path", F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")), old, "", "v1")
    return I.refresh(files, postings, new, "v1", "v1")


_PATH = "['docs','src/app','src/old','tests','lib/core/util'][(doc_id % 5 + 1)::int] || '/f' || doc_id || '.' || ['py','md','ts','go'][(doc_id // 5 % 4 + 1)::int]"
INDEX = f"""with f as (select {_PATH} as source, case when doc_id % 5 = 0 then coalesce(text, '') || ' newTerm' else coalesce(text, '') end as text from documents where doc_id % 13 > 0),
t as (select source as path, unnest({_CODE}) as term from f)
select path, count(distinct term) as terms, count(*) as length from t group by 1"""
REPORT = """with s as (select doc_id, case when doc_id % 13 = 0 then 'removed' when doc_id % 11 = 0 then 'added' when doc_id % 5 > 1 then 'unchanged' when doc_id % 5 = 0 then 'changed' else 'touched' end as state from documents where doc_id % 13 > 0 or doc_id % 11 > 0)
select state, count(*) as files, 'incremental' as mode from s group by 1"""


def front_door(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a prompt gets: a named one, then by content, history, its nearest chunks and the names in the code, in 20 000 characters."""
    prompt = "why does src/app/f1.py lose the thing and the other ring"
    f = _files(spark, sf_dir).select("path", F.length("text").alias("size"), "text", (F.col("doc_id") % 9 == 0).alias("recent"))
    history = f.where("path like 'src/app/%'").select("path", F.lit(0.15).alias("boost"))
    near = chunks.nearest(f, prompt, 30)
    semantic = frontdoor.semantic_boost(near, F.lit(True)).withColumn("boost", F.round("boost", 9))
    got = frontdoor.select_files(f, prompt, 15, 20_000, excludes=["src/old/"], boosts=[history, semantic])
    return frontdoor.place_of(got).select("place", "path", "pinned", F.round("score", 6).alias("score"), "share")


def stratified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty files, one of each content, in proportion to the languages, shallow paths first."""
    return I.stratified(_files(spark, sf_dir).select("path", F.sha2("text", 256).alias("hash")), 40)


def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges of Python modules: each document's own text behind a few import lines."""
    f = _files(spark, sf_dir)
    n = F.col("doc_id")
    head = F.concat(F.lit("import os, pkg.m"), (n % 17).cast("string"), F.lit(" as x\nfrom pkg.m"), (n % 5).cast("string"), F.lit(" import a, b as c  # why\nfrom m"), n.cast("string"), F.lit(" import *\n"))
    return I.import_edges(f.select(F.concat(F.lit("m"), n.cast("string")).alias("module"), F.concat(head, "text").alias("text")))


IMPORTS = r"""with e as (select 'm' || doc_id as source, unnest(['os', 'pkg.m' || (doc_id % 17), 'pkg.m' || (doc_id % 5), 'pkg.m' || (doc_id % 5) || '.a', 'pkg.m' || (doc_id % 5) || '.b']) as target from documents)
select distinct source, target from e"""


def pending_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions (customers) that wait on a suggested path (orders), by the files that the urgent orders changed."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.element_at(F.array(*map(F.lit, ["src/", "docs/", "review/", "lib/"])), (k % 4 + 1).cast("int")), (k % 997).cast("string"), F.lit(".py"))
    ts = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    s = o.select(F.col("o_custkey").alias("session"), F.date_trunc("month", "o_orderdate").alias("m"), ts.alias("t"), path.alias("path"), path.alias("normalized"), (k % 10 == 0).alias("resolved"), "o_orderpriority")
    s = s.withColumn("ts", F.unix_seconds("m").cast("double"))
    changed = s.where("o_orderpriority = '1-URGENT'").select("path")
    return L.pending(s, changed, 799_000_000.0 + 0 * 86400)


PENDING = """with s as (select o_custkey as session, epoch(date_trunc('month', o_orderdate))::double as ts, ['src/','docs/','review/','lib/'][(o_orderkey % 4 + 1)::int] || (o_orderkey % 997) || '.py' as path, o_orderkey % 10 = 0 as resolved, o_orderpriority from orders)
select session, ts, count(*) as waiting, 798999998.0::double as scanned_through from s
where ts >= 799000000 - 14 * 86400 and not resolved and path not like 'docs/%' and path not like 'review/%' and path not in (select path from s where o_orderpriority = '1-URGENT') group by all"""


def project_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of customers' projects without those that contain others."""
    c = read(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    path = F.concat(F.lit("/home/u"), F.col("c_nationkey").cast("string"), F.when(n % 3 > 0, F.concat(F.lit("/p"), (n % 40).cast("string"))).otherwise(""), F.when(n % 7 == 1, "/sub").otherwise(""), F.when(n % 2 == 0, "/").otherwise(""))
    return L.project_roots(c.select(path.alias("path")))


ROOTS = """with r as (select distinct '/home/u' || c_nationkey || case when c_custkey % 3 > 0 then '/p' || (c_custkey % 40) else '' end || case when c_custkey % 7 = 1 then '/sub' else '' end as path from customer)
select path from r where not exists (select 1 from r as x where starts_with(x.path, r.path || '/'))"""


def first_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct asks of all user turns, the first of each."""
    t = read(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    capitals = F.translate("text", ascii_lowercase, ascii_uppercase)
    asks = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" \n"), capitals)).otherwise(F.concat("text", F.lit("\t ")))
    return L.first_asks(t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), asks.alias("ask"))).select("ordinal", "copies")


ASKS = r"""with k as (select conv_id * 1000 + turn as ordinal, lower(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) as s from conversations where role = 'user' and text is not null)
select min(ordinal) as ordinal, count(*) as copies from k group by s"""


def alias_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are one under several names, by device and inode: how many names each canonical one has."""
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("path"), (F.col("page_id") % 3).alias("device"), (F.col("page_id") % 70).alias("inode"))
    return L.first_spelling(p).groupBy("canonical").agg(F.count("*").alias("names"))


ALIASES = """select 'r' || min(page_id) as canonical, count(*) as names from pages group by page_id % 3, page_id % 70"""


def version_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified diffs of consecutive turns of a role in a conversation: added and removed lines and the reason of the change."""
    from pyspark.sql import Window

    from tessera.functions.rules import change_reason

    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("old"), "text")
    d = t.select("conv_id", "turn", P.unified_diff(F.col("old"), F.col("text")).alias("diff"))
    return d.select("conv_id", "turn", F.sha2("diff", 256).alias("diff_sha256"), change_reason(F.col("diff")).alias("reason"))


def version_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn again, from the turn before of its role and the diff between them; the diff is also applied to a text whose lines have moved down by two (what is only added to an empty text comes first)."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("old"), "text")
    d = t.select("conv_id", "turn", "old", P.unified_diff(F.col("old"), F.col("text")).alias("diff"))
    moved = F.when(F.coalesce("old", F.lit("")) != "", F.concat(F.lit("moved\ndown\n"), "old")).otherwise("moved\ndown")
    p = d.select("conv_id", "turn", P.applied(F.col("old"), F.col("diff")).alias("same"), P.applied(moved, F.col("diff")).alias("moved"))
    return p.select("conv_id", "turn", F.sha2("same.patched", 256).alias("text_sha256"), "same.refused", F.sha2("moved.patched", 256).alias("moved_sha256"))


PATCHES = """with t as (select conv_id, turn, coalesce(lag(text) over (partition by conv_id, role order by turn), '') as old, coalesce(text, '') as text from conversations)
select conv_id, turn, sha256(text) as text_sha256, 0 as refused, sha256(case when text = '' then 'moved' || chr(10) || 'down' when old = '' then text || chr(10) || 'moved' || chr(10) || 'down' else 'moved' || chr(10) || 'down' || chr(10) || text end) as moved_sha256 from t"""


def include_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What include patterns name among the documents as files: folders and extensions by glob, every seventh document by its path, and paths that are refused or nowhere."""
    f = _files(spark, sf_dir)
    files = f.select("doc_id", "path", (F.length("text") * 400).cast("long").alias("size"), (F.col("doc_id") % 31 == 0).alias("link"))
    paths = files.where("doc_id % 7 = 0").select((F.col("doc_id") + 100).alias("ordinal"), F.when(F.col("doc_id") % 14 == 0, F.concat(F.lit("./"), "path")).otherwise(F.col("path")).alias("pattern"))
    globs = ["docs/*7.md", "*.go", "lib/core/*/f1?.ts", "nowhere/*", "no/such/file.py", "src/old/*"]
    patterns = paths.unionByName(spark.createDataFrame(list(enumerate(globs)), "ordinal long, pattern string"))
    return includes.resolve(files.drop("doc_id"), patterns, ["src/old/"], ["py", "md", "go"]).select("state", "pattern", "path", "reason")


INCLUDES = f"""with f as (select doc_id, {_PATH} as path, length(coalesce(text, '')) * 400 as size, doc_id % 31 = 0 as link from documents),
p as (select doc_id + 100 as ordinal, case when doc_id % 14 = 0 then './' || path else path end as pattern, path as exact from f where doc_id % 7 = 0
  union all select * from (values (0, 'docs/*7.md', 'docs/*7.md'), (1, '*.go', '*.go'), (2, 'lib/core/*/f1?.ts', 'lib/core/*/f1?.ts'), (3, 'nowhere/*', 'nowhere/*'), (4, 'no/such/file.py', 'no/such/file.py'), (5, 'src/old/*', 'src/old/*'))),
w as (select * from f where not link and path not like 'src/old/%' and size <= 524288 and (path like '%.py' or path like '%.md' or path like '%.go')),
m as (select p.ordinal, p.pattern, w.path from p join w on w.path = p.pattern where p.ordinal >= 100 union all select p.ordinal, p.pattern, w.path from p join w on w.path glob p.pattern where p.ordinal < 100),
t as (select p.ordinal, p.pattern, f.path, case when link then 'a link' when f.path like 'src/old/%' then 'inside an ignored folder' when size > 67108864 then 'too large' end as reason
  from p left join f on f.path = p.exact where p.pattern not in (select pattern from m)),
n as (select 'matched' as state, * from m union all select 'rescued', ordinal, pattern, path from t where path is not null and reason is null),
r as (select *, row_number() over (partition by path order by ordinal, pattern) as k from n)
select state, pattern, path, null as reason from r where k = 1 union all select case when path is null then 'unmatched' else 'refused' end, pattern, path, reason from t where path is null or reason is not null"""

QUERIES = {
    "walk_repository": (walk_repository, None),
    "index_refresh": (index_refresh, INDEX),
    "index_report": (index_report, REPORT),
    "front_door": (front_door, None),
    "stratified_files": (stratified_files, None),
    "import_graph": (import_graph, IMPORTS),
    "pending_sessions": (pending_sessions, PENDING),
    "project_roots": (project_roots, ROOTS),
    "first_asks": (first_asks, ASKS),
    "alias_files": (alias_files, ALIASES),
    "include_sets": (include_sets, INCLUDES),
    "version_patches": (version_patches, PATCHES),
    "version_diffs": (version_diffs, None),
}
