"""Text and dedup queries over documents, pages and benchmark, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import decisions as D, text as T
from tessera.functions.scores import cosine
from tessera.operators.similarity import jaccard_pairs
from tessera.operators.minhash import near_classes
from tessera.plans.search import _COS, _TOKENS, REVISIONS, revisions
from tessera.scratch import materialize
from tessera.sources.tables import read


def generalize_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical signatures (kind | scope | generalised text); the first of each keeps the row, twins add to its count."""
    d = read(spark, sf_dir, "conversations").where("role <> 'system'")
    rows = d.select("conv_id", "turn", F.concat_ws("|", "role", F.lit("project"), T.generalize(F.coalesce("text", F.lit("")))).alias("signature"))
    first = F.min(F.struct("conv_id", "turn")).alias("first")
    out = rows.groupBy(F.sha2("signature", 256).alias("signature")).agg(first, F.count("*").alias("copies"))
    return out.select("signature", F.col("first.conv_id").alias("conv_id"), F.col("first.turn").alias("turn"), "copies")


def _sql_generalize(text: str) -> str:
    """The canonical form, its values written out; this engine's word bounds are ASCII, so letters beyond get a mark of a word first."""
    word = r"[\p{L}\p{N}_]"
    before, after = f"(^|[^{word[1:-1]}])", f"($|[^{word[1:-1]}])"

    def swap(x: str, body: str, put: str) -> str:
        spread = f"regexp_replace({x}, '([^{word[1:-1]}])', chr(1) || '\\1' || chr(1), 'g')"
        inner = body.replace(" ", chr(1) + " " + chr(1)) if body.startswith("(?i)") else body
        flags, inner = ("(?i)", inner[4:]) if inner.startswith("(?i)") else ("", inner)
        return f"replace(regexp_replace({spread}, '{flags}(^|{chr(1)})(?:{inner})($|{chr(1)})', '\\1{put}\\2', 'g'), chr(1), '')"

    out = text
    for body, put in (
        (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
        (r"(?:[A-Za-z]:)?(?:[\\/][\p{L}\p{N}_.-]+){2,}", "<path>"),
    ):
        out = f"regexp_replace({out}, '{body}', '{put}', 'g')"
    out = swap(out, "[0-9a-f]{7,64}", "<hash>")
    out = f"regexp_replace(regexp_replace({out}, '{before}(v?[0-9]+(?:\\.[0-9]+){{1,3}}(?:-[\\p{{L}}\\p{{N}}_.+-]*[\\p{{L}}\\p{{N}}_])?){after}', '\\1<version>\\3', 'g'), '{before}(v?[0-9]+(?:\\.[0-9]+){{1,3}}(?:-[\\p{{L}}\\p{{N}}_.+-]*[\\p{{L}}\\p{{N}}_])?){after}', '\\1<version>\\3', 'g')"
    out = swap(out, "[0-9]{5,}", "<n>")
    for body, put in (
        ("(?i)log in|sign in", "authenticate"), ("(?i)get|fetch|retrieve|obtain|pull|download|load", "fetch"), ("(?i)send|submit|post|push|upload|transmit", "send"),
        ("(?i)create|make|build|add|new", "create"), ("(?i)delete|remove|drop|destroy|erase", "delete"), ("(?i)update|modify|change|edit|patch|alter", "update"),
        ("(?i)validate|verify|check|test|confirm|assert", "validate"), ("(?i)authenticate|auth|login|signin", "authenticate"),
    ):
        out = swap(out, body, put)
    out = f"regexp_replace({out}, '`[^`]*`|\"[^\"]*\"', '<q>', 'g')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


GENERALIZE = f"""with s as (select conv_id, turn, sha256(concat_ws('|', role, 'project', {_sql_generalize("coalesce(text, '')")})) as signature from conversations where role <> 'system'),
r as (select *, row_number() over (partition by signature order by conv_id, turn) as rn, count(*) over (partition by signature) as copies from s)
select signature, conv_id, turn, copies from r where rn = 1"""


def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by content hash: the first path of each hash and how many share it."""
    d = read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.sha2("text", 256).alias("hash"))
    return d.groupBy("hash").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


HASH_DEDUP = "select sha256(text) as hash, min(source || '/' || lpad(doc_id::varchar, 9, '0')) as path, count(*) as copies from documents group by 1"


def near_dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct short texts whose white-space token sets reach Jaccard 0.8 (exact)."""
    d = read(spark, sf_dir, "conversations").where("role = 'user'").groupBy("text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), "[ \t\n\r\f]+"), lambda t: t != ""))
    pages = read(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    rows = d.select("id", "text").unionByName(pages).unionByName(pages.select((F.col("id") * 1000).alias("id"), F.concat("text", F.lit(" extra")).alias("text")))
    return jaccard_pairs(rows.select("id", tokens.alias("tokens")), 0.8)


NEAR_DUP = """with t as (select min(conv_id * 1000 + turn) as id, text from conversations where role = 'user' group by text
  union all select -1 - item_id, text from benchmark union all select (-1 - item_id) * 1000, text || ' extra' from benchmark),
s as (select id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) as toks from t),
e as (select id, len(toks) as n, unnest(toks) as tok from s),
p as (select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as c from e a join e b on a.tok = b.tok and a.id < b.id group by all)
select a, b, round(c / (na + nb - c), 6) as jaccard from p where c >= 0.8 * (na + nb - c)"""


def near_dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies among all documents, by white-space token sets at Jaccard 0.8: each document with the smallest id that links reach."""
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[ \t\n\r\f]+"), lambda t: t != ""))
    classes = near_classes(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tokens.alias("tokens")))
    return classes.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


NEAR_CLASSES = r"""with recursive s as (select distinct doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f]+'), lambda t: t <> '')) as t from documents),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.t = b.t and a.doc_id <> b.doc_id group by all),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where c >= 0.8 * (x.n + y.n - c)),
r as (select a as node, a as seen from e union select r.node, e.b from r join e on e.a = r.seen),
m as (select node, min(seen) as class from r group by 1)
select doc_id, coalesce(class, doc_id) as class_id, coalesce(class, doc_id) = doc_id as kept from documents left join m on node = doc_id"""


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added-line overlap of documents and benchmark items: containment by the smaller side, Jaccard over the union."""
    lines = lambda df, key: df.select(key, F.explode(F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0))).alias("line"))
    a, b = lines(read(spark, sf_dir, "documents"), "doc_id"), lines(read(spark, sf_dir, "benchmark"), "item_id")
    na, nb = a.groupBy("doc_id").agg(F.count("*").alias("na")), b.groupBy("item_id").agg(F.count("*").alias("nb"))
    hits = a.join(b, "line").groupBy("doc_id", "item_id").agg(F.count("*").alias("common"))
    out = hits.join(na, "doc_id").join(nb, "item_id")
    return out.select(
        "doc_id", "item_id", F.round(F.col("common") / F.least("na", "nb"), 6).alias("containment"), F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard")
    )


OVERLAP = """with a as (select distinct doc_id, unnest(string_split(text, chr(10))) as line from documents), b as (select distinct item_id, unnest(string_split(text, chr(10))) as line from benchmark),
x as (select * from a where length(trim(line)) > 0), y as (select * from b where length(trim(line)) > 0),
na as (select doc_id, count(*) as na from x group by 1), nb as (select item_id, count(*) as nb from y group by 1),
h as (select doc_id, item_id, count(*) as c from x join y using (line) group by all)
select doc_id, item_id, round(c / least(na, nb), 6) as containment, round(c / (na + nb - c), 6) as jaccard from h join na using (doc_id) join nb using (item_id)"""


def supersession(spark: SparkSession, sf_dir: str, bar: float = 0.85) -> DataFrame:
    """For each later vector (three revisions of each) the earlier one of its label that it supersedes: the oldest with a cosine over the bar."""
    from tessera.operators.vectors import earliest_link

    v = revisions(spark, sf_dir)
    best = earliest_link(v, bar)
    both = best.join(v.select("id", F.col("vector").alias("e")), "id").join(v.select(F.col("id").alias("first"), F.col("vector").alias("o")), "first")
    conf = F.greatest(0.1 + F.col("id") % 9 / 10, F.least(F.lit(1.0), 0.1 + F.col("first") % 9 / 10 + 0.05))
    return both.select(F.col("id").alias("fact_id"), F.col("first").alias("superseded"), F.round(cosine(F.col("e"), F.col("o")), 6).alias("similarity"), F.round(conf, 6).alias("confidence"))


SUPERSESSION = f"""with {REVISIONS}, p as (select a.vec_id as fact_id, b.vec_id as old_id, {_COS.format(a="a.embedding", b="b.embedding")} as similarity from revisions a join revisions b on a.label = b.label and b.vec_id < a.vec_id),
r as (select *, row_number() over (partition by fact_id order by old_id) as rn from p where similarity > 0.85)
select fact_id, old_id as superseded, round(similarity, 6) as similarity, round(greatest(0.1 + fact_id % 9 / 10, least(1.0, 0.1 + old_id % 9 / 10 + 0.05)), 6)::double as confidence from r where rn = 1"""


def supersession_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact's chain of superseded predecessors, cycle-safe, by pointer doubling on written tables."""
    from tessera.operators.chains import chain_ends

    return chain_ends(supersession(spark, sf_dir).select(F.col("fact_id").alias("node"), F.col("superseded").alias("next")))


CHAIN = f"""with recursive {SUPERSESSION[5:SUPERSESSION.index("select fact_id, old_id as superseded")].strip()},
l as (select fact_id as node, old_id as next from r where rn = 1),
c as (select node, next, 1 as depth from l union all select c.node, l.next, c.depth + 1 from c join l on l.node = c.next where c.depth < 100)
select node, arg_max(next, depth) as root, max(depth) as depth from c group by node"""


def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    red = T.redact(F.col("text"))
    return d.select("doc_id", F.sha2(red, 256).alias("redacted_sha256"), (red != F.col("text")).alias("changed"))


REDACT = r"""select doc_id, sha256(r) as redacted_sha256, r <> text as changed from (select doc_id, text,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bsk-[A-Za-z0-9_-]{20,}\b', '[REDACTED]', 'g'), '\bAKIA[A-Z0-9]{16}\b', '[REDACTED]', 'g'),
    '\bghp_[A-Za-z0-9]{20,}\b', '[REDACTED]', 'g'), '\bxox[baprs]-[A-Za-z0-9-]{10,}\b', '[REDACTED]', 'g'),
    '(?i)\b(password|passwd|api[_-]?key|access[_-]?token|secret)\s*[:=]\s*([^\s,;]+)', '\1=[REDACTED]', 'g') as r from documents)"""


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers and secrets by line, at most eight findings a document."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    marker = F.regexp_extract("line", r"(^|[^A-Za-z])(TODO|FIXME|HACK|XXX)($|[^A-Za-z])", 2)
    kind = F.when(marker != "", F.concat(F.lit("marker:"), marker)).when(F.col("line").rlike(r"(?i)(api_key|secret|password|token)[ \t]*[:=]"), "secret")
    kind = kind.when(F.length("line") > 2000, "long_line")
    found = lines.select("doc_id", F.col("at").alias("line_no"), kind.alias("kind"), F.substring("line", 1, 40).alias("snippet")).where("kind is not null")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return found.withColumn("rn", F.row_number().over(w)).where("rn <= 8").drop("rn")


FINDINGS = """with l as (select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as line_no, unnest(string_split(text, chr(10))) as line from documents),
k as (select doc_id, line_no, case when regexp_extract(line, '(^|[^A-Za-z])(TODO|FIXME|HACK|XXX)($|[^A-Za-z])', 2) <> '' then 'marker:' || regexp_extract(line, '(^|[^A-Za-z])(TODO|FIXME|HACK|XXX)($|[^A-Za-z])', 2)
  when regexp_matches(line, '(?i)(api_key|secret|password|token)[ \\t]*[:=]') then 'secret' when length(line) > 2000 then 'long_line' end as kind, substring(line, 1, 40) as snippet from l),
r as (select *, row_number() over (partition by doc_id order by line_no) as rn from k where kind is not null)
select doc_id, line_no, kind, snippet from r where rn <= 8"""


_ASKED = "the quick heit and the thing with ring, ring of the ung schaft tion tion"


def exemplar_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents most like a query text by TF-IDF of words and pairs, 1000 features; at least 0.1, best twenty."""
    from tessera.operators.retrieval import tfidf_search

    return tfidf_search(read(spark, sf_dir, "documents"), "doc_id", "text", _ASKED, 20)


_STOP = "['the','a','an','and','or','but','of','to','in','on','at','by','for','from','with','as','is','are','was','were','be','been','it','its','this','that','these','those','not','no']"
_GRAMS = "list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1 and not list_contains(" + _STOP + ", x))"
TFIDF = f"""with w as (select doc_id, {_GRAMS.format(t="coalesce(text, '')")} as w from documents), qw as (select {_GRAMS.format(t="'" + _ASKED + "'")} as w),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w) group by all),
f as (select term, count(*) as df from tf group by term order by sum(tf) desc, term limit 1000),
x as (select doc_id, term, tf * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as x from tf join f using (term)),
q as (select term, count(*) * (ln((1 + (select count(*) from documents)) / (1 + any_value(df))) + 1) as q from (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from qw) join f using (term) group by term),
n as (select doc_id, sqrt(sum(x * x)) as norm from x group by 1), s as (select doc_id, round(sum(x * q) / (any_value(norm) * (select sqrt(sum(q * q)) from q)), 6) as score from x join q using (term) join n using (doc_id) group by 1)
select doc_id, score, rank from (select *, row_number() over (order by score desc, doc_id) as rank from s where score >= 0.1) where rank <= 20"""


def exemplar_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word overlap of each item with the query item, by the larger set; at least 0.1."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokenize(F.col("text"))).alias("w"))
    query = F.broadcast(words.where("item_id = 1").select(F.col("w").alias("q")))  # one row
    score = F.round(F.size(F.array_intersect("w", "q")) / F.nullif(F.greatest(F.size("w"), F.size("q")), F.lit(0)), 6)
    return words.where("item_id <> 1").crossJoin(query).select("item_id", score.alias("score")).where("score >= 0.1")


EX_OVERLAP = f"""with w as (select item_id, list_distinct({_TOKENS}) as w from benchmark), q as (select w as q from w where item_id = 1)
select item_id, score from (select item_id, round(len(list_intersect(w, q)) / nullif(greatest(len(w), len(q)), 0), 6) as score from w, q where item_id <> 1) where score >= 0.1"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project and global signatures: the fingerprint in brackets is cut out and re-joined, or left out with all qualifiers."""
    subject = F.concat("source", F.lit(" get doc "), F.col("doc_id").cast("string"), F.lit(" [fp:"), (F.col("doc_id") % 50).cast("string"), F.lit("] [lang "), "lang", F.lit("]"))
    s = read(spark, sf_dir, "documents").select("doc_id", subject.alias("s"))
    fp = F.regexp_extract("s", r"\[fp:([^\]]*)\]", 1)
    base = T.generalize(F.regexp_replace("s", r"\[fp:[^\]]*\]", ""))
    project = F.when(base == "", "").otherwise(F.concat(base, F.lit("\x1f"), fp))
    return s.select("doc_id", project.alias("project_signature"), T.generalize(F.regexp_replace("s", r"\[[^\]]*\]", "")).alias("global_signature"))


SIGNATURES = f"""with s as (select doc_id, source || ' get doc ' || doc_id || ' [fp:' || (doc_id % 50) || '] [lang ' || lang || ']' as s from documents)
select doc_id, {_sql_generalize("regexp_replace(s, '[[]fp:[^]]*[]]', '', 'g')")} || chr(31) || regexp_extract(s, '[[]fp:([^]]*)[]]', 1) as project_signature,
  {_sql_generalize("regexp_replace(s, '[[][^]]*[]]', '', 'g')")} as global_signature from s"""


def prevention_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prevention patterns that apply to a text: at least half of a pattern's keywords occur in it."""
    patterns = [("boundary", ["tion", "ing ", "the "]), ("concurrency", ["heit", "ung", "schaft"]), ("overflow", ["ción", "mente", "zzz", "qqq"])]
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("t"))
    held = F.array(*[F.struct(F.lit(n).alias("category"), sum((F.contains("t", F.lit(k)).cast("int") for k in ks), F.lit(0)).alias("hits"), F.lit(len(ks)).alias("size")) for n, ks in patterns])
    p = rows.select("item_id", F.explode(held).alias("p"))
    return p.where("p.hits >= p.size * 0.5").select("item_id", "p.category", "p.hits")


PREVENTION = """with p as (select * from (values ('boundary', ['tion','ing ','the ']), ('concurrency', ['heit','ung','schaft']), ('overflow', ['ción','mente','zzz','qqq'])) as p(category, ks)),
h as (select item_id, category, len(list_filter(ks, lambda k: contains(lower(text), k)))::int as hits, len(ks) as n from benchmark, p)
select item_id, category, hits from h where hits >= n * 0.5"""


_BITS = ["You are given a set. ", "Find the maximum of it; return true if so. ", "def f(): ", "class A: ", "", "check if the ring holds. "]


def junk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junk entries among all documents, each behind a few phrases: by phrases of problem descriptions, code and length."""
    n = F.col("doc_id")
    pick = lambda k: F.element_at(F.array(*map(F.lit, _BITS)), (k % 6 + 1).cast("int"))
    d = read(spark, sf_dir, "documents").select("doc_id", pick(n).alias("p"), F.concat(pick(F.floor(n / 6)), F.coalesce("text", F.lit(""))).alias("s"))
    return d.select("doc_id", D.junk_phrases(F.concat("p", F.lit(" "), "s")).alias("phrases"), D.is_junk(F.col("p"), F.col("s")).alias("junk"))


JUNK = """with b as (select doc_id, ['You are given a set. ','Find the maximum of it; return true if so. ','def f(): ','class A: ','','check if the ring holds. '] as bits, coalesce(text, '') as text from documents),
t as (select doc_id, bits[(doc_id % 6 + 1)::int] as p, bits[(doc_id // 6 % 6 + 1)::int] || text as s from b), l as (select *, lower(p || ' ' || s) as low from t),
h as (select doc_id, s, low, len(list_filter(['you are given','given an array','given a string','return true if','return the number of','find the number of','find the maximum','find the minimum','determine if the','calculate the number','check if the'], lambda k: contains(low, k)))::int as phrases from l)
select doc_id, phrases, (phrases >= 2 and length(s) > 150) or (phrases >= 1 and length(s) > 300) or ((contains(s, 'def ') or contains(s, 'class ')) and length(s) > 100
  and not regexp_matches(low, 'two pointer|left right|start end|both ends|from edges|sliding window|subarray|substring|consecutive|window size|hash map|dictionary|frequency|count occurrences|lookup|binary search|sorted array|log n|divide half|mid point|dp|dynamic programming|memoization|subproblem|optimal substructure|greedy|local optimum|sorted first|priority|backtrack|recursion|try all|explore paths|permutation|combination|graph|bfs|dfs|traversal|adjacency|connected|tree|binary tree|level order|inorder|preorder|postorder|stack|lifo|push pop|monotonic|queue|fifo|deque|heap|sort')) as junk from h"""


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recall@k, hit@k and MRR of keyword ranks: each language asks its own terms; relevant are its good documents of one source."""
    from tessera.operators import retrieval as R

    docs = read(spark, sf_dir, "documents")
    truth = docs.join(read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    ranked = None
    for name, terms in (("en", ["the", "and", "of"]), ("de", ["die", "und", "der"]), ("fr", ["le", "les", "de"]), ("es", ["de", "la", "que"])):
        scored = R.bm25(docs, "doc_id", T.tokenize(F.col("text")), terms).select(F.lit(name).alias("query"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))
        top = R.top_k(scored, "score", 100, "doc_id")
        ranked = top if ranked is None else ranked.unionByName(top)
    rel = truth.select(F.col("lang").alias("query"), "doc_id")
    hits = ranked.join(rel, ["query", "doc_id"]).groupBy("query").agg(F.count(F.when(F.col("rank") <= 50, 1)).alias("found"), F.min("rank").alias("first"))
    per = rel.groupBy("query").agg(F.count("*").alias("relevant")).join(hits, "query", "left").na.fill(0, ["found"])
    return per.select("query", F.round(F.col("found") / F.col("relevant"), 6).alias("recall"), (F.col("found") > 0).alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def _ir_sql() -> str:
    from tessera.plans.search import _bm25_sql

    parts = []
    for name, terms in (("en", ["the", "and", "of"]), ("de", ["die", "und", "der"]), ("fr", ["le", "les", "de"]), ("es", ["de", "la", "que"])):
        inner = f"with {_bm25_sql('documents', 'doc_id', _TOKENS, terms)} select '{name}' as query, doc as doc_id, row_number() over (order by round(score, 6) desc, doc) as rank from scored"
        parts.append(f"(select * from ({inner}) where rank <= 100)")
    return f"""with ranked as ({" union all ".join(parts)}),
rel as (select lang as query, doc_id from documents where doc_id in (select doc_id from labels where quality = 1)),
h as (select query, count(*) filter (rank <= 50) as found, min(rank) as first from ranked join rel using (query, doc_id) group by 1)
select query, round(coalesce(found, 0) / relevant, 6) as recall, coalesce(found, 0) > 0 as hit, round(coalesce(1 / first, 0), 6) as reciprocal_rank
from (select query, count(*) as relevant from rel group by 1) left join h using (query)"""


QUERIES = {
    "generalize_dedup": (generalize_dedup, GENERALIZE),
    "content_hash_dedup": (content_hash_dedup, HASH_DEDUP),
    "near_dup_jaccard": (near_dup_jaccard, NEAR_DUP),
    "near_dup_documents": (near_dup_documents, NEAR_CLASSES),
    "benchmark_overlap": (benchmark_overlap, OVERLAP),
    "supersession": (supersession, SUPERSESSION),
    "supersession_chain": (supersession_chain, CHAIN),
    "secret_redaction": (secret_redaction, REDACT),
    "line_findings": (line_findings, FINDINGS),
    "exemplar_tfidf": (exemplar_tfidf, TFIDF),
    "exemplar_overlap": (exemplar_overlap, EX_OVERLAP),
    "signatures": (signatures, SIGNATURES),
    "prevention_match": (prevention_match, PREVENTION),
    "junk_filter": (junk_filter, JUNK),
    "ir_metrics": (ir_metrics, _ir_sql()),
}
