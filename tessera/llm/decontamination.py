"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, slot consistency.

Texts become canonical tokens: runs of letters and digits, lower-cased; numbers, names and units after numbers become typed
placeholders. A name is a capitalised word inside a sentence, or one at a sentence's start that the text also has inside a sentence or at another
start, never in small letters (between a space and a space, comma, period or newline), and that is no usual opening word of a sentence. Windows of eight canonical tokens are hashed by three
doublings of pairwise hashes and joined with the items' windows; an item of four to seven tokens is one window of its own length. A document leaks an item if at least
``COVERAGE`` of the item's windows occur in it and its slots are consistent: within the matched windows of one alignment, each value in
the item corresponds to one value in the document throughout (a re-parameterised question) or to itself (an exact copy). An alignment
is one shift between item and document, or all shifts within ``DRIFT`` tokens of one, as inserted and dropped words move what follows.

Windows with fewer than four literal tokens are no evidence and are left out; an item without any other window ("What is 2
plus 2?") is found in documents that are this item as a whole, by the hash of the whole sequence.

Everything is DataFrame operations. The items' windows are broadcast only after a count shows that they fit
``BROADCAST_WINDOWS``; beyond that the join is shuffled. Documents are found by each item's rarest windows, as many as any document
that reaches the coverage must hit, so an instruction that many items share makes no pairs by itself; a found
document's windows then meet the items' as arrays. A hot passage only adds (document, item) pairs in proportion to the documents that have it. Null and empty texts match nothing. Rows of an equal or null ``doc_id`` are judged one by
one, each by its own text; items of an equal ``item_id`` too. Results name a pair of ids once, by its best row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.scratch import materialize

WINDOW, LITERALS, COVERAGE = 8, 4, 0.4
DRIFT = 2 * WINDOW
NO_ID = -(1 << 63)
BROADCAST_WINDOWS = 200_000
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
# Unit words.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yards mi mile miles g kg mg lb lbs oz ounces pounds grams kilograms tons tonnes "
    "l ml liter liters litre litres gallons s sec seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros pound cents percent degrees c f kmh mph w kw v hz gb mb kb meter meters metre metres"
).split()
# Words that open sentences and are no names.
OPENERS = (
    "A After All Also An And Any As At Because Before Both But By Calculate Did Do Does Each Every Find Five For Four From Given He Her His How I If In Is It "
    "Its Let Many Most My No Now Of On One Or Our She So Some Suppose That The Their Then There These They This Those Three Two We What When Where Which Who "
    "Why With You Your Zero Das Der Die Ein Eine Es Im In Was Wenn Wer Wie Wo Con El En La Las Los Por Que Si Un Una Avec Ce Ces Dans Elle Il Le Les Pour Un Une"
).split()
_INSIDE, _START = r"(?<=[\p{Ll}\p{N},] )\p{Lu}\p{L}*", rf"(?<![\p{{L}}\p{{N}}{NAME}])\p{{Lu}}\p{{L}}+"


def _opening_names() -> tuple[Column, Column]:
    """(capitalised words that are left in ``_named``, sorted, for a column ``_starts``; of those the names, by what the text has elsewhere)."""
    starts = F.sort_array(F.regexp_extract_all("_named", F.lit(_START), F.lit(0)))
    twice = F.zip_with("_starts", F.slice("_starts", F.lit(2), F.size("_starts") + 1), lambda a, b: F.when(a == b, a))
    inside = F.when(F.contains("_named", F.lit(NAME)), F.regexp_extract_all("_clean", F.lit(_INSIDE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    again = F.array_union(F.filter(twice, lambda w: w.isNotNull()), F.array_intersect("_starts", inside))
    small = lambda w: F.exists(F.array(*map(F.lit, " .,\n")), lambda end: F.contains("_clean", F.concat(F.lit(" "), F.lower(w), end)))
    return starts, F.filter(F.array_except(again, F.array(*map(F.lit, OPENERS))), lambda w: ~small(w))


def _canonical(rows: DataFrame, kept: list[str], tagged: bool) -> DataFrame:
    """``kept`` columns of ``rows`` and ``_tokens``, the canonical tokens of its ``text``; with ``tagged``, placeholders keep the value behind their mark.

    A decimal or grouped number is one. Each step is a column of its own, computed once.
    """
    value = "$0" if tagged else ""
    clean = F.coalesce(F.col("text"), F.lit(""))
    for mark in (NUMBER, UNIT, NAME):
        clean = F.replace(clean, F.lit(mark), F.lit(" "))
    rows = rows.select(*kept, clean.alias("_clean"))
    rows = rows.select(*kept, "_clean", F.regexp_replace("_clean", _INSIDE, NAME + value).alias("_named"))
    starts, names = _opening_names()
    rows = rows.select(*kept, "_clean", "_named", starts.alias("_starts")).select(*kept, "_clean", "_named", names.alias("_names"))
    opening = F.concat(F.lit(rf"(?<![\p{{L}}\p{{N}}{NAME}])(?:"), F.array_join("_names", "|"), F.lit(r")(?!\p{L})"))
    named = F.when(F.size("_names") > 0, F.regexp_replace("_named", opening, F.lit(NAME + value))).otherwise(F.col("_named"))
    rows = rows.select(*kept, "_clean", named.alias("_named"))
    spaced = F.regexp_replace("_named", r"(?<=\p{N})(?=\p{L})", " ")
    numbered = F.regexp_replace(spaced, r"(?<![\p{L}\p{N}])\p{N}+(?:[.,]\p{N}+)*(?![\p{L}\p{N}])", NUMBER + value)
    unit = F.regexp_replace(
        numbered, rf"(?i)({NUMBER}(?:\p{{N}}+(?:[.,]\p{{N}}+)*)?[ \t]?)({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", "$1 " + UNIT + ("$2" if tagged else "")
    )
    marked = F.when(F.col("_clean").rlike(r"\p{N}"), unit).otherwise(F.col("_named"))
    between = rf"(?:[^\p{{L}}\p{{N}}{NUMBER}{UNIT}{NAME}.,]|(?<!\p{{N}})[.,]|[.,](?!\p{{N}}))+"
    return rows.select(*kept, F.filter(F.split(F.lower(marked), between), lambda t: t != "").alias("_tokens"))


def _with_windows(rows: DataFrame, name: str, widths: list[int], whole: bool = False) -> DataFrame:
    """Adds ``name``: (width, at, h) of every run of each of ``widths`` (1 to 8) tokens of column ``_tokens``, by doubling.

    With ``whole``, the hash of the whole sequence comes too, with width 0. Each step is a column of its own, so that it is
    computed once; explode it with an outer generator, as the optimiser would otherwise infer a filter on its size and
    compute every step again in there.
    """
    kept = rows.columns
    rows = rows.withColumn("_runs1", F.transform("_tokens", lambda t: F.xxhash64(t)))
    for a, b in ((1, 1), (2, 2), (2, 1), (4, 4), (4, 1), (4, 2), (4, 3)):
        if a == b and max(widths, default=0) >= a + b or a + b in widths or (a, b) == (2, 1) and 7 in widths:
            later = F.slice(F.col(f"_runs{b}"), a + 1, 1 << 30)
            rows = rows.withColumn(f"_runs{a + b}", F.zip_with(F.col(f"_runs{a}"), later, lambda x, y: F.xxhash64(x, y)))

    def runs(width):
        valid = F.slice(F.col(f"_runs{width}"), F.lit(1), F.greatest(F.size("_tokens") - (width - 1), F.lit(0)))
        return F.transform(valid, lambda h, i: F.struct(F.lit(width).alias("width"), i.alias("at"), h.alias("h")))

    parts = [runs(w) for w in widths]
    if whole:
        one = F.struct(F.lit(0).alias("width"), F.lit(0).alias("at"), F.xxhash64(F.lit("whole"), F.concat_ws(" ", "_tokens")).alias("h"))
        parts.append(F.array(one))
    return rows.select(*kept, F.concat(*parts).alias(name))


def _slots(tokens: Column) -> Column:
    """(position, mark, value) of the placeholders among tagged tokens."""
    at = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), F.substring(t, 1, 1).alias("mark"), t.substr(F.lit(2), F.length(t)).alias("value")))
    return F.filter(at, lambda s: s["mark"].isin(NUMBER, UNIT, NAME))


def item_windows(items: DataFrame) -> DataFrame:
    """(h, item, item_at, item_windows, width, whole): the windows of each item (item, text) with enough literal tokens, or the whole item."""
    tokens = _canonical(items, ["item"], False).where("size(_tokens) > 0")
    rows = _with_windows(tokens, "runs", [4, 5, 6, 7, WINDOW], True)
    literal = F.transform("_tokens", lambda t: F.when(t.isin(NUMBER, UNIT, NAME), 0).otherwise(1))
    rows = rows.select("item", literal.alias("literal"), F.explode_outer("runs").alias("run")).select("item", "literal", "run.*")
    rows = materialize(rows.where(F.col("width").isin(0) | (F.col("width") == F.least(F.size("literal"), F.lit(WINDOW)))), "item_runs")
    enough = F.aggregate(F.slice("literal", F.col("at") + 1, F.col("width")), F.lit(0), lambda a, x: a + x) >= LITERALS
    good = rows.where((F.col("width") > 0) & enough).select("h", "item", F.col("at").alias("item_at"), "width", F.lit(False).alias("whole"))
    rest = rows.where("width = 0").join(good.select("item").distinct(), "item", "left_anti")
    good = good.unionByName(rest.select("h", "item", F.lit(0).alias("item_at"), F.size("literal").alias("width"), F.lit(True).alias("whole")))
    return good.join(good.groupBy("item").agg(F.countDistinct("item_at").alias("item_windows")), "item")


def _leaks(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """(doc_id, version, item, coverage, same) of rows (doc_id, version, text) and (item, text)."""
    known = materialize(item_windows(items), "item_windows")
    kinds = [(r.width, r.whole, r.n) for r in known.groupBy("whole", F.when(~F.col("whole"), F.col("width")).alias("width")).agg(F.count("*").alias("n")).collect()]
    widths, whole = sorted({w for w, whole, _ in kinds if not whole} or {WINDOW}), any(whole for _, whole, _ in kinds)
    small = F.broadcast if sum(n for _, _, n in kinds) <= BROADCAST_WINDOWS else (lambda side: side)
    # A document with enough of an item's n windows has one of any n - needed + 1 of them: those that the fewest items share find it.
    shared = known.groupBy("h").agg(F.countDistinct("item").alias("items"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("items", "item_at"))
    needed = F.greatest(F.lit(1), F.ceil(coverage * F.col("item_windows") - 1e-9))
    probes = known.join(shared, "h").withColumn("place", place).where(F.col("place") <= F.col("item_windows") - needed + 1)
    probes = materialize(probes.select("h", "item").distinct(), "probes")

    def found(rows: DataFrame) -> DataFrame:
        runs = _with_windows(_canonical(rows, ["doc_id", "version"], False), "runs", widths, whole)
        return runs.select("doc_id", "version", F.explode_outer("runs").alias("run")).select("doc_id", "version", "run.at", "run.h")

    key = ["doc_id", "version", "item"]
    candidates = materialize(found(docs).join(small(probes), "h").select(*key).distinct(), "candidates")
    rows = materialize(candidates.select("doc_id", "version").distinct(), "candidate_rows")
    texts = materialize(docs.join(rows, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"]), "candidate_texts")
    seen = found(texts).join(small(known.select("h").distinct()), "h").groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "h")).alias("seen"))
    own = known.groupBy("item", "item_windows", "width").agg(F.collect_list(F.struct("h", "item_at")).alias("own"))
    both = candidates.join(seen, ["doc_id", "version"]).join(small(own), "item")
    met = lambda s: F.transform(F.filter("own", lambda w: w["h"] == s["h"]), lambda w: F.struct((s["at"] - w["item_at"]).alias("shift"), w["item_at"].alias("item_at")))
    hits = both.select(*key, "item_windows", "width", F.explode_outer(F.flatten(F.transform("seen", met))).alias("hit"))
    hits = hits.where("hit is not null").select(*key, "item_windows", "width", "hit.shift", "hit.item_at")
    along = hits.groupBy(*key, "item_windows", "width", "shift").agg(F.collect_set("item_at").alias("found"))
    nearby = Window.partitionBy(*key).orderBy("shift").rangeBetween(-DRIFT, DRIFT)
    around = along.withColumn("around", F.collect_list(F.struct("shift", "found")).over(nearby))
    ways = F.array(F.array(F.struct("shift", "found")), "around")
    tried = F.explode(F.when(F.size("around") > 1, ways).otherwise(F.slice(ways, 1, 1)))
    around = around.select(*key, "item_windows", "width", "shift", tried.alias("matched"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("matched", lambda m: m["found"])))) / F.col("item_windows")
    pairs = materialize(around.select(*key, "width", "shift", "matched", covered.alias("coverage")).where(F.col("coverage") >= coverage), "pairs")
    item_slots = _canonical(items, ["item"], True).select("item", _slots(F.col("_tokens")).alias("item_slots")).where("size(item_slots) > 0")
    slotted = materialize(pairs.join(item_slots, "item"), "slotted")
    slots = texts.join(slotted.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_semi")
    slots = _canonical(slots, ["doc_id", "version"], True).select("doc_id", "version", _slots(F.col("_tokens")).alias("slots"))
    at_value = F.map_from_entries(F.transform("slots", lambda s: F.struct(s["at"], s["value"])))
    slots = materialize(slots.select("doc_id", "version", at_value.alias("at_value")), "doc_slots")
    valued = materialize(slotted.join(slots, ["doc_id", "version"]).select(*key, "shift", "coverage", _values().alias("values")), "values")
    keys = F.transform("values", lambda v: v["item_value"])
    consistent = F.size(F.array_distinct(F.transform("values", lambda v: F.struct(v["item_value"], v["doc_value"])))) == F.size(F.array_distinct(keys))
    same = F.forall("values", lambda v: v["doc_value"] == v["plain"])
    plain = pairs.join(slotted.select(*key).distinct(), key, "left_anti")
    return plain.select(*key, "coverage", F.lit(True).alias("same")).unionByName(valued.where(consistent).select(*key, "coverage", same.alias("same")))


def _version() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, version, text), null ids as ``NO_ID``, and items (item, item_id, text); a row is known by its id and text."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), _version().alias("version"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return docs, items.withColumn("item", F.xxhash64(F.coalesce("item_id", F.lit(NO_ID)), "text")).dropDuplicates(["item"])


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, kind): kind is ``exact`` or ``reparameterised``; one row per leaked pair of ids, by its best row."""
    docs, items = _keyed(docs, items)
    found = _leaks(docs, items, coverage).join(items.select("item", "item_id"), "item")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "same")).alias("best"))
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return best.select(doc_id, "item_id", "best.coverage", F.when(F.col("best.same"), "exact").otherwise("reparameterised").alias("kind"))


def _values() -> Column:
    """(item_value, doc_value, plain) of the item's slots inside matched windows, each at the nearest shift that matches there."""

    def valued(slot):
        inside = F.filter("matched", lambda m: F.exists(m["found"], lambda at: (at <= slot["at"]) & (slot["at"] < at + F.col("width"))))
        nearest = F.array_min(F.transform(inside, lambda m: F.struct(F.abs(m["shift"] - F.col("shift")), m["shift"].alias("shift"))))
        doc_value = F.element_at("at_value", slot["at"] + nearest["shift"])
        return F.struct(F.concat(slot["mark"], slot["value"]).alias("item_value"), doc_value.alias("doc_value"), slot["value"].alias("plain"))

    return F.filter(F.transform("item_slots", valued), lambda v: v["doc_value"].isNotNull())


def drop_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Rows of ``docs`` that leak no item."""
    keyed, templates = _keyed(docs, items)
    gone = materialize(_leaks(keyed, templates, coverage).select("doc_id", "version").distinct(), "leaked")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), _version().alias("version"))
    return rows.join(gone, ["doc_id", "version"], "left_anti").select("row.*")
