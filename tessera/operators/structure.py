"""Structure of code files: definitions with their names, bases and imports, and handlers that swallow errors.

``blocks`` is one pass over a file: strings and comments are blanked at their length, then braces (C-like languages) or indentation
(Python) open and close blocks. All else is columns over its rows: what a block's header defines, which definition is the
smallest around it, edges, chunks, and which handlers do nothing.

A header is what stands before a block, back to the end of the statement before. A file of an unknown language has no blocks; blocks
that are never closed end with the file; null and empty texts have none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.rules import language_of
from tessera.scratch import materialize

LONGEST = 2000
#: Languages with braces.
BRACED = ("javascript", "typescript", "tsx", "java", "c_sharp", "go", "rust", "c", "cpp")
_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'|`[^`]*`?"
_PYTHON = r"#[^\n]*|(?:\"\"\".*?(?:\"\"\"|\Z))|(?:'''.*?(?:'''|\Z))|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
#: A line that starts with a word begins a statement, unless the line before goes on or the word belongs to a header.
_MARK = r"[{}();]|\n(?=[ \t]*(?!(?:extends|implements|where|throws|permits|const|noexcept|override|for)\b)[A-Za-z_@#])"
_GOES_ON = tuple(",=(+-&|.:?<>")
_NOT_NEWLINE = re.compile(r"[^\n]")
_COLUMNS = [("path", pa.string()), ("language", pa.string()), ("block", pa.int32()), ("outer", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("line", pa.int32()), ("last", pa.int32()), ("header", pa.string()), ("body", pa.string()), ("content", pa.string())]
_SOME, _IDLE = re.compile(r"\S"), re.compile(r"((?:pass|\.\.\.)(?:\s*;)?)\s*")


def blanked(text: str, pattern: str) -> str:
    """The text with comments as spaces and strings as their quotes around spaces, every character at its place."""

    def blank(m: re.Match) -> str:
        inner = _NOT_NEWLINE.sub(" ", m[0])
        return inner if m[0][0] in "#/" else m[0][0] + inner[1:-1] + m[0][0] if len(m[0]) > 1 else m[0]

    return re.sub(pattern, blank, text, flags=re.S)


def _braced(code: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(block, outer, start of the header, opening brace, end) of every block, in order of their ends."""
    stack, last, n, round_ = [], 0, 0, 0
    for m in re.finditer(_MARK, code):
        at, c = m.start(), m[0]
        if c == "\n":
            if round_ <= 0 and code[last:at].strip()[-1:] not in _GOES_ON:
                last = at + 1
        elif c in "()":
            round_ += 1 if c == "(" else -1
        elif c == "{":
            stack.append((n, last, at, round_))
            n, last, round_ = n + 1, at + 1, 0
        elif c == "}" and stack:
            block, start, opened, round_ = stack.pop()
            yield block, stack[-1][0] if stack else -1, start, opened, at + 1
            last = at + 1
        elif c == ";" and round_ <= 0:
            last = at + 1
    while stack:
        block, start, opened, _ = stack.pop()
        yield block, stack[-1][0] if stack else -1, start, opened, len(code)


def _indented(code: str) -> Iterator[tuple[int, int, int, int, int]]:
    """The same by indentation: a line that ends in a colon, and the deeper lines after it; a body on the header's line too."""
    stack, n, at, round_, end = [], 0, 0, 0, 0
    for line in code.split("\n"):
        bare = line.strip()
        if bare and round_ <= 0:
            depth = len(line) - len(line.lstrip())
            while stack and stack[-1][3] >= depth:
                block, start, opened, _ = stack.pop()
                yield block, stack[-1][0] if stack else -1, start, opened, end
            m = re.match(r"(?:async\s+)?(?:def|class|if|elif|else|for|while|with|try|except|finally|match|case)\b", bare)
            colon = _colon(line) if m else -1
            if m and (colon >= 0 or line.count("(") > line.count(")")):
                stack.append((n, at + depth, at + colon if colon >= 0 else -1, depth))
                n += 1
        elif bare and stack and stack[-1][2] < 0 and (colon := _colon(line, round_)) >= 0:
            stack[-1] = (*stack[-1][:2], at + colon, stack[-1][3])
        round_ += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
        at += len(line) + 1
        end = at - 1 if bare else end
    while stack:
        block, start, opened, _ = stack.pop()
        yield block, stack[-1][0] if stack else -1, start, opened, max(end, start)


def _colon(line: str, depth: int = 0) -> int:
    """Place of the first colon outside brackets."""
    for k, c in enumerate(line):
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and depth <= 0:
            return k
    return -1


def _idle(code: str, start: int, end: int) -> str | None:
    """A body that is empty or only passes; null for any other, which is not read further than that takes."""
    some = _SOME.search(code, start, end)
    if not some:
        return ""
    idle = _IDLE.fullmatch(code, some.start(), end)
    return idle[1] if idle else None


def blocks(files: DataFrame) -> DataFrame:
    """(path, language, block, outer, start, end, line, last, header, body, content) of files (path, text).

    ``line`` and ``last`` are its first and last lines; ``header`` is without strings and comments; ``body`` is that of a block that does nothing, else null; ``content`` is
    the block as it stands, cut at 2000 characters. What is sent on grows with the blocks, not with their nested texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text, language in zip(*(batch.column(c).to_pylist() for c in ("path", "text", "language")), strict=True):
                python = language == "python"
                code = blanked(text, _PYTHON if python else _C_LIKE)
                rows, breaks = [], [m.start() for m in re.finditer("\n", text)]
                for block, outer, start, opened, end in (_indented if python else _braced)(code):
                    opened = opened if opened >= 0 else end
                    start += len(code[start:opened]) - len(code[start:opened].lstrip())
                    first, past = bisect_left(breaks, start), bisect_left(breaks, max(start, end))
                    rows.append((path, language, block, outer, start, end, first + 1, past + 1, code[start:opened].strip(), _idle(code, opened + 1, end if python else max(opened + 1, end - 1)), text[start : min(end, start + LONGEST)]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(_COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS, strict=True)], [n for n, _ in _COLUMNS])

    known = files.where(F.coalesce("text", F.lit("")) != "").select("path", "text", language_of(F.col("path")).alias("language"))
    known = known.where(F.col("language").isin("python", *BRACED))
    return known.mapInArrow(run, "path string, language string, block int, outer int, start int, `end` int, line int, last int, header string, body string, content string")


_CLASS = r"(?:^|\s)(class|struct|interface|enum|trait|impl|record)\s+(?:<[^>]*>\s*)?([A-Za-z_]\w*)"
_FUNCTION = (
    r"(?:^|\s)(?:def|func|fn|function)\b\s*\*?\s*(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"  # a keyword, perhaps a receiver
    r"|(?:^|\s)(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]*)?=>$"  # an arrow
    r"|(?:^|[\s*&:>])(~?[A-Za-z_$][\w$]*)\s*\([^;]*\)\s*(?:const|noexcept|override|throws\s+[\w., ]+|:\s*[\w<>\[\]|., ]+)?$"  # a name and its parameters
)
#: Words before a bracket that are no function's name.
FLOW = ("if", "for", "foreach", "while", "switch", "catch", "return", "do", "else", "try", "using", "lock", "synchronized", "match", "elif", "with", "except", "new", "await", "fixed", "when")


#: Names that do not follow their keyword: Go's types and the type that Rust implements a trait for.
_GO_TYPE, _FOR_TYPE = r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)$", r"^(?:unsafe\s+)?impl\b.*?\sfor\s+(\w+)"


def _class_name(header: Column) -> Column:
    names = [F.regexp_extract(header, p, k) for p, k in ((_GO_TYPE, 1), (_FOR_TYPE, 1), (_CLASS, 2))]
    return F.coalesce(*[F.when(n != "", n) for n in names])


def _class_kind(header: Column) -> Column:
    go = F.regexp_extract(header, _GO_TYPE, 2)
    word = F.when(go != "", go).otherwise(F.regexp_extract(header, _CLASS, 1))
    return F.when(word.isin("interface", "trait"), "interface").when(word.isin("struct", "enum"), "struct").when(word != "", "class")


def _around(found: DataFrame) -> DataFrame:
    """``found`` (path, start, end, name, ...) with ``within``, the name of the smallest other interval around each; intervals are nested or apart.

    Running counts of what has begun and ended give each one's level; the one around it is the last of the level above that began before.
    """
    marks = found.select("path", "start", F.col("start").alias("pos"), F.lit(1).alias("step")).unionByName(found.select("path", "start", F.col("end").alias("pos"), F.lit(-1).alias("step")))
    running = F.sum("step").over(Window.partitionBy("path").orderBy("pos", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    leveled = found.join(marks.withColumn("level", running).where("step = 1").select("path", "start", "level"), ["path", "start"])
    asks = leveled.withColumns({"at": F.col("level") - 1, "told": F.lit(None).cast("string")})
    tells = leveled.withColumns({"at": F.col("level"), "told": F.col("name")})
    last = F.last("told", ignorenulls=True).over(Window.partitionBy("path", "at").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    answered = asks.withColumn("asks", F.lit(True)).unionByName(tells.withColumn("asks", F.lit(False))).withColumn("within", last)
    return answered.where("asks").select(*found.columns, "within")


def definitions(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(path, language, name, kind, line, last, start, end, within, header, content): every function, class, interface and struct of ``files`` (path, text).

    ``found`` are the files' ``blocks``, if they are at hand.

    ``within`` names the smallest definition around it, or is null; ``content`` is cut at 2000 characters, which is the feature.
    """
    header = F.col("header")
    first = F.regexp_extract(header, r"^\W*(?:else\s+)?(\w+)", 1)
    names = [F.regexp_extract(header, _FUNCTION, k) for k in (1, 2, 3)]
    function = F.coalesce(*[F.when((n != "") & ~n.isin(*FLOW), n) for n in names])
    class_ = _class_kind(header)
    kind = F.coalesce(class_, F.when(~first.isin(*FLOW) & function.isNotNull(), "function"))
    name = F.when(class_.isNotNull(), _class_name(header)).otherwise(function)
    named = (blocks(files) if found is None else found).select("path", "language", name.alias("name"), kind.alias("kind"), "line", "last", "start", "end", "header", "content")
    return _around(materialize(named.where("kind is not null"), "definitions")).select("path", "language", "name", "kind", "line", "last", "start", "end", "within", "header", "content")


#: What a header says after the name: bases, by language.
_BASES = {
    "python": r"^class\s+\w+\s*\(([^)]*)\)", "c_sharp": r"(?:class|struct|interface|record)\s+\w+(?:<[^>]*>)?\s*:\s*(.+?)(?:\s+where\s.*)?$", "cpp": r"(?:class|struct)\s+\w+\s*(?:final\s*)?:\s*(.+)$",
    "rust": r"^(?:unsafe\s+)?impl\s*(?:<[^>]*>)?\s*([\w:]+)(?:<[^>]*>)?\s+for\s", "": r"\bextends\s+(.+?)(?:\s+implements\s.*)?$",
}
_IMPORTS = (
    r"(?m)^\s*(?:import|export)\b[^'\"\n;(]*?['\"]([^'\"\n]+)['\"]|\brequire\(\s*['\"]([^'\"\n]+)['\"]|^\s*import\s+(?:static\s+)?([\w.*]+)\s*;|^\s*using\s+(?:static\s+)?([\w.]+)\s*;"
    r"|^\s*(?:pub\s+)?use\s+([\w:]+)|^\s*#\s*include\s*[<\"]([^>\"\n]+)[>\"]"
)


def edges(files: DataFrame, defined: DataFrame | None = None) -> DataFrame:
    """(path, source, target, kind): ``inherits`` and ``implements`` from classes to their bases, ``imports`` (of no source) of braced languages, each once.

    ``defined`` are the files' ``definitions``, if they are at hand.
    """
    d = (definitions(files) if defined is None else defined).where("kind <> 'function'")
    named = F.coalesce(*[F.when(F.col("language") == n, F.regexp_extract("header", p, 1)) for n, p in _BASES.items() if n], F.regexp_extract("header", _BASES[""], 1))
    bare = lambda text: F.filter(F.transform(F.split(F.regexp_replace(text, r"<[^<>]*>", ""), ","), lambda b: F.regexp_extract(b, r"^\s*(?:(?:public|private|protected|virtual)\s+)*([\w.:]+)\s*$", 1)), lambda b: b != "")
    extended = d.select("path", F.col("name").alias("source"), F.explode(bare(named)).alias("target"), F.lit("inherits").alias("kind"))
    kept = d.select("path", F.col("name").alias("source"), F.explode(bare(F.regexp_extract("header", r"\bimplements\s+(.+)$", 1))).alias("target"), F.lit("implements").alias("kind"))
    known = files.withColumn("language", language_of(F.col("path"))).where(F.col("language").isin(*BRACED))
    groups = [F.regexp_extract_all("text", F.lit(_IMPORTS), F.lit(k)) for k in range(1, 7)]
    grouped = known.select("path", F.filter(F.flatten(F.array(*groups)), lambda t: t != "").alias("found"), F.regexp_extract_all("text", F.lit(r"(?ms)^import\s*\((.*?)\)"), F.lit(1)).alias("lists"), "language")
    listed = F.flatten(F.transform("lists", lambda b: F.regexp_extract_all(b, F.lit(r"\"([^\"\n]+)\""), F.lit(1))))
    imports = grouped.select("path", F.lit("").alias("source"), F.explode(F.when(F.col("language") == "go", F.concat("found", listed)).otherwise(F.col("found"))).alias("target"), F.lit("imports").alias("kind"))
    return extended.unionByName(kept).unionByName(imports).where("target <> source").distinct()


def code_chunks(files: DataFrame) -> DataFrame:
    """(path, place, first, content) of the definitions of code files, as ``chunks.embed`` and ``chunks.refresh`` take them: name, imports, then the code."""
    d = materialize(definitions(files), "defined")
    imports = edges(files, d).where("kind = 'imports'").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("target")), " ").alias("imports"))
    d = d.join(imports, "path", "left")
    place = F.row_number().over(Window.partitionBy("path").orderBy("start", F.col("end").desc()))
    return d.select("path", place.alias("place"), F.col("line").alias("first"), F.concat_ws(" ", "name", "imports", "content").alias("content"))


def swallowed(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(path, line, finding): handlers that do nothing but comment, by language: ``catch``, Go's check of an error, Rust's ``Err`` arm, Python's ``except`` with pass or an ellipsis; and bare excepts.

    ``found`` are the files' ``blocks``, if they are at hand.
    """
    h, body, python = F.col("header"), F.col("body"), F.col("language") == "python"
    empty = F.when(~python & h.rlike(r"(?:^|\s)catch\b[^;{}]*$"), "empty catch")
    empty = empty.when((F.col("language") == "go") & h.rlike(r"\b\w*[eE]rr\w*\s*!=\s*nil$"), "empty error check").when((F.col("language") == "rust") & h.rlike(r"\bErr\s*\([^()]*\)\s*=>$"), "empty Err arm")
    silent = F.when(python & h.rlike(r"^except\b") & body.rlike(r"^(?:pass|\.\.\.)\s*;?$"), "silent except")
    bare = F.when(python & h.rlike(r"^except\s*$"), "bare except")
    told = F.filter(F.array(F.when(body == "", empty), silent, bare), lambda f: f.isNotNull())
    return (blocks(files) if found is None else found).select("path", "line", F.explode(told).alias("finding"))
