"""Include patterns against plain fnmatch."""

import fnmatch

from tessera.operators.includes import RESCUE_BYTES, WALK_BYTES, resolve

FILES = [
    ("src/a.py", 10, False), ("src/b.PY", 10, False), ("src/deep/c.ts", 10, False), ("src/a[1].py", 10, False), ("docs/x.md", 10, False), ("big.py", WALK_BYTES + 1, False), ("huge.bin", RESCUE_BYTES + 1, False),
    ("link.py", 5, True), ("build/out.py", 5, False), ("secret.env", 5, False), ("src/deep/only.go", 7, None), ("top.py", 1, False), ("README", 1, False),
]
RULES = ["build/", "*.env"]


def run(spark, patterns, exts=()):
    files = spark.createDataFrame(FILES, "path string, size long, link boolean")
    table = spark.createDataFrame(list(enumerate(patterns)), "ordinal int, pattern string")
    return sorted(((r.state, r.pattern, r.path, r.reason) for r in resolve(files, table, RULES, list(exts), "/repo").collect()), key=str)


def test_states(spark):
    got = run(spark, ["src/*.py", "*.py", "big.py", "huge.bin", "link.py", "build/out.py", "secret.env", "no/such", "./docs/../docs/x.md", "/repo/README", "src/a[1].py", "../up.py", "src/deep/*", None, "", "big.py", "s*/d*/[co]*"])
    assert got == sorted([
        ("matched", "src/*.py", "src/a.py", None), ("matched", "src/*.py", "src/a[1].py", None), ("matched", "*.py", "top.py", None), ("matched", "src/deep/*", "src/deep/c.ts", None), ("matched", "src/deep/*", "src/deep/only.go", None),
        ("rescued", "big.py", "big.py", None), ("refused", "huge.bin", "huge.bin", "too large"), ("refused", "link.py", "link.py", "a link"), ("refused", "build/out.py", "build/out.py", "inside an ignored folder"),
        ("refused", "secret.env", "secret.env", "ignored"), ("unmatched", "no/such", None, None), ("rescued", "./docs/../docs/x.md", "docs/x.md", None), ("rescued", "/repo/README", "README", None), ("unmatched", "../up.py", None, None),
    ], key=str)


def test_an_exact_name_with_brackets_is_rescued(spark):
    assert run(spark, ["src/a[1].py"]) == [("rescued", "src/a[1].py", "src/a[1].py", None)]


def test_extensions(spark):
    assert run(spark, ["docs/*", "docs/x.md", "*.go"], ["py"]) == sorted([("unmatched", "docs/*", None, None), ("rescued", "docs/x.md", "docs/x.md", None), ("unmatched", "*.go", None, None)], key=str)
    assert run(spark, []) == []


def test_every_way_of_joining_is_fnmatch(spark):
    patterns = ["src/*", "src/*/*", "*", "s*", "*c*", "?op.py", "*.t?", "src/d*.ts", "[!s]*", "src/[ab].*", "*.md", "*/x.md", "src/deep/c.ts"]
    walked = [p for p, size, link in FILES if not link and size <= WALK_BYTES and not p.startswith("build/") and not p.endswith(".env")]
    for pattern in patterns:
        assert [(s, path) for s, _, path, _ in run(spark, [pattern])] == sorted(("matched", p) for p in walked if fnmatch.fnmatchcase(p, pattern)), pattern
