"""Diffs and their application on random texts."""

import difflib
import random

from tessera.operators import patches as P


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        a = [rng.choice("abcdef") * rng.randint(0, 2) for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.choice("abcdefxyz") for _ in range(rng.randint(0, 3))]
        yield "\n".join(a), "\n".join(b)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_matches_are_a_longest_common_subsequence():
    for a, b in texts(1, 150):
        a, b = list(a), list(b)
        got = P.matches(a, b)
        assert all(a[i] == b[j] for i, j in got) and len(got) == longest(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_long_texts_without_much_in_common():
    rng = random.Random(2)
    a, b = ([str(rng.randint(0, 10**18)) for _ in range(20_000)] for _ in range(2))
    b[5000:5003], b[100] = a[7000:7003], a[9]
    assert P.matches(a, b) == [(9, 100), (7000, 5000), (7001, 5001), (7002, 5002)]


def test_patch_restores():
    for a, b in texts(3, 300):
        assert P.apply(a, P.diff(a, b))[0] == b
        assert P.apply(b, P.diff(b, a))[0] == a
        assert P.apply(a, P.diff(a, a)) == (a, 0, 0, 0)


def test_diff_has_the_format():
    a, b = "\n".join(f"line {i}" for i in range(40)), "\n".join(f"line {i}" + "!" * (i in (3, 30)) for i in range(40) if i != 20)
    assert P.diff(a, b).split("\n") == list(difflib.unified_diff(a.split("\n"), b.split("\n"), "a", "b", lineterm=""))
    assert P.diff("", "x\ny") == "--- a\n+++ b\n@@ -0,0 +1,2 @@\n+x\n+y"
    for x, y in texts(5, 100):
        assert P.hunks("\n".join(difflib.unified_diff(x.split("\n") if x else [], y.split("\n") if y else [], "a", "b", lineterm=""))) is not None
        other = "\n".join(difflib.unified_diff(x.split("\n") if x else [], y.split("\n") if y else [], "a", "b", lineterm=""))
        assert P.apply(x, other)[0] == y


def test_hunks_move_and_are_refused():
    a = "\n".join(f"line {i}" for i in range(60))
    b = a.replace("line 10\n", "").replace("line 50", "line fifty")
    patch = P.diff(a, b)
    assert P.apply("new\nlines\n" + a, patch) == ("new\nlines\n" + b, 2, 0, 2)
    assert P.apply(a.split("line 4\n")[0] + "line 4\n" + a.split("line 4\n", 1)[1].replace("line 30\n", ""), patch) == (b.replace("line 30\n", ""), 2, 0, 1)
    assert P.apply(a.replace("line 49", "other"), patch) == (None, 2, 1, 0)
    assert P.apply("", patch) == (None, 2, 2, 0)


def test_columns(spark):
    rows = [*texts(7, 40), (None, "a"), ("a", None), (None, None)]
    table = spark.createDataFrame(rows, "old string, new string")
    out = table.select("new", P.unified_diff(table.old, table.new).alias("patch"), "old")
    got = out.select("new", P.applied(out.old, out.patch).alias("p")).select("new", "p.*").collect()
    assert all(r.patched == (r.new or "") and r.refused == 0 for r in got) and len(got) == len(rows)
