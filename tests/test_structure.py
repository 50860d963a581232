"""Definitions, edges and handlers of six languages, written out by hand; nesting against a plain search."""

import random

import pytest

from tessera.operators import structure as S

FILES = {
    "a.py": '''import os
class Base(Top, mixin.Other):
    """class Fake: { pass }"""
    def first(self, x="def no():"):
        try:
            return 1
        except ValueError:
            pass  # nothing
        except:
            ...
        except OSError as e:
            log(e)

    async def second(
        self, y,
    ):
        def inner(): return {"a": 1}
        return inner

def last(): pass
''',
    "b.ts": '''import { x } from './x'
import y from "y"
export interface Shape extends Thing, Other<T> { area(): number }
export class Circle extends Shape implements A, B<string> {
  constructor(private r: number) { super() }
  area(): number {
    if (this.r) { return 1 }  // } not here
    try { go("}{") } catch (e) { /* empty */ }
    try { go() } catch { }
    return 2
  }
}
const add = (a: number, b: number): number => {
  return a + b
}
function plain() { try { a() } catch (e) { log(e) } }
''',
    "c.java": '''package p;
import java.util.List;
import static a.B.*;
public class Car extends Vehicle implements Runs, Stops {
    private final int n = 1;
    public Car(int n) { this.n = n; }
    @Override
    public List<String> names(String s) throws IOException {
        for (int i = 0; i < 3; i++) { x(); }
        try { y(); } catch (IOException e) { } finally { z(); }
        return null;
    }
    enum Kind { A, B }
}
''',
    "d.cs": '''using System;
namespace N {
  public class Dog : Animal, IRun where T : new() {
    public void Bark(int times) {
      lock (x) { y(); }
      try { } catch (Exception) { // quiet
      }
    }
  }
}
''',
    "e.go": '''package main

import "fmt"
import (
	"os"
	str "strings"
)

type Point struct {
	X int
}

func (p *Point) Move(dx int) error {
	if err := do(); err != nil {
	}
	if err != nil {
		return err
	}
	return nil
}

func main() { fmt.Println("}") }
''',
    "f.rs": '''use std::io::Read;
pub struct Tree { n: u32 }
impl Display for Tree {
    fn fmt(&self, f: &mut Formatter) -> Result {
        match x() { Ok(v) => v, Err(_) => {} }
    }
}
''',
    "g.cpp": '''#include <vector>
#include "own.h"
class Box : public Shape, private detail::Base {
  int area() const { return 1; }
};
int main(int argc, char** argv)
{
  try { run(); } catch (...) {}
  return 0;
}
''',
    "h.txt": "class No { }",
    "i.js": "function open() { if (x) { return",
    "j.js": None,
    "k.js": "",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, text string").repartition(3)


def test_definitions(files):
    got = sorted(((r.path, r.line, r.kind, r.name, r.within) for r in S.definitions(files).collect()), key=str)
    assert got == sorted([
        ("a.py", 2, "class", "Base", None), ("a.py", 4, "function", "first", "Base"), ("a.py", 14, "function", "second", "Base"), ("a.py", 17, "function", "inner", "second"), ("a.py", 20, "function", "last", None),
        ("b.ts", 3, "interface", "Shape", None), ("b.ts", 4, "class", "Circle", None), ("b.ts", 5, "function", "constructor", "Circle"), ("b.ts", 6, "function", "area", "Circle"),
        ("b.ts", 13, "function", "add", None), ("b.ts", 16, "function", "plain", None),
        ("c.java", 4, "class", "Car", None), ("c.java", 6, "function", "Car", "Car"), ("c.java", 8, "function", "names", "Car"), ("c.java", 13, "struct", "Kind", "Car"),
        ("d.cs", 3, "class", "Dog", None), ("d.cs", 4, "function", "Bark", "Dog"),
        ("e.go", 13, "function", "Move", None), ("e.go", 22, "function", "main", None), ("e.go", 9, "struct", "Point", None),
        ("f.rs", 2, "struct", "Tree", None), ("f.rs", 3, "class", "Tree", None), ("f.rs", 4, "function", "fmt", "Tree"),
        ("g.cpp", 3, "class", "Box", None), ("g.cpp", 4, "function", "area", "Box"), ("g.cpp", 6, "function", "main", None),
        ("i.js", 1, "function", "open", None),
    ], key=str)


def test_contents(files):
    rows = {(r.path, r.name, r.kind): r for r in S.definitions(files).collect()}
    assert rows["a.py", "inner", "function"].content == 'def inner(): return {"a": 1}'
    assert rows["g.cpp", "area", "function"].content == "int area() const { return 1; }"
    assert rows["b.ts", "add", "function"].content.startswith("const add = (a") and rows["b.ts", "add", "function"].content.endswith("}")
    assert (rows["c.java", "names", "function"].line, rows["c.java", "names", "function"].last) == (8, 12)
    assert rows["a.py", "Base", "class"].last == 18


def test_edges(files):
    got = sorted(tuple(r) for r in S.edges(files).select("path", "source", "target", "kind").collect())
    assert got == sorted([
        ("a.py", "Base", "Top", "inherits"), ("a.py", "Base", "mixin.Other", "inherits"),
        ("b.ts", "", "./x", "imports"), ("b.ts", "", "y", "imports"), ("b.ts", "Shape", "Thing", "inherits"), ("b.ts", "Shape", "Other", "inherits"),
        ("b.ts", "Circle", "Shape", "inherits"), ("b.ts", "Circle", "A", "implements"), ("b.ts", "Circle", "B", "implements"),
        ("c.java", "", "java.util.List", "imports"), ("c.java", "", "a.B.*", "imports"), ("c.java", "Car", "Vehicle", "inherits"), ("c.java", "Car", "Runs", "implements"), ("c.java", "Car", "Stops", "implements"),
        ("d.cs", "", "System", "imports"), ("d.cs", "Dog", "Animal", "inherits"), ("d.cs", "Dog", "IRun", "inherits"),
        ("e.go", "", "fmt", "imports"), ("e.go", "", "os", "imports"), ("e.go", "", "strings", "imports"),
        ("f.rs", "", "std::io::Read", "imports"), ("f.rs", "Tree", "Display", "inherits"),
        ("g.cpp", "", "vector", "imports"), ("g.cpp", "", "own.h", "imports"), ("g.cpp", "Box", "Shape", "inherits"), ("g.cpp", "Box", "detail::Base", "inherits"),
    ])


def test_swallowed(files):
    got = sorted((r.path, r.line, r.finding) for r in S.swallowed(files).collect())
    assert got == [
        ("a.py", 7, "silent except"), ("a.py", 9, "bare except"), ("a.py", 9, "silent except"), ("b.ts", 8, "empty catch"), ("b.ts", 9, "empty catch"), ("c.java", 10, "empty catch"),
        ("d.cs", 6, "empty catch"), ("e.go", 14, "empty error check"), ("f.rs", 5, "empty Err arm"), ("g.cpp", 8, "empty catch"),
    ]


def test_the_smallest_around(spark):
    rng = random.Random(3)
    rows = []

    def nest(path, a, b, depth):
        at = a
        while at < b - 3 and depth < 7:
            start = at + rng.randint(0, 5)
            end = start + rng.randint(2, max(3, (b - a) // 2))
            if end >= b:
                break
            rows.append((path, start, end, f"{path}{start}"))
            nest(path, start + 1, end - 1, depth + 1)
            at = end + rng.randint(0, 2)

    for p in "xyz":
        nest(p, 0, 300, 0)
    got = {(r.path, r.start): r.within for r in S._around(spark.createDataFrame(rows, "path string, start int, end int, name string")).collect()}
    want = {}
    for p, s, e, _ in rows:
        around = [(b - a, n) for q, a, b, n in rows if q == p and a < s and b >= e]
        want[p, s] = min(around)[1] if around else None
    assert got == want


def test_blanking_keeps_places():
    for text in FILES.values():
        for pattern in (S._C_LIKE, S._PYTHON):
            blank = S.blanked(text or "", pattern)
            assert len(blank) == len(text or "") and blank.count("\n") == (text or "").count("\n")


def test_blocks_are_small_and_read_once(spark, tmp_path, monkeypatch):
    from tessera.plans import code

    calls, made = [], S.blocks
    monkeypatch.setattr(S, "blocks", lambda files: calls.append(1) or made(files))
    spark.createDataFrame([(i, "one\n\n  two\n" + "word " * 2000 + "\nfour") for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: r for r in code.code_structure(spark, str(tmp_path)).collect()}
    assert len(calls) == 1
    assert {(r.methods, r.inside, r.swallowed) for r in got.values()} == {(4, 4, 2)}
    assert {p.split(".")[1]: r.lines for p, r in got.items()} == {"js": 18, "java": 18, "cs": 18, "cpp": 18, "py": 26}
    files = spark.createDataFrame([("a.js", "class A {\n" + "f() { // " + "x" * 9000 + "\n g(); }\n" + "}")], "path string, text string")
    rows = made(files).collect()
    assert [(r.line, r.last, r.body, len(r.content)) for r in rows] == [(2, 3, None, 2000), (1, 4, None, 2000)]
    assert [S._idle(c, 0, len(c)) for c in (" \n", " pass ;\n", "...", "pass" + " " * 50_000 + "x", " " * 50_000 + "x")] == ["", "pass ;", "...", None, None]
