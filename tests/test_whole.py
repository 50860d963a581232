"""Queries that read their whole tables, against brute force on small ones."""

import random


def test_import_cycles_of_every_order(spark, tmp_path):
    from tessera.plans.events import import_cycles

    rng = random.Random(4)
    rows = [(k, rng.randint(1, 90)) for k in range(1, 120)] + [(k, k % 90 + 1) for k in range(200, 230)] + [(61, 1), (1, 61), (7, 7), (300, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    onward = {}
    for order, customer in rows:
        if customer is not None:
            onward.setdefault(customer, set()).add(order)

    def reach(node):
        seen, todo = set(), [node]
        while todo:
            for n in onward.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    closure = {n: reach(n) for n in onward}
    want = {}
    for n in closure:
        group = {m for m in closure[n] if n in closure.get(m, ())} | {n}
        if len(group) > 1:
            want[n] = min(group)
    assert len(want) > 2
    from tessera.operators import cycles

    small = cycles.SMALL
    try:
        for cycles.SMALL in (small, 0):
            assert {r.node: r.component for r in import_cycles(spark, str(tmp_path)).collect()} == want
    finally:
        cycles.SMALL = small


def test_keywords_after_the_first_characters(spark, tmp_path):
    from tessera.plans.reasoning import legacy_keyword_retrieval

    rows = [(8, "src9", "zzz " * 50 + "the"), (17, "src9", "zzz " * 50 + "\n" + "zzz " * 50 + "the"), (26, "src9", "zzz " * 100)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.score) for r in legacy_keyword_retrieval(spark, str(tmp_path)).orderBy("rank").collect()] == [(8, 0.45), (17, 0.18), (26, 0.0)]


def classes(rows, threshold=0.8):
    """{id: smallest id that links reach} of [(id, tokens)], by comparing all."""
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(i, set(t)) for i, t in rows if i is not None and t]
    for k, (i, s) in enumerate(known):
        for j, t in known[:k]:
            if len(s & t) >= threshold * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_near_classes(spark):
    import random

    from tessera.operators import minhash

    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(150):  # one large bucket of sets around the threshold, and sets of their own
        own = [f"o{rng.randint(0, 400)}" for _ in range(rng.randint(1, 12))]
        rows.append((i, list(dict.fromkeys(rng.sample(common, 60 - rng.randint(0, 9)) + own if i % 3 else own))))
    rows += [(i + 200, list(t)) for i, t in rows[:20]] + [(400, []), (401, None), (None, ["a"]), (402, ["only"]), (403, ["only"]), (5, list(rows[5][1]))]
    table = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(4)
    block, minhash.BLOCK = minhash.BLOCK, 16
    try:
        got = [(r.id, r.class_id) for r in minhash.near_classes(table).collect()]
    finally:
        minhash.BLOCK = block
    want = classes(rows)
    assert len(got) == len(rows) and {i: c for i, c in got if i is not None} == want
    assert len(set(want.values())) > 40 and max(list(want.values()).count(c) for c in set(want.values())) > 60
    assert minhash.near_classes(table.where("false")).count() == 0


def test_bands_find_what_reaches_the_threshold():
    from tessera.operators import minhash

    for t in (0.5, 0.8, 0.9):
        r = minhash.rows_of(t)
        assert (1 - t**r) ** (minhash.VALUES // r) <= minhash.MISS < (1 - t ** (r + 1)) ** (minhash.VALUES // (r + 1))


def test_near_copies_of_documents(spark, tmp_path):
    from tessera.plans.corpus import near_dup_documents

    rng = random.Random(6)
    texts = {i: " ".join(f"w{rng.randint(1, 40)}" for _ in range(rng.randint(3, 30))) for i in range(40)}
    texts |= {100 + i: texts[i] + " new" for i in range(20)} | {200 + i: texts[i].upper() for i in range(10)} | {300: "", 301: " ", 302: None, 303: texts[0]}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = classes([(i, (t or "").lower().split()) for i, t in texts.items()])
    got = {r.doc_id: (r.class_id, r.kept) for r in near_dup_documents(spark, str(tmp_path)).collect()}
    assert got == {i: (c, c == i) for i, c in want.items()} and len(set(want.values())) < len(want) - 20


def test_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    import random

    from tessera.operators import graph

    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or write(df, name))
    nodes = list(range(600))
    random.Random(4).shuffle(nodes)
    paths = [nodes[:400], nodes[400:]]
    rows = [(a, b) for p in paths for a, b in zip(p, p[1:])] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {n: min(p) for p in (*paths, range(1000, 1201)) for n in p}
    assert written.count("labels") <= 12  # 74 without hooks
