"""Searches of many queries at once against plain loops."""

import random

import numpy as np

from strandgraph.operators import search


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_names_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.randrange(0, 7)))
    names = [(i, word()) for i in range(150)] + [(900, None), (901, "é"), (902, "abcabc"), (903, "abcabc")]
    asked = [word() for _ in range(40)] + ["", "e", "abcabc", "abcabc", None]
    entities, queries = spark.createDataFrame(names, "id int, name string"), spark.createDataFrame([(q,) for q in asked], "query string")
    fuzzy, prefix, exact = {}, {}, {}
    for q in {q for q in asked if q is not None}:
        rows = [(q, i, n, edits(n.lower(), q.lower())) for i, n in names if n is not None]
        close = [(q, i, n, round(1 - d / max(len(n), len(q)), 6) if n or q else 1.0) for q, i, n, d in rows if d <= 2]
        fuzzy[q] = sorted(close, key=lambda r: (-r[3], r[1]))[:10]
        begin = [(q, i, n, round(len(q) / len(n), 6)) for q, i, n, _ in rows if q and n.lower().startswith(q.lower())]
        prefix[q] = sorted(begin, key=lambda r: (-r[3], r[1]))[:10]
        exact[q] = [(q, i, n, 1.0) for q, i, n, _ in rows if q in (n, n.lower())]
    flat = lambda d: sorted(r for rows in d.values() for r in rows)
    got = lambda df: sorted(map(tuple, df.select("query", "id", "name", "score").collect()))
    assert got(search.fuzzy_many(entities, queries)) == flat(fuzzy)
    assert got(search.prefix_many(entities, queries)) == flat(prefix)
    assert got(search.exact_many(entities, queries)) == flat(exact)
    smart = {}
    for q in fuzzy:
        stages = [(1, r) for r in exact[q]]
        stages += [(2, r) for r in prefix[q]] if len(exact[q]) < 2 else []
        stages += [(3, r) for r in fuzzy[q]] if len(exact[q]) + len(prefix[q]) < 2 else []
        first = {}
        for k, r in stages:
            first.setdefault(r[1], (k, r))
        smart[q] = [r for _, r in sorted(first.values(), key=lambda x: (x[0], -x[1][3], x[1][1]))[:10]]
    assert got(search.smart_many(entities, queries)) == flat(smart)


def test_vectors_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(90)]
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(200, None), (201, [0.0] * 6), (202, [float("nan")] * 6), (203, [1.0, 2.0]), (204, [2.0, 1.0]), (205, [])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and np.isfinite(v).all() and any(v)]
    want = []
    for q, x in good:
        if q % 4 == 0:
            near = sorted((-round(float(x @ y), 6), i) for i, y in good if i != q and len(x) == len(y))
            want += [(q, i, -s) for s, i in near[:5]]
    got = search.nearest_many(df, df.where("id % 4 = 0"), 5, block=16, query_block=7)
    assert sorted((r["query"], r["id"], r["score"] + 0.0) for r in got.collect()) == sorted((q, i, s + 0.0) for q, i, s in want)
