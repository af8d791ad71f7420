"""Manifest, near copies by registers and whitening: against plain implementations, and hard rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import merkle, minhash, registry, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- 11: manifest ---


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, arity):
    """(root, siblings of each node level by level as (left, right))."""
    steps, of = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, members = [], []
        for k in range(0, len(nodes), arity):
            run = nodes[k : k + arity]
            for i in range(len(run)):
                for leaf in of[k + i]:
                    steps[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
            above.append(h(*run))
            members.append(sum(of[k : k + arity], []))
        nodes, of = above, members
    return nodes[0], steps


def plain_manifest(rows, arity=2):
    leaf = lambda r, n: h(*(said(v) for v in (r[0], r[3], r[2], n, r[1])))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((leaf(r, r[4]), r))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    found, subroots = [], []
    for t in order:
        mine = sorted(trees[t], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        subroot, steps = climb([x[0] for x in mine], arity)
        subroots.append(subroot)
        found.append([(x, s) for x, s in zip(mine, steps, strict=True)])
    root, tops = climb(subroots, arity)
    out = []
    for group, subroot, top in zip(found, subroots, tops, strict=True):
        for (digest, r), steps in group:
            path = steps + top
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = leaf(r, r[4] + 1) if hit else digest
            for left, right in path:
                fold = h(left, fold, right)
            out.append((r[0], digest, subroot, root, h(*(a + b for a, b in path)), fold, fold == root))
    return out


def documents(rng, n):
    langs = ["en"] * 6 + ["de", "fr", "ελ", "", None, "zz"]
    return [(i * 3 - 40, rng.choice(["", None, "naïve text " * rng.randrange(5), "line\nline"]), rng.choice(langs), rng.choice(["web", None, "ü"]), rng.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 257, 700])
def test_manifest_against_plain_trees(spark, tmp_path, n):
    rows = documents(random.Random(n), n)
    got = registry.op11_merkle_manifest(spark, written(spark, tmp_path, "documents", rows, DOCS))
    assert sorted(map(tuple, got.collect())) == sorted(plain_manifest(rows))


def test_manifest_of_hard_rows(spark, tmp_path):
    """Null and repeated ids, equal rows, the largest count, a long text, no rows."""
    rows = [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (5, "a", "en", "s", 2), (5, "b", None, None, None), (5, "b", None, None, None), (7, "x" * 3_000_000, "en", "s", 2**63 - 1), (63, "y", "en", "s", 2**63 - 1), (14, None, None, None, 2**63 - 1)]
    got = registry.op11_merkle_manifest(spark, written(spark, tmp_path, "documents", rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_manifest(rows), key=repr)
    empty = registry.op11_merkle_manifest(spark, written(spark, tmp_path, "documents", [], DOCS))
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("arity", [3, 300])
def test_manifest_of_other_arities_and_names(spark, arity):
    rows = [(i, f"t{i}", "ab"[i % 2], "s", i) for i in range(650)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("tree", "at", "of", "digest", "own", "row", "part", "below", "order")})
    leaf = merkle.leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    got = merkle.manifest(df, F.col("lang"), F.col("doc_id"), leaf, arity, tree=F.col("doc_id"))
    got = got.select("tree", merkle.text_of("root"), F.sha2(merkle.proof_text("path"), 256), merkle.folded(F.col("leaf"), "path") == F.col("root"))
    assert sorted(map(tuple, got.collect())) == sorted((r[0], r[3], r[4], True) for r in plain_manifest(rows, arity))


# --- 12: near copies ---


def shingles(text, words=3):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_components(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) and common:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min([x for x in (least.get(find(k)), i) if x is not None], default=None)
    return [(i, len(s), least[find(k)], i == least[find(k)]) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


def near_copies(rng, n):
    words = [f"w{k}" for k in range(3000)]
    docs = []
    while len(docs) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 40, 120, 400, 900]))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            text = list(base)
            for _ in range(rng.randrange(max(1, len(base) // 30) + 1)):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((len(docs) * 7 % 1009, rng.choice([" ", "\n"]).join(text)))
    return docs


def test_near_duplicates_against_all_pairs(spark):
    docs = near_copies(random.Random(3), 500)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block_bytes=1 << 14)
    assert sorted(map(tuple, got.collect())) == sorted(plain_components(docs))


def test_large_families_and_a_common_passage(spark):
    """Hundreds of near copies at the threshold, and texts that only share a passage."""
    rng = random.Random(9)
    base, passage = [f"b{k}" for k in range(150)], [f"p{k}" for k in range(60)]
    docs = [(i, " ".join(w if rng.random() > 0.025 else f"x{rng.random()}" for w in base)) for i in range(300)]
    docs += [(1000 + i, " ".join(passage + [f"y{rng.random()}" for _ in range(rng.randrange(30, 60))])) for i in range(200)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), block_bytes=1 << 14)
    assert sorted(map(tuple, got.collect())) == sorted(plain_components(docs))


def test_near_duplicates_of_hard_rows(spark):
    """Null ids and texts, texts without words, repeated rows, a long text, clashing names, no rows."""
    long = " ".join(f"v{k}" for k in range(300_000))
    docs = [(None, "a b c d e f g h"), (4, "A B c d e f g h"), (9, None), (8, ""), (7, " \t\n"), (None, None), (3, "one"), (2, "ONE"), (2, "ONE"), (6, long), (5, long + " and more"), (11, "é È"), (10, "é è")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("set_id", "block", "sig", "root", "n_shingles", "registers")})
    assert sorted(map(tuple, minhash.near_duplicates(df).collect()), key=repr) == sorted(plain_components(docs), key=repr)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_registers_estimate_and_agree(spark):
    rng = np.random.default_rng(1)
    for n, d in ((60, 4), (500, 40), (5000, 300)):
        hits, guesses = [], []
        for _ in range(30):
            x = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            y = np.sort(np.r_[rng.permutation(x)[d:], rng.integers(0, 1 << 64, d, dtype=np.uint64)])
            regs = np.vstack([minhash.registers(np.zeros(n, np.int64), v, 1) for v in (x, y)])
            guesses.append(minhash.estimated(regs[:1], regs[1:], np.array([n]), np.array([n]))[0][0])
            sigs = minhash.band_signatures(regs)
            hits.append((sigs[0] == sigs[1]).mean())
        true = (n - d) / (n + d)
        assert abs(np.mean(guesses) - true) < 0.03 and abs(np.mean(hits) - true**minhash.ROWS) < 0.12
    # Registers of unlike sets agree as often as chance says.
    many = [minhash.registers(np.zeros(40_000, np.int64), np.sort(rng.integers(0, 1 << 64, 40_000, dtype=np.uint64)), 1)[0] for _ in range(120)]
    agree = np.mean([(many[i] == many[j]).mean() for i in range(120) for j in range(i)])
    assert agree == pytest.approx(float(minhash.chance(np.array(40_000.0), np.array(40_000.0))), rel=0.25)


# --- 13: whitening ---


@pytest.mark.parametrize("dim", [1, 2, 3, 17, 64])
def test_symmetric_qr(dim):
    rng = np.random.default_rng(dim)
    for a in (np.cov(rng.normal(size=(dim, 90)) * np.linspace(1, 9, dim)[:, None]).reshape(dim, dim), np.eye(dim), np.zeros((dim, dim)), np.ones((dim, dim)), np.diag(np.arange(dim) % 3.0)):
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(vectors @ vectors.T, np.eye(dim), atol=1e-12) and np.allclose(vectors @ a @ vectors.T, np.diag(values), atol=1e-11 * max(1, abs(values).max()))
        assert np.allclose(values, np.linalg.eigh(a)[0][::-1], atol=1e-11 * max(1, abs(values).max()))


def test_moments_merge_as_one_stream():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) + 1e4
    parts = [whitening.Moments(5) for _ in range(3)]
    for k, row in enumerate(x):
        parts[k % 2].add(row)
    whole = whitening.Moments(5)
    for p in parts:  # the last one is empty
        whole.merge(p.n, p.mean, p.products)
    assert whole.n == 200 and np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-9)


def plain_whitening(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * c) for c in v] for _, v in good])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    return good, n, ((n * x - s) ** 2).sum(1), (n * x - s) / n @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening_against_plain_arrays(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=7) * np.arange(1, 8) / 9]) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(150)]  # a third of all rows are copies
    rows += [(2000, None), (2001, [None] + [0.0] * 6), (2002, [math.nan] + [0.0] * 6), (2003, [math.inf] + [0.0] * 6), (2004, [-math.inf] + [0.0] * 6), (None, [0.5] * 7), (2005, [-0.0] * 7)]
    got = registry.op13_whitening(spark, written(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>")).toPandas()
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    good, n, deviation, white, explained = plain_whitening(rows)
    assert len(got) == 4 * len(good) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    got["vec_id"] = got["vec_id"].fillna(-1)
    sign = {}
    for k, (i, _) in enumerate(good):
        mine = got[got["vec_id"] == (-1 if i is None else i)].sort_values("component")
        assert mine["component"].tolist() == [1, 2, 3, 4] and set(mine["deviation"]) == {deviation[k]}
        for c, (w, x) in enumerate(zip(mine["whitened"], mine["explained"], strict=True)):
            flip = sign.setdefault(c, 1 if abs(w - white[k, c]) <= abs(w + white[k, c]) else -1) if abs(w) > 1e-3 else sign.get(c, 1)
            assert w == pytest.approx(flip * white[k, c], abs=1e-9) and x == pytest.approx(explained[c], rel=1e-9)


def test_whitening_of_hard_rows(spark):
    """Other lengths, equal vectors, empty ones, huge entries, clashing names, no rows."""
    rows = [(1, [0.5, 0.25]), (2, [0.1, -0.3]), (2, [0.1, -0.3]), (None, [0.7, 0.1]), (3, []), (4, [1.0]), (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, [3e9, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("z") for c in ("x", "component", "n", "dim", "white", "part")})
    got = whitening.whiten(df, "embedding")
    by = {}
    for r in got.collect():
        by.setdefault(r["vec_id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 2, 2: 4, None: 2, 6: 1, 7: 1}  # of two vectors only one component has a spread
    assert {r["n"] for r in by[1]} == {3} and {r["n"] for r in by[7]} == {2}
    assert all(r["identity_error"] < 1e-9 for v in by.values() for r in v) and by[7][0]["deviation"] is None
    assert whitening.whiten(df.limit(0), "embedding").collect() == []
