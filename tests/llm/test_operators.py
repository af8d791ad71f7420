"""Small tables with nulls, empty and repeated rows and clashing columns, each operator against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import common, decontaminate, jaccard_join, language_id, licenses, mixing, nearest, registry, sentence_spans, suffix_dedup, token_counts, toxicity

WORDS = [f"w{i}x" for i in range(200)]
BASE = " ".join(WORDS[:100])
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("w50x", "other")), (4, " ".join(WORDS[100:180])), (5, ""), (6, None), (None, BASE),
    (7, "one two three"), (8, "One  two\tthree"), (9, " \n "), (10, "lead. " + BASE + ". tail"), (10, "lead. " + BASE + ". tail"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "src", "x", 0) for i, t in TEXTS], "doc_id long, text string, source string, kept string, size int")


@pytest.fixture
def empty(docs):
    return docs.limit(0)


def test_jaccard_against_brute_force(docs, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(docs).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in TEXTS]
    root = list(range(len(sets)))
    for _ in sets:
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    least = {r: min((sets[k][0] for k in range(len(sets)) if root[k] == r and sets[k][0] is not None), default=None) for r in root}
    assert got == {(i, len(s), least[root[k]]) for k, (i, s) in enumerate(sets)}
    assert jaccard_join.similar_groups(empty).count() == 0


def test_suffix_dedup_against_brute_force(docs, empty):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()))
    want = []
    order = lambda i: float("inf") if i is None else i
    for i, t in TEXTS:
        data = (t or "").encode()
        before = b"\0".join((u or "").encode() for j, u in TEXTS if order(j) < order(i))
        gone = [False] * len(data)
        for p in range(len(data) - 49):
            if data[p : p + 50] in before:
                gone[p : p + 50] = [True] * 50
        want.append((i is None, i or 0, sum(gone), hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    assert got == sorted(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_sentence_spans(spark, docs):
    passage = "First thing here stands now. Second thing follows the first one. Third thing ends what the second began. Fourth thing is said too."
    rows = spark.createDataFrame([(2, "Own words of two. " + passage), (1, passage), (3, "Nothing is repeated here at all."), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sentence_spans.remove_repeated_spans(rows).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_removed"] == 0 and got[4]["kept"] == ""
    assert "Second thing" not in got[2]["kept"] and got[2]["kept"].startswith("Own words")
    assert sentence_spans.remove_repeated_spans(docs).count() == len(TEXTS)


def test_token_counts_match_the_library(docs):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.count_tokens(docs, path).collect())
    assert got == sorted((i or 0, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    odd = ["İstanbul ΑΣ naïve <|endoftext|>'s x", "a\x1cb \x85c\xa0d ''s 're'VE", "漢字 ①½ x²", "🙂 a'b", "it’s — fine", "ƾ̪Ⱥİ̻âŴ̴ś̖͕", "ΑΣ ΟΔΟΣ", "हिन्दी עִבְרִית 한국어", "x\ufffe\U000e0fff ﷐"]
    counter = token_counts.WordCounter(path)
    assert counter.split("it’s — fine") == ["it", "’", "s", "—", "fine"] and counter.split("Привет, мир") == ["привет", ",", "мир"]
    assert counter.counts(odd) == [len(tok.encode(o, add_special_tokens=False).ids) for o in odd]


def test_mixing_meets_budgets(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * sum(r["size"] for r in rows)) <= 1
    assert mixing.mix_sources(empty).count() == 0


def test_decontamination(spark, docs):
    item = spark.createDataFrame([(9, "If Anna buys 12 apples and Bob eats 5 apples then how many kg of fruit will Anna have left today?")], "item_id long, text string")
    texts = [
        (1, "Before. If Anna buys 12 apples and Bob eats 5 apples then how many kg of fruit will Anna have left today? After."),
        (2, "If Carl buys 40 apples and Dora eats 7 apples then how many kg of fruit will Carl have left today?"),
        (3, "If Carl buys 40 apples and Dora eats 7 apples then how many kg of fruit will Zoe have left today?"),
        (4, None), (5, "short"),
    ]
    got = {(r["doc_id"], r["exact"]) for r in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), item).collect()}
    assert got == {(1, True), (2, False)}
    assert decontaminate.decontaminate(docs, item).count() == len(TEXTS)


def test_toxicity_automaton_and_model(spark):
    a = toxicity.Automaton({"idiot", "scum"}, {"lowei"})
    assert [a.match(w) for w in ("idiot", "id1ot", "idiott", "idiots", "idot", "scum", "scam", "loweient", "theory")] == [1, 3, 3, 3, 3, 1, 0, 2, 0]
    rows = [(i, f"some plain text {i} {'you idiot' if i % 2 else 'fine day'} and more", i % 2) for i in range(60)]
    df = spark.createDataFrame([*rows, (100, None, None), (None, "", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(df, model).collect()}
    assert all(got[i] == i % 2 for i in range(60)) and got[100] == 0


def test_language_id(spark):
    rows = [(i, "the cat and the dog are here" if i % 2 else "der hund und die katze sind hier", "en" if i % 2 else "de") for i in range(20)]
    df = spark.createDataFrame([*rows, (50, None, "en"), (51, "123 !", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_languages(df, language_id.fit_languages(df)).collect()}
    assert all(got[i] == ("en" if i % 2 else "de") for i in range(20)) and got[50] == got[51] == "und"


def test_licenses(docs, spark):
    df = spark.createDataFrame([(1, "Some text.\nReleased under the MIT License.\nMore."), (2, "No notice."), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["license"], r["n_differences"]) for r in licenses.scan_licenses(df).collect()] == [(1, "MIT", 0)]


def test_nearest_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(df, F.col("vec_id") % 100 == 0).collect()
    hit = 0
    for q in (0, 100, 200, 300):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit >= 36 and not {r["vec_id"] for r in got} & {1000, 1001, 1002}


def test_parity_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for size in (1, 7, 60, 400, 3000):
        x = rng.integers(0, 1 << 63, size).astype(np.uint64)
        band = int(jaccard_join.band_of(np.array([size]))[0])
        for changed in {0, 1, size // 10, size // 4, size}:
            y = np.r_[x[changed:], rng.integers(0, 1 << 63, changed // 2).astype(np.uint64)]
            a, b = (jaccard_join.parity_sketch(e, band, 80) for e in (x, y))
            assert len(a) == len(b) and sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(5)
    ids = rng.integers(-(1 << 62), 1 << 62, 1000).tolist()
    apart = ids[:600], ids[600:]
    links = [(c[i], c[i + 1]) for c in apart for i in range(len(c) - 1)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(c) for c in apart for x in c} | {7: 7}


def _shares_a_run(a, b):
    x, y = (set(sentence_spans.spans(*sentence_spans.sentences(t), 3, 20)[0].tolist()) for t in (a, b))
    return bool(x & y)


def test_every_passage_of_fifty_words_has_a_run():
    rng = np.random.default_rng(11)
    for ends in (0.0, 0.06, 0.2):
        for _ in range(400):
            words = lambda n: [f"v{w}{'.' if rng.random() < ends else ''}" for w in rng.zipf(1.3, n) % 5000]  # noqa: B023, E731
            passage = words(50)
            texts = [" ".join([*words(30), *passage, *words(30)]) for _ in range(2)]
            assert _shares_a_run(*texts), texts


def test_spans_of_scripts_without_spaces():
    rng = np.random.default_rng(12)
    for low, high, n in ((0x4E00, 0x9000, 100), (0x0E01, 0x0E2F, 200)):
        for end in ("", "。"):
            chars = lambda n: "".join(chr(c) + (end if rng.random() < 0.03 else "") for c in rng.integers(low, high, n))  # noqa: B023, E731
            for _ in range(100):
                passage = chars(n)
                texts = [chars(60) + passage + chars(60) for _ in range(2)]
                assert "".join(sentence_spans.sentences(texts[0])[0]) == texts[0]
                assert _shares_a_run(*texts)


def test_decontamination_of_items_dense_in_numbers_and_short_ones(spark):
    dense = "Compute 12 + 7 * 3 - 4 / 2 when x = 5 and y = 9"
    items = spark.createDataFrame([(1, dense), (2, "Who wrote Faust?"), (3, " ? ")], "item_id long, text string")
    texts = [(1, f"Before it. {dense}. After it."), (2, dense.replace("12", "13")), (3, "Then: who wrote faust"), (4, "Who wrote that? Faust"), (5, "wrote Faust?"), (6, None)]
    got = {(r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1, True), (3, 2, True)}


def test_toxicity_learns_from_texts_with_a_common_header(spark):
    header = "This source opens every document that it has with one and the same long line of text. "
    assert len(header) > 80
    rows = [(i, f"{header} Number {i} {'you idiot' if i % 2 else 'fine day'}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert "idiot" in toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))["words"]


def test_each_license_of_a_paragraph(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    texts = [f"{mit} {apache}", f"{apache} {mit} {mit}", f"{mit}\n\n{apache}", f"Text before. {licenses.TEMPLATES['Apache-2.0-header']}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["n_found"], r["n_differences"]) for r in licenses.scan_licenses(df).collect()}
    assert {g for g in got if g[0] < 3} == {(0, "MIT", 1, 0), (0, "Apache-2.0", 1, 0), (1, "MIT", 2, 0), (1, "Apache-2.0", 1, 0), (2, "MIT", 1, 0), (2, "Apache-2.0", 1, 0)}
    assert all(g[2] == 1 for g in got if g[0] == 3)


def test_nearest_finds_all_that_is_due(spark):
    rng = np.random.default_rng(13)
    small = rng.normal(size=(8, 64))
    centre = rng.normal(size=32)
    skewed = np.r_[centre + rng.normal(size=(60, 32)) / 1000, [-centre]]
    rows = [(i, v.tolist()) for i, v in enumerate(small)] + [(100 + i, v.tolist()) for i, v in enumerate(skewed)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(df, (F.col("vec_id") < 8) | (F.col("vec_id") == 160)).collect()
    for ids, x, asked in ((range(8), small, range(8)), (range(100, 161), skewed, [160])):
        for q in asked:
            d = {i: np.linalg.norm(v - x[q - ids[0]]) for i, v in zip(ids, x, strict=True) if i != q}
            want = sorted(d, key=lambda i: (d[i], i))[:10]
            assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_pipeline_decides_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    other, item = " ".join(WORDS[100:180]), " ".join(WORDS[180:200])
    texts = [(None, BASE), (None, BASE), (None, other), (4, "own words of four"), (5, BASE), (5, "own words of five"), (6, item), (6, "own words of six"), (None, item + " more"), (None, "own words of none"), (7, "a copy with equal ids"), (7, "a copy with equal ids")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in left.collect())) == sorted((i or 0, t) for i, t in {*texts} - {(None, BASE)} - {(None, item + " more")})
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in left.collect())) == sorted((i or 0, t) for i, t in texts if not t.startswith(item))


def test_nearest_keeps_ties_and_tells_close_vectors_far_from_the_origin_apart(spark):
    rng = np.random.default_rng(17)
    far = 1e6 + rng.normal(size=(300, 8)) / 1000
    tied = np.tile([[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]], (1, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(far)] + [(1000 + i, tied[i % 4].tolist()) for i in range(60)] + [(2000, [1e-200] * 2), (2001, [2e-200, 1e-200]), (2002, [1e200, 1.0]), (1000, tied[0].tolist())]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, query_id string, rank int")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id").isin(5, 1000, 2000)).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    d = np.sqrt(((far - far[5]) ** 2).sum(1))
    d[5] = np.inf
    assert got[5] == np.lexsort((np.arange(300), d))[:10].tolist()
    assert got[1000] == [1000 + i for i in range(4, 44, 4)]
    assert got[2000] == [2001, 2002]
    assert nearest.nearest(df.limit(0), F.col("vec_id") == 1).count() == 0
