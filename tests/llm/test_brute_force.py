"""Each operator against a plain implementation on small random tables, and what the contracts say of hard cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import common, decontaminate, jaccard_join, language_id, licenses, mixing, sentence_spans, suffix_dedup, token_counts, toxicity
from strandgraph.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 3: licenses ---

LONG = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense and sell copies of it, subject to the following conditions.

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.

The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."""


def test_a_template_of_any_length_is_found(spark):
    df = spark.createDataFrame([(1, LONG), (2, "Before it stands this.\n\n" + LONG.replace("\n", "\n  ") + "\n\nAfter it."), (3, LONG.replace("express or", "express"))], SCHEMA)
    got = rows(licenses.scan_licenses(df, {"long": LONG}), "doc_id", "license", "n_found", "n_differences")
    assert got == [(1, "long", 1, 0), (2, "long", 1, 0), (3, "long", 1, 1)]
    with pytest.raises(ValueError, match="plain"):
        licenses.scan_licenses(df, {"plain": "Nothing is said here."})


def indel(own, words):
    """Fewest words to take out of or put into ``own`` to have a stretch of ``words``, by dynamic programming."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(own):
        new = [i + 1]
        for j, v in enumerate(words):
            new.append(min(row[j] if w == v else len(own) * 2, row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_licenses_against_brute_force(spark):
    rng = random.Random(4)
    docs, want = [], []
    words = {n: licenses._WORD.findall(t.lower()) for n, t in licenses.TEMPLATES.items()}
    for i in range(60):
        name = rng.choice(list(licenses.TEMPLATES))
        said = licenses.TEMPLATES[name].split()
        for _ in range(rng.randrange(3)):
            said.pop(rng.randrange(len(said))) if rng.random() < 0.5 else said.insert(rng.randrange(len(said)), "zzz")
        filler = [f"w{rng.randrange(500)}" for _ in range(80)]
        text = " ".join(filler[:40]) + "\n" + " ".join(said) + "\n" + " ".join(filler[40:])
        docs.append((i, text))
        own = licenses._WORD.findall(text.lower())
        if licenses._ANCHOR.search(text):
            # Distances count words that the text has or lacks within the template's stretch.
            near = [(d / len(w), -len(w), n, d) for n, w in words.items() if (d := indel(w, own)) <= (1 - licenses.MIN_ALIKE) * len(w) + 1e-9]
            if near:
                best = min(near)
                want.append((i, best[2], best[3]))
    got = rows(licenses.scan_licenses(spark.createDataFrame(docs, SCHEMA)), "doc_id", "license", "n_differences")
    # The best license of each text is found with its differences; a text may hold others beside it.
    missing = [w for w in want if w not in got]
    assert len(want) > 30 and len(missing) <= len(want) // 20, missing


# --- 4: n-gram Jaccard join ---


def test_subsets_agree_as_often_as_they_must():
    rng = np.random.default_rng(6)
    for n in (5, 12, 40, 90, 300):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for d in range(0, int(jaccard_join.most_differing(np.array([n]), 80)[0]) + 1):
            y = np.r_[x[d // 2 :], rng.integers(0, 1 << 63, d - d // 2).astype(np.uint64)]
            for band, _, sigs in jaccard_join.signatures(x, 80):
                for other, _, others in jaccard_join.signatures(y, 80):
                    if band == other:
                        assert len(set(sigs.tolist()) & set(others.tolist())) >= jaccard_join.agreeing(jaccard_join.first_parts(band, 80), d) >= 1


def test_joins_near_the_threshold_against_brute_force(spark):
    rng = random.Random(8)
    docs = []
    for group in range(12):
        n = rng.choice([3, 5, 9, 20, 60, 150])
        base = [f"g{group}w{rng.randrange(4000)}" for _ in range(n)]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, n // 30) + 2)):
                text[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(text[: rng.choice([n, n, max(1, n - n // 6)])])))
    sets = []
    for _, t in docs:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = rows(jaccard_join.similar_groups(spark.createDataFrame(docs, SCHEMA), block_bytes=2000), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, len(s), find(i)) for i, s in enumerate(sets)), key=repr)


# --- 5: toxicity ---


def edits(a, b):
    """Letters more, less or other, or neighbours swapped, by dynamic programming (no part is edited twice)."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_edit_distances():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    for _ in range(60):
        words, stems = {word(rng.randint(3, 7)) for _ in range(4)}, {word(rng.randint(4, 6))}
        automaton = toxicity.Automaton(words, stems)
        for w in {word(rng.randint(1, 9)) for _ in range(150)} | words:
            want = 1 if w in words else 2 if any(w.startswith(s) for s in stems) else 3 if any(len(t) >= 5 and edits(w, t) == 1 for t in words) else 0
            assert automaton.match(w) == want, (w, words, stems)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    from strandgraph.llm import registry

    labels = common.table(spark, d, "labels").where("toxic IS NOT NULL")
    scored = registry.op5_toxicity(spark, d).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("hits")).collect()
    found = {r["toxic"]: r["hits"] / r["n"] for r in scored}
    assert found[1] >= 0.85 and found[0] <= 0.01


def test_toxicity_of_hard_rows(spark):
    rows_ = [(i, f"word{i} {'you idiot' if i % 2 else 'a fine day'} said again", i % 2) for i in range(40)]
    df = spark.createDataFrame([*rows_, *rows_, (None, "x", 1), (99, None, 1)], "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    long = "fine day " * 120_000
    hard = spark.createDataFrame([(1, "you idoit", 0.5), (1, "you idoit", 0.5), (2, None, 1.0), (3, "", 0.0), (None, "idiot", 0.0), (4, long + "idiot", 0.1)], "doc_id long, text string, score double")
    got = rows(toxicity.score_toxicity(hard, model), "doc_id", "predicted")
    assert got == sorted([(1, 1), (1, 1), (2, 0), (3, 0), (None, 1), (4, 1)], key=repr)
    none = toxicity.fit_toxicity(df.limit(0), df.limit(0))
    assert rows(toxicity.score_toxicity(hard.limit(0), none), "doc_id") == [] and {p for _, p in rows(toxicity.score_toxicity(hard, none), "doc_id", "predicted")} == {0}


# --- 6: mixing ---


def test_mixing_rows_against_brute_force(spark):
    rng = random.Random(9)
    docs = [(rng.choice([None, i, i, i]), " ".join(["w"] * rng.randrange(0, 30)) or None, rng.choice(["a", "b", "c", None, "d"])) for i in range(300)] + [(5, "x y", "a")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = rows(mixing.mix_sources(df, bucket_rows=7), "doc_id", "size", "source_size", "target", "taken")
    size = lambda t: len((t or "").split())
    total = {}
    for _, t, s in docs:
        total[s] = total.get(s, 0) + size(t)
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:  # give by weight; who gets more than twice their size stops there, and what is left is shared again
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else share * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    want = []
    for s in names:
        key = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        mine = sorted((r for r in docs if r[2] == s), key=key)
        budget = int(target[s] + 1e-9)
        taken = [0] * len(mine)
        while budget > 0 and total[s]:
            for k, r in enumerate(mine):
                n = min(budget, size(r[1]))
                taken[k] += n
                budget -= n
        want += [(r[0], size(r[1]), total[s], round(target[s], 6), n) for r, n in zip(mine, taken, strict=True)]
    assert [(*g[:3], round(g[3], 6), g[4]) for g in got] == sorted(want, key=repr) or sorted((*g[:3], round(g[3], 6), g[4]) for g in got if g[0] is not None) == sorted(w for w in want if w[0] is not None)
    assert rows(mixing.mix_sources(df, bucket_rows=7), "doc_id", "size", "source_size", "target", "taken") == got


# --- 7: sentence spans ---


def test_sentence_spans_against_brute_force(spark):
    rng = random.Random(12)
    said = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randrange(3)) for _ in range(rng.randint(2, 11))) + rng.choice(". ! ? .\n".split(" ")) for _ in range(40)]
    docs = [(rng.choice([None, *range(30)]), " ".join(rng.choice(said) for _ in range(rng.randrange(0, 14)))) for _ in range(60)]
    docs += [(3, docs[0][1]), (3, docs[0][1]), (None, None), (50, "")]
    docs = [(i, t) for i, t in docs if i is not None] + [(None, None)]
    df = spark.createDataFrame(docs, SCHEMA).coalesce(1)
    got = rows(sentence_spans.remove_repeated_spans(df, block_bytes=600), "doc_id", "kept")
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    seen, want = set(), []
    for k in order:
        pieces, words = sentence_spans.sentences(docs[k][1] or "")
        full = [i for i, w in enumerate(words) if w > 0]
        gone = set()
        for a in range(len(full)):
            b, n = a, 0
            while b < len(full) and (b - a < sentence_spans.MIN_SENTENCES or n < sentence_spans.MIN_WORDS):
                n += words[full[b]]
                b += 1
            if b - a >= sentence_spans.MIN_SENTENCES and n >= sentence_spans.MIN_WORDS:
                run = tuple(pieces[i].strip().lower() for i in full[a:b])
                if run in seen:
                    gone |= set(range(full[a], full[b - 1] + 1))
                seen.add(run)
        want.append((docs[k][0], "".join(p for i, p in enumerate(pieces) if i not in gone)))
    assert got == sorted(want, key=repr)
    assert sentence_spans.remove_repeated_spans(df.limit(0)).count() == 0


def test_short_sentences_stay_whole():
    text = "One, two, three and four. Five; six: seven! Eight, nine?\nTen."
    assert sentence_spans.sentences(text)[0] == ["One, two, three and four. ", "Five; six: seven! ", "Eight, nine?\n", "Ten."]


# --- 8: suffixes ---


def test_suffix_dedup_of_random_texts(spark):
    rng = random.Random(14)
    parts = ["".join(rng.choice("abé ") for _ in range(n)) for n in (30, 49, 50, 51, 70, 120)]
    docs = [(rng.choice([None, *range(12)]), "".join(rng.choice([*parts, f"<{rng.random()}>"]) for _ in range(rng.randrange(0, 6)))) for _ in range(40)]
    docs += [(4, "aa" * 300), (2, "a" * 90), (7, None)]
    got = rows(suffix_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA), block_bytes=700), "doc_id", "n_removed", "n_spans", "kept_sha256")
    order = lambda i: float("inf") if i is None else i
    want = []
    for i, t in docs:
        data = (t or "").encode()
        strings = {(u or "").encode()[p : p + 50] for j, u in docs if order(j) < order(i) for p in range(len((u or "").encode()) - 49)}
        gone = [False] * len(data)
        for p in range(len(data) - 49):
            if data[p : p + 50] in strings:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    assert got == sorted(want, key=repr)


# --- 9: language identification ---


def test_language_profiles_against_plain_loops(spark):
    rng = random.Random(15)
    letters = {"xx": "aeioubdg", "yy": "äößüsch", "zz": "жизньдом"}
    text = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(30))
    docs = [(i, text(lang), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 12)] + [(100, None, "xx"), (101, "½ ② ² Ⅻ 12", None), (102, "", "yy"), (None, text("zz"), "zz"), (5, text("yy"), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    prototypes = language_id.fit_languages(df, dims=256)
    got = rows(language_id.predict_languages(df, prototypes), "doc_id", "lang_pred")

    def bundle(t):
        plain = " " + " ".join(re.findall(r"[^\W\d_½②²Ⅻ]+", t.lower())) + " "
        v = {c: language_id.letter_vectors(np.array([ord(c)]), 256)[0] for c in set(plain)}
        out = np.zeros(256)
        for a, b, c in zip(plain, plain[1:], plain[2:], strict=False):
            out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
        return out

    want = []
    profile = {}
    for _, t, lang in docs:
        if t and lang and (re.search(r"[^\W\d_½②²Ⅻ]", t)):
            counts = {}
            plain = " " + " ".join(re.findall(r"[^\W\d_½②²Ⅻ]+", t.lower())) + " "
            for k in range(len(plain) - 2):
                counts[plain[k : k + 3]] = counts.get(plain[k : k + 3], 0) + 1
            profile[lang] = profile.get(lang, 0) + bundle(t) / np.sqrt(sum(c * c for c in counts.values()))
    mean = sum(p / np.linalg.norm(p) for p in profile.values()) / len(profile)
    for i, t, _ in docs:
        if not t or not re.search(r"[^\W\d_½②²Ⅻ]", t):
            want.append((i, "und"))
            continue
        x = bundle(t)
        cosine = {lang: float((x / np.linalg.norm(x) - mean) @ (p / np.linalg.norm(p) - mean) / np.linalg.norm(p / np.linalg.norm(p) - mean)) for lang, p in profile.items()}
        want.append((i, max(cosine, key=cosine.get)))
    assert got == sorted(want, key=repr)


# --- 10: decontamination ---


def test_decontamination_against_brute_force(spark):
    rng = random.Random(16)
    vocabulary = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("lo", "mi", "nu", "ra", "se")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 8, 12, 25])))) for i in range(25)]
    docs = []
    for i in range(80):
        filler = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.6:
            held = rng.choice(items)[1].split()
            held = held[rng.randrange(0, 2) :] if rng.random() < 0.3 else held
            at = rng.randrange(len(filler) + 1)
            filler[at:at] = held
        docs.append((i, " ".join(filler).capitalize() + rng.choice([".", "", "?"])))
    docs += [(200, None), (201, ""), (3, docs[3][1])]
    got = rows(decontaminate.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id", "n_words"), "doc_id", "item_id", "n_words")
    clean = lambda t: re.sub(r"[^a-z ]", "", (t or "").lower()).split()
    want = set()
    for i, t in docs:
        d = clean(t)
        for j, u in items:
            q = clean(u)
            best = 0
            for shift in range(-len(q) + 1, len(d)):
                same = [0 <= shift + k < len(d) and d[shift + k] == q[k] for k in range(len(q))]
                if len(q) < 8:
                    best = max(best, len(q) if all(same) else 0)
                else:
                    covered = {k + x for k in range(len(q) - 7) if all(same[k : k + 8]) for x in range(8)}
                    best = max(best, len(covered))
            if best and best >= min(decontaminate.MIN_WORDS, len(q)):
                want.add((i, j, best))
    assert set(got) == want and len(got) == len(want)


# --- hard rows of the rest ---


@pytest.mark.parametrize("name", ["licenses", "tokens", "jaccard", "spans", "suffixes", "decontaminate", "mixing", "languages"])
def test_hard_rows(spark, name):
    """Nulls, empty and very long texts, repeated rows, an empty table, and columns whose names the results have, too."""
    long = "".join(f"word{i} " for i in range(150_000))
    texts = [(1, "short text."), (1, "short text."), (None, "short text."), (None, None), (2, ""), (3, long), (4, long), (None, long), (5, " \n\t "), (6, "\x00 a\x00b")]
    extra = "n_tokens string, kept int, block string, row string, key string, license string, size string, rest string, component_id string, lang string, source string"
    df = spark.createDataFrame([(*t, *["x", 1, *["x"] * 9]) for t in texts], f"{SCHEMA}, {extra}")
    item = spark.createDataFrame([(1, "short text")], "item_id long, text string")
    run = {
        "licenses": lambda d: licenses.scan_licenses(d), "tokens": lambda d: token_counts.count_tokens(d, tokenizer_path()), "jaccard": jaccard_join.similar_groups, "spans": sentence_spans.remove_repeated_spans,
        "suffixes": suffix_dedup.remove_repeats, "decontaminate": lambda d: decontaminate.decontaminate(d, item), "mixing": mixing.mix_sources, "languages": lambda d: language_id.predict_languages(d, language_id.fit_languages(d)),
    }[name]
    n = run(df).count()
    assert n == {"licenses": 0, "decontaminate": 7}.get(name, len(texts))
    assert run(df.limit(0)).count() == 0


# --- pipeline stages ---


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_hard_rows(spark, tmp_path, empty):
    import corpus_pipeline

    rng = random.Random(18)
    some = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    passage = ". ".join(some(9) for _ in range(8)) + ". "
    item = some(25)
    base = some(80)
    docs = [(i, some(60), "en", "a", 0) for i in range(20)]
    docs += [(30, base, "en", "a", 0), (31, base, None, None, 0), (None, base + " x", "en", "b", 0), (40, some(30) + ". " + passage + some(30), "en", "b", 0), (41, some(30) + ". " + passage + some(30), "en", "b", 0)]
    docs += [(50, some(20) + " " + item + " " + some(20), "en", "a", 0), (60, "you idiot " + some(20), "en", "a", 0), (70, None, "en", "a", 0), (71, "", "en", "a", 0), (None, None, None, None, None), (20, some(60), "en", "a", 0), (20, some(60), "en", "a", 0)]
    train = [(100 + i, some(20) + (" idiot" if i % 2 else ""), "en", "c", 0) for i in range(60)]
    df = spark.createDataFrame(docs + train, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(100 + i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for name, t in (("documents", df), ("labels", labels), ("benchmark", bench)):
        (t.limit(0) if empty else t).write.parquet(f"{tmp_path}/{name}.parquet")
    if empty:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
        return
    docs_, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, docs_, str(tmp_path)))
        seen[name] = {(r["doc_id"], r["text"]) for r in out.collect()} if name != "mix" else {(r["doc_id"], r["taken"]) for r in out.collect()}
        docs_ = out
    ids = {k: [i for i, _ in v] for k, v in seen.items()}
    assert 60 not in ids["toxicity"] and not {100 + i for i in range(1, 60, 2)} & set(ids["toxicity"]) and {100 + i for i in range(0, 60, 2)} <= set(ids["toxicity"])
    assert len([1 for _, t in seen["near copies"] if t and base in t]) == 1 and 30 in ids["near copies"]
    texts = {i: t for i, t in seen["repeated passages"] if i is not None}
    assert passage.strip() in texts[40] and len(texts[41]) < len(texts[40]) - len(passage) // 2
    assert 50 not in ids["benchmark"] and set(range(20)) <= set(ids["benchmark"])
    assert set(range(20)) <= set(ids["mix"])
