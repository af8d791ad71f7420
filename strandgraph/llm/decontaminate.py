"""Benchmark decontamination by templates, with DataFrame operations only.

Numbers, units and names of texts and benchmark items are replaced by typed placeholders. Windows of ``width`` template words are
hashed and joined by hash; windows of an item and a document on one diagonal (document place - item place) are an
alignment. Windows with few literal words, and items shorter than a window as a whole, are joined by their words as they
stand. An alignment counts if it covers enough words of the item and its slots are consistent: each value of the item stands for one value of the
document and the other way around. So copies are found, and questions that only have other numbers or names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WIDTH, MIN_WORDS, MIN_LITERALS = 8, 13, 5
#: Units of measure, and currency signs before a number. Fixed values.
UNITS = "mm|cm|km|m|mg|kg|g|ml|l|s|ms|min|h|hour|hours|minute|minutes|second|seconds|day|days|week|weeks|month|months|year|years|meter|meters|metre|metres|mile|miles|foot|feet|inch|inches|gram|grams|kilogram|kilograms|liter|liters|litre|litres|dollar|dollars|euro|euros|cent|cents|percent|degree|degrees|watt|watts|volt|volts"
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
#: Rows of benchmark windows, or of alignments to look into, up to which they are sent to every executor.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """The words of a text, one for each word of its template."""
    return F.transform(_pairs(text), lambda p: p["raw"])


def _canonical(text: Column) -> Column:
    """The text with placeholders, white space unchanged: a number is any word with a digit; a unit stands after a
    number; a name is a capitalised word inside a sentence."""
    t = F.regexp_replace(text, r"(?<=[\p{Ll},;][ ])\p{Lu}[\p{L}'’-]*", NAME)
    t = F.regexp_replace(t, r"[^\s<>]*\d[^\s<>]*", NUMBER)
    t = F.regexp_replace(t, rf"(?<=<num>\s)(?:{UNITS})(?![\p{{L}}\p{{N}}])", UNIT)
    return F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}<>\s]+", "")


def _template(text: Column) -> Column:
    return F.filter(F.split(_canonical(text), r"\s"), lambda w: w != "")


def _pairs(text: Column) -> Column:
    """Each word of the template, the word it stands for, and that without case and punctuation."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", "")
    both = F.arrays_zip(F.split(text, r"\s").alias("raw"), F.split(_canonical(text), r"\s").alias("word"), F.split(bare, r"\s").alias("bare"))
    return F.filter(both, lambda p: p["word"] != "")


def _windows(pairs: Column, width: int, least: int) -> Column:
    """Hashes of all windows, in order; fewer than ``width`` words have none. A window with fewer than ``least`` literal
    words is hashed by its words as they stand instead of its template."""

    def of(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(p["word"]) - F.lit(width) + 1)
        by_template = lambda i: F.xxhash64(F.slice(p["word"], i, width))
        slots = lambda part: F.size(F.array_remove(part, 0))
        either = lambda i: F.when(slots(F.slice(p["slot"], i, width)) > width - least, _standing(F.slice(p["bare"], i, width))).otherwise(by_template(i))
        hashed = F.when(slots(p["slot"]) > width - least, F.transform(starts, either)).otherwise(F.transform(starts, by_template))
        return F.when(F.size(p["word"]) >= width, hashed)

    def parts(all_pairs: Column) -> Column:
        word = F.transform(all_pairs, lambda p: F.xxhash64(p["word"])).alias("word")
        slot = F.transform(all_pairs, lambda p: F.when(p["word"].startswith("<"), 1).otherwise(0)).alias("slot")
        return _let(F.struct(word, slot, all_pairs["bare"].alias("bare")), of)

    return _let(pairs, parts)


def _text_windows(text: Column, width: int, least: int) -> Column:
    """``_windows`` of a text. Only one with so many slots that a window may be short of literal words is looked at word
    beside word; all others need their template alone."""

    def either(words: Column) -> Column:
        plain = F.size(F.filter(words, lambda w: w.startswith("<"))) <= width - least
        hashed = lambda h: F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(1), F.size(h) - F.lit(width) + 1), lambda i: F.xxhash64(F.slice(h, i, width))))
        return F.when(plain, _let(F.transform(words, lambda w: F.xxhash64(w)), hashed)).otherwise(_windows(_pairs(text), width, least))

    return _let(_template(text), either)


def _standing(words: Column) -> Column:
    """The hash of words as they stand, never that of a template."""
    return F.xxhash64(F.lit("as they stand"), words)


def _standing_windows(pairs: Column, width: int) -> Column:
    of = lambda bare: F.when(F.size(bare) >= width, F.transform(F.sequence(F.lit(1), F.size(bare) - F.lit(width) + 1), lambda i: _standing(F.slice(bare, i, width))))
    return _let(pairs["bare"], of)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: a lambda's variable isn't computed again for every use."""
    return F.element_at(F.transform(F.array(value), then), 1)


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, n_words, n_slots, exact``: one row for each document and item whose best alignment counts.

    It covers at least ``min_words`` words of the item, or all of a shorter item's; ``exact`` says that no slot has another value. Texts and
    items that are null or without words match nothing. Windows with fewer than 5 literal words, and items of fewer than ``width``
    words, match only the same words, whatever their case and punctuation; so an item of one word matches each text with this word. Rows with equal ids are one document, whose texts are looked at each for itself; a null id is
    reported as null. Extra columns aren't read. Of equal alignments of a pair the longest is taken, then the first.
    """
    item = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    item = item.withColumn("pairs", _pairs(F.col("text"))).withColumn("item_words", F.transform("pairs", lambda p: p["word"]))
    item = cut(item.withColumn("item_raw", F.transform("pairs", lambda p: p["raw"])).where(F.size("item_words") > 0).select("item_id", "item_words", "item_raw", "pairs"))
    item_size = F.size("item_words").alias("item_size")
    long = item.where(F.size("item_words") >= width).select("item_id", item_size, "item_words", F.posexplode(_windows(F.col("pairs"), width, MIN_LITERALS)).alias("item_at", "hash"))
    short = item.where(F.size("item_words") < width).select("item_id", item_size, "item_words", F.lit(0).alias("item_at"), _standing(F.col("pairs")["bare"]).alias("hash"))
    held = F.slice("item_words", F.col("item_at") + 1, width)
    has_slot = F.exists(held, lambda w: w.startswith("<")).alias("has_slot")
    spans = cut(long.union(short).select("item_id", "item_size", "item_at", "hash", has_slot))
    sizes = sorted(r[0] for r in spans.where(F.col("item_size") < width).select("item_size").distinct().collect())  # fewer than width

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    pairs = _pairs(F.col("text"))
    every = [_text_windows(F.col("text"), width, MIN_LITERALS), *(_standing_windows(pairs, n) for n in sizes)]
    there = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(every[0]).alias("doc_at", "hash"))
    for windows in every[1:]:
        there = there.union(docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(windows).alias("doc_at", "hash")))
    hits = there.join(_small(spans), "hash")
    by = ["doc_id", "text_key", "item_id", (F.col("doc_at") - F.col("item_at")).alias("diagonal")]
    lined = hits.groupBy(*by).agg(F.max("has_slot").alias("has_slot"), F.min("item_size").alias("item_size"), F.collect_set("item_at").alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + F.least(F.lit(width), F.col("item_size")) - 1)))))
    lined = lined.withColumn("n_words", covered).where(F.col("n_words") >= F.least(F.lit(min_words), F.col("item_size")))
    lined = cut(lined.withColumn("low", F.array_min("at")).withColumn("high", F.array_max("at") + F.least(F.lit(width), F.col("item_size"))).drop("at", "item_size"))

    plain = lined.where("NOT has_slot").select("doc_id", "item_id", "n_words", F.lit(0).alias("n_slots"), F.lit(True).alias("exact"))
    slotted = lined.where("has_slot").join(item, "item_id")
    texts = docs.withColumn("text_key", F.xxhash64("text"))
    keys = slotted.select("text_key").distinct()
    some = texts.join(_small(cut(keys)), "text_key", "left_semi").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), words_of(F.col("text")).alias("doc_raw"))
    slots = F.filter(F.sequence(F.col("low"), F.col("high") - 1), lambda i: F.element_at("item_words", i + 1).startswith("<"))
    bare = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]+", ""))
    pair = F.transform(slots, lambda i: F.struct(bare(F.element_at("item_raw", i + 1)).alias("item"), bare(F.element_at("doc_raw", i + F.col("diagonal") + 1)).alias("doc")))
    looked = slotted.join(some.distinct(), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))).withColumn("pair", pair)
    of = lambda part: F.size(F.array_distinct(F.transform("pair", lambda p: p[part])))
    distinct = F.size(F.array_distinct("pair"))
    looked = looked.where((of("item") == distinct) & (of("doc") == distinct))
    looked = looked.select("doc_id", "item_id", "n_words", F.size("pair").alias("n_slots"), (~F.exists("pair", lambda p: p["item"] != p["doc"])).alias("exact"))
    best = F.max(F.struct("n_words", "exact", "n_slots")).alias("best")
    return plain.unionByName(looked).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_words", "best.n_slots", "best.exact")


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, as a broadcast if it has few rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", key_col: str | None = None, **how) -> DataFrame:
    """The rows of ``df`` that match no item, each judged by its own text, whatever its id.

    ``key_col`` names a written column that is another value in each row; without it rows are numbered and written first.
    """
    key = key_col or "_row"
    rows = df if key_col else cut(df.withColumn(key, F.monotonically_increasing_id()))
    bad = cut(contaminated(rows, items, key, **how).select(F.col("doc_id").alias("bad_row")).distinct())
    return rows.join(_small(bad), F.col(key) == F.col("bad_row"), "left_anti").select(*df.columns)
