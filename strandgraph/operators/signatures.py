"""Function signatures: comparison, compatibility, lookup, renames.

A signature is a row ``name, params, param_types, return_type, is_async, is_exported, type_params, is_generator, has_rest``;
``params``, ``param_types`` and ``type_params`` are arrays of strings. Names are distinct within a version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAGS = ("is_async", "is_exported", "is_generator", "has_rest")
WILD = ("any", "unknown")


def _types(s: str) -> Column:
    """Types of the parameters, ``any`` where none is declared."""
    types = F.coalesce(F.col(f"{s}.param_types"), F.array().cast("array<string>"))
    return F.transform(F.coalesce(F.col(f"{s}.params"), F.array().cast("array<string>")), lambda p, i: F.coalesce(F.get(types, i), F.lit("any")))


def _changes(a: str, b: str) -> dict[str, Column]:
    pa, pb = F.col(f"{a}.params"), F.col(f"{b}.params")
    differs = lambda x, y: ~x.eqNullSafe(y)
    return {
        "params_changed": differs(pa, pb) | ((F.size(pa) == F.size(pb)) & differs(_types(a), _types(b))),
        "type_params_changed": differs(F.coalesce(F.col(f"{a}.type_params"), F.array().cast("array<string>")), F.coalesce(F.col(f"{b}.type_params"), F.array().cast("array<string>"))),
        "return_changed": differs(F.col(f"{a}.return_type"), F.col(f"{b}.return_type")),
        **{f"{f.split('_')[1]}_changed": differs(F.col(f"{a}.{f}"), F.col(f"{b}.{f}")) for f in FLAGS},
    }


def impact(c: dict[str, Column]) -> Column:
    """high: return type, async or rest; medium: parameters, generics, export or generator; null: nothing changed."""
    return F.when(c["return_changed"] | c["async_changed"] | c["rest_changed"], "high").when(c["params_changed"] | c["type_params_changed"] | c["exported_changed"] | c["generator_changed"], "medium")


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old_name, new_name``: functions that only one version has, with the same types in the same order.

    Where several names fit, the k-th of one side in order of names goes with the k-th of the other, so each function is
    renamed once at most, and a shape that thousands share makes no pairs.
    """
    shape = lambda s: F.sha2(F.to_json(F.struct(_types(s).alias("t"), F.col(f"{s}.return_type").alias("r"))), 256)
    lone = lambda x, y, s: x.join(y.select("name"), "name", "left_anti").alias(s).select("name", shape(s).alias("shape"), F.size(f"{s}.params").alias("arity"))
    place = Window.partitionBy("shape", "arity").orderBy("name")
    number = lambda df, name: df.withColumn("n", F.row_number().over(place)).withColumnRenamed("name", name)
    gone, come = number(lone(old, new, "a"), "old_name"), number(lone(new, old, "b"), "new_name")
    return gone.join(come, ["shape", "arity", "n"]).select("old_name", "new_name")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``name, new_name, status, impact``: changed, unchanged, missing, added, and renamed (with its own impact)."""
    named = renames(old, new)
    a = old.join(named, old["name"] == named["old_name"], "left").withColumn("key", F.coalesce("new_name", "name")).withColumn("renamed", F.col("new_name").isNotNull()).drop("old_name", "new_name").alias("a")
    c = _changes("a", "b")
    both = a.join(new.alias("b"), F.col("a.key") == F.col("b.name"), "full_outer")
    changed = impact(c)
    status = F.when(F.col("b.name").isNull(), "missing").when(F.col("a.name").isNull(), "added").when(F.col("a.renamed"), "renamed").when(changed.isNotNull(), "changed").otherwise("unchanged")
    inside = F.col("a.name").isNotNull() & F.col("b.name").isNotNull()
    return both.select(F.col("a.name").alias("name"), F.col("b.name").alias("new_name"), status.alias("status"), F.when(inside, changed).alias("impact"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``name`` and what changed of it, with the impact: functions of both versions that differ."""
    c = _changes("a", "b")
    both = old.alias("a").join(new.alias("b"), F.col("a.name") == F.col("b.name"))
    return both.select(F.col("a.name").alias("name"), *(v.alias(k) for k, v in c.items()), impact(c).alias("impact")).where("impact IS NOT NULL")


def compatible(a: str, b: str) -> Column:
    """Whether callers of signature ``a`` can call ``b``: arity, return type and async agree, and types agree or one is open."""
    fits = F.forall(F.zip_with(_types(a), _types(b), lambda x, y: (x == y) | x.isin(*WILD) | y.isin(*WILD)), lambda ok: ok)
    return (F.size(f"{a}.params") == F.size(f"{b}.params")) & fits & F.col(f"{a}.return_type").eqNullSafe(F.col(f"{b}.return_type")) & F.col(f"{a}.is_async").eqNullSafe(F.col(f"{b}.is_async"))


def first_by_shape(signatures: DataFrame, arity: int | None = None, return_type: str | None = None, is_async: bool | None = None) -> DataFrame:
    """The first name, in order of names, with this arity, return type and async flag; what isn't given isn't asked."""
    for column, value in ((F.size("params"), arity), (F.col("return_type"), return_type), (F.col("is_async"), is_async)):
        signatures = signatures if value is None else signatures.where(column == value)
    return signatures.select("name").orderBy("name").limit(1)


def numbered(signatures: DataFrame, by: list[str]) -> DataFrame:
    """Repeated names get ``_1``, ``_2`` ... from the second on, in the order of ``by``."""
    n = F.row_number().over(Window.partitionBy("name").orderBy(*by)) - 1
    return signatures.withColumn("n", n).withColumn("name", F.when(F.col("n") > 0, F.concat("name", F.lit("_"), "n")).otherwise(F.col("name"))).drop("n")


def contracts_equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, same``: whether contract rows of one key agree in all columns, whatever their order; a key on one side differs."""
    columns = [c for c in a.columns if c != key]
    body = lambda df, name: df.select(key, F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))).alias("row")).groupBy(key).agg(F.array_sort(F.collect_set("row")).alias(name))
    return body(a, "x").join(body(b, "y"), key, "full_outer").select(key, F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))
