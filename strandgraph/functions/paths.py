"""Column functions over paths and import specifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that no file may have on some systems. Fixed values.
DEVICE_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
SOURCE_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".vue", ".mjs")


def to_unix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def to_windows(path: Column) -> Column:
    return F.when(path.rlike(r"^[a-zA-Z]:\\"), path).otherwise(F.replace(path, F.lit("/"), F.lit("\\")))


def parts(path: Column) -> Column:
    return F.split(to_unix(path), "/", -1)


def base_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(path: Column) -> Column:
    """With its dot; empty for names without one and for those that only begin with one."""
    return F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1)


def without_extension(path: Column) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def directory(path: Column) -> Column:
    return F.regexp_extract(to_unix(path), "^(.*)/[^/]*$", 1)


def display(path: Column) -> Column:
    """With forward slashes; of a path that climbs out, only what is below."""
    unix = to_unix(path)
    kept = F.array_join(F.filter(F.split(unix, "/", -1), lambda p: ~p.isin("..", ".")), "/")
    return F.when(unix.startswith("../") & (kept != ""), kept).otherwise(unix)


def shortened(path: Column, most: int = 80) -> Column:
    """The first and the last two parts of a path longer than ``most``, dots between them."""
    shown = display(path)
    p = F.split(shown, "/", -1)
    short = F.concat(F.when(F.element_at(p, 1) == "", "").otherwise(F.concat(F.element_at(p, 1), F.lit("/.../"))), F.array_join(F.slice(p, -2, 2), "/"))
    return F.when((F.length(shown) <= most) | (F.size(p) <= 2), shown).otherwise(short)


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^[a-zA-Z]:\\") | path.rlike("^/[^/]") | path.rlike(r"^\\\\[^\\]+\\")


def is_valid_windows(path: Column) -> Column:
    return F.coalesce((path != "") & (F.length(path) <= 260) & ~path.rlike('[<>:"|?*]') & ~F.upper(base_name(path)).isin(*DEVICE_NAMES), F.lit(False))


def relative(source: Column, target: Column) -> Column:
    """The path from a file's folder to another file."""
    folder = lambda p: F.filter(F.split(directory(p), "/"), lambda x: x != "")
    a, b = folder(source), folder(target)
    same = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)), lambda ok: ok)) - 1
    up = F.array_repeat(F.lit(".."), (F.size(a) - same).cast("int"))
    down = F.slice(b, same + 1, F.size(b))
    return F.array_join(F.concat(up, down, F.array(base_name(target))), "/")


def import_path(source: Column, target: Column) -> Column:
    """How a file imports another: always begins with a dot."""
    found = relative(source, target)
    return F.when(found.startswith("."), found).otherwise(F.concat(F.lit("./"), found))


def collapsed(path: Column) -> Column:
    """Without ``.`` parts, and ``..`` taken off with the part before it."""
    step = lambda out, p: F.when(p.isin("", "."), out).when((p == "..") & (F.size(out) > 0) & (F.element_at(F.concat(out, F.array(F.lit(""))), F.greatest(F.size(out), F.lit(1))) != ".."), F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def is_external(specifier: Column) -> Column:
    """A package: not an alias (@, #, ~), not relative, not absolute."""
    return ~specifier.rlike(r"^[@#~./]") & ~specifier.rlike(r"^[a-zA-Z]:[\\/]")


def import_class(specifier: Column) -> Column:
    """0 external, 1 alias, 2 internal: the order of a tidy import list."""
    return F.when(specifier.rlike("^[@#]"), 1).when(specifier.startswith("."), 2).otherwise(0)


def language(path: Column) -> Column:
    return F.when(path.rlike(r"\.tsx?$"), "typescript").when(path.endswith(".vue"), "vue").when(path.endswith(".jsx"), "jsx").otherwise("javascript")
