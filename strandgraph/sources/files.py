"""Files of a project as rows: path, ext, size, lines, content.

A scan goes through Spark's own reader, so a project may lie wherever it can list. Filters on the path alone come before
a file's content is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions import paths

SCRIPTS = (".js", ".jsx", ".ts", ".tsx", ".vue", ".mjs")
MARKUP = (".jsx", ".tsx", ".vue")
#: Folders and files that no scan looks at. Fixed values.
EXCLUDED = ("node_modules", "dist", "build", ".git", "coverage", ".next", ".nuxt", ".cache")
#: Characters beyond which a file is read by patterns only.
LARGE = 500 * 1024


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = SCRIPTS, exclude: tuple[str, ...] = EXCLUDED, max_depth: int | None = None, glob: str | None = None) -> DataFrame:
    """``path, ext, size, lines, content`` of the files under ``root``, whose paths are relative to it.

    ``exclude`` are substrings of the path; ``max_depth`` counts the folders below the root. An empty folder gives no
    rows; nor do files without a byte, which Spark's readers leave out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return shaped(reader.load(root), root, extensions, exclude, max_depth)


def shaped(raw: DataFrame, root: str, extensions: tuple[str, ...], exclude: tuple[str, ...], max_depth: int | None) -> DataFrame:
    full, top = F.regexp_replace("path", "^[a-z]+:/*", "/"), root.rstrip("/") + "/"
    below = F.when(full.startswith(top), F.substring(full, len(top) + 1, 1 << 30)).otherwise(full)
    keep = F.lit(False)
    for e in extensions:
        keep = keep | full.endswith(e)
    for part in exclude:
        keep = keep & ~below.contains(part)
    if max_depth is not None:
        keep = keep & (F.size(F.split(below, "/")) - 1 <= max_depth)
    content = F.decode("content", "UTF-8")
    return raw.where(keep).select(below.alias("path"), paths.extension(below).alias("ext"), F.col("length").alias("size"), F.size(F.split(content, "\n", -1)).alias("lines"), content.alias("content"))


def scan_many(spark: SparkSession, roots: list[str], recursive: bool = True, **how) -> DataFrame:
    """The files of several roots, each path once; without ``recursive`` only those right in a root."""
    found = None
    for root in roots:
        part = scan(spark, root, max_depth=None if recursive else 0, **how).withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "path"))
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["path"])


def is_source(path: Column) -> Column:
    """No declaration, test or specification file."""
    return ~path.rlike(r"\.(d|test|spec)\.tsx?$")


def sources_only(files: DataFrame) -> DataFrame:
    return files.where(is_source(F.col("path")))


def markup_files(files: DataFrame) -> DataFrame:
    """Files that may hold elements: .jsx, .tsx, .vue."""
    return files.where(F.col("ext").isin(*MARKUP))


def is_large(content: Column) -> Column:
    return F.length(content) > LARGE


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``path, config``: the settings file in the closest folder above each file, null if there is none.

    A file's folders are made rows with how far above they are, so this is one hash join on the folder.
    """
    folder = paths.directory(F.col("path"))
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = files.select("path", F.explode(F.array_distinct(above)).alias("folder"))
    held = configs.select(F.col("path").alias("config"), paths.directory(F.col("path")).alias("folder"))
    hits = rows.join(held, "folder").groupBy("path").agg(F.max_by("config", F.struct(F.length("folder"), F.col("config"))).alias("config"))
    return files.select("path").join(hits, "path", "left")


def aliases_of(configs: DataFrame) -> DataFrame:
    """``config, place, alias, target, base_url`` of tsconfig files (path, content), comments and trailing commas taken out; the
    first target of each alias. Files that can't be read give no rows."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"/\*[\s\S]*?\*/", ""), r"(?m)^\s*//.*$", ""), r",(\s*[}\]])", "$1")
    parsed = F.from_json(clean, "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")
    rows = configs.select(F.col("path").alias("config"), parsed.alias("c")).where("c.compilerOptions.paths IS NOT NULL")
    made = rows.select("config", F.coalesce("c.compilerOptions.baseUrl", F.lit(".")).alias("base_url"), F.posexplode(F.map_entries("c.compilerOptions.paths")).alias("place", "e"))
    return made.select("config", "place", F.col("e.key").alias("alias"), F.get("e.value", F.lit(0)).alias("target"), "base_url")


def tree(files: DataFrame) -> DataFrame:
    """``place, line``: the folders and files drawn as a tree, a row a line, folders before what is in them.

    Each path gives a row for itself and one for each folder above; whether a branch is its folder's last one is a window
    over that folder, so nothing but the numbering of lines is ordered as a whole.
    """
    from pyspark.sql import Window

    parts = F.split("path", "/")
    rows = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.slice(parts, F.lit(1), n).alias("p"), (n == F.size(parts)).alias("leaf")))).alias("r")).select("r.p", "r.leaf").distinct()
    last = rows.withColumn("up", F.slice("p", F.lit(1), F.size("p") - 1)).withColumn("last", F.row_number().over(Window.partitionBy("up").orderBy(F.desc("p"))) == 1)
    ends = last.select(F.col("p").alias("q"), F.col("last").alias("q_last"))
    above = last.select("p", "leaf", "last", F.explode(F.when(F.size("p") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda n: F.slice("p", F.lit(1), n))).otherwise(F.array(F.array().cast("array<string>")))).alias("q"))
    bars = above.join(ends, "q", "left").groupBy("p", "leaf", "last").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.size("q") > 0, F.struct(F.size("q").alias("n"), "q_last")))), lambda s: F.when(s["q_last"], "    ").otherwise("│   ")), "").alias("bar"))
    line = F.concat("bar", F.when(F.col("last"), "└── ").otherwise("├── "), F.element_at("p", -1), F.when(F.col("leaf"), "").otherwise("/"))
    return bars.select((F.row_number().over(Window.orderBy("p")) - 1).alias("place"), line.alias("line"))
