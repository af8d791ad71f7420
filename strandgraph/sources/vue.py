"""Single-file components: their blocks, and the facets of script and template, by patterns over the text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = re.compile(r"<(script|template|style)\b([^>]*)>(.*?)</\1>", re.S)
#: Composables of the framework and its router and store. Fixed values.
KNOWN_COMPOSABLES = ("useRoute", "useRouter", "useStore", "useI18n", "useHead", "useFetch", "useAsyncData", "useNuxtApp", "useState", "useCookie")
DIRECTIVES = "v-if v-else-if v-else v-for v-show v-model v-bind v-on v-html v-text v-slot v-once v-memo v-cloak v-pre".split()
ADVICE = (("complexity", 50, "split the template"), ("n_props", 10, "group the props"), ("n_composables", 5, "merge composables"), ("lines", 300, "split the component"))


def script_only(content: str) -> str:
    """The content with everything but its scripts blanked, so that places and lines stay."""
    kept = [(m.start(3), m.end(3)) for m in _BLOCK.finditer(content) if m.group(1) == "script"]
    out, at = [], 0
    for a, b in kept:
        out += [re.sub(r"[^\n]", " ", content[at:a]), content[a:b]]
        at = b
    return "".join([*out, re.sub(r"[^\n]", " ", content[at:])])


def _block(content: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(content, pattern, group)


def blocks(files: DataFrame) -> DataFrame:
    """``path, script, script_setup, template, styles, custom_blocks, is_setup, is_ts`` of each component."""
    c = F.col("content")
    setup = _block(c, r"(?s)<script\b[^>]*\bsetup\b[^>]*>(.*?)</script>", 1)
    plain = F.regexp_replace(c, r"(?s)<script\b[^>]*\bsetup\b[^>]*>.*?</script>", "")
    return files.select(
        "path", _block(plain, r"(?s)<script\b[^>]*>(.*?)</script>", 1).alias("script"), setup.alias("script_setup"), _block(c, r"(?s)<template\b[^>]*>(.*)</template>", 1).alias("template"),
        F.regexp_extract_all(c, F.lit(r"(?s)<style\b[^>]*>(.*?)</style>"), F.lit(1)).alias("styles"),
        F.array_distinct(F.array_except(F.regexp_extract_all(c, F.lit("(?m)^<([a-zA-Z][a-zA-Z0-9-]*)"), F.lit(1)), F.array(F.lit("script"), F.lit("template"), F.lit("style")))).alias("custom_blocks"),
        c.rlike(r"<script\b[^>]*\bsetup\b").alias("is_setup"), c.rlike(r"<script\b[^>]*\blang=[\"']tsx?[\"']").alias("is_ts"),
    )


def _script(b: DataFrame) -> Column:
    return F.concat_ws("\n", "script_setup", "script")


def props(component_blocks: DataFrame) -> DataFrame:
    """``path, prop, type, required, default``: of a type argument of defineProps, of its object, and of the options' object."""
    s = _script(component_blocks)
    generic = F.regexp_extract(s, r"(?s)defineProps<\s*\{(.*?)\}\s*>", 1)
    listed_ = F.regexp_extract(s, r"(?s)(?:defineProps\(|props:)\s*\[([^\]]*)\]", 1)
    nested = F.regexp_extract(s, r"(?s)(?:defineProps\(|props:)\s*\{((?:[^{}]|\{[^{}]*\})*)\}", 1)
    defaults = F.regexp_extract(s, r"(?s)withDefaults\(.*?>\s*\(\)\s*,\s*\{(.*?)\}\s*\)", 1)
    rows = component_blocks.select("path", generic.alias("generic"), listed_.alias("listed"), nested.alias("nested"), defaults.alias("defaults"))
    typed = rows.select("path", "defaults", F.explode(F.regexp_extract_all("generic", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*\??\s*:\s*[^;,\n]+)"), F.lit(1))).alias("m"))
    typed = typed.select("path", F.regexp_extract("m", r"^([A-Za-z0-9_$]+)", 1).alias("prop"), F.trim(F.regexp_extract("m", r":\s*(.*)$", 1)).alias("type"), (~F.col("m").rlike(r"^[A-Za-z0-9_$]+\?")).alias("required"), "defaults")
    typed = typed.withColumn("d", F.expr(r"regexp_extract(defaults, concat('(?:^|[\\s,{])', prop, '\\s*:\\s*([^,\\n}]+)'), 1)"))
    typed = typed.select("path", "prop", "type", "required", F.when(F.col("d") != "", F.trim("d")).alias("default"))
    names = rows.select("path", F.explode(F.regexp_extract_all("listed", F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1))).alias("prop")).select("path", "prop", F.lit("any").alias("type"), F.lit(False).alias("required"), F.lit(None).cast("string").alias("default"))
    objects = rows.select("path", F.explode(F.regexp_extract_all("nested", F.lit(r"(?s)([A-Za-z_$][A-Za-z0-9_$]*\s*:\s*(?:\{[^{}]*\}|\[[^\]]*\]|[A-Za-z]+))"), F.lit(1))).alias("m"))
    of = F.regexp_extract("m", r"(?s):\s*\{.*?type\s*:\s*(\[[^\]]*\]|[A-Za-z]+)", 1)
    objects = objects.select("path", F.regexp_extract("m", "^([A-Za-z0-9_$]+)", 1).alias("prop"), F.when(of != "", of).otherwise(F.trim(F.regexp_extract("m", r"(?s):\s*(\[[^\]]*\]|[A-Za-z]+)", 1))).alias("type"), F.col("m").rlike(r"required\s*:\s*true").alias("required"), F.nullif(F.trim(F.regexp_extract("m", r"default\s*:\s*([^,}\n]+)", 1)), F.lit("")).alias("default"))
    return typed.union(names).union(objects).dropDuplicates(["path", "prop"])


def emits(component_blocks: DataFrame) -> DataFrame:
    """``path, event``: events that are declared or raised."""
    s = _script(component_blocks)
    generic = F.regexp_extract(s, r"(?s)defineEmits<\s*\{(.*?)\}\s*>", 1)
    names = F.regexp_extract_all(generic, F.lit(r"['\"]?([A-Za-z_$][A-Za-z0-9_$:-]*)['\"]?\s*(?:\(|:\s*\[)"), F.lit(1))
    called = F.regexp_extract_all(generic, F.lit(r"\(\s*e\s*:\s*['\"]([^'\"]+)['\"]"), F.lit(1))
    listed_ = F.regexp_extract_all(F.regexp_extract(s, r"(?s)(?:defineEmits\(|emits:)\s*\[([^\]]*)\]", 1), F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1))
    raised = F.regexp_extract_all(s, F.lit(r"\$?emit\(\s*['\"]([^'\"]+)['\"]"), F.lit(1))
    return component_blocks.select("path", F.explode(F.array_distinct(F.concat(names, called, listed_, raised))).alias("event"))


def exposes(component_blocks: DataFrame) -> DataFrame:
    """``path, name``: what defineExpose or the options' expose names."""
    s = _script(component_blocks)
    inside = F.concat_ws(",", F.regexp_extract(s, r"(?s)defineExpose\(\s*\{(.*?)\}\s*\)", 1), F.regexp_extract(s, r"(?s)expose:\s*\[([^\]]*)\]", 1))
    return component_blocks.select("path", F.explode(F.array_distinct(F.regexp_extract_all(inside, F.lit(r"(?:^|[,{\s'\"])([A-Za-z_$][A-Za-z0-9_$]*)\s*(?=[,:'\"]|$|\s*$)"), F.lit(1)))).alias("name"))


def composables(component_blocks: DataFrame) -> DataFrame:
    """``path, name, known``: calls of use...; known ones are the framework's."""
    found = F.array_distinct(F.regexp_extract_all(_script(component_blocks), F.lit(r"(?:^|[^A-Za-z0-9_$.])(use[A-Z][A-Za-z0-9_]*)\s*\("), F.lit(1)))
    return component_blocks.select("path", F.explode(found).alias("name")).select("path", "name", F.col("name").isin(*KNOWN_COMPOSABLES).alias("known"))


def imports(component_blocks: DataFrame) -> DataFrame:
    """``path, source, names``."""
    found = F.regexp_extract_all(_script(component_blocks), F.lit(r"(import\s+[^;'\"]*?from\s+['\"][^'\"]+['\"])"), F.lit(1))
    rows = component_blocks.select("path", F.explode(found).alias("m"))
    return rows.select("path", F.regexp_extract("m", r"from\s+['\"]([^'\"]+)['\"]", 1).alias("source"), F.trim(F.regexp_extract("m", r"(?s)import\s+(?:type\s+)?(.*?)\s+from", 1)).alias("names"))


def template_facets(texts: DataFrame, key: str, template: str) -> DataFrame:
    """``key, complexity, tags, expressions, root_tags, slots, directives, events`` of markup; lists are sorted.

    Complexity is the number of tags, closing ones too, plus that of expressions in double braces.
    """
    t = F.coalesce(F.col(template), F.lit(""))
    every = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1))))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    tags, expressions = count("<[^>]+>"), count(r"\{\{[^}]*\}\}")
    slots = every(r"<slot[^>]*[ ]name=\"([^\"]+)\"")
    slots = F.when(t.rlike("<slot[ ]*/?>"), F.array_sort(F.array_union(slots, F.array(F.lit("default"))))).otherwise(slots)
    return texts.select(key, (tags + expressions).alias("complexity"), tags.alias("tags"), expressions.alias("expressions"), F.regexp_extract(t, r"^\s*(?:<!--.*?-->\s*)*<([a-zA-Z][a-zA-Z0-9-]*)", 1).alias("root_tag"), slots.alias("slots"), every(r"[ ](v-[a-z-]+)").alias("directives"), every(r"[ ](?:@|v-on:)([a-zA-Z:-]+)").alias("events"))


def functions(component_blocks: DataFrame) -> DataFrame:
    """``path, name``: functions declared in a component's scripts."""
    s = _script(component_blocks)
    found = F.concat(F.regexp_extract_all(s, F.lit(r"function\s+([A-Za-z0-9_$]+)\s*\("), F.lit(1)), F.regexp_extract_all(s, F.lit(r"const\s+([A-Za-z0-9_$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z0-9_$]+)\s*=>"), F.lit(1)))
    return component_blocks.select("path", F.explode(F.array_distinct(found)).alias("name"))


def components(files: DataFrame) -> DataFrame:
    """One row a component: its flags and how much it has of each facet; facets that are missing count 0."""
    b = blocks(files)
    count = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name))
    out = b.select("path", "is_setup", "is_ts", F.size("styles").alias("n_styles")).join(template_facets(b, "path", "template").select("path", "complexity", "root_tag"), "path")
    out = out.join(files.select("path", F.size(F.split("content", "\n", -1)).alias("lines")), "path")
    for df, name in ((props(b), "n_props"), (emits(b), "n_emits"), (composables(b), "n_composables"), (functions(b), "n_functions"), (imports(b), "n_imports")):
        out = out.join(count(df, name), "path", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def with_advice(component_rows: DataFrame) -> DataFrame:
    """``components`` with what their sizes advise."""
    return component_rows.withColumn("advice", F.array_compact(F.array(*(F.when(F.col(c) > n, said) for c, n, said in ADVICE))))


def totals(component_rows: DataFrame) -> DataFrame:
    return component_rows.agg(F.count("*").alias("components"), *(F.sum(c).alias(c.removeprefix("n_")) for c in ("n_functions", "n_composables", "n_imports")))


def report(modules: DataFrame, files: DataFrame) -> DataFrame:
    """``modules`` (path, ...) with the components' facets where a module is one."""
    return modules.join(components(files.where(F.col("path").endswith(".vue"))), "path", "left")
