"""Queries of the column functions: text, names, paths, rules, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.functions import paths, rules, text

from .catalogue import ENT, fixture, part_entities, query, read

_STRIPPED = r"regexp_replace(lower(text), '[^a-zа-яё0-9_]+', ' ', 'g')"


@query(f"SELECT doc_id, array_to_string(list_filter(string_split({_STRIPPED}, ' '), lambda t: length(t) > 1), ' ') AS tokens FROM documents")
def tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT id, concat_ws(' ', name, module, type) AS entity_text FROM {ENT}")
def entity_text(spark, sf_dir):
    return part_entities(spark, sf_dir).select("id", text.entity_text(F.col("name"), F.col("module"), F.col("type")).alias("entity_text"))


@query(f"""WITH n AS (SELECT id, replace(lower(name), ' ', '_') AS name FROM {ENT}),
k AS (SELECT id, unnest(list_concat([name[1:i] FOR i IN range(2, least(length(name), 10) + 1)], list_filter(string_split(name, '_'), lambda p: length(p) > 1))) AS key FROM n)
SELECT key, count(DISTINCT id) AS entities, min(id) AS first_id FROM k GROUP BY key""")
def inverted_index(spark, sf_dir):
    keys = part_entities(spark, sf_dir).select("id", F.explode(text.index_keys(F.replace(F.col("name"), F.lit(" "), F.lit("_")))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("entities"), F.min("id").alias("first_id"))


_SECRETS = "|".join(rules.SECRET_FORMS).replace("'", "''")


@query(
    rf"""SELECT page_id, contains(html, 'eval(') OR contains(html, 'eval (') AS has_eval, contains(html, 'process.env') AS has_process_env,
contains(html, 'exec(') OR contains(html, 'exec (') OR contains(html, 'execSync(') AS has_exec,
regexp_matches(lower(html), '(^|[^a-z0-9_])(password|passwd|pwd|secret|token|api[_-]?key)([^a-z0-9_]|$)') AS has_password, regexp_matches(html, '{_SECRETS}') AS has_sensitive FROM pages"""
)
def page_security_flags(spark, sf_dir):
    flags = rules.security_flags(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", *(c.alias(name) for name, c in flags.items()))


_ISSUES = [("eval", "error", 9, "contains(text, 'eval(')"), ("exec", "warning", 7, "contains(text, 'exec(''') OR contains(text, 'exec(`')"), ("console.log", "warning", 5, "contains(text, 'console.log')")]
_ISSUES += [(f"hard-coded {name}", "warning", 8, f"regexp_matches(lower(text), '{pattern}[ ]*=[ ]*[''\"][^''\"]+[''\"]')") for name, pattern in rules.SECRET_NAMES]
_ISSUE_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, '{k}' AS kind, {s}::INT AS severity, {str(r == 'console.log').lower()} AS fixable FROM documents WHERE {c}" for r, k, s, c in _ISSUES)
_ISSUE_ROWS += " UNION ALL SELECT doc_id, 'large file', 'warning', 4, false FROM documents WHERE len(string_split(text, chr(10))) > 1000"
_LOOPS = "list_transform(string_split(text, chr(10)), lambda x: contains(x, 'for') OR contains(x, 'while'))"
_ISSUE_ROWS += f" UNION ALL SELECT doc_id, 'nested loops', 'warning', 6, false FROM (SELECT doc_id, {_LOOPS} AS f FROM documents) WHERE len([i FOR i IN range(1, len(f) - 1) IF f[i] AND f[i + 1]]) > 0"
_ISSUE_ROWS += " UNION ALL " + " UNION ALL ".join(rf"SELECT doc_id, 'unbalanced {name}', 'error', 8, false FROM documents WHERE len(regexp_extract_all(text, '\{a}')) <> len(regexp_extract_all(text, '\{b}'))" for a, b, name in (("{", "}", "braces"), ("(", ")", "parentheses"), ("[", "]", "brackets")))


def document_issues_of(spark, sf_dir):
    t = F.col("text")
    every = F.concat(rules.security_issues(t), rules.performance_issues(t), rules.syntax_issues(t))
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(every).alias("i")).select("doc_id", "i.*")


@query(_ISSUE_ROWS)
def document_issues(spark, sf_dir):
    return document_issues_of(spark, sf_dir)


@query(f"SELECT count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'warning') AS warnings, count(*) FILTER (kind = 'info') AS info, count(*) FILTER (fixable) AS fixable, count(*) FILTER (kind = 'error') = 0 AS passed FROM ({_ISSUE_ROWS})")
def issue_totals(spark, sf_dir):
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return document_issues_of(spark, sf_dir).agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("info"), F.count_if("fixable").alias("fixable"), (n("error") == 0).alias("passed"))


_NAMES = """(SELECT c_custkey AS id, c_mktsegment AS name, 'function' AS kind, 'number' AS returns, false AS exported FROM customer
UNION ALL SELECT c_custkey, c_name || c_name || c_mktsegment, 'function', 'number', false FROM customer
UNION ALL SELECT c_custkey, 'get' || c_mktsegment, 'function', CASE WHEN c_acctbal < 0 THEN 'boolean' ELSE 'number' END, false FROM customer
UNION ALL SELECT event_id, event_type, 'variable', 'any', value > 20 FROM events UNION ALL SELECT event_id, 'data', 'variable', 'any', value > 20 FROM events)"""


@query(
    f"""SELECT id, name, 'function named like a constant' AS rule, 2::INT AS severity FROM {_NAMES} WHERE kind = 'function' AND upper(name) = name AND length(name) > 2 AND NOT contains(name, '_')
UNION ALL SELECT id, name, 'long name', 3 FROM {_NAMES} WHERE kind = 'function' AND length(name) > 40
UNION ALL SELECT id, name, 'getter of a boolean', 2 FROM {_NAMES} WHERE kind = 'function' AND starts_with(name, 'get') AND returns = 'boolean'
UNION ALL SELECT id, name, 'common name', 2 FROM {_NAMES} WHERE kind = 'variable' AND name IN ({", ".join(repr(n) for n in rules.COMMON_NAMES)}) AND NOT exported"""
)
def naming_issues(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    row = lambda df, i, name, kind, returns, exported: df.select(F.col(i).alias("id"), name.alias("name"), F.lit(kind).alias("kind"), returns.alias("returns"), exported.alias("exported"))
    segment, events, no = F.col("c_mktsegment"), read(spark, sf_dir, "events"), F.lit(False)
    names = row(customers, "c_custkey", segment, "function", F.lit("number"), no)
    names = names.union(row(customers, "c_custkey", F.concat("c_name", "c_name", segment), "function", F.lit("number"), no))
    names = names.union(row(customers, "c_custkey", F.concat(F.lit("get"), segment), "function", F.when(F.col("c_acctbal") < 0, "boolean").otherwise("number"), no))
    for name in (F.col("event_type"), F.lit("data")):
        names = names.union(row(events, "event_id", name, "variable", F.lit("any"), F.col("value") > 20))
    found = names.select("id", "name", F.explode(rules.naming_issues(F.col("name"), F.col("kind"), F.col("returns"), F.col("exported"))).alias("i"))
    return found.select("id", "name", "i.rule", "i.severity")


@query(r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '([A-Za-z0-9_]+)[ \t\r\n]*\(', 1))), ',') AS calls FROM pages")
def calls_in_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(text.calls(F.col("html")), ",").alias("calls"))


@query(f"""WITH u AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '([a-zA-Z_$][a-zA-Z0-9_$]*)', 1))) AS name FROM pages)
SELECT page_id, count(*) AS n_names, min(name) AS first_name, max(name) AS last_name FROM u WHERE name NOT IN ({", ".join(repr(w) for w in text.RESERVED)}) GROUP BY page_id""")
def used_identifiers(spark, sf_dir):
    names = text.identifiers(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", names.alias("n")).select("page_id", F.size("n").cast("long").alias("n_names"), F.array_min("n").alias("first_name"), F.array_max("n").alias("last_name"))


_EXT = r"regexp_extract(string_split(url, '/')[-1], '[^.](\.[^.]*)$', 1)"
_COUNT = lambda w: rf"len(regexp_extract_all(html, '\b{w}\b'))"


@query(rf"""WITH p AS (SELECT page_id, {_EXT} AS ext, regexp_matches(html, '(?m)^[ \t]*(import|export)[ \t\r\n]') AS esm,
regexp_matches(html, '(^|[^A-Za-z0-9_])require[ ]*\(') OR regexp_matches(html, '(^|[^A-Za-z0-9_])(module\.exports|exports\.)[ ]*=') AS req, {_COUNT('import')} + {_COUNT('export')} > {_COUNT('require')} AS more FROM pages)
SELECT page_id, CASE WHEN ext = '.mjs' THEN 'esm' WHEN ext = '.cjs' THEN 'cjs' WHEN esm AND NOT req THEN 'esm' WHEN req AND NOT esm THEN 'cjs' WHEN esm AND more THEN 'esm' WHEN esm THEN 'cjs' WHEN page_id % 3 = 0 THEN 'esm' WHEN page_id % 3 = 1 THEN 'cjs' WHEN ext IN ('.ts', '.tsx', '.jsx') THEN 'esm' ELSE 'cjs' END AS type,
CASE WHEN ext IN ('.mjs', '.cjs') OR esm <> req THEN 'high' WHEN esm THEN 'medium' WHEN page_id % 3 < 2 THEN 'high' WHEN ext IN ('.ts', '.tsx', '.jsx', '.js') THEN 'medium' ELSE 'low' END AS confidence FROM p""")
def module_types(spark, sf_dir):
    package = F.when(F.col("page_id") % 3 == 0, "module").when(F.col("page_id") % 3 == 1, "commonjs")
    return read(spark, sf_dir, "pages").select("page_id", rules.module_type(F.col("url"), F.col("html"), package).alias("t")).select("page_id", "t.*")


_BASE = "string_split(url, '/')[-1]"


@query(rf"""SELECT page_id, {_BASE} AS base_name, {_EXT} AS extension, {_BASE}[1:length({_BASE}) - length({_EXT})] AS without_extension, regexp_extract(url, '^(.*)/[^/]*$', 1) AS directory,
replace(url, '/', '\') AS windows, replace(replace(url, '/', '\'), '\', '/') AS unix,
CASE WHEN length(url) <= 30 THEN url ELSE string_split(url, '/')[1] || '/.../' || string_split(url, '/')[-2] || '/' || string_split(url, '/')[-1] END AS short,
regexp_matches(url, '^/[^/]') AS absolute, length(url) <= 260 AND NOT regexp_matches(url, '[<>:"|?*]') AS valid_windows FROM pages""")
def path_functions(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", paths.base_name(url).alias("base_name"), paths.extension(url).alias("extension"), paths.without_extension(url).alias("without_extension"), paths.directory(url).alias("directory"),
        paths.to_windows(url).alias("windows"), paths.to_unix(paths.to_windows(url)).alias("unix"), paths.shortened(url, 30).alias("short"), paths.is_absolute(url).alias("absolute"), paths.is_valid_windows(url).alias("valid_windows"),
    )


_PATH = "'src/' || replace(lower(p_brand), '#', '/') || '/' || replace(p_name, ' ', '/') || '/' || p_partkey || '.ts'"
_FOLDER = "'src/' || replace(lower(p_brand), '#', '/') || '/' || replace(p_name, ' ', '/')"


@query(f"""WITH p AS (SELECT p_partkey, string_split({_FOLDER}, '/') AS a, string_split('src/brand/7/blue', '/') AS b FROM part),
s AS (SELECT p_partkey, a, b, coalesce(list_max([i FOR i IN range(0, 5) IF a[1:i] = b[1:i] AND i <= len(a)]), 0) AS same FROM p)
SELECT p_partkey, CASE WHEN len(a) > same THEN '' ELSE './' END || array_to_string(list_concat(['..' FOR i IN range(same, len(a))], b[same + 1:], ['index.ts']), '/') AS import_path FROM s""")
def import_paths(spark, sf_dir):
    path = F.concat(F.lit("src/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("/")), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    return read(spark, sf_dir, "part").select("p_partkey", paths.import_path(path, F.lit("src/brand/7/blue/index.ts")).alias("import_path"))


@query(r"""SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html_md5, regexp_replace(url, '([|*_\[\]()#+.!-])', '\\\1', 'g') AS markdown FROM pages""")
def escaped_texts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("html_md5"), text.escape_markdown(F.col("url")).alias("markdown"))


@query("WITH s AS (SELECT doc_id, strlen(text) * (1 + doc_id % 2000) AS n FROM documents) SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KB', floor(n * 100 / 1024.0::DOUBLE + 0.5) / 100) ELSE printf('%.2f MB', floor(n * 100 / 1048576.0::DOUBLE + 0.5) / 100) END AS size FROM s")
def file_sizes(spark, sf_dir):
    n = F.octet_length("text") * (1 + F.col("doc_id") % 2000)
    return read(spark, sf_dir, "documents").select("doc_id", text.file_size(n).alias("size"))


@query("""WITH n AS (SELECT DISTINCT v || s AS name FROM (SELECT unnest(['get', 'handle', 'on', 'process', 'compute', '']) AS v), (SELECT DISTINCT upper(p_type[1:1]) || lower(p_type[2:]) AS s FROM part UNION ALL SELECT ''))
SELECT name, CASE WHEN rest = '' THEN 'module' ELSE lower(rest[1:1]) || rest[2:] END || 'Module' AS module FROM (SELECT name, regexp_replace(name, '^(get|set|is|has|use|fetch|handle|on|save|load|create|process)', '') AS rest FROM n)""")
def cluster_names(spark, sf_dir):
    types = read(spark, sf_dir, "part").select(F.initcap("p_type").alias("s")).distinct()
    types = types.union(types.limit(1).select(F.lit("")))
    names = types.select(F.explode(F.array(*map(F.lit, ("get", "handle", "on", "process", "compute", "")))).alias("v"), "s").select(F.concat("v", "s").alias("name")).distinct()
    return names.select("name", text.cluster_name(F.col("name")).alias("module"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(path, '\.tsx?$') THEN 'typescript' WHEN path LIKE '%.vue' THEN 'vue' WHEN path LIKE '%.jsx' THEN 'jsx' ELSE 'javascript' END AS language FROM (SELECT page_id, regexp_extract(url, '^[^?#]*', 0) || ['.ts', '.tsx', '.vue', '.jsx', '.js', ''][page_id % 6 + 1] AS path FROM pages)")
def languages_by_extension(spark, sf_dir):
    path = F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.get(F.array(*map(F.lit, (".ts", ".tsx", ".vue", ".jsx", ".js", ""))), (F.col("page_id") % 6).cast("int")))
    return read(spark, sf_dir, "pages").select("page_id", paths.language(path).alias("language"))


@query(r"WITH d AS (SELECT doc_id, regexp_replace(text, '[ \t\r\n]', '', 'g') AS t, trim(regexp_replace(regexp_replace(text, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g')) AS c FROM documents) SELECT a.doc_id, a.t = b.t AS but_blanks, a.c = b.c AS but_comments FROM d a JOIN d b ON b.doc_id = a.doc_id + 1")
def texts_equal_but(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    later = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(later, "doc_id").select("doc_id", text.same_but_blanks(F.col("text"), F.col("other")).alias("but_blanks"), text.same_but_comments(F.col("text"), F.col("other")).alias("but_comments"))


@query("SELECT p_brand, '[' || repeat('█', k::BIGINT) || repeat('░', 20 - k::BIGINT) || ']' AS bar FROM (SELECT p_brand, round(count(*) * 200.0::DOUBLE / (SELECT count(*) FROM part))::INT AS k FROM part GROUP BY p_brand)")
def progress_bars(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    n = parts.groupBy("p_brand").agg((F.count("*") * 10).alias("n"))
    total = parts.agg(F.count("*").alias("total"))
    return n.join(F.broadcast(total)).select("p_brand", text.progress_bar(F.col("n"), F.col("total")).alias("bar"))  # one row


_HREFS = "(SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages UNION ALL SELECT page_id, unnest(['react', '@/a', '#b', '~c', './d', '../e', 'lodash/fp', 'C:/x']) FROM pages)"


@query(rf"SELECT page_id, target, NOT regexp_matches(target, '^[@#~./]') AND NOT regexp_matches(target, '^[a-zA-Z]:[\\/]') AS external, CASE WHEN regexp_matches(target, '^[@#]') THEN 1 WHEN starts_with(target, '.') THEN 2 ELSE 0 END::INT AS class FROM {_HREFS}")
def external_targets(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    hrefs = pages.select("page_id", F.explode(F.concat(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), F.array(*map(F.lit, ("react", "@/a", "#b", "~c", "./d", "../e", "lodash/fp", "C:/x"))))).alias("target"))
    return hrefs.select("page_id", "target", paths.is_external(F.col("target")).alias("external"), paths.import_class(F.col("target")).alias("class"))


@query(f"SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN regexp_matches(target, '^[@#]') THEN 1 WHEN starts_with(target, '.') THEN 2 ELSE 0 END, target)::INT AS place FROM (SELECT DISTINCT * FROM {_HREFS})")
def import_order(spark, sf_dir):
    from pyspark.sql import Window

    hrefs = external_targets(spark, sf_dir).select("page_id", "target", "class").distinct()
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("class", "target"))
    return hrefs.select("page_id", "target", place.alias("place"))


@query(f"SELECT id, name, module FROM {ENT} WHERE type = 'ECONOMY'")
def entities_by_type(spark, sf_dir):
    return part_entities(spark, sf_dir).where("type = 'ECONOMY'").select("id", "name", "module")


@query(f"SELECT id, name, type FROM {ENT} WHERE module = 'Brand#7'")
def entities_by_module(spark, sf_dir):
    return part_entities(spark, sf_dir).where("module = 'Brand#7'").select("id", "name", "type")


@query(f"SELECT * FROM {ENT} WHERE id = 42")
def entity_by_id(spark, sf_dir):
    return part_entities(spark, sf_dir).where("id = 42")


@query(r"SELECT doc_id, NOT regexp_matches(text, '" + "|".join(rules.UNMODELLED) + "') AS can_be_modelled FROM documents")
def modelled_bodies(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", rules.can_be_modelled(F.col("text")).alias("can_be_modelled"))


@query(f"SELECT o_orderkey, o_orderkey IN ({', '.join(map(str, rules.FIXABLE_CODES))}) AS fixable FROM orders")
def fixable_codes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", rules.is_fixable(F.col("o_orderkey")).alias("fixable"))


_CONF = "SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, 1 - l_discount * 5 AS confidence, l_returnflag = 'N' AS equal, CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS differences FROM lineitem"


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, equal AND confidence > 0.7 AS equivalent, confidence < 0.85 OR differences > 0 AS review, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS level FROM ({_CONF})")
def equivalence_verdicts(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (1 - F.col("l_discount") * 5).alias("confidence"), (F.col("l_returnflag") == "N").alias("equal"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("differences")).distinct()
    c = F.col("confidence")
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", rules.is_equivalent(F.col("equal"), c).alias("equivalent"), rules.needs_review(c, F.col("differences")).alias("review"), text.confidence_level(c).alias("level"))


_KINDS = [*text.ENTITY_COLOURS, "other"]


@fixture("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{text.ENTITY_COLOURS.get(k, text.OTHER_COLOUR)}', '{text.ENTITY_ICONS.get(k, text.OTHER_ICON)}')" for k in _KINDS) + ") t(kind, colour, icon)")
def entity_styles(spark, sf_dir):
    kind = F.col("kind")
    return spark.createDataFrame([(k,) for k in _KINDS], "kind string").select(kind, text.entity_colour(kind).alias("colour"), text.entity_icon(kind).alias("icon"))


_EXPRESSIONS = {
    "a + b": ("a b", "int"), "a && !b": ("a b", "bool"), "true": ("", "bool"), "x1": ("x1", "int"), "-4": ("", "int"), "'s'": ("s", "string"), "f(y)": ("f y", "unknown"), "a => a >= 0": ("a", "bool"), "n % 2": ("n", "int"),
}


@fixture("SELECT * FROM (VALUES " + ", ".join(f"""('{e.replace("'", "''")}', '{v}', '{t}')""" for e, (v, t) in _EXPRESSIONS.items()) + ") t(expression, variables, type)")
def expression_facts(spark, sf_dir):
    e = F.col("expression")
    return spark.createDataFrame([(x,) for x in _EXPRESSIONS], "expression string").select(e, F.array_join(text.expression_variables(e), " ").alias("variables"), text.expression_type(e).alias("type"))


_HANDLERS = [("addEventListener", "click", False, True, "click"), ("onClick", None, True, True, "click"), ("emit", "update", False, True, "update"), ("render", "x", False, False, "x"), ("class", None, True, False, None)]


@fixture("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(h).lower()}, {'NULL' if e is None else repr(e)})" for n, _, _, h, e in _HANDLERS) + ") t(name, handler, event)")
def event_handlers(spark, sf_dir):
    rows = spark.createDataFrame([h[:3] for h in _HANDLERS], "name string, argument string, attribute boolean")
    n, a = F.col("name"), F.col("attribute")
    return rows.select("name", text.is_event_handler(n, a).alias("handler"), text.event_type(n, F.col("argument"), a).alias("event"))


_CONTRACTS = {"number": "int", "boolean": "bool", "string[]": "string", "Foo": "int", "bigint": "int"}


@fixture("SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{t}')" for d, t in _CONTRACTS.items()) + ") t(declared, sort)")
def contract_types(spark, sf_dir):
    return spark.createDataFrame([(d,) for d in _CONTRACTS], "declared string").select("declared", text.contract_type(F.col("declared")).alias("sort"))


_CHANGES = {"name": "high", "operator": "high", "leftKind": "medium", "methodCount": "medium", "text": "low"}


@fixture("SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{t}')" for d, t in _CHANGES.items()) + ") t(field, impact)")
def change_impacts(spark, sf_dir):
    return spark.createDataFrame([(d,) for d in _CHANGES], "field string").select("field", text.change_impact(F.col("field")).alias("impact"))


_GUARDS = {"if (a !== null) { a": True, "if (b && b.c) { b": True, "if (b && d.c) { b": False, "x?.y + ": True, "return z": False}


@fixture("SELECT * FROM (VALUES " + ", ".join(f"('{d}', {str(t).lower()})" for d, t in _GUARDS.items()) + ") t(before, checked)")
def null_checks(spark, sf_dir):
    return spark.createDataFrame([(d,) for d in _GUARDS], "before string").select("before", text.null_checked(F.col("before")).alias("checked"))


_VALUES = [("MAX_SIZE", "other", [], True), ("appConfig", "other", [], False), ("APP_CONFIG", "other", [], True), ("pageContext", "other", [], True), ("limit", "literal", [], True), ("word", "regex", [], True), ("list", "array", ["#main", "b"], True), ("list", "array", ["a", "b"], False), ("make", "other", [], False)]


@fixture("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {str(k).lower()})" for i, (n, _, _, k) in enumerate(_VALUES)) + ") t(id, name, kept)")
def preserved_values(spark, sf_dir):
    rows = spark.createDataFrame([(i, *v[:3]) for i, v in enumerate(_VALUES)], "id int, name string, kind string, elements array<string>")
    return rows.select("id", "name", rules.keeps_value(F.col("name"), F.col("kind"), F.col("elements")).alias("kept"))
