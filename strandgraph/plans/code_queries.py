"""Queries of the operators on source code, over the small project whose texts stand in ``project``.

Their SQL states the rows that must come out. These were checked by reading the texts, most of them from an output of the
operators, so they guard against changes more than they are a second opinion.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.operators import clusters, fixers, flow, formal, graph, minify, report, resolve
from strandgraph.sources import code, files, vue
from strandgraph.sources.statements import statements

from .catalogue import fixture, query, read
from .project import FILES, literal
from .project import files as project_files

API, INDEX, TYPES, HELPER, UTIL, CARD, PANEL, OLD = "src/api.ts", "src/index.ts", "src/types.ts", "src/util/helper.js", "src/util/index.ts", "src/ui/Card.jsx", "src/ui/Panel.vue", "src/ui/Old.vue"


def nodes(spark):
    return code.parse(project_files(spark))


def joined(name):
    return F.array_join(name, ",").alias(name)


@fixture(literal("path, ext, lines", [(p, "." + p.rsplit(".", 1)[1], t.count("\n") + 1) for p, t in FILES.items() if p.endswith((".ts", ".vue")) and "/ui/" not in p]))
def project_scan(spark, sf_dir):
    """Files with wanted extensions, without excluded folders and at most two folders deep."""
    raw = project_files(spark).select(F.concat(F.lit("file:/p/"), "path").alias("path"), F.col("size").alias("length"), F.encode("content", "UTF-8").alias("content"))
    return files.shaped(raw, "/p", (".ts", ".vue"), ("/ui/",), 2).select("path", "ext", "lines")


@fixture(literal("path, is_source, is_markup, is_large", [(p, True, p.endswith((".jsx", ".vue")), False) for p in FILES] + [("a.d.ts", False, False, False), ("b.spec.ts", False, False, False), ("c.test.tsx", False, True, False)]))
def file_kinds(spark, sf_dir):
    more = spark.createDataFrame([("a.d.ts", ".ts", 0, 1, ""), ("b.spec.ts", ".ts", 0, 1, ""), ("c.test.tsx", ".tsx", 0, 1, "")], "path string, ext string, size long, lines int, content string")
    every = project_files(spark).union(more)
    return every.select("path", files.is_source(F.col("path")).alias("is_source"), F.col("ext").isin(*files.MARKUP).alias("is_markup"), files.is_large(F.col("content")).alias("is_large"))


_CONFIGS = [("tsconfig.json", '{\n  // base\n  "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "x/*"], "#api": ["src/api"],}}\n}'), ("src/ui/tsconfig.json", '{"compilerOptions": {"paths": {"~/*": ["./*"]}}}'), ("src/util/tsconfig.json", "{broken")]


def configs(spark):
    return spark.createDataFrame(_CONFIGS, "path string, content string")


@fixture(literal("path, config", [(p, "src/ui/tsconfig.json" if "/ui/" in p else "src/util/tsconfig.json" if "/util/" in p else "tsconfig.json") for p in FILES]))
def nearest_configs(spark, sf_dir):
    return files.nearest_config(project_files(spark), configs(spark))


@fixture(literal("config, alias, target, base_url", [("tsconfig.json", "@/*", "src/*", "."), ("tsconfig.json", "#api", "src/api", "."), ("src/ui/tsconfig.json", "~/*", "./*", ".")]))
def config_aliases(spark, sf_dir):
    return files.aliases_of(configs(spark)).select("config", "alias", "target", "base_url")


@fixture(literal("place, line", list(enumerate(["└── src/", "    ├── api.ts", "    ├── broken.js", "    ├── empty.js", "    ├── index.ts", "    ├── types.ts", "    ├── ui/", "    │   ├── Card.jsx", "    │   ├── Old.vue", "    │   └── Panel.vue", "    └── util/", "        ├── helper.js", "        └── index.ts"]))))
def directory_tree(spark, sf_dir):
    return files.tree(project_files(spark))


@fixture(literal("file, line, problem", [("src/broken.js", 1, "string without end")]))
def parse_errors(spark, sf_dir):
    return code.errors(nodes(spark))


@fixture(literal("kind, n", [("program", 10), ("import", 11), ("import_name", 13), ("export", 17), ("export_from", 2), ("function", 9), ("arrow", 3), ("method", 2), ("class", 1), ("property", 1), ("interface", 1), ("type", 1), ("enum", 1), ("error", 1), ("jsx", 7)]))
def syntax_nodes(spark, sf_dir):
    return nodes(spark).groupBy("kind").agg(F.count("*").cast("int").alias("n")).where("kind IN ('program', 'import', 'import_name', 'export', 'export_from', 'function', 'arrow', 'method', 'class', 'property', 'interface', 'type', 'enum', 'error', 'jsx')")


@fixture(literal("file, specifier, imported, local, how, is_type_only, line", [
    (API, "./missing", "gone", "gone", "static", False, 2), (API, "./util", "absent", "absent", "static", False, 3), (API, "./util", "helper", "helper", "static", False, 3), (API, "axios", "default", "axios", "static", False, 1),
    (INDEX, "./api", "LIMIT", "max", "static", False, 1), (INDEX, "./api", "fetchData", "fetchData", "static", False, 1), (INDEX, "./types", "User", "User", "static", True, 3), (INDEX, "./util", "*", None, "re-export", False, 4),
    (INDEX, "./util/index", "default", "helper", "static", False, 2), (TYPES, "./index", "main", "main", "static", False, 4), (CARD, "./Row", "Row", "Row", "static", False, 1), (OLD, "./x", "default", "x", "static", False, 3),
    (PANEL, "./Card.vue", "default", "Card", "static", False, 7), (PANEL, "vue-router", "useRoute", "useRoute", "static", False, 8), (UTIL, "./helper", "helper", None, "re-export", False, 1)]))
def project_imports(spark, sf_dir):
    return code.imports(nodes(spark))


@fixture(literal("file, specifier, names", [(INDEX, "./util", "*"), (UTIL, "./helper", "helper")]))
def re_exports(spark, sf_dir):
    return code.re_exports(nodes(spark))


EXPORTS = [
    (API, "Client", "class", False), (API, "LIMIT", "const", False), (API, "fetchData", "function", False), (INDEX, "main", "function", False), (TYPES, "Id", "type", False), (TYPES, "Role", "enum", False), (TYPES, "User", "interface", False),
    (CARD, "Card", "function", False), (OLD, "default", "value", True), (HELPER, "helper", "function", False), (HELPER, "isOk", "function", False), (HELPER, "lonely", "function", False), (HELPER, "lonely", "name", False),
    (HELPER, "lonely2", "const", False), (HELPER, "lonely3", "const", False), (UTIL, "first", "function", True), (UTIL, "helper", "re-export", False),
]


@fixture(literal("file, name, type, is_default", EXPORTS))
def project_exports(spark, sf_dir):
    return code.exports(nodes(spark)).drop("line")


FUNCTIONS = [
    (API, "Client.constructor", "method", "Client", None, 1, "name", "string", "any", False, True, 14, 14), (API, "Client.open", "method", "Client", None, 1, "", "", "void", False, True, 15, 15),
    (API, "fetchData", "arrow", None, None, 0, "id,more", "number,string[]", "any", True, True, 7, 11), (API, "getConfig", "function", None, None, 0, "", "", "any", False, False, 6, 6),
    (INDEX, "main", "function", None, None, 0, "id", "number", "Promise<User>", True, True, 6, 15), (INDEX, "main.inner", "function", None, "main", 1, "x", "any", "any", False, False, 11, 13),
    (CARD, "Card", "arrow", None, None, 0, "{ title }", "any", "any", False, True, 3, 8), (CARD, "Local", "function", None, None, 0, "", "", "any", False, False, 2, 2),
    (PANEL, "close", "function", None, None, 0, "", "", "any", False, False, 14, 14), (PANEL, "select", "arrow", None, None, 0, "", "", "any", False, False, 13, 13),
    (HELPER, "helper", "function", None, None, 0, "x", "any", "any", False, True, 1, 1), (HELPER, "isOk", "function", None, None, 0, "x", "any", "any", False, True, 2, 2),
    (HELPER, "lonely", "function", None, None, 0, "a,b", "any,any", "any", False, True, 3, 3), (UTIL, "first", "function", None, None, 0, "list", "any", "any", False, True, 2, 2),
]


@fixture(literal("file, name, kind, class_name, parent_function, depth, params, param_types, return_type, is_async, is_exported, line, end_line", FUNCTIONS))
def project_functions(spark, sf_dir):
    return code.functions(nodes(spark)).select("file", "name", "kind", "class_name", "parent_function", "depth", joined("params"), joined("param_types"), "return_type", "is_async", "is_exported", "line", "end_line")


@fixture(literal("file, type, n", [(API, "class", 1), (API, "constant", 2), (API, "function", 4), (INDEX, "constant", 1), (INDEX, "function", 2), (TYPES, "enum", 1), (TYPES, "interface", 1), (TYPES, "type", 1), (CARD, "function", 2), (PANEL, "constant", 4), (PANEL, "function", 2), (HELPER, "constant", 2), (HELPER, "function", 3), (UTIL, "function", 1)]))
def module_structure(spark, sf_dir):
    """How many entities of each kind a file has."""
    return code.entities(nodes(spark)).groupBy("file", "type").agg(F.count("*").cast("int").alias("n"))


@fixture(literal("file, name, extends, implements, methods, properties", [(API, "Client", "Base", "Api,Other", "constructor,open", "size")]))
def project_classes(spark, sf_dir):
    return code.classes(nodes(spark)).select("file", "name", "extends", joined("implements"), joined("methods"), joined("properties"))


@fixture(literal("file, name, kind, extends, members, value", [(TYPES, "Id", "type", "", "", "string | number"), (TYPES, "Role", "enum", "", "Admin,Guest", None), (TYPES, "User", "interface", "Named,Aged", "id,name", None)]))
def project_shapes(spark, sf_dir):
    return code.shapes(nodes(spark)).select("file", "name", "kind", joined("extends"), joined("members"), "value")


@fixture(literal("file, name, literal, value", [(API, "LIMIT", "literal", "10"), (API, "config", "object", ""), (INDEX, "unusedValue", "call", ""), (PANEL, "emit", "other", ""), (PANEL, "own", "call", ""), (PANEL, "props", "call", ""), (PANEL, "route", "call", ""), (HELPER, "lonely2", "literal", "1"), (HELPER, "lonely3", "regex", "/a/")]))
def literal_values(spark, sf_dir):
    return code.constants(nodes(spark)).drop("line")


@fixture(literal("src, dst, type", [
    (f"{API}#Client.constructor", f"{API}#Client.open", "method"), (f"{API}#fetchData", "./util#helper", "import"), (f"{API}#fetchData", f"{API}#getConfig", "direct"), (f"{INDEX}#main", "./api#fetchData", "import"),
    (f"{INDEX}#main", "./util/index#default", "import"), (f"{INDEX}#main", f"{INDEX}#main.inner", "direct"), (f"{INDEX}#main", f"{INDEX}#main.inner", "nested"), (f"{INDEX}#main.inner", f"{INDEX}#main", "direct"), (f"{HELPER}#helper", f"{HELPER}#isOk", "direct")]))
def project_call_graph(spark, sf_dir):
    return code.call_graph(nodes(spark))


@fixture(literal("file, caller, callee, calls", [
    (API, "Client.constructor", "this.open", 1), (API, "fetchData", "axios.get", 1), (API, "fetchData", "getConfig", 1), (API, "fetchData", "helper", 1), (INDEX, "main", "fetchData", 1), (INDEX, "main", "helper", 1), (INDEX, "main", "inner", 1),
    (INDEX, "main.inner", "main", 1), (INDEX, None, "eval", 1), (CARD, "Card", "go", 1), (OLD, None, "this.$emit", 1), (PANEL, "close", "emit", 1), (PANEL, "select", "emit", 1), (PANEL, None, "defineEmits", 1), (PANEL, None, "defineExpose", 1),
    (PANEL, None, "defineProps", 1), (PANEL, None, "useOwn", 1), (PANEL, None, "useRoute", 1), (PANEL, None, "withDefaults", 1), (HELPER, "helper", "isOk", 2)]))
def project_calls(spark, sf_dir):
    return code.calls(nodes(spark)).groupBy("file", "caller", F.col("chain").alias("callee")).agg(F.count("*").cast("int").alias("calls"))


@fixture(literal("file, src, dst", [(API, "Client", "LIMIT"), (API, "fetchData", "getConfig"), (API, "getConfig", "config"), (CARD, "Card", "Local"), (PANEL, "close", "emit"), (PANEL, "select", "emit"), (PANEL, "select", "props"), (HELPER, "helper", "isOk")]))
def file_internal_graph(spark, sf_dir):
    return code.file_graph(nodes(spark))


@fixture(literal("id, complexity", [(f"{f}#{n}", {"fetchData": 2, "main": 3, "main.inner": 2, "Card": 2, "helper": 2, "isOk": 2}.get(n, 1)) for f, n, *_ in FUNCTIONS]))
def function_complexity(spark, sf_dir):
    return code.complexity(nodes(spark)).select("id", F.col("complexity").cast("int").alias("complexity"))


@fixture(literal("id, has_process_env, has_password", [(f"{API}#fetchData", True, True)]))
def body_security(spark, sf_dir):
    found = code.body_flags(project_files(spark), nodes(spark))
    return found.where("has_eval OR has_process_env OR has_exec OR has_password OR has_sensitive").select("id", "has_process_env", "has_password")


@fixture(literal("file, name, kind", [(INDEX, "unusedValue", "variable"), (PANEL, "own", "variable"), (PANEL, "route", "variable"), (HELPER, "b", "parameter")]))
def unused_declarations(spark, sf_dir):
    return code.unused_names(project_files(spark), nodes(spark)).drop("line")


@fixture(literal("file, name, times", [(HELPER, "lonely", 2)]))
def duplicate_exports(spark, sf_dir):
    return code.duplicate_exports(nodes(spark)).select("file", "name", F.col("times").cast("int").alias("times"))


EDGES = [
    (API, "./missing", "external"), (API, "axios", "external"), (API, UTIL, "import"), (INDEX, API, "import"), (INDEX, TYPES, "import"), (INDEX, UTIL, "import"), (INDEX, UTIL, "re-export"), (TYPES, INDEX, "import"),
    (CARD, "./Row", "external"), (OLD, "./x", "external"), (PANEL, "./Card.vue", "external"), (PANEL, "vue-router", "external"), (UTIL, HELPER, "re-export"),
]


@fixture(literal("src, dst, type", EDGES))
def module_graph(spark, sf_dir):
    return code.project_edges(project_files(spark), nodes(spark))


@fixture(literal("src, dst, type", [*EDGES, (API, HELPER, "re-export"), (INDEX, HELPER, "re-export"), (TYPES, UTIL, "re-export")]))
def folder_re_exports(spark, sf_dir):
    every = nodes(spark)
    return code.folder_expansion(code.project_edges(project_files(spark), every), every, project_files(spark))


@fixture(literal("node, depth", [(INDEX, 1), (API, 2), (TYPES, 2), (UTIL, 2), (HELPER, 3), ("./missing", 3), ("axios", 3)]))
def project_graph(spark, sf_dir):
    """What the entry file needs, the entry at depth 1; imports that mean no file stay as leaves."""
    g = graph.CodeGraph(module_graph(spark, sf_dir))
    return g.reach(spark.createDataFrame([(INDEX,)], "node string"), 4).select("node", (F.col("distance") + 1).alias("depth"))


def meant(spark):
    every = nodes(spark)
    brought = code.imports(every)
    return every, brought, resolve.resolve_imports(brought, project_files(spark))


@fixture(literal("file, specifier", [(API, "./missing"), (CARD, "./Row"), (OLD, "./x"), (PANEL, "./Card.vue")]))
def missing_modules(spark, sf_dir):
    return resolve.unresolved_imports(meant(spark)[2]).select("file", "specifier")


@fixture(literal("file, specifier, imported", [(API, "./util", "absent")]))
def missing_exports(spark, sf_dir):
    every, brought, resolved = meant(spark)
    return resolve.missing_exports(brought, resolved, code.exports(every))


@fixture(literal("file, name", [(f, n) for f, n in sorted({(f, n) for f, n, *_ in EXPORTS}) if (f, n) not in ((API, "LIMIT"), (API, "fetchData"), (TYPES, "User"), (INDEX, "main"), (HELPER, "helper")) and f != UTIL]))
def dead_exports_of_files(spark, sf_dir):
    """Exports nothing imports; a re-export of everything uses all of a file."""
    every, brought, resolved = meant(spark)
    return resolve.dead_exports(code.exports(every), brought, resolved)


@fixture(literal("file, local, line, span", [(API, "helper", 9, "fetchData")]))
def entity_impact(spark, sf_dir):
    """Where the helper that the util folder hands on is used, and in which function."""
    every, brought, resolved = meant(spark)
    spans = every.where(F.col("kind").isin(*code.FUNCTIONS)).select("file", F.col("name").alias("span"), "start", "end")
    uses = code.identifiers(every)
    found = resolve.impact(UTIL, "helper", brought, resolved, uses.select("file", "name", "pos"), spans)
    return found.join(uses.select("file", "pos", "line"), ["file", "pos"]).select("file", "local", "line", "span").distinct()


@fixture(literal("file, tag, kind", [(CARD, "Row", "imported"), (CARD, "Local", "local"), (CARD, "Unknown", "unknown"), (CARD, "a", "intrinsic"), (CARD, "b", "intrinsic"), (CARD, "button", "intrinsic"), (CARD, "img", "intrinsic")]))
def element_kinds(spark, sf_dir):
    every = nodes(spark)
    local = code.functions(every).select("file", "name")
    return resolve.component_kinds(code.elements(every), code.imports(every).where("local IS NOT NULL"), local)


@fixture(literal("tag, props", [("Local", "size"), ("Row", "...,onClick"), ("Unknown", "color,size")]))
def component_props(spark, sf_dir):
    return code.component_props(nodes(spark)).select("tag", joined("props"))


@fixture(literal("file, rule, tag", [(CARD, "React isn't imported", None), (CARD, "link without href", "a")]))
def element_issues(spark, sf_dir):
    return code.element_issues(nodes(spark)).drop("line")


@fixture(literal("file, name, event", [(CARD, "onClick", "click"), (PANEL, "emit", "close"), (PANEL, "emit", "update")]))
def bound_events(spark, sf_dir):
    return code.event_handlers(nodes(spark))


@fixture(literal("path, type, imports, exports, functions, components, composables", [
    (API, "ts", "axios,./missing,./util", "LIMIT,fetchData,Client", "getConfig,fetchData", "", ""), ("src/broken.js", "js", "", "", "", "", ""), ("src/empty.js", "js", "", "", "", "", ""), (INDEX, "ts", "./api,./util/index,./types", "main", "main,inner", "", ""),
    (TYPES, "ts", "./index", "", "", "", ""), (CARD, "jsx", "./Row", "Card", "Local,Card", "Row,Local,Unknown", ""), (OLD, "vue", "./x", "", "", "", ""), (PANEL, "vue", "./Card.vue,vue-router", "", "close,select", "Card", "useRoute,useOwn"),
    (HELPER, "js", "", "helper,isOk,lonely,lonely2", "helper,isOk,lonely", "", ""), (UTIL, "ts", "", "first", "first", "", "")]))
def facets_by_pattern(spark, sf_dir):
    return code.by_patterns(project_files(spark)).select("path", "type", *(joined(c) for c in ("imports", "exports", "functions", "components", "composables")))


@fixture(literal("read_whole, by_pattern", [(8, 2)]))
def large_file_shortcut(spark, sf_dir):
    """Files beyond a size are read by patterns only; the limit is low here."""
    whole, large = code.parse_or_patterns(project_files(spark), 480)
    return whole.agg(F.count_distinct("file").cast("int").alias("read_whole")).join(large.agg(F.count("*").cast("int").alias("by_pattern")))


@fixture(literal("fn, pos, kind, target", [(f"{INDEX}#main", 0, "plain", None), (f"{INDEX}#main", 1, "branch", 3), (f"{INDEX}#main", 2, "return", None), (f"{INDEX}#main", 3, "plain", None), (f"{INDEX}#main", 4, "return", None), (f"{HELPER}#isOk", 0, "branch", 3), (f"{HELPER}#isOk", 1, "return", None), (f"{HELPER}#isOk", 2, "jump", 4), (f"{HELPER}#isOk", 3, "return", None)]))
def function_statements(spark, sf_dir):
    """What functions are made of, and where their branches and jumps go."""
    return statements(project_files(spark)).where("fn LIKE '%#main' OR fn LIKE '%#isOk'").select("fn", "pos", "kind", "target")


@fixture(literal("fn, edges, nodes, complexity", [(f"{INDEX}#main", 5, 5, 2), (f"{HELPER}#isOk", 6, 6, 2), (f"{API}#getConfig", 2, 3, 1)]))
def function_flow(spark, sf_dir):
    """Size and E - N + 2 of functions' control flow, entry and exit included."""
    found = flow.complexity(statements(project_files(spark))).where("fn LIKE '%#main' OR fn LIKE '%#isOk' OR fn LIKE '%#getConfig'")
    return found.select("fn", *(F.col(c).cast("int").alias(c) for c in ("edges", "nodes", "complexity")))


def blocks(spark):
    return vue.blocks(project_files(spark).where("ext = '.vue'"))


@fixture(literal("path, is_setup, is_ts, styles, custom_blocks, has_script", [(PANEL, True, True, 1, "i18n", False), (OLD, False, False, 0, "", True)]))
def component_blocks(spark, sf_dir):
    return blocks(spark).select("path", "is_setup", "is_ts", F.size("styles").alias("styles"), joined("custom_blocks"), (F.col("script") != "").alias("has_script"))


@fixture(literal("path, prop, type, required, \"default\"", [(OLD, "a", "String", False, None), (OLD, "b", "Number", True, "1"), (PANEL, "count", "number", False, "3"), (PANEL, "title", "string", True, None)]))
def declared_props(spark, sf_dir):
    return vue.props(blocks(spark))


@fixture(literal("path, event", [(OLD, "done"), (PANEL, "close"), (PANEL, "update")]))
def declared_emits(spark, sf_dir):
    return vue.emits(blocks(spark))


@fixture(literal("path, name", [(OLD, "run"), (PANEL, "close"), (PANEL, "select")]))
def exposed_names(spark, sf_dir):
    return vue.exposes(blocks(spark))


@fixture(literal("path, name, known", [(PANEL, "useOwn", False), (PANEL, "useRoute", True)]))
def composables(spark, sf_dir):
    return vue.composables(blocks(spark))


@fixture(literal("path, source, names", [(OLD, "./x", "x"), (PANEL, "./Card.vue", "Card"), (PANEL, "vue-router", "{ useRoute }")]))
def component_imports(spark, sf_dir):
    return vue.imports(blocks(spark))


@fixture(literal("path, name", [(PANEL, "close"), (PANEL, "select")]))
def component_functions(spark, sf_dir):
    return vue.functions(blocks(spark))


@fixture(literal("path, complexity, tags, expressions, root_tag, slots, directives, events", [(OLD, 3, 2, 1, "p", "", "", ""), (PANEL, 6, 5, 1, "div", "default,head", "v-for,v-if", "click,close")]))
def template_facets(spark, sf_dir):
    return vue.template_facets(blocks(spark), "path", "template").select("path", "complexity", "tags", "expressions", "root_tag", *(joined(c) for c in ("slots", "directives", "events")))


@query(r"""SELECT page_id, (len(regexp_extract_all(html, '<[^>]+>')) + len(regexp_extract_all(html, '\{\{[^}]*\}\}')))::INT AS complexity, len(regexp_extract_all(html, '<[^>]+>'))::INT AS tags, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '[ ](v-[a-z-]+)', 1))), ',') AS directives, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '[ ](?:@|v-on:)([a-zA-Z:-]+)', 1))), ',') AS events FROM pages""")
def page_facets(spark, sf_dir):
    return vue.template_facets(read(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "complexity", "tags", joined("directives"), joined("events"))


@fixture(literal("components, functions, composables, imports", [(2, 2, 2, 3)]))
def component_totals(spark, sf_dir):
    return vue.totals(vue.components(project_files(spark).where("ext = '.vue'"))).select(*(F.col(c).cast("int").alias(c) for c in ("components", "functions", "composables", "imports")))


@fixture(literal("path, n_props, advice", [(p, {PANEL: 2, OLD: 2}.get(p), {PANEL: "", OLD: ""}.get(p)) for p in FILES]))
def component_report(spark, sf_dir):
    """Every module, those that are components with their facets."""
    merged = vue.report(project_files(spark).select("path"), project_files(spark))
    return vue.with_advice(merged).select("path", F.col("n_props").cast("int").alias("n_props"), F.when(F.col("n_props").isNotNull(), F.array_join("advice", ",")).alias("advice"))


@fixture(literal("path, line", [(API, "function getConfig() { /* реализация скрыта */ }"), (API, "const config = /* значение скрыто */;"), (API, "export const LIMIT = 10;"), (UTIL, "export default function first(list) { /* реализация скрыта */ }"), (HELPER, "export const lonely2 = 1, lonely3 = /a/;"), ("src/broken.js", "const a = { b: 'c;")]))
def minified_lines(spark, sf_dir):
    lines = minify.minify(project_files(spark)).select("path", F.explode(F.split("minified", "\n")).alias("line"))
    return lines.where("line LIKE '%getConfig()%{%' OR line LIKE '%config =%' OR line LIKE '%LIMIT = 10%' OR line LIKE '%first%' OR line LIKE '%lonely2 =%' OR path = 'src/broken.js' AND line <> ''")


@fixture(literal("ext, files, size", [(e, len(g), sum(len(t.encode()) for t in g)) for e in sorted({"." + p.rsplit(".", 1)[1] for p in FILES}) for g in [[t for p, t in FILES.items() if p.endswith(e)]]]))
def files_by_extension(spark, sf_dir):
    return minify.by_extension(project_files(spark)).select("ext", F.col("files").cast("int").alias("files"), F.col("size").cast("int").alias("size"))


@fixture(literal("files, size, adds_up", [(len(FILES), sum(len(t.encode()) for t in FILES.values()), True)]))
def minified_savings(spark, sf_dir):
    return minify.savings(minify.minify(project_files(spark))).select(F.col("files").cast("int").alias("files"), F.col("size").cast("int").alias("size"), (F.abs(F.col("saved_kb") * 1024 - F.col("size") + F.col("minified_size")) < 6).alias("adds_up"))


@fixture(literal("place, path, language, whole", [(0, INDEX, "typescript", True), (1, API, "typescript", False), (2, TYPES, "typescript", False), (3, UTIL, "typescript", False), (4, HELPER, "javascript", False)]))
def prompt_pack(spark, sf_dir):
    closure = project_graph(spark, sf_dir).select("node", F.col("depth").alias("distance"))
    return minify.prompt_pack(INDEX, closure, project_files(spark)).select("place", "path", "language", (F.col("text") == F.lit(FILES[INDEX])).alias("whole"))


@fixture(literal("src, dst", [(INDEX, TYPES), (TYPES, INDEX)]))
def module_cycles(spark, sf_dir):
    return graph.CodeGraph(module_graph(spark, sf_dir)).cyclic_edges().select("src", "dst")


@fixture(literal("total, used, unused, constants, reassigned_constants", [(12, 8, 4, 12, 0)]))
def project_variables(spark, sf_dir):
    """Variables and whether their scope or one inside it reads them."""
    every = nodes(spark)
    defs = code.variables(every)
    owner = every.where(F.col("kind").isin(*code.FUNCTIONS)).select("file", F.col("node_id").alias("parent_id"), F.col("name").alias("fn"))
    reads = code.identifiers(every).join(owner, ["file", "parent_id"], "left")
    scopes = F.array(F.col("file"), F.concat_ws("#", "file", "fn"))
    uses = reads.select(F.explode(F.array_distinct(scopes)).alias("scope"), "name", "pos")
    return flow.variable_stats(defs, uses).select(*(F.col(c).cast("int").alias(c) for c in ("total", "used", "unused", "constants", "reassigned_constants")))


@fixture(literal("line", [(x,) for x in ('digraph "Dependency Graph" {', "}", f'  "{INDEX}" -> "{TYPES}" [color="#ef4444", penwidth=2.5, style="dashed"];', f'  "{TYPES}" -> "{INDEX}" [color="#ef4444", penwidth=2.5, style="dashed"];', f'  "{INDEX}" -> "{API}" [label="import"];', f'  "{UTIL}" -> "{HELPER}" [label="re-export"];')]))
def dot_lines(spark, sf_dir):
    edges = module_graph(spark, sf_dir)
    lines = report.dot(edges, graph.CodeGraph(edges).cyclic_edges(), label="type").select("line")
    return lines.where(F.col("line").rlike(f'^digraph|^}}$|types.ts|"{INDEX}" -> "{API}"|helper.js'))


@fixture(literal("name, json", [(HELPER + "#helper", '{"name":"src/util/helper.js#helper","calls":["src/util/helper.js#isOk"],"cycles":[]}'), (INDEX + "#main.inner", '{"name":"src/index.ts#main.inner","calls":["src/index.ts#main"],"cycles":["src/index.ts#main.inner->src/index.ts#main"]}')]))
def call_graph_json(spark, sf_dir):
    edges = project_call_graph(spark, sf_dir)
    cyclic = graph.CodeGraph(edges).cyclic_edges()
    return report.adjacency_json(edges, cyclic).where("name LIKE '%#helper' OR name LIKE '%main.inner'")


@fixture(literal("file, json", [(UTIL, '{"file":"src/util/index.ts","entities":{"function":["first"]},"dependencies":["src/util/helper.js"]}')]))
def package_report(spark, sf_dir):
    return report.package_json(code.entities(nodes(spark)), module_graph(spark, sf_dir)).where(F.col("file") == UTIL)


@fixture(literal("line", [("| class | 1 |",), ("| constant | 9 |",), ("| enum | 1 |",), ("| function | 14 |",), ("| interface | 1 |",), ("| type | 1 |",), (f"- {INDEX} -> {TYPES}",), (f"- {TYPES} -> {INDEX}",)]))
def project_markdown(spark, sf_dir):
    every, edges = nodes(spark), module_graph(spark, sf_dir)
    lines = report.project_markdown(code.entities(every), code.exports(every), code.imports(every), graph.CodeGraph(edges).cyclic_edges(), project_call_graph(spark, sf_dir)).select("line")
    return lines.where("line RLIKE '^. (class|constant|enum|function|interface|type) . [0-9]' OR line LIKE '- src/%->%.ts'")


@fixture(literal("rule, changed", [("quotes", True), ("eqeqeq", True), ("prefer-const", True), ("semi", True), ("react/alt-text", True), ("no-var", False)]))
def fixed_files(spark, sf_dir):
    """Which fixers change a text that needs all of them but one."""
    text = 'let a = "b"\nif (a == 1) { x = <img src="y" />; }\n'
    out = None
    for rule in ("quotes", "eqeqeq", "prefer-const", "semi", "react/alt-text", "no-var"):
        files_ = spark.createDataFrame([("f.jsx", text)], "path string, content string")
        one = fixers.apply(files_, [rule]).select(F.lit(rule).alias("rule"), (F.col("content") != text).alias("changed"))
        out = one if out is None else out.union(one)
    return out


@fixture("SELECT 'bounded product' AS name, true AS valid, 10201::BIGINT AS checked UNION ALL SELECT 'sum is larger', false, 441")
def contract_checks(spark, sf_dir):
    good = formal.Contract("bounded product", {"a": (0, 100), "b": (0, 100)}, "a * b", ["0 <= a && a <= 100"], ["result >= 0 && result <= 10000"])
    bad = formal.Contract("sum is larger", {"a": (-10, 10), "b": (-10, 10)}, "a + b", [], ["result >= a"])
    return formal.verify(spark, good).union(formal.verify(spark, bad)).select("name", "valid", "checked")


@fixture("SELECT a, b, a * b AS result FROM range(-20, 21) x(a), range(-20, 21) y(b) WHERE a * b > 100 AND a < b AND NOT (a % 3 = 0 OR b > 15)")
def bounded_counterexamples(spark, sf_dir):
    c = formal.Contract("c", {"a": (-20, 20), "b": (-20, 20)}, "a * b", ["a * b > 100 && a < b"], ["a % 3 == 0 || b > 15"])
    return formal.counterexamples(spark, c)


_PAIRS = [("a + b", "b + a", True), ("a - b - c", "a - (b + c)", True), ("a * (b + c)", "a * b + a * c", True), ("a - b", "b - a", False), ("a > b => a >= b", "true", True), ("a % 2 == 0", "a / 2 == 1", False)]


@fixture(literal("id, equivalent", [(k, e) for k, (_, _, e) in enumerate(_PAIRS)]))
def expression_equivalence(spark, sf_dir):
    out = None
    for k, (a, b, _) in enumerate(_PAIRS):
        one = formal.equivalent(spark, a, b, {"a": (-9, 9), "b": (-9, 9), "c": (-9, 9)}).select(F.lit(k).alias("id"), "equivalent")
        out = one if out is None else out.union(one)
    return out


@fixture("SELECT true AS initial, true AS kept, true AS enough")
def loop_invariants(spark, sf_dir):
    """Of a loop that adds up 0 .. i - 1 while i < n."""
    return formal.loop_invariant(spark, {"i": (0, 30), "n": (0, 30), "s": (0, 500)}, "2 * s == i * (i - 1) && i <= n", "i < n", {"s": "s + i", "i": "i + 1"}, "i == 0 && s == 0", "2 * s == n * (n - 1)").select("initial", F.col("kept"), "enough")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: NOT (x >= -1 AND x <= 1))) = 0 AS bounded, len(list_filter(embedding, lambda x: NOT (x > 0))) = 0 AS positive FROM embeddings")
def array_properties(spark, sf_dir):
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", formal.array_property(v, "x >= -1 && x <= 1").alias("bounded"), formal.array_property(v, "x > 0").alias("positive"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity BETWEEN 1 AND 50 AND (NOT (l_discount > 0.05) OR l_tax < 0.08) AND (l_linenumber <> 3 OR l_quantity >= 2) AND CASE WHEN l_tax = 0 THEN l_discount >= 0 ELSE l_discount < 0.1 END AS holds FROM lineitem")
def constraint_trees(spark, sf_dir):
    tree = formal.both(formal.in_range("l_quantity", 1, 50), formal.implies("l_discount > 0.05", ("lt", "l_tax", "0.08")), formal.either(formal.neq("l_linenumber", 3), ("ge", "l_quantity", 2)), formal.if_(formal.eq("l_tax", "0.0"), "l_discount >= 0", "l_discount < 0.1"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", formal.constraint(tree).alias("holds"))


@fixture(literal("equivalent, how", [(True, "values")]))
def modelled_functions(spark, sf_dir):
    return formal.functions_equivalent(spark, "{ const d = a - b; if (d > 0) { return a; } else { return b; } }", "{ return a > b ? a : b; }", {"a": (-20, 20), "b": (-20, 20)}).select("equivalent", "how")


@fixture(literal("name, type, least", [("n", "number", 1), ("m", "number", 0), ("s", "string", None)]))
def documented_contracts(spark, sf_dir):
    doc = spark.createDataFrame([("/**\n * @param {number} n positive count\n * @param {number} m a non-negative offset\n * @param {string} s text\n */",)], "doc string")
    return doc.select(F.explode(formal.contract_from_comment(F.col("doc"))).alias("p")).select("p.*")


@fixture(literal("cluster, size, kind", [("src/api.ts#LIMIT", 1, "core"), ("src/api.ts#Client", 1, "core"), ("src/api.ts#fetchData", 3, "core")]))
def file_clusters(spark, sf_dir):
    """The declarations of one file, clustered by what names what, at most three each."""
    every = nodes(spark).where(F.col("file") == API)
    own = code.entities(every).where("name NOT LIKE '%.%'").select(F.col("file").alias("module"), "name", F.col("is_exported").alias("exported"))
    calls = code.file_graph(every).where("dst <> 'LIMIT'").select(F.col("file").alias("module"), "src", "dst")
    found = clusters.by_importance(own, calls, 3)
    return clusters.described(found, own, calls).select("cluster", F.col("size").cast("int").alias("size"), "kind")


@fixture(literal("module, cluster, needed_imports, needed_constants, outside", [(API, "fetchData", "axios,gone,helper", "config", "")]))
def cluster_dependencies(spark, sf_dir):
    every = nodes(spark).where(F.col("file") == API)
    found = spark.createDataFrame([(API, "fetchData", "fetchData"), (API, "fetchData", "getConfig")], "module string, cluster string, name string")
    own = every.where("parent_id = 0 AND kind IN ('function', 'arrow')").select("file", F.col("name").alias("span"), "start", "end")
    uses = resolve.enclosing(code.identifiers(every).select("file", "name", "pos"), own).where("span IS NOT NULL").select(F.col("file").alias("module"), F.col("span").alias("function"), "name")
    brought = code.imports(every).select(F.col("file").alias("module"), F.col("local").alias("name"))
    constants = code.constants(every).select(F.col("file").alias("module"), "name")
    return clusters.dependencies(found, uses, brought, constants)


@fixture(literal("module, line", [("api", "export { LIMIT, fetchData } from './api';")]))
def re_export_lines(spark, sf_dir):
    return fixers.re_export_lines(spark.createDataFrame([("api", "fetchData"), ("api", "LIMIT"), ("api", "LIMIT")], "module string, name string"))


@fixture(literal("module, cluster, content", [(API, "fetchData", "export function getConfig() { return config; }\n\n" + FILES[API][FILES[API].index("export const fetchData") : FILES[API].index("\n};\nexport class") + 2])]))
def extracted_modules(spark, sf_dir):
    f = code.functions(nodes(spark)).select(F.col("file").alias("module"), "name", "start", "end")
    found = spark.createDataFrame([(API, "fetchData", "fetchData"), (API, "fetchData", "getConfig")], "module string, cluster string, name string")
    return fixers.extracted_modules(project_files(spark), f, found)


@fixture(literal("path, moved", [(p, p in (API, INDEX)) for p in FILES]))
def updated_imports(spark, sf_dir):
    moved = spark.createDataFrame([("./util", "./lib/util"), ("./util/index", "./lib")], "old string, new string")
    new = fixers.component_imports(project_files(spark).select("path", "content"), moved)
    return new.join(project_files(spark).select("path", F.col("content").alias("was")), "path").select("path", (F.col("content") != F.col("was")).alias("moved"))
