"""Scans of real folders, JSON documents, the reader of source text, fixers, the minifier."""

import json

import pytest

from strandgraph.operators import fixers, minify, report
from strandgraph.plans import project
from strandgraph.sources import code, files, json_io, vue
from strandgraph.sources.javascript import read


@pytest.fixture
def folder(tmp_path):
    for path, text in {**project.FILES, "node_modules/x/index.js": "no", "deep/a/b/c.ts": "const c = 1;", "notes.md": "no", "types.d.ts": "declare const x: number;"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    return str(tmp_path)


def paths_of(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_scans(spark, folder):
    every = files.scan(spark, folder)
    assert paths_of(every) == sorted([*(set(project.FILES) - {"src/empty.js"}), "deep/a/b/c.ts", "types.d.ts"])
    assert {(r["path"], r["ext"], r["size"], r["lines"], r["content"]) for r in every.where("path = 'src/api.ts'").collect()} == {("src/api.ts", ".ts", len(project.API), 17, project.API)}
    assert paths_of(files.scan(spark, folder, (".ts",), max_depth=1)) == ["src/api.ts", "src/index.ts", "src/types.ts", "types.d.ts"]
    assert "types.d.ts" not in paths_of(files.sources_only(every)) and paths_of(files.markup_files(every)) == ["src/ui/Card.jsx", "src/ui/Old.vue", "src/ui/Panel.vue"]
    assert len(paths_of(files.scan_many(spark, [folder, folder, folder + "/src"]))) == len(paths_of(every))
    assert len(paths_of(files.scan_many(spark, [folder + "/src"], recursive=False))) == 4
    assert files.scan(spark, folder, (".none",)).count() == 0


def test_whole_path_from_folder_to_report(spark, folder, tmp_path):
    scanned = files.scan(spark, folder)
    nodes = code.parse(scanned)
    edges = code.project_edges(scanned, nodes)
    lines = report.dot(edges, label="type")
    report.write(lines, str(tmp_path / "dot"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "dot").glob("part-*")))
    assert written == report.as_text(lines) and '"src/index.ts" -> "src/api.ts"' in written and "rankdir=LR" in written
    report.write_json(code.entities(nodes), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == code.entities(nodes).count()
    report.write_tables({"edges": edges}, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index" / "edges")).count() == edges.count()
    page = report.html_page("A <b>", {"edges": edges.orderBy("src", "dst")}, 3)
    assert page.count("<tr>") == 4 and "A &lt;b&gt;" in page
    report.save(spark, page, str(tmp_path / "page"))
    lively = report.interactive_page("Graph", edges.selectExpr("src AS node").distinct(), edges)
    assert "src/index.ts" in lively and "<script>" in lively
    issues = spark.createDataFrame([("a.ts", 3, "eval", "error", 9), ("b.ts", 1, "exec", "warning", 7)], "file string, line int, rule string, kind string, severity int")
    assert report.as_text(report.issues_markdown(issues)).index("eval") < report.as_text(report.issues_markdown(issues)).rindex("exec")
    shown = report.as_text(report.component_markdown(vue.with_advice(vue.components(scanned.where("ext = '.vue'")))))
    assert "Panel.vue`: 2 props, 2 events" in shown


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"entities": [{"id": "x", "name": "x", "type": "function", "module": "m"}], "edges": []}, indent=1))
    docs = json_io.documents(spark, str(tmp_path))
    assert json_io.index(docs)[0].count() == 1 and json_io.index(docs)[1].count() == 0 and json_io.report(docs).count() == 0


def kinds(text, path="a.tsx"):
    return [(n["kind"], n["name"]) for n in read(text, path) if n["kind"] not in ("program", "identifier")]


def test_reader_of_hard_texts():
    assert kinds("") == [] and kinds(" \n// only a comment") == []
    assert kinds("const a = x / y / z; const b = /[/]x/.test(s);") == [("variable", "a"), ("variable", "b"), ("call", "test")]
    assert kinds("const t = `a ${f(`b ${g()}`)} c`;") == [("variable", "t"), ("call", "f"), ("call", "g")]
    assert kinds("function f<T extends A<B>>(x: Map<string, T>): { a: T } { return x; }", "a.ts") == [("function", "f"), ("return", "return")]
    assert kinds("abstract class A { abstract run(): void; static async *gen() {} get x() { return 1; } }", "a.ts") == [("class", "A"), ("method", "A.gen"), ("method", "A.x"), ("return", "return")]
    assert kinds("export const { a, b: [c] } = o, d = async () => {}, e = function* () {};")[-3::2] == [("arrow", "d"), ("function", "e")]
    assert [n["kind"] for n in read("const a = (;", "a.js")] == ["program", "error"]
    assert kinds("export default () => 1; export type A = 'x' | 'y'; export interface I<T> { a(): T }", "a.ts") == [("export", "default"), ("export", "A"), ("type", "A"), ("export", "I"), ("interface", "I")]
    assert ("jsx", "A.B") in kinds("const x = <A.B {...p} q={<i/>}>it's {y} <></></A.B>;")
    long = "".join(f"export function f{i}(a) {{ return g{i}(a); }}\n" for i in range(3000))
    assert sum(k == "function" for k, _ in kinds(long, "a.js")) == 3000


def test_files_without_text(spark):
    rows = spark.createDataFrame([(None, None), ("a.js", None), ("b.js", ""), ("b.js", "const a = 1;"), ("b.js", "const a = 1;")], "path string, content string")
    nodes = code.parse(rows)
    assert code.constants(nodes).count() == 2 and code.functions(nodes).count() == 0 and code.parse(rows.limit(0)).count() == 0


def test_minifier():
    text = "function add(a, b) {\n  return a + b;\n}\nconst multiply = function(x, y) {\n  return x * y;\n};\nconst greet = (name) => {\n  return `Hello, ${name}!`;\n};\n"
    got = minify.minified(text, "a.js")
    assert "function add(a, b) { /* реализация скрыта */ }" in got and "const multiply = function(x, y) { /* реализация скрыта */ };" in got and "const greet = (name) => { /* реализация скрыта */ };" in got and "Hello" not in got
    assert minify.minified("const x = 42;", "a.js") == "const x = 42;" and minify.minified("const a = (;", "a.js") == "const a = (;"
    assert minify.minified("const API_URL = 'u'; const config = { a: 1 };", "a.js") == "const API_URL = 'u'; const config = /* значение скрыто */;"
    assert minify.squeezed("a\n\n\n\n\nb") == "a\n\nb"


FIXES = [
    ("quotes", 'a = "b" + "it\'s"', "a = 'b' + \"it's\""), ("eqeqeq", "a == b != c", "a === b !== c"), ("prefer-const", "let a = 1; let b = 2; b++;", "const a = 1; let b = 2; b++;"), ("no-var", "var a = 1; var b; b = 2;", "const a = 1; let b; b = 2;"),
    ("object-shorthand", "x = {a: a, b: c}", "x = {a, b: c}"), ("arrow-body-style", "f = () => { return {a}; }", "f = () => ({a})"), ("no-unused-vars", "function f(a, b) { return a; }\nf();", "function f(a, _b) { return a; }\nf();"),
    ("unused-imports", "import { a, b } from 'x';\nb();", "import { b } from 'x';\nb();"), ("2835", "import a from './a';", "import a from './a.js';"), ("7006", "function f(a, b: number) {}", "function f(a: any, b: number) {}"),
    ("react/react-in-jsx-scope", "x = <a />", "import React from 'react';\nx = <a />"), ("react/self-closing-comp", "x = <a></a>", "x = <a />"), ("react/jsx-boolean-value", "x = <a b={true} />", "x = <a b />"), ("react/jsx-curly-brace-presence", "x = <a b={'c'} />", 'x = <a b="c" />'),
    ("react/no-unknown-property", '<label for="a" class="b">', '<label htmlFor="a" className="b">'), ("react/jsx-no-target-blank", '<a target="_blank">', '<a target="_blank" rel="noreferrer">'), ("react/jsx-fragments", "<React.Fragment></React.Fragment>", "<></>"),
    ("react/no-unescaped-entities", "<p>it's</p>", "<p>it&apos;s</p>"), ("react/jsx-no-duplicate-props", '<a b="1" c="2" b="3">', '<a c="2" b="3">'), ("react/button-has-type", "x = <button>y</button>", 'x = <button type="button">y</button>'),
    ("react/jsx-key", "x.map(i => <li>a</li>)", "x.map(i => <li key={i}>a</li>)"), ("react/alt-text", "x = <img src='a' />", "x = <img alt=\"\" src='a' />"), ("quotes", "const a = (;", "const a = (;"),
]


@pytest.mark.parametrize(("rule", "text", "want"), FIXES)
def test_fixers(rule, text, want):
    assert fixers.fixed(text, [rule]) == want
    assert fixers.fixed(want, [rule]) == want


def test_line_fixers(spark):
    rows = spark.createDataFrame([("a.js", "let a = 1  \n\n\n\nfoo\nx;\nif (b) {\n}")], "path string, content string")
    one = lambda rule: fixers.apply(rows, [rule]).first()["content"]
    assert one("no-trailing-spaces").startswith("let a = 1\n") and one("eol-last").endswith("}\n") and "\n\n\n" not in one("no-multiple-empty-lines") and one("semi").startswith("let a = 1;\n") and "foo;" in one("semi") and "x;" not in one("no-unused-expressions")
    both = fixers.apply(rows, ["eol-last", "prefer-const", "unknown"]).first()
    assert both["content"].startswith("const a") and both["rounds"] == 1
    from pyspark.sql import functions as F

    assert rows.select(fixers.trailing_comma(F.lit("a\nb"), F.lit(1), F.lit(True))).first()[0] == "a,\nb" and rows.select(fixers.define_missing(F.lit("x"), F.lit("y"))).first()[0] == "const y = undefined;\nx"
