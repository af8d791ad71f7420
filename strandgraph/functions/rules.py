"""Rules over source text: security, naming, performance, module type, syntax. Each gives flags or issue structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

#: Secrets by their form. Fixed values.
SECRET_FORMS = (r"['\"][a-zA-Z0-9_-]{32,}['\"]", r"['\"]sk-[a-zA-Z0-9]{20,}['\"]", r"['\"]gh[pous]_[a-zA-Z0-9]{36,}['\"]", r"['\"]xox[baprs]-[a-zA-Z0-9-]+['\"]")
SECRET_NAMES = (("password", "password"), ("secret", "secret"), ("token", "token"), ("api key", "api[_-]?key"))
COMMON_NAMES = ("data", "temp", "tmp", "val", "value", "obj", "obj1", "obj2", "x", "y", "i", "j", "k")
#: Diagnostics that can be mended. Fixed values.
FIXABLE_CODES = (2304, 2307, 2339, 7006, 7031, 7034, 7053, 6133, 2322, 2552, 18046, 2835, 2591)
#: What a function body may not have, to be modelled.
UNMODELLED = (r"\bfor[ ]*\(", r"\bwhile[ ]*\(", r"\bdo[ ]*\{", r"\btry[ ]*\{", r"\bthrow ", r"\bawait ", r"\byield\b", r"\bnew ", r"\bswitch[ ]*\(", r"\bclass ", "=>", r"\bthis\.")


def security_flags(body: Column) -> dict[str, Column]:
    """What the source of a body does: evaluates, reads the environment, runs programs, names or holds secrets."""
    has = body.contains
    return {
        "has_eval": has("eval(") | has("eval ("), "has_process_env": has("process.env"), "has_exec": has("exec(") | has("exec (") | has("execSync("),
        "has_password": F.lower(body).rlike("(^|[^a-z0-9_])(password|passwd|pwd|secret|token|api[_-]?key)([^a-z0-9_]|$)"),
        "has_sensitive": body.rlike("|".join(SECRET_FORMS)),
    }


def issue(kind: str, severity: int, rule: str, fixable: bool = False) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(fixable).alias("fixable"))


def found(rules: list[tuple[Column, Column]]) -> Column:
    """The issues of those rules that hold."""
    return F.filter(F.array(*(F.when(F.coalesce(holds, F.lit(False)), i) for holds, i in rules)), lambda i: i.isNotNull())


def security_issues(text: Column, production: bool = True) -> Column:
    rules = [(text.contains("eval("), issue("error", 9, "eval")), (text.contains("exec('") | text.contains("exec(`"), issue("warning", 7, "exec"))]
    if production:
        rules.append((text.contains("console.log"), issue("warning", 5, "console.log", True)))
    return found(rules + [(F.lower(text).rlike(pattern + "[ ]*=[ ]*['\"][^'\"]+['\"]"), issue("warning", 8, f"hard-coded {name}")) for name, pattern in SECRET_NAMES])


def naming_issues(name: Column, kind: Column, returns: Column, exported: Column) -> Column:
    function = kind == "function"
    return found([
        (function & (F.upper(name) == name) & (F.length(name) > 2) & ~name.contains("_"), issue("info", 2, "function named like a constant")),
        (function & (F.length(name) > 40), issue("warning", 3, "long name")),
        (function & name.startswith("get") & (returns == "boolean"), issue("info", 2, "getter of a boolean")),
        ((kind == "variable") & name.isin(*COMMON_NAMES) & ~exported, issue("info", 2, "common name")),
    ])


def nested_loop_lines(text: Column) -> Column:
    """How many lines with a loop are followed by another one; the last line isn't looked at, nor the one before it."""
    flags = F.transform(F.split(text, "\n", -1), lambda x: x.contains("for") | x.contains("while"))
    pairs = F.zip_with(F.slice(flags, F.lit(1), F.greatest(F.size(flags) - 2, F.lit(0))), F.slice(flags, F.lit(2), F.greatest(F.size(flags) - 2, F.lit(0))), lambda a, b: a & b)
    return F.size(F.filter(pairs, lambda p: p))


def performance_issues(text: Column) -> Column:
    return found([(F.size(F.split(text, "\n", -1)) > 1000, issue("warning", 4, "large file")), (nested_loop_lines(text) > 0, issue("warning", 6, "nested loops"))])


def is_recursive(name: Column, text: Column) -> Column:
    return F.contains(text, F.concat(F.lit("return "), name, F.lit("(")))


def syntax_issues(text: Column) -> Column:
    n = lambda c: F.regexp_count(text, F.lit("\\" + c))
    return found([(n(a) != n(b), issue("error", 8, f"unbalanced {name}")) for a, b, name in (("{", "}", "braces"), ("(", ")", "parentheses"), ("[", "]", "brackets"))])


def any_types(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r":[ ]*any([^A-Za-z0-9_]|$)"))


def type_issues(text: Column) -> Column:
    return found([(any_types(text) > 3, issue("warning", 4, "many any types"))])


def is_fixable(code: Column) -> Column:
    return code.isin(*FIXABLE_CODES)


def can_be_modelled(body: Column) -> Column:
    return ~body.rlike("|".join(UNMODELLED))


def module_type(path: Column, text: Column, package: Column) -> Column:
    """``type`` (esm or cjs) and ``confidence`` of a file; ``package`` is what its package.json says, or null."""
    ext = paths.extension(path)
    says = lambda kind, how: F.struct(F.lit(kind).alias("type"), F.lit(how).alias("confidence"))
    esm, require = text.rlike(r"(?m)^[ \t]*(import|export)[ \t\r\n]"), text.rlike(r"(^|[^A-Za-z0-9_])require[ ]*\(") | text.rlike(r"(^|[^A-Za-z0-9_])(module\.exports|exports\.)[ ]*=")
    count = lambda word: F.regexp_count(text, F.lit(rf"\b{word}\b"))
    return (
        F.when(ext == ".mjs", says("esm", "high")).when(ext == ".cjs", says("cjs", "high"))
        .when(esm & ~require, says("esm", "high")).when(~esm & require, says("cjs", "high"))
        .when(esm & require, F.when(count("import") + count("export") > count("require"), says("esm", "medium")).otherwise(says("cjs", "medium")))
        .when(package == "module", says("esm", "high")).when(package == "commonjs", says("cjs", "high"))
        .when(ext.isin(".ts", ".tsx", ".jsx"), says("esm", "medium")).when(ext == ".js", says("cjs", "medium")).otherwise(says("cjs", "low"))
    )


def keeps_value(name: Column, literal_kind: Column, elements: Column) -> Column:
    """Whether a minified file keeps a variable's value: settings by their name, plain literals and regular expressions,
    and arrays of selectors or patterns."""
    named = name.rlike("^[A-Z][A-Z_]+$|(PATTERNS|SELECTORS|CONFIG|SETTINGS|OPTIONS)$|^(pageContext|lastPageState|syncScheduled)$")
    telling = F.exists(elements, lambda e: e.rlike(r"^[#.\[]|selector|pattern"))
    return F.coalesce(named | literal_kind.isin("literal", "regex") | ((literal_kind == "array") & F.coalesce(telling, F.lit(False))), F.lit(False))


def is_equivalent(equal: Column, confidence: Column) -> Column:
    return equal & (confidence > 0.7)


def needs_review(confidence: Column, n_differences: Column) -> Column:
    return (confidence < 0.85) | (n_differences > 0)
