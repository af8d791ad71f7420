"""Column functions over source text and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no identifiers. Fixed values.
RESERVED = (
    "if else for while do switch case break continue return throw try catch finally debugger const let var function class "
    "extends implements interface type enum namespace module declare export import default new delete typeof instanceof void "
    "this super null undefined true false async await yield static public private protected readonly abstract override"
).split()
#: Calls that bind or raise events. Fixed values.
EVENT_CALLS = ("addEventListener", "on", "once", "emit", "dispatchEvent", "addListener")
#: Beginnings of function names that a cluster's name leaves out. Fixed values.
VERBS = ("get", "set", "is", "has", "use", "fetch", "handle", "on", "save", "load", "create", "process")
#: Colours and icons of entity kinds, colours of edge kinds. Fixed values.
ENTITY_COLOURS = {"function": "#4f46e5", "class": "#7c3aed", "constant": "#059669", "interface": "#0ea5e9", "type": "#f59e0b", "variable": "#ef4444", "enum": "#8b5cf6", "module": "#6b7280"}
ENTITY_ICONS = {"function": "ƒ", "class": "📦", "constant": "📌", "interface": "📋", "type": "📝", "variable": "📄", "enum": "🔢", "module": "📁"}
EDGE_COLOURS = {"function_call": "#f59e0b", "constant_reference": "#059669", "class_extends": "#7c3aed", "class_implements": "#8b5cf6", "interface_extends": "#0ea5e9", "method_call": "#f97316", "property_access": "#ec4899", "import_binding": "#3b82f6", "export_binding": "#22c55e"}
OTHER_COLOUR, OTHER_ICON = "#9ca3af", "•"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters a-z, а-я, digits and underscores, of two characters or more; null for null."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-zа-яё0-9_]+", " "), " ")
    return F.filter(words, lambda t: F.length(t) > 1)


def entity_text(*parts: Column) -> Column:
    """What an entity is embedded by: its parts in turn, nulls left out."""
    return F.concat_ws(" ", *parts)


def index_keys(name: Column) -> Column:
    """Keys an index has of a name: its beginnings of 2 to 10 characters and its parts between ``.``, ``_`` and ``-``."""
    low = F.lower(name)
    longest = F.least(F.length(low), F.lit(10))
    begins = F.when(longest >= 2, F.transform(F.sequence(F.lit(2), F.greatest(longest, F.lit(2))), lambda n: F.substring(low, F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.split(low, "[._-]"), lambda p: F.length(p) > 1)
    return F.array_sort(F.array_distinct(F.concat(begins, parts)))


def calls(text: Column) -> Column:
    """Distinct names that are followed by an opening bracket, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)[ \t\r\n]*\("), F.lit(1))))


def identifiers(text: Column) -> Column:
    """Distinct identifiers of a text but reserved words."""
    found = F.regexp_extract_all(text, F.lit("([a-zA-Z_$][a-zA-Z0-9_$]*)"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, RESERVED))))


def lines(text: Column) -> Column:
    """Number of lines; an empty text has one."""
    return F.size(F.split(text, "\n", -1))


def is_event_handler(name: Column, is_attribute: Column) -> Column:
    return F.when(is_attribute, name.startswith("on")).otherwise(name.isin(*EVENT_CALLS))


def event_type(name: Column, first_argument: Column, is_attribute: Column) -> Column:
    """The event that a call or attribute is about: its first argument, or what follows ``on``."""
    return F.when(is_attribute & name.startswith("on"), F.lower(F.substring(name, F.lit(3), F.length(name)))).when(~is_attribute, first_argument)


def escape_html(text: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([|*_\[\]()#+.!-])", r"\\$1")


def file_size(n: Column) -> Column:
    """Bytes as ``B``, ``KB`` or ``MB``, the latter two with two decimals."""
    shown = lambda unit, name: F.concat(F.format_string("%.2f", n / F.lit(float(unit))), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, shown(1024, "KB")).otherwise(shown(1024 * 1024, "MB"))


def progress_bar(done: Column, total: Column, width: int = 20) -> Column:
    filled = F.when(total > 0, F.round(done / total * width)).otherwise(0).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled), F.lit("]"))


def cluster_name(function: Column) -> Column:
    """The name of a module for a function: without its verb, beginning in lower case, with ``Module`` after it."""
    rest = F.regexp_replace(function, f"^({'|'.join(VERBS)})", "")
    named = F.concat(F.lower(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))
    return F.concat(F.when(rest == "", F.lit("module")).otherwise(named), F.lit("Module"))


def size_advice(size: Column, wanted: int, most: int) -> Column:
    return F.when(size < wanted, "too small").when(size > most, "too large").otherwise("good")


def cohesion_advice(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "moderate").otherwise("low")


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").otherwise("low")


def change_impact(field: Column) -> Column:
    """How much a change of a syntax node's field matters."""
    return F.when(field.isin("name", "returnType", "parameterCount", "isAsync", "isExported", "operator"), "high").when(field.isin("leftKind", "rightKind", "methodCount"), "medium").otherwise("low")


def without_comments(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"/\*[\s\S]*?\*/", ""), "//[^\n]*", ""))


def shortened(text: Column) -> Column:
    """The whole text without comments, each run of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(without_comments(text), r"[ \t\r\n]+", " "))


def same_but_blanks(a: Column, b: Column) -> Column:
    strip = lambda t: F.regexp_replace(t, r"[ \t\r\n]", "")
    return strip(a) == strip(b)


def same_but_comments(a: Column, b: Column) -> Column:
    return without_comments(a) == without_comments(b)


def contract_type(declared: Column) -> Column:
    """The sort of a parameter of this declared type; whole numbers where nothing is known."""
    has = lambda *names: F.coalesce(F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(declared, n)), F.lit(False))
    return F.when(has("number", "int"), "int").when(has("boolean", "bool"), "bool").when(has("string"), "string").otherwise("int")


def expression_variables(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, ("true", "false", "null", "undefined", "typeof", "instanceof"))))


def expression_type(text: Column) -> Column:
    """``bool``, ``int``, ``string`` or ``unknown``, by what the expression is or which operators it has."""
    t = F.trim(text)
    return (
        F.when(t.isin("true", "false"), "bool").when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "int").when(t.rlike("^['\"]"), "string")
        .when(t.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"), "int").when(t.rlike(r"&&|\|\||!|==|=>"), "bool").when(t.rlike("[-+*/%]"), "int").otherwise("unknown")
    )


def null_checked(before: Column) -> Column:
    """Whether the 500 characters before an access test for null."""
    t = F.right(before, F.lit(500))
    guarded = F.regexp_extract_all(t, F.lit(r"if[ ]*\([ ]*([A-Za-z0-9_]+[ ]*&&[ ]*[A-Za-z0-9_]+)\."), F.lit(1))
    same = F.exists(guarded, lambda g: F.regexp_extract(g, "^([A-Za-z0-9_]+)", 1) == F.regexp_extract(g, "([A-Za-z0-9_]+)$", 1))
    return t.rlike(r"if[ ]*\([ ]*[A-Za-z0-9_]+[ ]*!==[ ]*null[ ]*\)") | t.rlike(r"[A-Za-z0-9_]\?\.") | same


def signature_text(s: Column) -> Column:
    """A signature struct (name, params, param_types, return_type, is_async, is_exported, is_generator, type_params,
    class_name) as it is declared; the class is named once."""
    shown = F.transform(s["params"], lambda p, i: F.concat(p, F.lit(": "), F.coalesce(F.get(s["param_types"], i), F.lit("any"))))
    flag = lambda c, word: F.when(F.coalesce(c, F.lit(False)), word).otherwise("")
    generic = F.when(F.size(F.coalesce(s["type_params"], F.array().cast("array<string>"))) > 0, F.concat(F.lit("<"), F.array_join(s["type_params"], ", "), F.lit(">"))).otherwise("")
    owner = F.when(s["class_name"].isNotNull() & ~s["name"].contains("."), F.concat(s["class_name"], F.lit("."))).otherwise("")
    return F.concat(flag(s["is_exported"], "export "), flag(s["is_async"], "async "), F.lit("function"), flag(s["is_generator"], "*"), F.lit(" "), owner, s["name"], generic, F.lit("("), F.array_join(shown, ", "), F.lit("): "), F.coalesce(s["return_type"], F.lit("any")))


def looked_up(key: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(other))


def entity_colour(kind: Column) -> Column:
    return looked_up(kind, ENTITY_COLOURS, OTHER_COLOUR)


def entity_icon(kind: Column) -> Column:
    return looked_up(kind, ENTITY_ICONS, OTHER_ICON)


def edge_colour(kind: Column) -> Column:
    return looked_up(kind, EDGE_COLOURS, OTHER_COLOUR)
