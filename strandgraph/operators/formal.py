"""Checks of contracts and expressions on bounded domains.

Expressions are parsed with the usual precedences, operators of one level from the left, and become columns; a check is a
query over all points of the inputs' ranges, numbered by one ``range`` so that no domains are joined. A result holds for
these bounds only, which go along with it; it is no proof.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(=>|\|\||&&|===|!==|==|!=|<=|>=|[-+*/%<>!()?:]|\d+(?:\.\d+)?|[A-Za-z_]\w*(?:\.\w+)*|'[^']*'|\"[^\"]*\")")
LEVELS = (("=>",), ("||",), ("&&",), ("==", "!=", "===", "!=="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))
#: Points of a domain that a check may have.
MOST = 50_000_000

Node = tuple  # ("num", 3) ("name", "a") ("bool", True) ("str", "x") ("not", n) ("neg", n) (operator, left, right) ("if", c, a, b)


class ExpressionProblem(ValueError):
    """What is wrong with an expression."""


def parse(text: str) -> Node:
    """An expression's tree. ``=>`` is implication, from the right; everything else of one level is from the left."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionProblem(f"can't read {text[at:]!r}")
        tokens.append(m.group(1))
        at = m.end()
    place = 0

    def peek() -> str | None:
        return tokens[place] if place < len(tokens) else None

    def take(wanted: str | None = None) -> str:
        nonlocal place
        if place >= len(tokens) or (wanted and tokens[place] != wanted):
            raise ExpressionProblem(f"{wanted or 'a value'} is missing in {text!r}")
        place += 1
        return tokens[place - 1]

    def choice() -> Node:
        condition = binary(0)
        if peek() != "?":
            return condition
        take("?")
        yes = choice()
        take(":")
        return "if", condition, yes, choice()

    def binary(level: int) -> Node:
        if level == len(LEVELS):
            return unary()
        left = binary(level + 1)
        while peek() in LEVELS[level]:
            op = take()
            if op == "=>":
                return "=>", left, binary(level)
            left = (op[:2] if op in ("===", "!==") else op, left, binary(level + 1))
        return left

    def unary() -> Node:
        t = peek()
        if t in ("!", "-"):
            take()
            return ("not" if t == "!" else "neg"), unary()
        t = take()
        if t == "(":
            inside = choice()
            take(")")
            return inside
        if re.fullmatch(r"\d+(\.\d+)?", t):
            return "num", float(t) if "." in t else int(t)
        if t in ("true", "false"):
            return "bool", t == "true"
        if t[0] in "'\"":
            return "str", t[1:-1]
        if re.match("[A-Za-z_]", t):
            return "name", t
        raise ExpressionProblem(f"{t!r} in {text!r}")

    tree = choice()
    if place < len(tokens):
        raise ExpressionProblem(f"{tokens[place]!r} is left over in {text!r}")
    return tree


def names(tree: Node) -> set[str]:
    return {tree[1]} if tree[0] == "name" else set().union(*(names(t) for t in tree[1:] if isinstance(t, tuple)))


def column(tree: Node, values: dict[str, Column] | None = None) -> Column:
    """The tree as a column; names are columns or what ``values`` says. Division of whole numbers is exact, % is as in the
    language: of the sign of the dividend."""
    kind, rest = tree[0], tree[1:]
    if kind in ("num", "bool", "str"):
        return F.lit(rest[0])
    if kind == "name":
        return (values or {}).get(rest[0], F.col(rest[0]) if values is None else None) if values is None or rest[0] in values else F.col(rest[0])
    a, *others = (column(t, values) for t in rest)
    b = others[0] if others else None
    table: dict[str, Callable[[], Column]] = {
        "not": lambda: ~a, "neg": lambda: -a, "if": lambda: F.when(a, b).otherwise(others[1]), "=>": lambda: ~a | b, "||": lambda: a | b, "&&": lambda: a & b, "==": lambda: a.eqNullSafe(b), "!=": lambda: ~a.eqNullSafe(b),
        "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / F.nullif(b, F.lit(0)), "%": lambda: a % F.nullif(b, F.lit(0)),
    }
    return table[kind]()


@dataclass
class Contract:
    """What a function takes, needs, returns and promises. ``inputs`` are ranges of whole numbers, or ``bool``."""

    name: str
    inputs: dict[str, tuple[int, int] | str]
    result: str | None = None
    pre: list[str] = field(default_factory=list)
    post: list[str] = field(default_factory=list)
    invariants: list[str] = field(default_factory=list)


def template(name: str, inputs: dict[str, str], bound: int = 100) -> Contract:
    """A contract from sorts: ``int`` within the bound either way, ``nat`` from 0, ``positive`` from 1, ``bool``."""
    ranges = {"int": (-bound, bound), "nat": (0, bound), "positive": (1, bound), "bool": "bool"}
    return Contract(name, {k: ranges[v] for k, v in inputs.items()})


def domain(spark: SparkSession, inputs: dict[str, tuple[int, int] | str]) -> DataFrame:
    """All points of the inputs' ranges, a column an input."""
    sizes = {k: 2 if v == "bool" else max(0, v[1] - v[0] + 1) for k, v in inputs.items()}
    total = 1
    for n in sizes.values():
        total *= n
    if total > MOST:
        raise ExpressionProblem(f"{total} points are more than {MOST}")
    out, left = [], F.col("id")
    for k, v in inputs.items():
        here = left % sizes[k] if sizes[k] else left
        out.append((here == 1).alias(k) if v == "bool" else (here + v[0]).alias(k))
        left = F.floor(left / max(1, sizes[k]))
    return spark.range(total).select(*out) if out else spark.range(1).select(F.lit(True).alias("always"))


def _all(parts: list[str], values: dict[str, Column] | None = None) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & column(parse(p), values)
    return out


def counterexamples(spark: SparkSession, c: Contract) -> DataFrame:
    """Points that meet the conditions and invariants and not the promises; ``result`` is the body's value."""
    points = domain(spark, c.inputs)
    points = points.withColumn("result", column(parse(c.result))) if c.result else points
    return points.where(_all(c.pre) & _all(c.invariants)).where(~F.coalesce(_all(c.post), F.lit(False)))


def verify(spark: SparkSession, c: Contract) -> DataFrame:
    """One row: ``name, valid, checked, counterexample`` (JSON of the first one by its inputs' order, null if none)."""
    wrong = counterexamples(spark, c).orderBy(*c.inputs).limit(1).select(F.to_json(F.struct("*")).alias("counterexample"))
    points = domain(spark, c.inputs).agg(F.count("*").alias("checked"))
    return points.join(wrong, how="left").select(F.lit(c.name).alias("name"), F.col("counterexample").isNull().alias("valid"), "checked", "counterexample")  # one row each


def equivalent(spark: SparkSession, a: str, b: str, inputs: dict[str, tuple[int, int] | str]) -> DataFrame:
    """One row: ``equivalent, checked, counterexample``. Sums of products that are the same are so without a search."""
    if same_polynomial(parse(a), parse(b)):
        return spark.range(1).select(F.lit(True).alias("equivalent"), F.lit(0).cast("long").alias("checked"), F.lit(None).cast("string").alias("counterexample"))
    points = domain(spark, inputs)
    wrong = points.where(~column(parse(a)).eqNullSafe(column(parse(b)))).orderBy(*inputs).limit(1).select(F.to_json(F.struct("*")).alias("counterexample"))
    return points.agg(F.count("*").alias("checked")).join(wrong, how="left").select(F.col("counterexample").isNull().alias("equivalent"), "checked", "counterexample")


def polynomial(tree: Node) -> dict[tuple[str, ...], float] | None:
    """Monomials with their factors, if the tree is a sum of products; else None."""
    kind = tree[0]
    if kind == "num":
        return {(): tree[1]} if tree[1] else {}
    if kind == "name":
        return {(tree[1],): 1}
    if kind == "neg" and (p := polynomial(tree[1])) is not None:
        return {k: -v for k, v in p.items()}
    if kind in ("+", "-", "*"):
        x, y = polynomial(tree[1]), polynomial(tree[2])
        if x is None or y is None:
            return None
        out: dict[tuple[str, ...], float] = {} if kind == "*" else dict(x)
        for k, v in y.items():
            if kind == "*":
                for j, w in x.items():
                    m = tuple(sorted(j + k))
                    out[m] = out.get(m, 0) + v * w
            else:
                out[k] = out.get(k, 0) + (v if kind == "+" else -v)
        return {k: v for k, v in out.items() if v}
    return None


def same_polynomial(a: Node, b: Node) -> bool:
    x, y = polynomial(a), polynomial(b)
    return x is not None and x == y


def loop_invariant(spark: SparkSession, inputs: dict[str, tuple[int, int] | str], invariant: str, condition: str, step: dict[str, str], pre: str = "true", post: str = "true") -> DataFrame:
    """One row: ``initial, kept, enough, checked``: the condition before gives the invariant, a turn keeps it, and it gives the
    condition after once the loop ends. ``step`` maps names to their next values."""
    after = {k: column(parse(v)) for k, v in step.items()}
    inv, cond = parse(invariant), column(parse(condition))
    holds = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    return domain(spark, inputs).agg(holds(~column(parse(pre)) | column(inv)).alias("initial"), holds(~(column(inv) & cond) | column(inv, after)).alias("kept"), holds(~(column(inv) & ~cond) | column(parse(post))).alias("enough"), F.count("*").alias("checked"))


def array_property(array: Column, predicate: str, item: str = "x") -> Column:
    """Whether each item of an array column has a property, as ``x >= 0``; true for an empty array."""
    tree = parse(predicate)
    return F.forall(array, lambda x: F.coalesce(column(tree, {item: x}), F.lit(False)))


# --- constraints as trees: ("eq", a, b) ("range", x, lo, hi) ("implies", p, q) ("and", ...) ("or", ...) ("not", p) ("if", c, p, q)
# ("forall", array, item, p) and comparisons; leaves are expressions as text ---


def constraint(tree: tuple) -> Column:
    kind, rest = tree[0], tree[1:]
    value = lambda x: constraint(x) if isinstance(x, tuple) else column(parse(str(x)))
    if kind == "range":
        return value(rest[0]).between(value(rest[1]), value(rest[2]))
    if kind == "forall":
        return array_property(F.col(rest[0]), rest[2], rest[1])
    if kind in ("and", "or"):
        out = value(rest[0])
        for x in rest[1:]:
            out = out & value(x) if kind == "and" else out | value(x)
        return out
    if kind == "not":
        return ~value(rest[0])
    if kind == "implies":
        return ~value(rest[0]) | value(rest[1])
    if kind == "if":
        return F.when(value(rest[0]), value(rest[1])).otherwise(value(rest[2]) if len(rest) > 2 else F.lit(True))
    signs = {"eq": "==", "neq": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    a, b = value(rest[0]), value(rest[1])
    return {"==": a.eqNullSafe(b), "!=": ~a.eqNullSafe(b), "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[signs[kind]]


def eq(a: object, b: object) -> tuple:
    return "eq", a, b


def neq(a: object, b: object) -> tuple:
    return "neq", a, b


def in_range(x: object, low: object, high: object) -> tuple:
    return "range", x, low, high


def implies(p: object, q: object) -> tuple:
    return "implies", p, q


def both(*parts: object) -> tuple:
    return "and", *parts


def either(*parts: object) -> tuple:
    return "or", *parts


def negated(p: object) -> tuple:
    return "not", p


def if_(c: object, p: object, q: object = "true") -> tuple:
    return "if", c, p, q


# --- bodies and comments ---


def body_expression(body: str) -> str | None:
    """A function's value as one expression: of ``return e``, of ``if (c) return a; else return b`` chains, of constants before
    them that are put in; None for anything else."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", body, flags=re.S).strip().removeprefix("{").removesuffix("}").strip()
    known: dict[str, str] = {}

    def filled(e: str) -> str:
        for k, v in reversed(known.items()):
            e = re.sub(rf"\b{k}\b", f"({v})", e)
        return e.strip()

    while m := re.match(r"(?:const|let|var)\s+(\w+)\s*=\s*([^;\n]+);?\s*", text):
        known[m.group(1)] = filled(m.group(2))
        text = text[m.end() :]

    def value(t: str) -> str | None:
        t = t.strip()
        if m := re.fullmatch(r"return\s+([^;]+);?", t):
            return filled(m.group(1))
        if m := re.match(r"if\s*\(", t):
            depth, k = 1, m.end()
            while k < len(t) and depth:
                depth += (t[k] == "(") - (t[k] == ")")
                k += 1
            test, rest = filled(t[m.end() : k - 1]), t[k:].strip()
            yes = re.match(r"\{([^{}]*)\}|return[^;]*;?", rest)
            if not yes:
                return None
            no = re.sub(r"^\s*else\b", "", rest[yes.end() :]).strip()
            no = no[1:-1] if no.startswith("{") and no.endswith("}") else no
            a, b = value(yes.group(1) if yes.group(1) is not None else yes.group(0)), value(no)
            return None if a is None or b is None else f"(({test}) ? ({a}) : ({b}))"
        return None

    found = value(text)
    try:
        if found is not None:
            parse(found)
    except ExpressionProblem:
        return None
    return found


def contract_from_comment(comment: Column) -> Column:
    """``params`` with the ranges that a documentation comment gives them: positive from 1, non-negative from 0, else any."""
    said = F.regexp_extract_all(comment, F.lit(r"(@param\s+(?:\{[^}]*\}\s*)?[A-Za-z_$][A-Za-z0-9_$]*[^\n@]*)"), F.lit(1))
    least = lambda p: F.when(F.lower(p).rlike("non-negative|nonnegative"), 0).when(F.lower(p).rlike("positive"), 1)
    return F.transform(said, lambda p: F.struct(F.regexp_extract(p, r"@param\s+(?:\{[^}]*\}\s*)?([A-Za-z_$][A-Za-z0-9_$]*)", 1).alias("name"), F.regexp_extract(p, r"\{([^}]*)\}", 1).alias("type"), least(p).alias("least")))


def functions_equivalent(spark: SparkSession, body_a: str, body_b: str, inputs: dict[str, tuple[int, int] | str]) -> DataFrame:
    """One row: ``equivalent, confidence, how, counterexample``: equal text but for blanks and comments, else equal values on the
    inputs' ranges, else unknown (confidence 0.5)."""
    plain = lambda b: re.sub(r"\s+|//[^\n]*|/\*.*?\*/", "", b, flags=re.S)
    say = lambda ok, sure, how: spark.createDataFrame([(ok, sure, how, None)], "equivalent boolean, confidence double, how string, counterexample string")
    if plain(body_a) == plain(body_b):
        return say(True, 1.0, "text")
    a, b = body_expression(body_a), body_expression(body_b)
    if a is None or b is None:
        return say(False, 0.5, "not modelled")
    return equivalent(spark, a, b, inputs).select("equivalent", F.when(F.col("equivalent"), 0.95).otherwise(1.0).alias("confidence"), F.lit("values").alias("how"), "counterexample")


def decompose(text: str) -> list[str]:
    """The parts of a conjunction, as text."""
    out: list[str] = []

    def walk(tree: Node) -> None:
        if tree[0] == "&&":
            walk(tree[1])
            walk(tree[2])
        else:
            out.append(shown(tree))

    walk(parse(text))
    return out


def shown(tree: Node) -> str:
    kind, rest = tree[0], tree[1:]
    if kind in ("num", "name"):
        return str(rest[0])
    if kind in ("bool", "str"):
        return str(rest[0]).lower() if kind == "bool" else repr(rest[0])
    if kind in ("not", "neg"):
        return f"{'!' if kind == 'not' else '-'}{shown(rest[0])}"
    if kind == "if":
        return f"({shown(rest[0])} ? {shown(rest[1])} : {shown(rest[2])})"
    return f"({shown(rest[0])} {kind} {shown(rest[1])})"
