"""Expressions, contracts and equivalence on bounded domains."""

import pytest

from strandgraph.operators import formal


@pytest.mark.parametrize(("text", "tree"), [
    ("a - b - c", ("-", ("-", ("name", "a"), ("name", "b")), ("name", "c"))), ("!a && b || c", ("||", ("&&", ("not", ("name", "a")), ("name", "b")), ("name", "c"))),
    ("a => b => c", ("=>", ("name", "a"), ("=>", ("name", "b"), ("name", "c")))), ("a * (b + 2)", ("*", ("name", "a"), ("+", ("name", "b"), ("num", 2)))), ("-a < 'x'", ("<", ("neg", ("name", "a")), ("str", "x"))),
    ("a ? 1 : b ? 2 : 3", ("if", ("name", "a"), ("num", 1), ("if", ("name", "b"), ("num", 2), ("num", 3)))),
])
def test_parsing(text, tree):
    assert formal.parse(text) == tree


@pytest.mark.parametrize("text", ["", "a +", "(a", "a b", "a ? b", "#"])
def test_what_cannot_be_read(text):
    with pytest.raises(formal.ExpressionProblem):
        formal.parse(text)


def test_contracts(spark):
    ok = formal.Contract("abs", {"x": (-50, 50)}, "x < 0 ? -x : x", [], ["result >= 0"])
    bad = formal.Contract("half", {"x": (0, 10), "up": "bool"}, "x * 2", ["x > 2"], ["!up || result < 12"])
    assert formal.verify(spark, ok).first()["valid"] is True
    got = formal.verify(spark, bad).first()
    assert got["valid"] is False and got["checked"] == 22 and got["counterexample"] == '{"x":6,"up":true,"result":12}'
    assert formal.counterexamples(spark, formal.template("t", {"n": "positive"}, 5)).count() == 0
    with pytest.raises(formal.ExpressionProblem):
        formal.domain(spark, {k: (0, 10**4) for k in "abc"})


def test_equivalence(spark):
    one = lambda a, b, **r: formal.equivalent(spark, a, b, r or {"a": (-9, 9), "b": (-9, 9)}).first()
    assert one("a + b", "b + a")["equivalent"] and one("a * (a + b)", "a * a + b * a")["checked"] == 0
    assert one("a > b", "b < a")["equivalent"] and not one("a / b", "b / a")["equivalent"]
    how = lambda x, y: formal.functions_equivalent(spark, x, y, {"a": (-5, 5), "b": (-5, 5)}).first().asDict()
    assert how("{ return a; } // x", "{ return  a; }")["how"] == "text"
    assert how("{ while (a) {} }", "{ return a; }") == {"equivalent": False, "confidence": 0.5, "how": "not modelled", "counterexample": None}
    assert how("{ if (a > b) { return a - b; } else { return b - a; } }", "{ return b > a ? b - a : a - b; }")["equivalent"]
    assert how("{ return a; }", "{ return b; }")["counterexample"] == '{"a":-5,"b":-4}'


def test_decomposition():
    assert formal.decompose("a > 1 && (b || c) && !d") == ["(a > 1)", "(b || c)", "!d"]
    assert formal.shown(formal.parse("a ? -1 : 'x'")) == "(a ? -1 : 'x')"
