"""A reader of JavaScript and TypeScript: text -> tokens -> rows of syntax nodes.

It knows brackets, strings, templates, regular expressions, JSX and the declarations of both languages, not whole
expressions: enough for entities, imports, exports, calls, references and decision points. Each function here is plain
Python over one text; ``code`` runs them on files as a DataFrame.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

NAME = re.compile(r"[A-Za-z_$¡-￿][\w$¡-￿]*")
NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|\d[\d_]*(\.[\d_]*)?([eE][+-]?\d+)?n?|\.\d+([eE][+-]?\d+)?")
PUNCT = re.compile(r"=>|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
SPACE = re.compile(r"\s+")
#: After these a slash begins a regular expression and < may begin an element. Fixed values.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof await yield default extends".split())
KEYWORDS = frozenset("if else for while do switch case break continue return throw try catch finally const let var function class extends new delete typeof instanceof void this super null undefined true false async await yield import export default from as of in static get set interface type enum implements public private protected readonly abstract override declare namespace".split())
DECISIONS = {"if": "if", "for": "for", "while": "while", "do": "do", "switch": "switch", "catch": "catch"}
MODIFIERS = frozenset("static public private protected readonly abstract override async get set declare".split())
CLOSES = {"(": ")", "[": "]", "{": "}"}


class SyntaxProblem(ValueError):
    """The text can't be read; ``pos`` says from where on."""

    def __init__(self, message: str, pos: int) -> None:
        super().__init__(message)
        self.pos = pos


@dataclass
class Token:
    kind: str  # name, number, string, template, regex, punct, jsx
    text: str
    start: int
    end: int
    attrs: list[str] = field(default_factory=list)


class Lexer:
    def __init__(self, text: str, jsx: bool) -> None:
        self.text, self.jsx, self.tokens, self.comments = text, jsx, [], []

    def run(self) -> list[Token]:
        end = self.read(0, None)
        if end < len(self.text):
            raise SyntaxProblem("unbalanced bracket", end)
        return self.tokens

    def add(self, kind: str, start: int, end: int, attrs: list[str] | None = None) -> int:
        self.tokens.append(Token(kind, self.text[start:end], start, end, attrs or []))
        return end

    def value_may_begin(self) -> bool:
        if not self.tokens:
            return True
        last = self.tokens[-1]
        return last.text not in (")", "]", "}") if last.kind == "punct" else last.kind == "name" and last.text in BEFORE_VALUE

    def read(self, i: int, stop: str | None) -> int:
        """Tokens from ``i`` on, until the bracket ``stop`` that closes this level or the end; where that is."""
        text, open_, n = self.text, [], len(self.text)
        while i < n:
            c = text[i]
            if m := SPACE.match(text, i):
                i = m.end()
            elif text.startswith("//", i) or (i == 0 and text.startswith("#!")):
                end = text.find("\n", i)
                end = n if end < 0 else end
                self.comments.append((i, end))
                i = end
            elif text.startswith("/*", i):
                end = text.find("*/", i + 2)
                if end < 0:
                    raise SyntaxProblem("comment without end", i)
                self.comments.append((i, end + 2))
                i = end + 2
            elif c in "'\"":
                i = self.add("string", i, self.string_end(i))
            elif c == "`":
                i = self.template(i)
            elif m := NAME.match(text, i):
                i = self.add("name", i, m.end())
            elif (c.isdigit() or (c == "." and text[i + 1 : i + 2].isdigit())) and (m := NUMBER.match(text, i)):
                i = self.add("number", i, m.end())
            elif c == "/" and self.value_may_begin():
                i = self.add("regex", i, self.regex_end(i))
            elif c == "<" and self.jsx and self.value_may_begin() and re.match(r"<(>|[A-Za-z])", text[i : i + 2]):
                i = self.element(i)
            elif m := PUNCT.match(text, i):
                if c in CLOSES:
                    open_.append(CLOSES[c])
                elif c in ")]}":
                    if not open_ and c == stop:
                        return i
                    if not open_ or open_.pop() != c:
                        raise SyntaxProblem("unbalanced bracket", i)
                i = self.add("punct", i, m.end())
            else:
                raise SyntaxProblem(f"unknown character {c!r}", i)
        if open_ or stop:
            raise SyntaxProblem("bracket without end", n)
        return i

    def string_end(self, i: int) -> int:
        at = i + 1
        while at < len(self.text) and self.text[at] != self.text[i]:
            if self.text[at] == "\n":
                break
            at += 2 if self.text[at] == "\\" else 1
        if at >= len(self.text) or self.text[at] == "\n":
            raise SyntaxProblem("string without end", i)
        return at + 1

    def regex_end(self, i: int) -> int:
        at, in_class = i + 1, False
        while at < len(self.text) and (self.text[at] != "/" or in_class):
            c = self.text[at]
            if c == "\n":
                raise SyntaxProblem("regular expression without end", i)
            in_class = c == "[" or (in_class and c != "]")
            at += 2 if c == "\\" else 1
        if at >= len(self.text):
            raise SyntaxProblem("regular expression without end", i)
        return re.compile(r"/\w*").match(self.text, at).end()

    def template(self, i: int) -> int:
        """A template; what stands in ``${}`` follows it as tokens between brackets."""
        mark = len(self.tokens)
        self.tokens.append(Token("template", "", i, i))
        at = i + 1
        while at < len(self.text) and self.text[at] != "`":
            if self.text.startswith("${", at):
                self.add("punct", at + 1, at + 2)
                end = self.read(at + 2, "}")
                at = self.add("punct", end, end + 1)
            else:
                at += 2 if self.text[at] == "\\" else 1
        if at >= len(self.text):
            raise SyntaxProblem("template without end", i)
        self.tokens[mark] = Token("template", self.text[i : at + 1], i, at + 1)
        return at + 1

    def element(self, i: int) -> int:
        """An element with its attributes and children; expressions in braces follow as tokens between brackets."""
        text, start = self.text, i
        m = re.compile(r"<([A-Za-z][\w.:-]*)?").match(text, i)
        mark, attrs, i = len(self.tokens), [], m.end()
        self.tokens.append(Token("jsx", m.group(1) or "", start, m.end()))
        while True:
            i = (re.compile(r"\s*").match(text, i)).end()
            if text.startswith("/>", i):
                self.tokens[mark].attrs, self.tokens[mark].end = attrs, i + 2
                return i + 2
            if text.startswith(">", i):
                i += 1
                break
            if text.startswith("{", i):
                i = self.braces(i)
                attrs.append("...")
            elif a := re.compile(r"[A-Za-z_$@:][\w$:.-]*").match(text, i):
                attrs.append(a.group())
                i = a.end()
                if v := re.compile(r"\s*=\s*").match(text, i):
                    i = v.end()
                    if text[i : i + 1] in ("'", '"'):
                        i = text.find(text[i], i + 1) + 1
                        if not i:
                            raise SyntaxProblem("attribute without end", start)
                    elif text.startswith("{", i):
                        i = self.braces(i)
                    else:
                        raise SyntaxProblem("attribute without value", i)
            else:
                raise SyntaxProblem("element without end", start)
        while i < len(text):
            if text.startswith("</", i):
                end = text.find(">", i)
                if end < 0:
                    break
                self.tokens[mark].attrs, self.tokens[mark].end = attrs, end + 1
                return end + 1
            if text[i] == "{":
                i = self.braces(i)
            elif text[i] == "<":
                i = self.element(i)
            else:
                i += 1
        raise SyntaxProblem("element without end", start)

    def braces(self, i: int) -> int:
        self.add("punct", i, i + 1)
        end = self.read(i + 1, "}")
        return self.add("punct", end, end + 1)


class Reader:
    """Walks the tokens of one text and collects nodes: dicts of id, parent, kind, name, start, end, attrs."""

    def __init__(self, text: str, path: str = "") -> None:
        self.text = text
        self.t = Lexer(text, not path.endswith(".ts")).run()
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.match = self.matched()
        self.nodes: list[dict] = []
        self.program = self.node("program", path, 0, len(text), None)

    def line(self, pos: int) -> int:
        return bisect_right(self.lines, pos)

    def node(self, kind: str, name: str, start: int, end: int, parent: int | None, **attrs: object) -> int:
        said = {k: ("true" if v is True else "false" if v is False else str(v)) for k, v in attrs.items() if v is not None}
        self.nodes.append({"node_id": len(self.nodes), "parent_id": parent, "kind": kind, "name": name, "start": start, "end": end, "line": self.line(start), "end_line": self.line(max(start, end - 1)), "attrs": said})
        return len(self.nodes) - 1

    def matched(self) -> dict[int, int]:
        found, stack = {}, []
        for k, t in enumerate(self.t):
            if t.kind == "punct" and t.text in CLOSES:
                stack.append(k)
            elif t.kind == "punct" and t.text in (")", "]", "}"):
                found[stack[-1]] = k
                found[k] = stack.pop()
        return found

    def at(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "name"

    def slice(self, a: int, b: int) -> str:
        """The source between tokens a and b (b is left out)."""
        return self.text[self.t[a].start : self.t[b - 1].end] if a < b <= len(self.t) else ""

    def run(self) -> list[dict]:
        self.walk(0, len(self.t), self.program, "", 0)
        return self.nodes

    # --- pieces ---

    def angles(self, k: int) -> int:
        """The token after a list in angle brackets that begins at ``k``; ``k`` if there is none."""
        if self.at(k) != "<":
            return k
        depth, j = 0, k
        while j < len(self.t):
            if self.at(j) in CLOSES:
                j = self.match[j]
            elif self.at(j) == "<":
                depth += 1
            elif self.at(j) == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif self.at(j) in (";", "}"):
                return k
            j += 1
        return k

    def split(self, a: int, b: int, by: str = ",") -> list[tuple[int, int]]:
        """Ranges of tokens between separators at the level of a."""
        out, j, first = [], a, a
        while j < b:
            if self.at(j) in CLOSES and self.t[j].kind == "punct":
                j = self.match[j]
            elif self.at(j) == "<" and (end := self.angles(j)) > j and end <= b:
                j = end - 1
            elif self.at(j) == by and self.t[j].kind == "punct":
                out.append((first, j))
                first = j + 1
            j += 1
        return [*out, (first, b)] if first < b else out

    def type_end(self, k: int, stops: tuple[str, ...]) -> int:
        """The token after a type that begins at ``k``."""
        j = k
        while j < len(self.t):
            c = self.at(j)
            if self.t[j].kind == "punct" and c in stops and not (c == "{" and j == k):
                return j
            if self.t[j].kind == "punct" and c in CLOSES:
                j = self.match[j]
            elif c == "<" and (end := self.angles(j)) > j:
                j = end - 1
            elif c in (")", "]", "}", ";", ","):
                return j
            j += 1
        return j

    def params(self, open_: int) -> tuple[list[str], list[str], bool]:
        names, types, rest = [], [], False
        for a, b in self.split(open_ + 1, self.match[open_]):
            while self.at(a) in ("public", "private", "protected", "readonly") and self.is_name(a + 1):
                a += 1
            if self.at(a) == "...":
                rest, a = True, a + 1
            if self.at(a) in ("{", "["):
                end = self.match[a] + 1
                names.append(self.slice(a, end))
            else:
                end = a + 1
                names.append(self.at(a))
            if self.at(end) == "?":
                end += 1
            stop = next((j for j, _ in [(e, None) for e in range(end, b)] if self.at(j) == "=" and j >= end), b) if self.at(end) != ":" else self.type_end(end + 1, ("=",))
            types.append(self.slice(end + 1, min(stop, b)) if self.at(end) == ":" and end < b else "any")
        return names, types, rest

    def function(self, kind: str, name: str, start: int, open_: int, generics: str, parent: int, scope: str, depth: int, arrow: bool = False, **flags: object) -> int:
        """A function whose parameters open at token ``open_`` (or are one bare name there); the token after its body."""
        bare = self.at(open_) != "("
        names, types, rest = ([self.at(open_)], ["any"], False) if bare else self.params(open_)
        k = open_ + 1 if bare else self.match[open_] + 1
        returns = "any"
        if self.at(k) == ":":
            end = self.type_end(k + 1, ("=>",) if arrow else ("{", ";"))
            returns, k = self.slice(k + 1, end), end
        if arrow:
            k += 1
        if self.at(k) == "{":
            body, end = (k + 1, self.match[k]), self.match[k] + 1
            span = (self.t[k].start, self.t[end - 1].end)
        elif arrow:
            end = self.expression_end(k)
            body, span = (k, end), (self.t[k].start, self.t[end - 1].end) if end > k else (len(self.text),) * 2
        else:  # an overload or an abstract method
            return k
        full = f"{scope}.{name}" if scope else name
        me = self.node(kind, full, start, span[1], parent, short=name, depth=depth, params="\x1f".join(names), param_types="\x1f".join(types), return_type=returns, has_rest=rest, type_params=generics, body_start=span[0], body_end=span[1], block=self.text[span[0]] == "{", **flags)
        if not bare:
            self.references(open_ + 1, self.match[open_], me)
        self.walk(*body, me, full, depth + 1)
        return end

    def expression_end(self, k: int) -> int:
        j = k
        while j < len(self.t):
            c = self.at(j)
            if self.t[j].kind == "punct" and c in CLOSES:
                j = self.match[j]
            elif self.t[j].kind == "punct" and c in (",", ";", ")", "]", "}"):
                return j
            elif j > k and self.line(self.t[j].start) > self.line(self.t[j - 1].end - 1) and self.is_name(j) and self.at(j) in ("const", "let", "var", "function", "class", "export", "import", "return", "if", "for", "while", "interface", "type", "enum") and self.t[j - 1].kind != "punct":
                return j
            j += 1
        return j

    def arrow_at(self, k: int) -> tuple[int, bool] | None:
        """(token of the parameters, async) if an arrow function begins at ``k``."""
        is_async = self.at(k) == "async" and self.at(k + 1) != "=>"
        j = self.angles(k + is_async)
        if self.is_name(j) and self.at(j + 1) == "=>":
            return j, is_async
        if self.at(j) == "(":
            end = self.match[j] + 1
            if self.at(end) == ":":
                end = self.type_end(end + 1, ("=>",))
            if self.at(end) == "=>":
                return j, is_async
        return None

    # --- statements ---

    def walk(self, k: int, end: int, parent: int, scope: str, depth: int) -> None:
        while k < end:
            t = self.t[k]
            step = None
            if t.kind == "name" and self.at(k - 1) not in (".", "?."):
                step = self.statement(k, parent, scope, depth)
            if step is not None and step > k:
                k = step
                continue
            self.leaf(k, parent)
            k += 1

    def statement(self, k: int, parent: int, scope: str, depth: int) -> int | None:
        word, start, exported = self.at(k), self.t[k].start, False
        j = k
        if word == "import" and self.at(k + 1) not in ("(", "."):
            return self.import_statement(k, parent)
        if word == "export" and parent == self.program:
            if (found := self.export_statement(k, parent)) is not None:
                return found
            exported, j = True, k + 1
            if self.at(j) == "default":
                j += 1
                named = self.at(j + 1 + (self.at(j) == "async")) if self.at(j) in ("function", "class", "async", "abstract") else ""
                named = named if NAME.fullmatch(named or "") and named not in KEYWORDS else "default"
                self.node("export", named, start, self.t[j].end, parent, type="function" if self.at(j) in ("function", "async") else "class" if self.at(j) == "class" else "value", is_default=True)
                if self.at(j) not in ("function", "async", "class", "abstract"):
                    return j
        while self.at(j) in ("declare", "abstract") and self.is_name(j + 1):
            j += 1
        word, default = self.at(j), self.at(j - 1) == "default"
        is_async = word == "async" and self.at(j + 1) == "function"
        if is_async:
            j, word = j + 1, "function"
        if word == "function":
            star = self.at(j + 1) == "*"
            n = j + 1 + star
            name = self.at(n) if self.is_name(n) else ""
            open_ = self.angles(n + bool(name))
            if self.at(open_) != "(":
                return None
            if exported and not default:
                self.node("export", name, start, self.t[n].end, parent, type="function", is_default=False)
            return self.function("function", name or ("default" if default else "(anonymous)"), start, open_, self.slice(n + bool(name), open_), parent, scope, depth, is_async=is_async, is_generator=star, is_exported=exported)
        if word == "class" and (self.is_name(j + 1) or self.at(j + 1) == "{"):
            return self.class_statement(j, start, parent, scope, depth, exported, default)
        if word in ("interface", "enum") and self.is_name(j + 1):
            return self.shape(word, j, start, parent, exported)
        if word == "const" and self.at(j + 1) == "enum":
            return self.shape("enum", j + 1, start, parent, exported)
        if word == "type" and self.is_name(j + 1) and self.at(self.angles(j + 2)) == "=":
            a = self.angles(j + 2) + 1
            b = self.alias_end(a)
            if exported:
                self.node("export", self.at(j + 1), start, self.t[j + 1].end, parent, type="type", is_default=False)
            self.node("type", self.at(j + 1), start, self.t[b - 1].end, parent, value=self.slice(a, b), is_exported=exported)
            return b
        if word in ("const", "let", "var") and (self.is_name(j + 1) or self.at(j + 1) in ("{", "[")):
            return self.variables(j, start, parent, scope, depth, exported)
        return j if exported else None

    def alias_end(self, k: int) -> int:
        j = k
        while j < len(self.t):
            c = self.at(j)
            if self.t[j].kind == "punct" and c in CLOSES:
                j = self.match[j]
            elif c == "<" and (e := self.angles(j)) > j:
                j = e - 1
            elif c in (";", "}", ")"):
                return j
            elif j > k and self.line(self.t[j].start) > self.line(self.t[j - 1].end - 1) and c not in ("|", "&", "?", ":", "=>") and self.at(j - 1) not in ("|", "&", "?", ":", "=", "=>"):
                return j
            j += 1
        return j

    def import_statement(self, k: int, parent: int) -> int:
        start, j = self.t[k].start, k + 1
        type_only = self.at(j) == "type" and self.at(j + 1) != "from" and self.at(j + 1) != ","
        j += type_only
        names: list[tuple[str, str]] = []
        while j < len(self.t) and self.t[j].kind != "string":
            if self.at(j) == "*" and self.at(j + 1) == "as":
                names.append(("*", self.at(j + 2)))
                j += 3
            elif self.at(j) == "{":
                for a, b in self.split(j + 1, self.match[j]):
                    a += self.at(a) == "type" and b - a > 1 and self.at(a + 1) != "as"
                    names.append((self.at(a).strip("'\""), self.at(b - 1)))
                j = self.match[j] + 1
            elif self.is_name(j) and self.at(j) != "from":
                names.append(("default", self.at(j)))
                j += 1
            else:
                j += 1
        if j >= len(self.t):
            return k + 1
        source = self.t[j].text[1:-1]
        me = self.node("import", source, start, self.t[j].end, parent, is_type_only=type_only, how="static")
        for imported, local in names:
            self.node("import_name", local, start, self.t[j].end, me, imported=imported, source=source, is_type_only=type_only)
        j += 1
        return j + (self.at(j) == ";")

    def export_statement(self, k: int, parent: int) -> int | None:
        start, j = self.t[k].start, k + 1
        type_only = self.at(j) == "type" and self.at(j + 1) in ("{", "*")
        j += type_only
        if self.at(j) == "*":
            alias = self.at(j + 2) if self.at(j + 1) == "as" else "*"
            j += 2 if alias != "*" else 0
            if self.at(j + 1) == "from":
                source = self.at(j + 2)[1:-1]
                self.node("export_from", source, start, self.t[j + 2].end, parent, names=alias, how="re-export")
                if alias != "*":
                    self.node("export", alias, start, self.t[j + 2].end, parent, type="re-export", is_default=False, source=source)
                return j + 3 + (self.at(j + 3) == ";")
            return None
        if self.at(j) != "{":
            return None
        close = self.match[j]
        source = self.at(close + 2)[1:-1] if self.at(close + 1) == "from" else None
        said = []
        for a, b in self.split(j + 1, close):
            a += self.at(a) == "type" and b - a > 1 and self.at(a + 1) != "as"
            said.append(self.at(a))
            self.node("export", self.at(b - 1), start, self.t[close].end, parent, type="re-export" if source is not None else "name", local=self.at(a), is_default=self.at(b - 1) == "default", source=source)
        end = close + 1
        if source is not None:
            self.node("export_from", source, start, self.t[close + 2].end, parent, names=",".join(said), how="re-export")
            end = close + 3
        else:
            for a, _ in self.split(j + 1, close):
                self.leaf(a, parent)
        return end + (self.at(end) == ";")

    def shape(self, kind: str, j: int, start: int, parent: int, exported: bool) -> int:
        name, k = self.at(j + 1), self.angles(j + 2)
        over: list[str] = []
        if self.at(k) == "extends":
            e = self.type_end(k + 1, ("{",))
            while self.at(e) == ",":
                e = self.type_end(e + 1, ("{",))
            over = [self.slice(a, b) for a, b in self.split(k + 1, e)]
            k = e
        if self.at(k) != "{":
            return j + 1
        members = self.split(k + 1, self.match[k])
        found = [self.at(a) for a, _ in members] if kind == "enum" else [self.at(a) for a, _ in self.members(k)]
        if exported:
            self.node("export", name, start, self.t[j + 1].end, parent, type=kind, is_default=False)
        self.node(kind, name, start, self.t[self.match[k]].end, parent, extends=",".join(over), members=",".join(found), is_exported=exported)
        return self.match[k] + 1

    def members(self, open_: int) -> list[tuple[int, int]]:
        """Members of an interface, which end at ``;``, ``,`` or a line's end."""
        out, j, first, end = [], open_ + 1, open_ + 1, self.match[open_]
        while j < end:
            if self.t[j].kind == "punct" and self.at(j) in CLOSES:
                j = self.match[j]
            elif self.at(j) == "<" and (e := self.angles(j)) > j:
                j = e - 1
            elif self.at(j) in (";", ","):
                out.append((first, j))
                first = j + 1
            elif j > first and self.line(self.t[j].start) > self.line(self.t[j - 1].end - 1) and self.at(j - 1) not in ("|", "&", ":", "=>") and self.at(j) not in ("|", "&"):
                out.append((first, j))
                first = j
            j += 1
        return [(a, b) for a, b in [*out, (first, end)] if a < b]

    def class_statement(self, j: int, start: int, parent: int, scope: str, depth: int, exported: bool, default: bool) -> int:
        name = self.at(j + 1) if self.is_name(j + 1) and self.at(j + 1) not in ("extends", "implements") else "default"
        k = self.angles(j + 1 + (name != "default"))
        over, does = "", []
        if self.at(k) == "extends":
            e = self.type_end(k + 1, ("{",))
            e = next((x for x in range(k + 1, e) if self.at(x) == "implements"), e)
            over, k = self.slice(k + 1, e), e
        if self.at(k) == "implements":
            e = self.type_end(k + 1, ("{",))
            while self.at(e) == ",":
                e = self.type_end(e + 1, ("{",))
            does, k = [self.slice(a, b) for a, b in self.split(k + 1, e)], e
        if self.at(k) != "{":
            return j + 1
        if exported and not default:
            self.node("export", name, start, self.t[j + 1].end, parent, type="class", is_default=False)
        end = self.match[k]
        me = self.node("class", name, start, self.t[end].end, parent, extends=over, implements=",".join(does), is_exported=exported)
        m = k + 1
        while m < end:
            first, flags = m, set()
            while self.at(m) in MODIFIERS and self.at(m + 1) not in ("(", "=", ";", ":", "<", "?"):
                flags.add(self.at(m))
                m += 1
            star = self.at(m) == "*"
            m += star
            if self.at(m) == "#":
                m += 1
            if self.at(m) == "[":
                m = self.match[m]
            if self.at(m) == "@":
                m += 2 + (self.at(m + 2) == "(" and self.match[m + 2] - m - 1)
                continue
            open_ = self.angles(m + 1)
            if self.at(open_) == "(" and self.t[m].kind in ("name", "string", "number", "punct") and self.at(m) not in ("=", ":", ";", ","):
                m2 = self.function("method", self.at(m), self.t[first].start, open_, self.slice(m + 1, open_), me, name, depth + 1, is_async="async" in flags, is_generator=star, is_exported=exported, is_static="static" in flags, class_name=name)
                m = max(m2, m + 1)
            elif self.is_name(m) and self.at(m + 1) in ("=", ":", ";", "?", "!", ""):
                stop = m + 1
                if self.at(stop) in ("?", "!"):
                    stop += 1
                if self.at(stop) == ":":
                    stop = self.type_end(stop + 1, ("=", ";"))
                if self.at(stop) == "=":
                    if (arrow := self.arrow_at(stop + 1)) is not None:
                        m = self.function("method", self.at(m), self.t[first].start, arrow[0], "", me, name, depth + 1, arrow=True, is_async=arrow[1], is_generator=False, is_exported=exported, class_name=name)
                        continue
                    e = self.expression_end(stop + 1)
                    self.node("property", f"{name}.{self.at(m)}", self.t[first].start, self.t[e - 1].end, me, class_name=name)
                    self.walk(stop + 1, e, me, name, depth + 1)
                    m = e
                else:
                    self.node("property", f"{name}.{self.at(m)}", self.t[first].start, self.t[m].end, me, class_name=name)
                    m = stop
            else:
                m += 1
        return end + 1

    def variables(self, j: int, start: int, parent: int, scope: str, depth: int, exported: bool) -> int:
        how, k = self.at(j), j + 1
        while k < len(self.t):
            if self.at(k) in ("{", "["):
                names = [self.t[x].text for x in range(k + 1, self.match[k]) if self.is_name(x) and self.at(x + 1) in (",", "}", "]", "=") and self.at(x) not in KEYWORDS]
                after = self.match[k] + 1
            else:
                names, after = [self.at(k)], k + 1
            if self.at(after) == "!":
                after += 1
            if self.at(after) == ":":
                after = self.type_end(after + 1, ("=", ";"))
            value = after + 1 if self.at(after) == "=" else None
            arrow = self.arrow_at(value) if value is not None and len(names) == 1 else None
            is_async = value is not None and self.at(value) == "async" and self.at(value + 1) == "function"
            if exported:
                for name in names:
                    self.node("export", name, start, self.t[k].end, parent, type="function" if arrow or (value is not None and self.at(value + is_async) == "function") else how, is_default=False)
            if arrow is not None:
                k = self.function("arrow", names[0], start, arrow[0], self.slice(value + arrow[1], arrow[0]), parent, scope, depth, arrow=True, is_async=arrow[1], is_generator=False, is_exported=exported)
            elif value is not None and self.at(value + is_async) == "function":
                n = value + is_async + 1
                star = self.at(n) == "*"
                n += star
                n += self.is_name(n)
                k = self.function("function", names[0], start, self.angles(n), "", parent, scope, depth, is_async=is_async, is_generator=star, is_exported=exported)
            else:
                end = self.expression_end(value) if value is not None else after
                kind, literal = self.literal(value, end) if value is not None else ("none", "")
                for name in names:
                    full = f"{scope}.{name}" if scope else name
                    self.node("variable", full, start, self.t[end - 1].end, parent, short=name, declared=how, literal=kind, value=literal, value_start=self.t[value].start if value is not None and value < end else None, value_end=self.t[end - 1].end if value is not None and value < end else None, is_exported=exported, depth=depth)
                if value is not None:
                    self.walk(value, end, parent, scope, depth)
                k = end
            if self.at(k) != ",":
                return k
            k += 1
        return k

    def literal(self, a: int, b: int) -> tuple[str, str]:
        """(kind, value) of an initial value: literal, template, regex, array, object, call or other."""
        first = self.t[a] if a < len(self.t) else None
        if first is None or b <= a:
            return "none", ""
        if b == a + 1:
            if first.kind == "string":
                return "literal", first.text[1:-1]
            if first.kind == "number" or first.text in ("true", "false", "null"):
                return "literal", first.text
            if first.kind in ("template", "regex"):
                return first.kind, first.text
        if b == a + 2 and first.text in ("-", "+") and self.t[a + 1].kind == "number":
            return "literal", first.text + self.at(a + 1)
        if first.text == "[" and self.match[a] == b - 1:
            return "array", "\x1f".join(self.slice(x, y).strip("'\"") for x, y in self.split(a + 1, b - 1))
        if first.text == "{" and self.match[a] == b - 1:
            return "object", ""
        return ("call" if self.at(b - 1) == ")" and self.is_name(self.match[b - 1] - 1) else "other"), ""

    def references(self, a: int, b: int, parent: int) -> None:
        for k in range(a, b):
            self.leaf(k, parent)

    def leaf(self, k: int, parent: int) -> None:
        """What a single token says: a call, a reference, a decision, an element."""
        t, word = self.t[k], self.t[k].text
        if t.kind == "jsx":
            self.node("jsx", word, t.start, t.end, parent, attrs="\x1f".join(t.attrs))
            if word[:1].isupper():
                self.node("identifier", word.split(".")[0], t.start + 1, t.start + 1 + len(word), parent)
        elif t.kind == "punct":
            if word in ("&&", "||"):
                self.node("and" if word == "&&" else "or", word, t.start, t.end, parent)
            elif word == "?" and self.at(k + 1) not in (":", ".", ")", ",", "=") and self.at(k - 1) not in (",", "("):
                self.node("ternary", "?", t.start, t.end, parent)
        elif t.kind == "name":
            member = self.at(k - 1) in (".", "?.")
            if not member and word in DECISIONS:
                self.node(DECISIONS[word], word, t.start, t.end, parent)
            elif not member and word == "return":
                self.node("return", word, t.start, t.end, parent)
            elif not member and word == "import" and self.at(k + 1) == "(" and self.t[k + 2].kind == "string":
                self.node("import", self.at(k + 2)[1:-1], t.start, self.t[k + 2].end, parent, is_type_only=False, how="dynamic")
            elif not member and word == "require" and self.at(k + 1) == "(" and self.t[k + 2].kind == "string":
                self.node("import", self.at(k + 2)[1:-1], t.start, self.t[k + 2].end, parent, is_type_only=False, how="require")
            elif member or word not in KEYWORDS or word in ("this", "super"):
                after = self.angles(k + 1)
                defined = self.at(after) == "(" and self.at(k - 1) in ("{", ",", "async", "get", "set") and self.at(self.match[after] + 1) == "{"  # a method of an object
                called = (self.at(after) == "(" and not defined) or (self.at(after) == "?." and self.at(after + 1) == "(")
                if called and word not in ("this", "super"):
                    chain, b = word, k
                    while self.at(b - 1) in (".", "?.") and self.is_name(b - 2):
                        chain, b = f"{self.at(b - 2)}.{chain}", b - 2
                    open_ = after if self.at(after) == "(" else after + 1
                    first = self.split(open_ + 1, self.match[open_])[:1]
                    told = self.slice(*first[0]) if first else None
                    self.node("call", word, t.start, t.end, parent, member=member, chain=chain, new=self.at(b - 1) == "new", first_argument=told if told is None or len(told) < 200 else told[:200])
                if not member and self.at(k + 1) != ":" and word not in KEYWORDS:
                    self.node("identifier", word, t.start, t.end, parent)
                elif not member and word not in KEYWORDS and self.at(k - 1) == "?":
                    self.node("identifier", word, t.start, t.end, parent)


def read(text: str, path: str = "") -> list[dict]:
    """Nodes of a text; one that can't be read gives its program node and an ``error`` node with what is wrong and where."""
    try:
        return Reader(text, path).run()
    except SyntaxProblem as problem:
        line = text.count("\n", 0, problem.pos) + 1
        blank = {"node_id": 0, "parent_id": None, "kind": "program", "name": path, "start": 0, "end": len(text), "line": 1, "end_line": text.count("\n") + 1, "attrs": {}}
        return [blank, blank | {"node_id": 1, "parent_id": 0, "kind": "error", "name": str(problem), "start": problem.pos, "end": len(text), "line": line}]
