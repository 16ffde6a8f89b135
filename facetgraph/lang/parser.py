"""Lexer and Pratt parser."""

from __future__ import annotations

import json
import re

from .ast import Bind, Call, Const, Construct, FilterSet, Item, Op, Prop, Ref, Star

# The language's reserved words.
KEYWORDS = set("and or not maybe in where group by order asc desc limit offset depth mergeall namemap omitnull true false null".split())
CLAUSES = {"where", "group", "order", "limit", "offset", "depth", "mergeall", "namemap"}
TOKEN = re.compile(
    r"""(?P<skip>\s+|/\*.*?\*/|//[^\n]*|\#[^\n]*)
    |(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
    |(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
    |(?P<ref>@<[^>]*>|@(?:::)?[\w:/.#~%+-]*[\w/#~%+-])
    |(?P<label>\?[A-Za-z_]\w*)
    |(?P<bind>:[A-Za-z_]\w*)
    |(?P<quoted><[^<>=\s][^<>]*>)
    |(?P<name>[A-Za-z_$][\w$]*)
    |(?P<op>==|!=|<=|>=|[-+*/%=<>(){}\[\],:.])""",
    re.X | re.S,
)
# Arguments that may be given by name; other names before = are properties that are compared.
NAMED = {"excludeInitial", "edgesOnly"}
COMPARE = {"=": "=", "==": "=", "!=": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
ARITH = {"+": "add", "-": "sub", "*": "mul", "/": "div", "%": "mod"}


class QueryError(ValueError):
    """The query's text or meaning is wrong."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at : at + 10]!r}")
        kind, value = m.lastgroup, m[0]
        at = m.end()
        # a bind follows an operator or an opening; after a key the colon stands alone
        if kind == "bind" and out and (out[-1][0] in ("string", "quoted", "label") or out[-1][0] == "name" or out[-1][1] in ")]"):
            at = m.start() + 1
            out.append(("op", ":"))
            continue
        if kind == "name" and value.lower() in KEYWORDS:
            kind, value = "word", value.lower()
        if kind != "skip":
            out.append((kind, value))
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.toks, self.at = tokens(text), 0

    def peek(self, *values: str, ahead: int = 0) -> bool:
        kind, value = self.toks[min(self.at + ahead, len(self.toks) - 1)]
        return value in values and kind in ("op", "word")

    def kind(self, ahead: int = 0) -> str:
        return self.toks[min(self.at + ahead, len(self.toks) - 1)][0]

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, *values: str) -> str:
        if not self.peek(*values):
            raise QueryError(f"expected {' or '.join(values)}, not {self.toks[self.at][1] or 'the end'!r}")
        self.at += 1
        return self.toks[self.at - 1][1]

    # constructs

    def query(self) -> Construct:
        c = self.construct()
        if self.kind() != "end":
            raise QueryError(f"unexpected {self.toks[self.at][1]!r} after the query")
        return c

    def construct(self) -> Construct:
        kind = {"{": "dict", "[": "list", "(": "value"}[self.need("{", "[", "(")]
        end = {"dict": "}", "list": "]", "value": ")"}[kind]
        c = Construct(kind, None, [])
        if self.kind() == "label" and not self.peek(".", ahead=1) and not (kind != "dict" and self.peek(end, ",", ahead=1)):
            c.label = self.toks[self.at][1][1:]
            self.at += 1
            self.take(",")
        while not self.peek(end):
            if self.kind() == "word" and self.toks[self.at][1] in CLAUSES:
                self.clause(c)
            else:
                c.items.append(self.item(kind))
            self.take(",")
        self.need(end)
        return c

    def flags(self) -> dict:
        omit = self.take("omitnull")
        return {"omit_null": omit, "maybe": self.take("maybe")}

    def item(self, kind: str) -> Item:
        if self.peek("*") and not self.peek(":", ahead=1):
            self.at += 1
            return Item("*", Star())
        if kind != "dict":
            return Item(None, self.value()) if self.peek("{") else self.flagged(None)
        if self.peek("["):  # [maybe prop]: always a list
            self.at += 1
            f = self.flags()
            value = self.expression()
            self.need("]")
            return Item(self.name_of(value), value, force_list=True, **f)
        f = self.flags()
        key = self.expression()
        if self.take(":"):
            return self.flagged(key.value if isinstance(key, Const) else key)
        return Item(self.name_of(key), key, **f)

    def flagged(self, key) -> Item:
        f = self.flags()
        if self.peek("*"):
            self.at += 1
            return Item(key, Star(), **f)
        if self.peek("[") and key is not None:
            at = self.at
            self.at += 1
            g = self.flags()
            value = self.value()
            if self.take("]"):
                return Item(key, value, force_list=True, **{k: f[k] or g[k] for k in f})
            self.at = at
        return Item(key, self.value(), **f)

    def value(self):
        return self.construct() if self.peek("{", "[") else self.expression()

    def name_of(self, e) -> str:
        if isinstance(e, Prop) and e.path:
            return e.path[-1]
        raise QueryError("an item without a key must be a property")

    def clause(self, c: Construct) -> None:
        word = self.need(*CLAUSES)
        if word == "where":
            c.where = self.expression()
        elif word == "group":
            self.need("by")
            c.group = self.expression()
        elif word == "order":
            self.need("by")
            while True:
                e = self.expression()
                c.order.append((e, not self.take("asc") and self.take("desc")))
                if not (self.peek(",") and not (self.kind(1) == "word" and self.toks[self.at + 1][1] in CLAUSES)):
                    break
                self.at += 1
        elif word in ("limit", "offset", "depth"):
            if self.kind() != "number":
                raise QueryError(f"{word} needs a number")
            setattr(c, word, int(self.toks[self.at][1]))
            self.at += 1
        elif word == "mergeall":
            c.merge_all = True
        else:
            self.take("=")
            c.name_map = self.json()

    def json(self):
        if self.take("{"):
            out = {}
            while not self.take("}"):
                key = self.json()
                self.need(":")
                out[key] = self.json()
                self.take(",")
            return out
        kind, value = self.toks[self.at]
        self.at += 1
        if kind in ("string", "number"):
            return self.literal(kind, value)
        raise QueryError(f"unexpected {value!r} in a namemap")

    # expressions

    def expression(self, level: int = 0):
        if level == 0:
            return self.chain(["or"], 1)
        if level == 1:
            return self.chain(["and"], 2)
        if level == 2:
            return Op("maybe", (self.expression(2),)) if self.take("maybe") else self.expression(3)
        if level == 3:
            return Op("not", (self.expression(3),)) if self.take("not") else self.expression(4)
        if level == 4:
            left = self.expression(5)
            while self.peek("in") or (self.peek("not") and self.peek("in", ahead=1)):
                no = self.take("not")
                self.need("in")
                e = Op("in", (left, self.members()))
                left = Op("not", (e,)) if no else e
            return left
        if level == 5:
            left = self.expression(6)
            if self.kind() == "op" and self.toks[self.at][1] in COMPARE:
                name = COMPARE[self.need(*COMPARE)]
                return Op(name, (left, Op("maybe", (self.expression(6),)) if self.take("maybe") else self.expression(6)))
            return left
        if level in (6, 7):
            ops, left = (("+", "-"), ("*", "/", "%"))[level - 6], self.expression(level + 1)
            while self.peek(*ops):
                left = Call(ARITH[self.need(*ops)], (left, self.expression(level + 1)))
            return left
        if self.take("-"):
            e = self.expression(8)
            return Const(-e.value) if isinstance(e, Const) and isinstance(e.value, int | float) and not isinstance(e.value, bool) else Call("negate", (e,))
        if self.take("+"):
            return self.expression(8)
        return self.atom()

    def chain(self, words, level):
        args = [self.expression(level)]
        while self.take(*words):
            args.append(self.expression(level))
        return args[0] if len(args) == 1 else Op(words[0], tuple(args))

    def members(self):
        if self.peek("("):
            self.at += 1
            out = []
            while not self.take(")"):
                out.append(self.expression())
                self.take(",")
            return tuple(out)
        return self.expression(5)

    @staticmethod
    def literal(kind: str, value: str):
        if kind == "number":
            return float(value) if re.search(r"[.eE]", value) else int(value)
        body = value[1:-1]
        if value[0] == "'":
            body = body.replace("\\'", "'").replace('"', '\\"') if '\\"' not in body else body.replace("\\'", "'")
        return json.loads(f'"{body}"', strict=False)

    def atom(self):
        kind, value = self.toks[self.at]
        self.at += 1
        if kind in ("number", "string"):
            return Const(self.literal(kind, value))
        if kind == "word" and value in ("true", "false", "null"):
            return Const({"true": True, "false": False, "null": None}[value])
        if kind == "ref":
            return Ref(value[2:-1] if value[1:2] == "<" else value[1:])
        if kind == "bind":
            return Bind(value[1:])
        if kind == "label":
            return Prop(self.path(), value[1:])
        if kind == "quoted":
            return Prop((value[1:-1], *self.path()))
        if kind == "name" and self.peek("("):
            self.at += 1
            args, named = [], []
            while not self.take(")"):
                if self.kind() == "name" and self.toks[self.at][1] in NAMED and self.peek("=", ahead=1):
                    key = self.toks[self.at][1]
                    self.at += 2
                    named.append((key, self.expression()))
                elif self.peek("*"):
                    self.at += 1
                    args.append(Star())
                else:
                    args.append(self.expression())
                self.take(",")
            return Call(value, tuple(args), tuple(named))
        if kind == "name":
            return Prop((value, *self.path()))
        if value == "(" and kind == "op":
            e = self.expression()
            self.need(")")
            return e
        if value == "{" and kind == "op":
            label = None
            if self.kind() == "label" and not self.peek(".", "=", "!=", "<", ">", "in", ahead=1):
                label = self.toks[self.at][1][1:]
                self.at += 1
            where = None if self.peek("}") else self.expression()
            self.need("}")
            return FilterSet(label, where)
        raise QueryError(f"unexpected {value or 'end'!r}")

    def path(self) -> tuple[str, ...]:
        out = []
        while self.peek("."):
            self.at += 1
            kind, value = self.toks[self.at]
            if kind not in ("name", "quoted", "word"):
                raise QueryError(f"expected a property after '.', not {value!r}")
            out.append(value[1:-1] if kind == "quoted" else value)
            self.at += 1
        return tuple(out)


def parse(text: str) -> Construct:
    """The query's syntax tree."""
    return Parser(text).query()
