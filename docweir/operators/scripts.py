"""Two small script languages, compiled to Columns: a filter language of pipes, and object templates.

Filters: paths, literals, + - * / %, comparisons, and/or/not, //, if-then-elif-else-end, objects, arrays, parentheses,
pipes, select(c), del(.a), assignments .a = e and .a |= e, and the functions below. Templates: an object with computed
fields, `* : .` for the rest (`* - a, b : .` without some), let, if (c) a else b, and the functions. Anything else is
refused when the pipeline is made. A caller's own language can be given by Context.scripts.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame

from docweir.functions.expressions import Json
from docweir.operators import fields
from docweir.operators.fields import must
from docweir.plans.context import Context

_TOKEN = re.compile(r"\s*(?:(//(?!=)|\|=|[=!<>]=|[-+*/%<>=|(){}\[\]:,;])|(\.[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*|\.)|(\d+(?:\.\d+)?)|(\"(?:[^\"\\]|\\.)*\")|(\$?[A-Za-z_][\w-]*))")
_COMPARE = {"==": "$eq", "!=": "$ne", "<": "$lt", "<=": "$lte", ">": "$gt", ">=": "$gte"}
_MATH = {"-": "$subtract", "*": "$multiply", "/": "$divide", "%": "$mod"}
_CALLS = {"ascii_upcase": "$toUpper", "ascii_downcase": "$toLower", "uppercase": "$toUpper", "lowercase": "$toLower", "tostring": "$toString", "string": "$toString", "tonumber": "$toDouble", "number": "$toDouble", "floor": "$floor", "ceil": "$ceil", "ceiling": "$ceil", "round": "$round", "sqrt": "$sqrt", "not": "$not", "trim": "$trim", "abs": "$abs"}


def tokens(text: str, comment: str) -> list[str]:
    text = re.sub(rf"(?m)^\s*{comment}.*$", "", text)
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        must(bool(m), f"a script can't be read at: {text[at:at + 20]}")
        out.append(m[0].strip())
        at = m.end()
    return out


class Reader:
    """Precedence climbing over tokens, to the expression language."""

    def __init__(self, script: str, template: bool) -> None:
        self.template = template
        self.toks = tokens(script, "//" if template else "#")
        self.at = 0
        self.names: dict[str, Json] = {}

    def peek(self) -> str | None:
        return self.toks[self.at] if self.at < len(self.toks) else None

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        must(t is not None and (want is None or t == want), f"a script has {t} where {want or 'more'} is needed")
        self.at += 1
        return t

    def expression(self, level: int = 0) -> Json:
        levels = [("//",), ("or",), ("and",), tuple(_COMPARE), ("+", "-"), ("*", "/", "%")]
        if level == len(levels):
            return self.term()
        left = self.expression(level + 1)
        while self.peek() in levels[level]:
            op = self.take()
            right = self.expression(level + 1)
            left = self.binary(op, left, right)
        return left

    def binary(self, op: str, a: Json, b: Json) -> Json:
        if op == "+":
            return {"$concat" if any(isinstance(x, str) and not x.startswith("$") for x in (a, b)) else "$add": [a, b]}
        if op in _COMPARE:
            return {_COMPARE[op]: [a, b]}
        return {{"//": "$ifNull", "or": "$or", "and": "$and"}.get(op) or _MATH[op]: [a, b]}

    def term(self) -> Json:
        t = self.take()
        if t == "(":
            e = self.expression()
            self.take(")")
            return e
        if t == "-":
            return {"$subtract": [0, self.term()]}
        if t == ".":
            return "$$ROOT"
        if t.startswith("."):
            return "$" + t[1:]
        if t[0].isdigit():
            return float(t) if "." in t else int(t)
        if t[0] == '"':
            s = t[1:-1].encode().decode("unicode_escape") if "\\" in t else t[1:-1]
            return {"$literal": s} if s.startswith("$") else s
        if t in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[t]
        if t == "{":
            return self.object()
        if t == "[":
            out = []
            while self.peek() != "]":
                out.append(self.expression())
                if self.peek() == ",":
                    self.take()
            self.take("]")
            return out
        if t == "if":
            return self.choice()
        if t.startswith("$") and t[1:] in self.names:
            return self.names[t[1:]]
        if t in ("length", "size"):
            return {"$strLenCP": {"$toString": self.argument()}}
        must(t in _CALLS, f"a script uses {t}, which isn't known")
        arg = self.argument()
        return {_CALLS[t]: {"input": arg} if t == "trim" else arg}

    def argument(self) -> Json:
        if self.peek() != "(":
            return "$$ROOT"
        self.take("(")
        e = self.expression()
        self.take(")")
        return e

    def choice(self) -> Json:
        test = self.expression()
        if not self.template:
            self.take("then")
        then = self.expression()
        t = self.peek()
        if t == "elif":
            self.take()
            return {"$cond": [test, then, self.choice()]}
        other: Json = None
        if t == "else":
            self.take()
            other = self.choice() if self.template and self.peek() == "if" and self.take() else self.expression()
        if not self.template:
            self.take("end")
        return {"$cond": [test, then, other]}

    def object(self) -> dict:
        out: dict[str, Json] = {}
        while self.peek() != "}":
            t = self.take()
            if t == "let":
                name = self.take()
                self.take("=")
                self.names[name] = self.expression()
                continue
            if t == "*":
                left = []
                while self.peek() != ":":
                    x = self.take()
                    left += [x.strip('"')] if x not in ("-", ",") else []
                self.take(":")
                must(self.take() == ".", "a template copies the rest of .")
                out["*"] = left
            else:
                name = t.strip('"').removeprefix(".")
                if self.peek() == ":":
                    self.take()
                    out[name] = self.expression()
                else:
                    out[name] = "$" + name
            if self.peek() == ",":
                self.take()
        self.take("}")
        return out


def _text(spec: Json) -> str:
    must(isinstance(spec, str), "a script is a text or a file's name")
    if "\n" not in spec and len(spec) < 1000 and Path(spec.removeprefix("resource:")).is_file():
        return Path(spec.removeprefix("resource:")).read_text(encoding="utf-8")
    return spec


def filters(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """A script of the filter language: its steps, between pipes, are stages."""
    text = _text(spec)
    if "jq" in ctx.scripts:
        return ctx.scripts["jq"](df, text, ctx)
    r = Reader(text, template=False)
    while True:
        df = _step(df, r, ctx)
        if r.peek() is None:
            return df
        r.take("|")


def _step(df: DataFrame, r: Reader, ctx: Context) -> DataFrame:
    t = r.peek()
    if t == "select":
        r.take()
        return fields.match(df, {"$expr": r.argument()}, ctx)
    if t == "del":
        r.take()
        r.take("(")
        paths = []
        while r.peek() != ")":
            x = r.take()
            paths += [x[1:]] if x.startswith(".") else []
        r.take(")")
        return fields.unset(df, paths, ctx)
    if t == ".":
        r.take()
        return df
    if t is not None and t.startswith(".") and r.at + 1 < len(r.toks) and r.toks[r.at + 1] in ("=", "|="):
        path, op = r.take()[1:], r.take()
        if op == "|=":
            # Inside an update, the point is the old value.
            own = r.toks[r.at :]
            r.toks[r.at :] = [f".{path}" if x == "." else x for x in own[: _end(own)]] + own[_end(own) :]
        return fields.add_fields(df, {path: r.expression()}, ctx)
    return _replace(df, r.expression(), ctx)


def _end(toks: list[str]) -> int:
    depth = 0
    for i, t in enumerate(toks):
        depth += t in "({[" if len(t) == 1 else 0
        depth -= t in ")}]" if len(t) == 1 else 0
        if t == "|" and not depth:
            return i
    return len(toks)


def _replace(df: DataFrame, value: Json, ctx: Context) -> DataFrame:
    """The result becomes the document. `* : .` brings the fields that aren't named."""
    if isinstance(value, dict) and "*" in value:
        left = value.pop("*")
        names = [c for c in df.columns if c not in value and c not in left]
        value = {**{n: f"${n}" for n in names}, **value}
    out = fields.replace_with(df, value, ctx)
    return out


def templates(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """An object template; let definitions may come before it."""
    text = _text(spec)
    if "jslt" in ctx.scripts:
        return ctx.scripts["jslt"](df, text, ctx)
    r = Reader(text, template=True)
    while r.peek() == "let":
        r.take()
        name = r.take()
        r.take("=")
        r.names[name] = r.expression()
    value = r.expression()
    must(r.peek() is None, "a template has more after its object")
    return _replace(df, value, ctx)

