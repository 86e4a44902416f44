"""Expressions as nested tuples, and the cursor that parsers share.

Nodes: num, str, miss, name, qname, star, qstar, bin, neg, cmp, and, or, not, in, insub, between, like, contains,
isnull, exists, case, call, over, sub, calc, idx, list.
"""

from __future__ import annotations

import datetime as dt
import re

from .lexer import ProgramError, Token, tokenize

EPOCH = dt.date(1960, 1, 1)
_CMP = {"=": "=", "eq": "=", "^=": "<>", "~=": "<>", "!=": "<>", "<>": "<>", "ne": "<>", "<": "<", "lt": "<", "<=": "<=", "le": "<=", ">": ">", "gt": ">", ">=": ">=", "ge": ">="}
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def date_number(text: str) -> float | None:
    """Days since 1960 of 01JAN2020."""
    m = re.fullmatch(r"\s*(\d{1,2})([A-Za-z]{3})(\d{4}|\d{2})\s*", text)
    if not m or m[2].lower() not in _MONTHS:
        return None
    year = int(m[3]) + (0 if len(m[3]) == 4 else 2000 if int(m[3]) < 60 else 1900)
    try:
        return float((dt.date(year, _MONTHS[m[2].lower()], int(m[1])) - EPOCH).days)
    except ValueError:
        return None


def time_number(text: str) -> float | None:
    m = re.fullmatch(r"\s*(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d*)?))?\s*", text)
    return int(m[1]) * 3600 + int(m[2]) * 60 + float(m[3] or 0) if m else None


def literal(value: tuple[str, str]) -> tuple:
    text, suffix = value
    if suffix == "d":
        n = date_number(text)
    elif suffix == "t":
        n = time_number(text)
    elif suffix == "dt":
        day, _, time = text.partition(":")
        d, t = date_number(day), time_number(time) if time else 0.0
        n = None if d is None or t is None else d * 86400 + t
    elif suffix == "x":
        return ("str", bytes.fromhex(re.sub(r"[\s,]", "", text)).decode("latin-1"))
    elif suffix == "n":
        return ("name", text)
    else:
        return ("str", text)
    if n is None:
        raise ProgramError(f"invalid literal {text!r}{suffix}")
    return ("num", n)


class Cursor:
    """Tokens with a place in them."""

    def __init__(self, text: str, tokens: list[Token] | None = None):
        self.text, self.tokens, self.i = text, tokens if tokens is not None else tokenize(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.now
        self.i += t.kind != "end"
        return t

    def at(self, *words: str) -> bool:
        return self.now.kind in ("name", "op") and self.now.low in words

    def accept(self, *words: str) -> bool:
        if self.at(*words):
            self.i += 1
            return True
        return False

    def accept_all(self, *words: str) -> bool:
        if all(self.peek(k).kind in ("name", "op") and self.peek(k).low == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> str:
        if not self.at(*words):
            raise ProgramError(f"expected {' or '.join(words)}, found {self.now.text or 'the end'!r} near {self.text[max(0, self.now.at - 40) : self.now.at + 20]!r}")
        return self.take().low

    def name(self) -> str:
        if self.now.kind == "str" and self.now.value[1] == "n":
            return self.take().value[0]
        if self.now.kind != "name":
            raise ProgramError(f"expected a name, found {self.now.text or 'the end'!r} near {self.text[max(0, self.now.at - 40) : self.now.at + 20]!r}")
        return self.take().text

    # expressions

    def expression(self) -> tuple:
        left = self._and()
        while self.accept("or", "|") or (self.at("!") and self.peek().low != "=" and self.accept("!")):
            left = ("or", left, self._and())
        return left

    def _and(self) -> tuple:
        left = self._not()
        while self.accept("and", "&"):
            left = ("and", left, self._not())
        return left

    def _not(self) -> tuple:
        if self.at("not", "^", "~"):
            self.take()
            return ("not", self._not())
        return self._compare()

    def _compare(self) -> tuple:
        left = self._concat()
        while True:
            negated = False
            if self.at("not", "^", "~") and self.peek().low in ("in", "like", "contains", "between"):
                self.take()
                negated = True
            if self.now.kind in ("name", "op") and self.now.low in _CMP:
                op = _CMP[self.take().low]
                if op in "<>" and self.at("=") and self.tokens[self.i - 1].text in "<>":  # spaced
                    self.take()
                    op += "="
                self.accept(":")
                left = ("cmp", op, left, self._concat())
            elif self.accept("in"):
                left = self._in(left, negated)
            elif self.accept("between"):
                low = self._concat()
                self.expect("and")
                left = ("between", left, low, self._concat(), negated)
            elif self.accept("like"):
                left = ("like", left, self._concat(), negated)
            elif self.accept("contains") or self.at("?") and self.accept("?"):
                left = ("contains", left, self._concat(), negated)
            elif self.at("is") and self.peek().low in ("null", "missing", "not"):
                self.take()
                negated = self.accept("not")
                self.expect("null", "missing")
                left = ("isnull", left, negated)
            else:
                return left

    def _in(self, left: tuple, negated: bool) -> tuple:
        self.expect("(")
        if self.at("select"):
            from .sql import select

            sub = select(self)
            self.expect(")")
            return ("insub", left, sub, negated)
        items = []
        while not self.accept(")"):
            items.append(self._unary())
            if items[-1][0] == "num" and self.at(":"):  # a range of integers
                self.take()
                items[-1:] = [("num", k) for k in range(int(items[-1][1]), int(self._unary()[1]) + 1)]
            self.accept(",")
        return ("in", left, items, negated)

    def _concat(self) -> tuple:
        left = self._sum()
        while self.accept("||") or (self.at("!") and self.peek().text == "!" and self.accept_all("!", "!")):
            left = ("bin", "||", left, self._sum())
        return left

    def _sum(self) -> tuple:
        left = self._product()
        while self.at("+", "-"):
            left = ("bin", self.take().text, left, self._product())
        return left

    def _product(self) -> tuple:
        left = self._unary()
        while self.at("*", "/"):
            left = ("bin", self.take().text, left, self._unary())
        return left

    def _unary(self) -> tuple:
        if self.accept("-"):
            inner = self._unary()
            return ("num", -inner[1]) if inner[0] == "num" else ("neg", inner)
        if self.accept("+"):
            return self._unary()
        left = self._primary()
        if self.accept("**"):
            return ("bin", "**", left, self._unary())
        return left

    def _primary(self) -> tuple:
        t = self.now
        if t.kind == "num":
            self.take()
            return ("num", t.value)
        if t.kind == "str" and t.value[1] != "n":
            self.take()
            return literal(t.value)
        if self.accept("."):
            if self.now.kind == "name" and len(self.now.text) == 1 and self.now.at == self.tokens[self.i - 1].end:
                self.take()  # special missing
            return ("miss",)
        if self.accept("("):
            if self.at("select"):
                from .sql import select

                inner = ("sub", select(self))
            else:
                inner = self.expression()
            self.expect(")")
            return inner
        if self.at("case"):
            return self._case()
        if self.at("exists") and self.peek().text == "(":
            from .sql import select

            self.take()
            self.expect("(")
            sub = select(self)
            self.expect(")")
            return ("exists", sub, False)
        if self.at("calculated"):
            self.take()
            return ("calc", self.name())
        if self.at("null") and self.peek().text != "(":
            self.take()
            return ("miss",)
        if self.at("*"):
            self.take()
            return ("star",)
        name = self.name()
        if self.at("("):
            return self._call(name)
        if self.at("[", "{"):
            close = "]" if self.take().text == "[" else "}"
            inner = ("star",) if self.accept("*") else self.expression()
            self.expect(close)
            return ("idx", name, inner)
        if self.at(".") and self.now.at == self.tokens[self.i - 1].end and (self.peek().text == "*" or self.peek().kind == "name") and self.peek().at == self.now.end:
            self.take()
            if self.accept("*"):
                return ("qstar", name)
            return ("qname", name, self.name())
        return ("name", name)

    def _call(self, name: str) -> tuple:
        self.expect("(")
        distinct, args = self.accept("distinct"), []
        while not self.accept(")"):
            if self.accept("of"):
                while not self.at(",", ")"):
                    args.append(("list", self.name_list_item()))
            elif self.at("?"):  # ?? before an informat
                self.take()
                continue
            elif self.at("$"):
                args.append(("fmt", self.format_name() or "$"))
            else:
                a = self.expression()
                while self.at("?"):
                    self.take()
                if self.at(".") or (a[0] in ("name", "num") and self.at("$")):
                    a = ("fmt", self._format_from(a))
                elif self.now.kind == "num" and a[0] == "name" and self.now.at == self.tokens[self.i - 1].end:
                    a = ("fmt", self._format_from(a))
                args.append(a)
            self.accept(",")
        call = ("call", name.lower(), args, distinct)
        if self.at("over"):
            self.take()
            self.expect("(")
            part, order = [], []
            if self.accept_all("partition", "by"):
                part.append(self.expression())
                while self.accept(","):
                    part.append(self.expression())
            if self.accept_all("order", "by"):
                while True:
                    e = self.expression()
                    order.append((e, self.accept("desc", "descending")))
                    self.accept("asc", "ascending")
                    if not self.accept(","):
                        break
            self.expect(")")
            return ("over", call, part, order)
        return call

    def _format_from(self, first: tuple) -> str:
        text = str(first[1]) if first[0] in ("name", "num") else ""
        while self.at(".", "$") or self.now.kind in ("num", "name") and self.now.at == self.tokens[self.i - 1].end:
            text += self.take().text
        return text

    def format_name(self) -> str | None:
        """date9. or $12. or 8.2 or $fmt."""
        start, text = self.i, ""
        last = None
        while self.now.kind in ("num", "name") or self.at(".", "$"):
            if last is not None and self.now.at != last.end:
                break
            last = self.take()
            text += last.text
            if last.text == "." and not (self.now.kind == "num" and self.now.at == last.end):
                break
            if last.kind == "num" and "." in text and text[-1] != ".":
                break
        if "." not in text:
            self.i = start
            return None
        return text

    def name_list_item(self) -> tuple:
        """x, x1-x9, x: or arr[*]."""
        name = self.name()
        if self.at("[", "{"):
            close = "]" if self.take().text == "[" else "}"
            self.expect("*")
            self.expect(close)
            return ("array", name)
        if self.at("-") and self.peek().text == "-":
            self.take()
            self.take()
            return ("span", name, self.name())
        if self.at("-") and self.peek().kind == "name":
            self.take()
            return ("range", name, self.name())
        if self.at(":"):
            self.take()
            return ("prefix", name)
        return ("one", name)

    def _case(self) -> tuple:
        self.expect("case")
        operand = None if self.at("when") else self.expression()
        whens, other = [], None
        while self.accept("when"):
            w = self.expression()
            self.expect("then")
            whens.append((w, self.expression()))
        if self.accept("else"):
            other = self.expression()
        self.expect("end")
        return ("case", operand, whens, other)


def expand_names(item: tuple, columns: list[str], arrays: dict[str, list[str]] | None = None) -> list[str]:
    """The columns that an entry of a name list stands for."""
    kind, low = item[0], {c.lower(): c for c in columns}
    if kind == "one":
        if item[1].lower() == "_all_":
            return list(columns)
        return [low.get(item[1].lower(), item[1])]
    if kind == "prefix":
        return [c for c in columns if c.lower().startswith(item[1].lower())]
    if kind == "array":
        return list((arrays or {})[item[1].lower()])
    if kind == "span":
        names = [c.lower() for c in columns]
        return columns[names.index(item[1].lower()) : names.index(item[2].lower()) + 1]
    a, z = (re.fullmatch(r"(.*?)(\d+)", x) for x in item[1:3])
    if not a or not z or a[1].lower() != z[1].lower():
        raise ProgramError(f"no numbered range: {item[1]}-{item[2]}")
    made = [f"{a[1]}{k:0{len(a[2]) if a[2][0] == '0' else 1}d}" for k in range(int(a[2]), int(z[2]) + 1)]
    return [low.get(x.lower(), x) for x in made]


def walk(node, visit) -> None:
    """Call visit on each node of an expression, inner selects left out."""
    if isinstance(node, tuple):
        if node and isinstance(node[0], str):
            visit(node)
        for x in node:
            if isinstance(x, (tuple, list)):
                walk(x, visit)
    elif isinstance(node, list):
        for x in node:
            walk(x, visit)
