"""Statements of PROC SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from .expressions import Cursor
from .lexer import ProgramError

_STOP = {"from", "where", "group", "having", "order", "union", "intersect", "except", "on", "inner", "left", "right", "full", "cross", "join", "into", "as", "outer", "natural", "corr", "corresponding", "all"}


@dataclass
class Table:
    name: str | None  # LIB.MEMBER or MEMBER
    sub: object = None  # Select or SetOp
    alias: str | None = None
    options: dict = field(default_factory=dict)


@dataclass
class Join:
    kind: str  # inner, left, right, full, cross
    table: Table
    on: tuple | None


@dataclass
class Item:
    expr: tuple
    alias: str | None
    attrs: dict = field(default_factory=dict)


@dataclass
class Select:
    items: list[Item]
    distinct: bool = False
    into: list[tuple] = field(default_factory=list)
    table: Table | None = None
    joins: list[Join] = field(default_factory=list)
    where: tuple | None = None
    group: list[tuple] = field(default_factory=list)
    having: tuple | None = None
    order: list[tuple] = field(default_factory=list)


@dataclass
class SetOp:
    left: object
    op: str
    all: bool
    right: object
    order: list[tuple] = field(default_factory=list)


def dotted(c: Cursor) -> str:
    name = c.name()
    if c.at(".") and c.now.at == c.tokens[c.i - 1].end:
        c.take()
        name += "." + c.name()
    return name


def dataset_options(c: Cursor) -> dict:
    """( KEEP= DROP= WHERE=( ) RENAME=( ) IN= FIRSTOBS= OBS= ) behind a dataset's name, in the order written."""
    options: dict = {}
    if not c.accept("("):
        return options
    while not c.accept(")"):
        key = c.name().lower()
        c.expect("=")
        if key in ("keep", "drop"):
            names = []
            while c.now.kind in ("name", "str") and c.peek().text != "=":
                names.append(c.name_list_item())
            options.setdefault(key, []).extend(names)
        elif key == "where":
            c.expect("(")
            options["where"] = c.expression()
            c.expect(")")
        elif key == "rename":
            c.expect("(")
            pairs = options.setdefault("rename", [])
            while not c.accept(")"):
                old = c.name()
                c.expect("=")
                pairs.append((old, c.name()))
        elif key in ("firstobs", "obs"):
            options[key] = None if c.accept("max") else int(c.take().value)
        elif key == "in":
            options["in"] = c.name()
        else:
            t = c.take()
            options[key] = t.value[0] if t.kind == "str" else t.text
    return options


def table(c: Cursor) -> Table:
    if c.accept("("):
        t = Table(None, query(c))
        c.expect(")")
    else:
        t = Table(dotted(c))
        if c.at("(") and c.peek().low in ("keep", "drop", "where", "rename", "obs", "firstobs"):
            t.options = dataset_options(c)
    if c.accept("as") or c.now.kind == "name" and c.now.low not in _STOP:
        t.alias = c.name()
    return t


def select(c: Cursor) -> Select:
    c.expect("select")
    s = Select([], c.accept("distinct", "unique"))
    while True:
        e = c.expression()
        item = Item(e, c.name() if c.accept("as") else None)
        while c.now.kind == "name" and c.now.low in ("format", "label", "length", "informat") and c.peek().text == "=":
            key = c.take().low
            c.expect("=")
            item.attrs[key] = c.take().value[0] if c.now.kind == "str" else c.format_name() or c.take().text
        s.items.append(item)
        if not c.accept(","):
            break
    if c.accept("into"):
        while True:
            c.expect(":")
            first = c.name()
            last, sep, trimmed = None, None, False
            if c.accept("-"):
                last = (c.name() if c.accept(":") else "") if c.at(":") else ""
            while c.at("separated", "trimmed", "notrim"):
                if c.accept("separated"):
                    c.expect("by")
                    sep = c.take().value[0]
                else:
                    trimmed = c.take().low == "trimmed"
            s.into.append((first, last, sep, trimmed))
            if not c.accept(","):
                break
    if c.accept("from"):
        s.table = table(c)
        while True:
            if c.accept(","):
                s.joins.append(Join("cross", table(c), None))
                continue
            kind = next((k for k in ("inner", "left", "right", "full", "cross") if c.accept(k)), None)
            if kind:
                c.accept("outer")
            elif not c.at("join"):
                break
            c.expect("join")
            t = table(c)
            s.joins.append(Join(kind or "inner", t, c.expression() if c.accept("on") else None))
    if c.accept("where"):
        s.where = c.expression()
    if c.accept_all("group", "by"):
        s.group.append(c.expression())
        while c.accept(","):
            s.group.append(c.expression())
    if c.accept("having"):
        s.having = c.expression()
    s.order = order_by(c)
    return s


def order_by(c: Cursor) -> list[tuple]:
    out = []
    if c.accept_all("order", "by"):
        while True:
            e = c.expression()
            out.append((e, c.accept("desc", "descending")))
            c.accept("asc", "ascending")
            if not c.accept(","):
                break
    return out


def query(c: Cursor):
    """A select, or a left-associative chain of set operations; an ORDER BY of the last belongs to the whole."""
    left = select(c)
    while c.at("union", "intersect", "except"):
        op, all_ = c.take().low, c.accept("all")
        right = select(c)
        left = SetOp(left, op, all_, right)
    if isinstance(left, SetOp) and isinstance(left.right, Select):
        left.order, left.right.order = left.right.order, []
    return left


def statement(c: Cursor) -> tuple:
    """(kind, …) of one statement up to its semicolon."""
    if c.at("select"):
        out = ("select", query(c))
    elif c.accept("create"):
        kind = c.expect("table", "view")
        name = dotted(c)
        options = dataset_options(c)
        c.expect("as")
        out = ("create", name, query(c), options, kind)
    elif c.accept("insert"):
        c.expect("into")
        name, columns = dotted(c), []
        if c.accept("("):
            while not c.accept(")"):
                columns.append(c.name())
                c.accept(",")
        rows = []
        if c.at("select"):
            out = ("insert", name, columns, query(c))
        elif c.accept("set"):
            pairs = []
            while True:
                col = c.name()
                c.expect("=")
                pairs.append((col, c.expression()))
                if not c.accept(","):
                    break
            out = ("insert", name, [p[0] for p in pairs], [[p[1] for p in pairs]])
        else:
            while c.accept("values"):
                c.expect("(")
                row = []
                while not c.accept(")"):
                    row.append(c.expression())
                    c.accept(",")
                rows.append(row)
            out = ("insert", name, columns, rows)
    elif c.accept("update"):
        name = dotted(c)
        c.expect("set")
        pairs = []
        while True:
            col = c.name()
            c.expect("=")
            pairs.append((col, c.expression()))
            if not c.accept(","):
                break
        out = ("update", name, pairs, c.expression() if c.accept("where") else None)
    elif c.accept("delete"):
        c.expect("from")
        out = ("delete", dotted(c), c.expression() if c.accept("where") else None)
    elif c.accept("drop"):
        c.expect("table", "view")
        names = [dotted(c)]
        while c.accept(","):
            names.append(dotted(c))
        out = ("drop", names)
    elif c.accept("reset"):
        out = ("reset",)
        while not c.at(";"):
            c.take()
    else:
        raise ProgramError(f"unknown SQL statement at {c.now.text!r}")
    c.expect(";")
    return out
