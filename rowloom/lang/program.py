"""Programs to steps."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import sql as Q
from .expressions import Cursor
from .lexer import ProgramError, Token, tokenize

_DATALINES = re.compile(r"\b(datalines|cards|lines)(4?)\s*;[ \t]*\r?\n?", re.I)


def lift_datalines(text: str) -> tuple[str, list[list[str]]]:
    """Replaces each block of data lines by its number, so that neither macro nor parser looks into it."""
    out, blocks, at = [], [], 0
    for m in _DATALINES.finditer(text):
        if m.start() < at or text[: m.start()].rstrip()[-1:] not in (";", "") or _quoted(text[at : m.start()]):
            continue
        stop = re.compile(r"^[ \t]*;;;;[ \t]*;?" if m[2] else r"^.*;.*$", re.M).search(text, m.end())
        end = stop.start() if stop else len(text)
        lines = text[m.end() : end].split("\n")
        lines = [x.rstrip("\r") for x in lines]
        tail = ""
        if stop and not m[2]:
            before, _, _ = stop.group().partition(";")
            if before.strip():  # inline form
                tail = before
        if lines and not lines[-1]:
            lines.pop()
        if tail:
            lines.append(tail)
        out.append(text[at : m.start()] + f"datalines {len(blocks)};")
        blocks.append(lines)
        at = stop.end() if stop and m[2] else (end + stop.group().index(";") + 1 if stop else len(text))
    return "".join(out) + text[at:], blocks


def _quoted(text: str) -> bool:
    text = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    return len(re.findall(r"(?<!')'(?!')", text)) % 2 == 1 and len(re.findall(r'"', text)) % 2 == 1


@dataclass
class DataStep:
    targets: list[tuple[str, dict]]
    body: list[tuple]
    text: str = ""


@dataclass
class ProcStep:
    name: str
    header: Cursor
    statements: list[Cursor]
    text: str = ""


@dataclass
class SqlStep:
    options: dict
    statements: list[tuple] = field(default_factory=list)
    text: str = ""


@dataclass
class Global:
    kind: str  # libname, filename, options, ods, title
    cursor: Cursor
    text: str = ""


_GLOBALS = {"libname", "filename", "options", "option", "ods", "title", "footnote", "goptions", "dm"}


def parse(text: str) -> list:
    """The steps of a program without macro statements."""
    c = Cursor(text)
    steps = []
    while c.now.kind != "end":
        start = c.now.at
        if c.accept(";"):
            continue
        if c.at("run", "quit"):
            while not c.accept(";") and c.now.kind != "end":
                c.take()
            continue
        word = c.now.low
        if word == "data":
            steps.append(_data(c))
        elif word == "proc" and c.peek().low == "sql":
            steps.append(_sql(c))
        elif word == "proc":
            steps.append(_proc(c))
        elif word in _GLOBALS or re.fullmatch(r"(title|footnote)\d*", word):
            c.take()
            steps.append(Global(word, _rest(c)))
        else:
            raise ProgramError(f"unknown statement at {text[start : start + 40]!r}")
        steps[-1].text = text[start : c.tokens[c.i - 1].end]
    return steps


def _rest(c: Cursor) -> Cursor:
    """A cursor on what is left of the statement; the semicolon is taken."""
    start = c.i
    while c.now.kind != "end" and not c.at(";"):
        c.take()
    tokens = c.tokens[start : c.i]
    c.accept(";")
    end = tokens[-1].end if tokens else c.now.at
    return Cursor(c.text, [*tokens, Token("end", "", None, end, end)])


def _boundary(c: Cursor) -> bool:
    if c.now.kind == "end":
        return True
    if c.at("run", "quit") and c.peek().text == ";":
        return True
    if c.at("data") and c.peek().kind in ("name", "op") and c.peek().text != "=":
        return True
    return c.at("proc") and c.peek().kind == "name"


def _close(c: Cursor) -> None:
    if c.at("run", "quit"):
        c.take()
        c.accept(";")


def _sql(c: Cursor) -> SqlStep:
    c.take()
    c.take()
    step = SqlStep({})
    while not c.accept(";"):
        key = c.name().lower()
        step.options[key] = c.take().value if c.accept("=") else True
    while not _boundary(c):
        if c.accept(";"):
            continue
        step.statements.append(Q.statement(c))
    _close(c)
    return step


def _proc(c: Cursor) -> ProcStep:
    c.take()
    name = c.name().lower()
    step = ProcStep(name, _rest(c), [])
    while not _boundary(c):
        if c.accept(";"):
            continue
        if c.now.low in _GLOBALS and c.peek().text != "=" and name != "datasets":
            break
        step.statements.append(_rest(c))
    _close(c)
    return step


def _data(c: Cursor) -> DataStep:
    c.take()
    targets = []
    while not c.accept(";"):
        name = Q.dotted(c)
        targets.append((name, Q.dataset_options(c)))
    body = []
    while not _boundary(c):
        s = statement(c)
        if s is not None:
            body.append(s)
    _close(c)
    return DataStep(targets or [("data1", {})], body)


def _sources(c: Cursor) -> list[tuple[str, dict]]:
    out = []
    while c.now.kind == "name" and c.peek().text != "=" or c.now.kind == "str":
        name = Q.dotted(c)
        if c.at(":"):
            c.take()
            name += ":"
        out.append((name, Q.dataset_options(c)))
    return out


def _flags(c: Cursor) -> dict:
    out = {}
    while not c.at(";") and c.now.kind == "name":
        key = c.name().lower()
        c.expect("=")
        out[key] = c.take().text
    return out


def _name_items(c: Cursor) -> list[tuple]:
    out = []
    while c.now.kind in ("name", "str"):
        out.append(c.name_list_item())
    return out


def statement(c: Cursor):
    """One statement of a data step; None if empty."""
    if c.accept(";"):
        return None
    word, nxt = c.now.low, c.peek()
    assigns = nxt.text in ("=", "[", "{", "+") and c.now.kind == "name" or nxt.text == "." and False
    if c.now.kind == "name" and not (assigns and word not in ("do", "end", "if", "else")):
        made = _STATEMENTS.get(word)
        if made:
            c.take()
            out = made(c)
            return out
    if c.now.kind == "name" and c.peek().text == "(":  # substr(x, 1, 2) = … or arr(i) = …
        call = c._primary()
        if not c.at("="):
            raise ProgramError(f"unknown statement near {c.text[max(0, c.now.at - 40) : c.now.at + 10]!r}")
        c.take()
        value = c.expression()
        c.expect(";")
        return ("assign", ("substr", call[2]) if call[1] == "substr" else ("idx", call[1], call[2][0]), value)
    target = c._primary()
    if c.accept("+"):
        value = c.expression()
        c.expect(";")
        return ("sum", target[1], value)
    if c.accept("-"):
        value = c.expression()
        c.expect(";")
        return ("sum", target[1], ("neg", value))
    c.expect("=")
    value = c.expression()
    c.expect(";")
    return ("assign", target, value)


def _end(c: Cursor, out):
    c.expect(";")
    return out


def _set(c: Cursor):
    sources = _sources(c)
    return _end(c, ("set", sources, _flags(c)))


def _merge(c: Cursor):
    sources = _sources(c)
    return _end(c, ("merge", sources, _flags(c)))


def _update(c: Cursor):
    sources = _sources(c)
    return _end(c, ("update", sources, _flags(c)))


def by_list(c: Cursor) -> list[tuple[tuple, bool]]:
    out = []
    while c.now.kind in ("name", "str"):
        desc = c.accept("descending")
        if c.at("notsorted"):
            c.take()
            continue
        out.append((c.name_list_item(), desc))
    return out


def _by(c: Cursor):
    return _end(c, ("by", by_list(c)))


def _if(c: Cursor):
    cond = c.expression()
    if c.accept(";"):
        return ("subif", cond)
    c.expect("then")
    yes = statement(c)
    no = None
    save = c.i
    while c.accept(";"):
        pass
    if c.accept("else"):
        no = statement(c)
    else:
        c.i = save
    return ("if", cond, yes, no)


def _do(c: Cursor):
    spec = None
    if c.accept(";"):
        pass
    elif c.at("while", "until") and c.peek().text == "(":
        kind = c.take().low
        c.expect("(")
        spec = (kind, c.expression())
        c.expect(")")
        c.expect(";")
    else:
        var = c.name()
        c.expect("=")
        ranges = []
        while True:
            a = c.expression()
            z = by = cond = None
            while c.at("to", "by", "while", "until"):
                w = c.take().low
                if w == "to":
                    z = c.expression()
                elif w == "by":
                    by = c.expression()
                else:
                    c.expect("(")
                    cond = (w, c.expression())
                    c.expect(")")
            ranges.append((a, z, by, cond))
            if not c.accept(","):
                break
        c.expect(";")
        spec = ("for", var, ranges)
    body = []
    while not c.at("end"):
        if c.now.kind == "end":
            raise ProgramError("DO without END")
        s = statement(c)
        if s is not None:
            body.append(s)
    c.take()
    c.expect(";")
    return ("do", spec, body)


def _select(c: Cursor):
    operand = None
    if c.accept("("):
        operand = c.expression()
        c.expect(")")
    c.expect(";")
    whens, other = [], None
    while not c.at("end"):
        if c.accept("when"):
            c.expect("(")
            values = [c.expression()]
            while c.accept(","):
                values.append(c.expression())
            c.expect(")")
            whens.append((values, statement(c)))
        else:
            c.expect("otherwise")
            other = statement(c)
    c.take()
    c.expect(";")
    out = other
    for values, s in reversed(whens):
        conds = [v if operand is None else ("cmp", "=", operand, v) for v in values]
        cond = conds[0]
        for x in conds[1:]:
            cond = ("or", cond, x)
        out = ("if", cond, s, out)
    return out


def _output(c: Cursor):
    names = []
    while c.now.kind == "name":
        names.append(Q.dotted(c))
    return _end(c, ("output", names))


def _where(c: Cursor):
    return _end(c, ("where", c.expression()))


def _rename(c: Cursor):
    pairs = []
    while c.now.kind in ("name", "str"):
        old = c.name()
        c.expect("=")
        pairs.append((old, c.name()))
    return _end(c, ("rename", pairs))


def _literal(c: Cursor):
    if c.accept("."):
        return None
    neg = c.accept("-")
    t = c.take()
    if t.kind == "str":
        from .expressions import literal

        return literal(t.value)[1]
    return -t.value if neg else t.value


def _retain(c: Cursor):
    items, held = [], []
    while not c.at(";"):
        if c.now.kind == "name" or c.now.kind == "str" and c.now.value[1] == "n":
            held.append(c.name_list_item())
        elif c.accept("("):
            values = []
            while not c.accept(")"):
                values.append(_literal(c))
                c.accept(",")
            items.append((held, values))
            held = []
        else:
            items.append((held, [_literal(c)]))
            held = []
    if held:
        items.append((held, None))
    return _end(c, ("retain", items))


def _array(c: Cursor):
    name = c.name()
    size = None
    if c.at("[", "{", "("):
        close = {"[": "]", "{": "}", "(": ")"}[c.take().text]
        if not c.accept("*"):
            size = int(c.take().value)
            if c.accept(":"):
                size = int(c.take().value) - size + 1
        c.expect(close)
    char = False
    if c.accept("$"):
        char = True
        if c.now.kind == "num":
            c.take()
    elif c.now.kind == "num":
        c.take()
    if c.accept("_temporary_"):
        names = None
    else:
        names = _name_items(c)
    values = []
    if c.accept("("):
        while not c.accept(")"):
            values.append(_literal(c))
            c.accept(",")
    return _end(c, ("array", name, size, char, names, values))


def _length(c: Cursor):
    out, held = [], []
    while not c.at(";"):
        if c.accept("$"):
            n = int(c.take().value) if c.now.kind == "num" else 8
            c.accept(".")
            out.append((held, True, n))
            held = []
        elif c.now.kind == "num":
            n = int(float(c.take().value))
            c.accept(".")
            out.append((held, False, n))
            held = []
        else:
            held.append(c.name_list_item())
    return _end(c, ("length", out))


def format_list(c: Cursor) -> list[tuple[list, str | None]]:
    out, held = [], []
    while not c.at(";") and c.now.kind != "end":
        f = None
        if c.now.kind in ("name", "num") or c.at("$"):
            f = c.format_name()
        if f:
            out.append((held, f))
            held = []
        else:
            held.append(c.name_list_item())
    if held:
        out.append((held, None))
    return out


def _format(c: Cursor):
    return _end(c, ("format", format_list(c)))


def _informat(c: Cursor):
    return _end(c, ("informat", format_list(c)))


def labels(c: Cursor) -> list[tuple[str, str]]:
    out = []
    while c.now.kind in ("name", "str") and c.peek().text == "=":
        n = c.name()
        c.expect("=")
        t = c.take()
        out.append((n, t.value[0] if t.kind == "str" else t.text))
    return out


def _label(c: Cursor):
    return _end(c, ("label", labels(c)))


def _attrib(c: Cursor):
    out, names = [], []
    while not c.at(";"):
        if c.now.low in ("format", "label", "length", "informat") and c.peek().text == "=":
            key = c.take().low
            c.expect("=")
            if key == "label":
                value = c.take().value[0]
            elif key == "length":
                char = c.accept("$")
                value = (char, int(float(c.take().value)))
                c.accept(".")
            else:
                value = c.format_name()
            out.append((list(names), key, value))
            fresh = True
        else:
            if out and fresh:
                names = []
            names.append(c.name_list_item())
            fresh = False
    return _end(c, ("attrib", out))


def _call(c: Cursor):
    name = c.name().lower()
    call = c._call(name)
    return _end(c, ("call", name, call[2]))


def _put(c: Cursor):
    items = []
    while not c.at(";"):
        if c.now.kind == "str":
            items.append(("text", c.take().value[0]))
        elif c.accept("_all_"):
            items.append(("all",))
        elif c.now.kind == "name":
            n = c.name()
            named = c.accept("=")
            f = c.format_name() if c.now.kind in ("name", "num") or c.at("$") else None
            items.append(("var", n, named, f))
        else:
            c.take()
    return _end(c, ("put", items))


def _input(c: Cursor):
    """(name, is character, informat or None, columns or None) in the order of reading."""
    out = []
    while not c.at(";"):
        if c.now.kind != "name":
            c.take()
            continue
        item = c.name_list_item() if c.peek().text == "-" and c.peek(2).kind == "name" else ("one", c.name())
        names = [item]
        char, fmt, cols = False, None, None
        if c.at("$") and c.peek().kind == "num" and c.peek().at == c.now.end:  # $20.
            fmt, char = c.format_name() or c.take().text, True
        elif c.accept("$"):
            char = True
        modified = c.at(":", "&", "~")
        if modified:
            c.take()
        if c.now.kind == "num" and c.peek().text == "-" and c.peek(2).kind == "num":
            a = int(c.take().value)
            c.take()
            cols = (a, int(c.take().value))
        elif c.now.kind in ("name", "num") or c.at("$"):
            f = c.format_name()
            if f:
                fmt, char = f, char or f.startswith("$")
                if not modified:
                    cols = None
            elif c.now.kind == "num":
                a = int(c.take().value)
                cols = (a, a)
        out += [(n, char, fmt, cols) for n in names]
    return _end(c, ("input", out))


def _infile(c: Cursor):
    out = {}
    t = c.take()
    out["file"] = t.value[0] if t.kind == "str" else t.text
    while not c.at(";"):
        key = c.name().lower()
        out[key] = True
        if c.accept("="):
            t = c.take()
            out[key] = t.value[0] if t.kind == "str" else t.value if t.kind == "num" else t.text
            if t.kind == "str" and t.value[1] == "x":
                out[key] = bytes.fromhex(t.value[0]).decode("latin-1")
    return _end(c, ("infile", out))


def _datalines(c: Cursor):
    return _end(c, ("datalines", int(c.take().value)))


_STATEMENTS = {
    "set": _set, "merge": _merge, "update": _update, "by": _by, "if": _if, "do": _do, "select": _select, "output": _output, "where": _where,
    "keep": lambda c: _end(c, ("keep", _name_items(c))), "drop": lambda c: _end(c, ("drop", _name_items(c))), "rename": _rename, "retain": _retain,
    "array": _array, "length": _length, "format": _format, "informat": _informat, "label": _label, "attrib": _attrib, "call": _call, "put": _put,
    "input": _input, "infile": _infile, "datalines": _datalines, "delete": lambda c: _end(c, ("delete",)), "stop": lambda c: _end(c, ("stop",)),
    "return": lambda c: _end(c, ("return",)),
}
