"""Expressions to Spark SQL text.

Missing values follow the language, not SQL's three-valued logic: a missing value equals a missing value and is less
than any other, and conditions are true or false only. Where a condition stands as a filter, unknown may stay unknown
(it drops the row just as false does), which keeps comparisons in the form that reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..functions import scalar
from ..functions.scalar import Arg, char, num, quote, truth
from ..lang.expressions import expand_names
from ..lang.lexer import ProgramError

AGGREGATES = {
    "count": "count", "n": "count", "freq": "count", "sum": "sum", "avg": "avg", "mean": "avg", "min": "min", "max": "max",
    "std": "stddev_samp", "stddev": "stddev_samp", "var": "var_samp", "median": "median", "range": None, "nmiss": None, "css": None, "uss": None, "cv": None, "stderr": None,
}
_ONLY_AGGREGATE = {"avg", "freq", "css", "uss"}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "c"
    if isinstance(t, T.BooleanType):
        return "b"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "t"
    if isinstance(t, T.DateType):
        return "d"
    return "n" if isinstance(t, T.NumericType) else "x"


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Scope:
    """What names mean. ``column`` gives (text, kind) or None; the rest is optional."""

    column: Callable[[str | None, str], Arg | None]
    subquery: Callable | None = None  # (select, scope) -> text
    calculated: dict[str, tuple] = field(default_factory=dict)
    arrays: dict[str, list[str]] = field(default_factory=dict)
    temporary: dict[str, list] = field(default_factory=dict)
    columns: list[str] = field(default_factory=list)
    formats: dict = field(default_factory=dict)  # user formats by name
    labels: dict[str, str] = field(default_factory=dict)
    variable_formats: dict[str, str] = field(default_factory=dict)
    aggregates: bool = False
    call: Callable | None = None  # (name, args as nodes, scope) -> Arg or None: what only the step knows
    unknown: list[str] = field(default_factory=list)
    unique: set = field(default_factory=set)


def sql(e: tuple, s: Scope, filter_: bool = False) -> Arg:
    """(text, kind) of an expression; filter_: unknown may stand for false."""
    return _NODES[e[0]](e, s, filter_) if e[0] in _FILTERS else _NODES[e[0]](e, s)


def condition(e: tuple, s: Scope, filter_: bool = True) -> str:
    return truth(sql(e, s, filter_))


def _num(e, s):
    v = e[1]
    if isinstance(v, int):
        return (str(v) if abs(v) < 2**31 else f"{v}L" if abs(v) < 2**63 else f"{float(v)!r}D"), "n"
    return f"{v!r}D", "n"


def _name(e, s, table=None):
    name = e[1] if table is None else e[2]
    found = s.column(table, name)
    if found is None:
        s.unknown.append(name)
        return "CAST(NULL AS DOUBLE)", "n"
    return found


def _bin(e, s):
    op, a, b = e[1], sql(e[2], s), sql(e[3], s)
    if op == "||":
        return f"concat(coalesce({char(a)}, ''), coalesce({char(b)}, ''))", "c"
    x, y = num(a), num(b)
    if op == "/":
        return f"try_divide({x}, {y})", "n"
    if op == "**":
        p = f"power({x}, {y})"
        return f"CASE WHEN isnan({p}) OR abs({p}) = double('Infinity') THEN NULL ELSE {p} END", "n"
    return f"({x} {op} {y})", "n"


def _neg(e, s):
    return f"(- {num(sql(e[1], s))})", "n"


def _pair(a: Arg, b: Arg) -> tuple[str, str]:
    """Both sides in one type."""
    if a[1] == b[1] or a[1] in "nx" and b[1] in "nx":
        return a[0], b[0]
    if "t" in a[1] + b[1] and "d" in a[1] + b[1]:
        return a[0], b[0]
    return num(a), num(b)


def _is_literal(e) -> bool:
    return e[0] in ("num", "str")


def _cmp(e, s, filter_):
    op, le, re_ = e[1], e[2], e[3]
    a, b = sql(le, s), sql(re_, s)
    if le[0] == "miss" or re_[0] == "miss" or e[2:] == (("str", ""),) or ("str", "") in (le, re_):
        other = b if le[0] == "miss" or le == ("str", "") else a
        if op in ("=", "<>"):
            none = scalar._missing(other)
            return (none if op == "=" else f"(NOT {none})"), "b"
    x, y = _pair(a, b)
    if op == "=":
        return f"({x} <=> {y})", "b"
    if op == "<>":
        if _is_literal(re_) and filter_:
            return f"({x} <> {y} OR {x} IS NULL)", "b"
        return f"(NOT ({x} <=> {y}))", "b"
    if op in (">", ">="):
        op, x, y, le, re_ = {">": "<", ">=": "<="}[op], y, x, re_, le
    plain = f"{x} {op} {y}"
    if _is_literal(le):  # a missing right side is never above a value
        return (f"({plain})" if filter_ else f"coalesce({plain}, false)"), "b"
    if _is_literal(re_):
        return f"({plain} OR {x} IS NULL)", "b"
    none = f"{x} IS NULL" if op == "<=" else f"({x} IS NULL AND {y} IS NOT NULL)"
    return f"coalesce({plain}, {none})", "b"


def _logic(e, s, filter_):
    word = e[0].upper()
    return f"({condition(e[1], s, filter_)} {word} {condition(e[2], s, filter_)})", "b"


def _not(e, s, filter_):
    inner = e[1]
    if inner[0] == "exists":
        return sql(("exists", inner[1], not inner[2]), s)
    if inner[0] == "insub":
        return sql((*inner[:3], not inner[3]), s)
    return f"(NOT {condition(inner, s, False)})", "b"


def _in(e, s, filter_):
    a = sql(e[1], s)
    items = [sql(x, s) for x in e[2] if x[0] != "miss"]
    parts = [f"{a[0] if all(i[1] == a[1] for i in items) else num(a)} IN ({', '.join(i[0] if i[1] == a[1] else num(i) for i in items)})"] if items else []
    if any(x[0] == "miss" for x in e[2]):
        parts.append(scalar._missing(a))
    text = "(" + (" OR ".join(parts) or "false") + ")"
    if e[3]:
        return f"(NOT coalesce({text}, false))", "b"
    return (text if filter_ else f"coalesce({text}, false)"), "b"


def _between(e, s, filter_):
    a, lo, hi = (sql(x, s) for x in e[1:4])
    kinds = {x[1] for x in (a, lo, hi)}
    texts = [a[0], lo[0], hi[0]] if len(kinds) == 1 else [num(x) for x in (a, lo, hi)]
    t = f"({texts[0]} BETWEEN {texts[1]} AND {texts[2]})"
    if e[4]:
        return f"(NOT coalesce({t}, false))", "b"
    return (t if filter_ else f"coalesce({t}, false)"), "b"


def _like(e, s, filter_):
    t = f"{char(sql(e[1], s))} LIKE {char(sql(e[2], s))}"
    return (f"(NOT coalesce({t}, false))" if e[3] else f"({t})" if filter_ else f"coalesce({t}, false)"), "b"


def _contains(e, s, filter_):
    t = f"contains({char(sql(e[1], s))}, {char(sql(e[2], s))})"
    return (f"(NOT coalesce({t}, false))" if e[3] else t if filter_ else f"coalesce({t}, false)"), "b"


def _isnull(e, s):
    t = scalar._missing(sql(e[1], s))
    return (f"(NOT {t})" if e[2] else t), "b"


def _case(e, s):
    operand, whens, other = e[1:]
    values = [sql(v, s) for _, v in whens] + ([sql(other, s)] if other else [])
    kinds = {v[1] for v, n in zip(values, [x[1] for x in whens] + [other], strict=False) if n[0] != "miss"}
    if len(kinds) > 1:
        values = [(char(v), "c") for v in values] if "c" in kinds else [(num(v), "n") for v in values]
    kind = values[0][1] if len(kinds) > 1 or not kinds else kinds.pop()
    text = "CASE"
    for (w, _), v in zip(whens, values, strict=False):
        text += f" WHEN {condition(w if operand is None else ('cmp', '=', operand, w), s)} THEN {v[0] if v[0] != 'NULL' else 'NULL'}"
    return text + (f" ELSE {values[-1][0]}" if other else "") + " END", kind


def _args(args, s) -> list[tuple]:
    out = []
    for a in args:
        if a[0] == "list":
            names = expand_names(a[1], s.columns, s.arrays)
            out += [("name", n) for n in names]
        else:
            out.append(a)
    return out


def aggregate(name: str, args: list[Arg], distinct: bool, over: str = "") -> Arg:
    d = "DISTINCT " if distinct else ""
    if not args or args[0][0] == "*":
        return f"count(1){over}", "n"
    a = args[0]
    if name in ("count", "n", "freq"):
        return f"count({d}{f'nullif({a[0]}, {quote(chr(0))})' if False else a[0]}){over}", "n"
    if name in ("min", "max"):
        return f"{name}({d}{a[0] if a[1] != 'b' else num(a)}){over}", a[1] if a[1] != "b" else "n"
    x = num(a)
    plain = a[0] if a[1] == "n" and name == "sum" else x
    if name == "nmiss":
        return f"count_if({a[0]} IS NULL){over}", "n"
    if name == "range":
        return f"(max({d}{x}){over} - min({d}{x}){over})", "n"
    if name == "uss":
        return f"sum({x} * {x}){over}", "n"
    if name == "css":
        return f"(var_pop({x}){over} * count({x}){over})", "n"
    if name == "cv":
        return f"try_divide(100 * stddev_samp({x}){over}, avg({x}){over})", "n"
    if name == "stderr":
        return f"try_divide(stddev_samp({x}){over}, sqrt(count({x}){over}))", "n"
    return f"{AGGREGATES[name]}({d}{plain}){over}", "n"


def is_aggregate(e: tuple) -> bool:
    return e[0] == "call" and e[1] in AGGREGATES and (len(e[2]) == 1 and e[2][0][0] != "list" or e[1] in _ONLY_AGGREGATE or e[3])


def has_aggregate(e) -> bool:
    if not isinstance(e, (tuple, list)):
        return False
    if isinstance(e, tuple) and e and e[0] in ("over", "sub", "exists", "insub") and e[0] != "insub":
        return False
    if isinstance(e, tuple) and e and e[0] == "call" and is_aggregate(e):
        return True
    return any(has_aggregate(x) for x in e)


def _call(e, s):
    name, args = e[1], e[2]
    if s.call and (out := s.call(name, args, s)) is not None:
        return out
    if s.aggregates and is_aggregate(e):
        inner = [("*", "x") if a[0] == "star" else sql(a, s) for a in args]
        if name == "count" and len(args) > 1:
            return _builder("count", args, s)
        return aggregate(name, inner, e[3])
    if name == "dim" and args and args[0][0] == "name":
        a = args[0][1].lower()
        return str(len(s.arrays.get(a) or s.temporary.get(a) or [])), "n"
    if name in ("vlabel", "vname") and args[0][0] == "name":
        return quote(s.labels.get(args[0][1].lower(), args[0][1]) if name == "vlabel" else args[0][1]), "c"
    if name == "vvalue" and args[0][0] == "name":
        return formatted(sql(args[0], s), s.variable_formats.get(args[0][1].lower(), ""), s), "c"
    if name in ("put", "putn", "putc"):
        return formatted(sql(args[0], s), _format_text(args[1]), s), "c"
    if name in ("input", "inputn", "inputc"):
        out = scalar.input_number(sql(args[0], s), _format_text(args[1]))
        return out
    if name in s.arrays or name in s.temporary:  # arr(i)
        return sql(("idx", name, args[0]), s)
    return _builder(name, args, s)


def _builder(name, args, s):
    build = scalar.BUILDERS.get(name)
    if build is None:
        raise ProgramError(f"unknown function {name.upper()}")
    return build(*(sql(a, s) for a in _args(args, s)))


def _format_text(e: tuple) -> str:
    if e[0] in ("fmt", "str"):
        return str(e[1])
    if e[0] == "num":
        return repr(e[1])
    if e[0] == "name":
        return e[1] + "."
    raise ProgramError("a format must be a literal here")


def formatted(a: Arg, spec: str, s: Scope) -> str:
    """The text of a value under a user's or a built-in format."""
    spec = spec.strip()
    key = spec.rstrip(".").lower()
    if key in s.formats:
        return format_case(a, s.formats[key], key)
    return scalar.put_text(a, spec) if spec else char(a)


def format_case(a: Arg, entries: list[tuple], name: str) -> str:
    """entries: (low, high, low_open, high_open, label); None bounds are open; ('other', label) is the rest."""
    is_char = name.startswith("$")
    x = char(a) if is_char else num(a)
    lit = (lambda v: quote(str(v))) if is_char else (lambda v: f"{float(v)!r}D")
    text, other = "CASE", f"coalesce({char(a)}, {quote('.' if not is_char else '')})"
    for entry in entries:
        if entry[0] == "other":
            other = quote(entry[1])
            continue
        low, high, low_open, high_open, label = entry
        if low == "missing":
            text += f" WHEN {x} IS NULL THEN {quote(label)}"
        elif low is not None and low == high:
            text += f" WHEN {x} = {lit(low)} THEN {quote(label)}"
        else:
            parts = [f"{x} {'>' if low_open else '>='} {lit(low)}"] if low is not None else []
            parts += [f"{x} {'<' if high_open else '<='} {lit(high)}"] if high is not None else []
            text += f" WHEN {' AND '.join(parts) or f'{x} IS NOT NULL'} THEN {quote(label)}"
    return other if text == "CASE" else f"{text} ELSE {other} END"


def _over(e, s):
    call, part, order = e[1:]
    inner = [("*", "x") if a[0] == "star" else sql(a, s) for a in call[2]]
    by = []
    if part:
        by.append("PARTITION BY " + ", ".join(sql(p, s)[0] for p in part))
    ranks = call[1] in ("row_number", "rank", "dense_rank", "lag", "lead", "ntile", "percent_rank", "cume_dist")
    keys = ", ".join(sql(o, s)[0] + (" DESC" if d else "") for o, d in order)
    if order and ranks:
        by.append("ORDER BY " + keys)
    over = f" OVER ({' '.join(by)})"
    if call[1] in ("lag", "lead"):
        more = f", {inner[1][0]}" if len(inner) > 1 else ""
        return f"{call[1]}({inner[0][0]}{more}){over}", inner[0][1]
    if ranks:
        if not order:
            over = f" OVER ({' '.join([*by, 'ORDER BY 1'])})"
        return f"{call[1]}({inner[0][0] if inner else ''}){over}", "n"
    return aggregate(call[1], inner, call[3], over)


def _idx(e, s):
    name = e[1].lower()
    if name in s.temporary:
        values = [(_num(("num", v), s) if isinstance(v, (int, float)) else (quote(v), "c")) if v is not None else ("NULL", "n") for v in s.temporary[name]]
        return f"get(array({', '.join(v[0] for v in values)}), {scalar.integer(sql(e[2], s))} - 1)", values[0][1]
    names = s.arrays.get(name)
    if names is None:
        raise ProgramError(f"unknown array {e[1]}")
    cols = [_name(("name", n), s) for n in names]
    if e[2][0] == "num" and 1 <= e[2][1] <= len(cols):
        return cols[int(e[2][1]) - 1]
    kind = "c" if any(c[1] == "c" for c in cols) else "n"
    conv = char if kind == "c" else num
    return f"get(array({', '.join(map(conv, cols))}), {scalar.integer(sql(e[2], s))} - 1)", kind


def _calc(e, s):
    inner = s.calculated.get(e[1].lower())
    return _name(("name", e[1]), s) if inner is None else sql(inner, s)


def _sub(e, s):
    return f"({s.subquery(e[1], s)})", s.subquery.kind if hasattr(s.subquery, "kind") else "n"


def _exists(e, s):
    return f"({'NOT ' if e[2] else ''}EXISTS ({s.subquery(e[1], s)}))", "b"


def _insub(e, s):
    a = sql(e[1], s)[0]
    inner = s.subquery(e[2], s)
    if e[3]:  # two-valued: missing values of the list never match
        return f"(NOT EXISTS (SELECT 1 FROM ({inner}) AS __in(v) WHERE __in.v = {a}))" if e[1][0] == "qname" else f"(NOT coalesce({a} IN (SELECT v FROM ({inner}) AS __in(v) WHERE v IS NOT NULL), false))", "b"
    return f"({a} IN ({inner}))", "b"


_FILTERS = {"cmp", "and", "or", "not", "in", "between", "like", "contains"}
_NODES = {
    "num": _num, "str": lambda e, s: (quote(e[1]), "c"), "miss": lambda e, s: ("NULL", "n"), "name": _name, "qname": lambda e, s: _name(e, s, e[1]),
    "bin": _bin, "neg": _neg, "cmp": _cmp, "and": _logic, "or": _logic, "not": _not, "in": _in, "between": _between, "like": _like,
    "contains": _contains, "isnull": _isnull, "case": _case, "call": _call, "over": _over, "idx": _idx, "calc": _calc, "sub": _sub,
    "exists": _exists, "insub": _insub, "fmt": lambda e, s: (quote(str(e[1])), "c"),
}
