"""Row by row execution of a data step's body, for programs that columns and windows can't express.

Runs inside ``mapInPandas`` / ``applyInPandas``: a program without state in parallel over all partitions, one whose
state starts anew with each BY group in parallel over the groups, and any other in order in one task.
"""

from __future__ import annotations

import math
import operator
import re
from datetime import date, timedelta

from ..lang.lexer import ProgramError

EPOCH = date(1960, 1, 1)


class _Delete(Exception):
    pass


class _Stop(Exception):
    pass


def missing(v) -> bool:
    return v is None or isinstance(v, float) and math.isnan(v) or v == ""


def number(v):
    if type(v) is float:
        return v if v == v else None
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, str):
        try:
            return float(v.strip())
        except ValueError:
            return None
    if hasattr(v, "timestamp"):
        return (v - type(v)(1960, 1, 1)).total_seconds()
    return float(v)


def text(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return str(int(v)) if float(v) == int(v) and abs(v) < 1e15 else str(v)
    return str(v)


def true(v) -> bool:
    return v not in ("", None) if isinstance(v, str) else bool(v) and not missing(v)


_HOLDS = {"=": lambda key: key == 0, "<>": lambda key: key != 0, "<": lambda key: key < 0, "<=": lambda key: key <= 0, ">": lambda key: key > 0, ">=": lambda key: key >= 0}
_MADE = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "**": operator.pow}


def compare(op: str, a, b) -> bool:
    if isinstance(a, str) != isinstance(b, str) and not missing(a) and not missing(b):
        a, b = number(a), number(b)
    am, bm = missing(a), missing(b)
    if am or bm:
        key = (0 if am else 1) - (0 if bm else 1)
    else:
        key = (a > b) - (a < b)
    return _HOLDS[op](key)


def _nums(args):
    return [x for a in args if (x := number(a)) is not None]


def _guard(f):
    def g(*args):
        try:
            return f(*args)
        except (ValueError, OverflowError, ZeroDivisionError, TypeError):
            return None

    return g


def _day(n) -> date:
    return EPOCH + timedelta(days=math.floor(n))


def _mdy(m, d, y):
    return float((date(int(y), int(m), int(d)) - EPOCH).days)


def _std(v):
    m = sum(v) / len(v)
    return math.sqrt(sum((x - m) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else None


def _scan(s, n, d=" \t\n\r\f.-/,;:!?()[]{}"):
    parts = [p for p in re.split("[" + re.escape(d) + "]+", text(s)) if p]
    n = int(n)
    return parts[n - 1] if 0 < n <= len(parts) else parts[n] if n < 0 and -n <= len(parts) else ""


FUNCTIONS = {
    "sum": lambda *a: float(sum(_nums(a))), "mean": lambda *a: sum(v) / len(v) if (v := _nums(a)) else None, "min": lambda *a: min(v) if (v := _nums(a)) else None,
    "max": lambda *a: max(v) if (v := _nums(a)) else None, "n": lambda *a: float(len(_nums(a))), "nmiss": lambda *a: float(len(a) - len(_nums(a))),
    "std": lambda *a: _std(_nums(a)) if _nums(a) else None, "range": lambda *a: max(v) - min(v) if (v := _nums(a)) else None,
    "cmiss": lambda *a: float(sum(missing(x) or isinstance(x, str) and not x.strip() for x in a)), "missing": lambda a: int(missing(a)),
    "round": _guard(lambda x, u=1: math.copysign(math.floor(abs(number(x)) / u + 0.5) * u, number(x))), "int": _guard(lambda x: float(math.trunc(number(x)))),
    "mod": _guard(lambda a, b: number(a) - number(b) * math.floor(number(a) / number(b))), "abs": _guard(lambda x: abs(number(x))), "sqrt": _guard(lambda x: math.sqrt(number(x))),
    "log": _guard(lambda x: math.log(number(x))), "log10": _guard(lambda x: math.log10(number(x))), "exp": _guard(lambda x: math.exp(number(x))), "floor": _guard(lambda x: float(math.floor(number(x)))),
    "ceil": _guard(lambda x: float(math.ceil(number(x)))), "sign": _guard(lambda x: float((number(x) > 0) - (number(x) < 0))), "sin": _guard(lambda x: math.sin(number(x))), "cos": _guard(lambda x: math.cos(number(x))),
    "substr": lambda s, a, n=None: text(s)[max(int(a), 1) - 1 :][: None if n is None else int(n)], "scan": _scan, "upcase": lambda s: text(s).upper(), "lowcase": lambda s: text(s).lower(),
    "strip": lambda s: text(s).strip(), "trim": lambda s: text(s).rstrip(), "left": lambda s: text(s).lstrip(), "cat": lambda *a: "".join(map(text, a)), "cats": lambda *a: "".join(text(x).strip() for x in a),
    "catx": lambda d, *a: d.join(t for x in a if (t := text(x).strip()) not in ("", ".")), "compress": lambda s, c=" ", m="": "".join(x for x in text(s) if (x in c) == ("k" in m.lower())),
    "index": lambda s, t: text(s).find(text(t)) + 1, "length": lambda s: 0 if text(s) == "" else max(len(text(s).rstrip()), 1), "tranwrd": lambda s, a, b: text(s).replace(text(a), text(b)),
    "reverse": lambda s: text(s)[::-1], "repeat": lambda s, n: text(s) * int(n), "coalesce": lambda *a: next((number(x) for x in a if not missing(x)), None),
    "coalescec": lambda *a: next((text(x) for x in a if not missing(x)), ""), "ifn": lambda c, a, b=0, m=None: (m if m is not None and missing(c) else number(a) if true(c) else number(b)),
    "ifc": lambda c, a, b="", m=None: (m if m is not None and missing(c) else text(a) if true(c) else text(b)), "mdy": _guard(_mdy), "year": _guard(lambda d: float(_day(number(d)).year)),
    "month": _guard(lambda d: float(_day(number(d)).month)), "day": _guard(lambda d: float(_day(number(d)).day)), "datepart": _guard(lambda d: float(math.floor(number(d) / 86400))),
    "timepart": _guard(lambda d: number(d) % 86400),
}


def put(v, spec: str) -> str:
    m = re.fullmatch(r"(\$?[A-Za-z_]*)(\d*)\.?(\d*)", spec.strip())
    base, width, dec = (m[1].upper(), int(m[2] or 0), int(m[3] or 0)) if m else ("", 0, 0)
    if base.startswith("$") or isinstance(v, str):
        return text(v)[: width or None]
    n = number(v)
    if n is None:
        return "."
    if base == "DATE":
        return _day(n).strftime("%d%b%Y").upper()
    if base == "YYMMDD":
        return _day(n).isoformat()
    if base == "Z":
        return f"{n:0{width}.{dec}f}"
    if base in ("", "F") and (width or dec):
        return f"{n:{width}.{dec}f}" if dec else text(round(n)).rjust(width)
    return text(n)


class Interpreter:
    """One data step's body over rows in order; ``run`` yields (target, values) for each row that is put out."""

    def __init__(self, body, arrays, temporary, retained, initial, by, chars, formats=None):
        self.body, self.arrays, self.temporary, self.retained, self.initial, self.by, self.chars = body, arrays, {k: list(v) for k, v in temporary.items()}, retained, initial, by, chars
        self.explicit = any(_has(s, "output") for s in body)
        self.queues: dict[int, list] = {}
        self.formats = formats or {}
        self.state: dict = dict(initial)
        self.n = 0

    def run(self, rows, first_last=None):
        """rows: dicts with lower-case names; __first / __last: BY variables that begin or end with the row."""
        for row in rows:
            self.n += 1
            flags = {f"first.{b}": int(b in row.get("__first", ())) for b in self.by} | {f"last.{b}": int(b in row.get("__last", ())) for b in self.by}
            self.v = {k: v for k, v in row.items() if not k.startswith("__")} | {k: self.state.get(k) for k in self.retained} | flags | {"_n_": self.n, "_error_": 0}
            for k, v in row.get("__flags", {}).items():
                self.v[k] = v
            self.out = []
            try:
                for s in self.body:
                    self.do(s)
                if not self.explicit:
                    self.out.append((None, dict(self.v)))
            except _Delete:
                pass
            except _Stop:
                yield from self.out
                return
            self.state = {k: self.v.get(k) for k in self.retained}
            yield from self.out

    def do(self, s) -> None:
        kind = s[0]
        if kind == "assign":
            self.assign(s[1], self.value(s[2]))
        elif kind == "sum":
            k = s[1].lower()
            self.v[k] = (number(self.v.get(k)) or 0.0) + (number(self.value(s[2])) or 0.0)
        elif kind == "if":
            if true(self.value(s[1])):
                if s[2]:
                    self.do(s[2])
            elif s[3]:
                self.do(s[3])
        elif kind == "subif":
            if not true(self.value(s[1])):
                raise _Delete
        elif kind in ("delete", "return"):
            raise _Delete
        elif kind == "stop":
            raise _Stop
        elif kind == "output":
            for t in s[1] or [None]:
                self.out.append((t, dict(self.v)))
        elif kind == "do":
            self.loop(s[1], s[2])
        elif kind == "call":
            if s[1] == "missing":
                for a in s[2]:
                    self.assign(a, "" if a[0] == "name" and a[1].lower() in self.chars else None)

    def loop(self, spec, body) -> None:
        def once():
            for s in body:
                self.do(s)

        if spec is None:
            once()
        elif spec[0] == "while":
            while true(self.value(spec[1])):
                once()
        elif spec[0] == "until":
            while True:
                once()
                if true(self.value(spec[1])):
                    break
        else:
            k = spec[1].lower()
            for a, z, by, cond in spec[2]:
                start = self.value(a)
                values = [start] if z is None and by is None else None
                end, step = (number(self.value(z)) if z else None), (number(self.value(by)) if by else 1.0)
                x = start
                while values or (values is None and (end is None or (x <= end if step > 0 else x >= end))):
                    if values:
                        x = values.pop()
                    self.v[k] = x
                    if cond and cond[0] == "while" and not true(self.value(cond[1])):
                        break
                    once()
                    x = self.v[k] + step if values is None else x
                    if values is None:
                        self.v[k] = x
                    if cond and cond[0] == "until" and true(self.value(cond[1])):
                        break
                    if values == []:
                        break

    def assign(self, target, v) -> None:
        if isinstance(v, bool):
            v = int(v)
        if target[0] == "idx":
            name, i = target[1].lower(), int(number(self.value(target[2])) or 0)
            cells = self.temporary.get(name)
            if cells is not None and 1 <= i <= len(cells):
                cells[i - 1] = v
            elif cells is None and 1 <= i <= len(self.arrays[name]):
                self.v[self.arrays[name][i - 1].lower()] = v
        elif target[0] == "substr":
            old, a = text(self.v.get(target[1][0][1].lower())), int(self.value(target[1][1]))
            n = int(self.value(target[1][2])) if len(target[1]) > 2 else len(old) - a + 1
            self.v[target[1][0][1].lower()] = old[: a - 1] + text(v)[:n].ljust(n) + old[a - 1 + n :]
        else:
            k = target[1].lower() if target[0] == "name" else f"{target[1]}.{target[2]}".lower()
            self.v[k] = text(v) if k in self.chars and not isinstance(v, str) else number(v) if k not in self.chars and isinstance(v, str) and k in self.v and isinstance(self.v[k], float) else v

    def value(self, e):
        kind = e[0]
        if kind in ("num", "str"):
            return e[1]
        if kind == "miss":
            return None
        if kind == "name":
            return self.v.get(e[1].lower())
        if kind == "qname":
            return self.v.get(f"{e[1]}.{e[2]}".lower())
        if kind == "bin":
            a, b = self.value(e[2]), self.value(e[3])
            if e[1] == "||":
                return text(a) + text(b)
            a, b = number(a), number(b)
            if a is None or b is None:
                return None
            try:
                r = _MADE[e[1]](a, b)
                return None if isinstance(r, complex) else r
            except (ZeroDivisionError, OverflowError):
                return None
        if kind == "neg":
            a = number(self.value(e[1]))
            return None if a is None else -a
        if kind == "cmp":
            return int(compare(e[1], self.value(e[2]), self.value(e[3])))
        if kind == "and":
            return int(true(self.value(e[1])) and true(self.value(e[2])))
        if kind == "or":
            return int(true(self.value(e[1])) or true(self.value(e[2])))
        if kind == "not":
            return int(not true(self.value(e[1])))
        if kind == "in":
            a = self.value(e[1])
            return int(any(compare("=", a, self.value(x)) for x in e[2]) != e[3])
        if kind == "between":
            a, lo, hi = (self.value(x) for x in e[1:4])
            return int((not missing(a) and compare(">=", a, lo) and compare("<=", a, hi)) != e[4])
        if kind == "like":
            p = re.escape(text(self.value(e[2]))).replace("%", ".*").replace("_", ".")
            return int(bool(re.fullmatch(p, text(self.value(e[1])), re.S)) != e[3])
        if kind == "contains":
            return int((text(self.value(e[2])) in text(self.value(e[1]))) != e[3])
        if kind == "isnull":
            return int(missing(self.value(e[1])) != e[2])
        if kind == "idx":
            name, i = e[1].lower(), int(number(self.value(e[2])) or 0)
            if name in self.temporary:
                return self.temporary[name][i - 1] if 1 <= i <= len(self.temporary[name]) else None
            return self.v.get(self.arrays[name][i - 1].lower()) if 1 <= i <= len(self.arrays[name]) else None
        if kind == "case":
            for w, t in e[2]:
                if true(self.value(w if e[1] is None else ("cmp", "=", e[1], w))):
                    return self.value(t)
            return self.value(e[3]) if e[3] else None
        if kind == "call":
            return self.call(e)
        raise ProgramError(f"no row-wise form of {kind}")

    @staticmethod
    def labelled(v, entries) -> str:
        """The label of a user's format; the first range that fits."""
        other = put(v, "") if not isinstance(v, str) else v
        for entry in entries:
            if entry[0] == "other":
                other = entry[1]
                continue
            low, high, low_open, high_open, label = entry
            if low == "missing":
                if missing(v):
                    return label
            elif not missing(v) and (low is None or v > low or v == low and not low_open) and (high is None or v < high or v == high and not high_open):
                return label
        return other

    def call(self, e):
        name, args = e[1], e[2]
        m = re.fullmatch(r"(lag|dif)(\d*)", name)
        if m:
            n, x = int(m[2] or 1), self.value(args[0])
            q = self.queues.setdefault(id(e), [None] * n)
            q.append(x)
            old = q.pop(0)
            if m[1] == "lag":
                return old
            return None if number(x) is None or number(old) is None else number(x) - number(old)
        if name == "dim":
            k = args[0][1].lower()
            return len(self.arrays.get(k) or self.temporary[k])
        if name in self.arrays or name in self.temporary:
            return self.value(("idx", name, args[0]))
        if name == "put":
            f = args[1][1] if args[1][0] != "name" else args[1][1] + "."
            own = self.formats.get(str(f).rstrip(".").lower())
            return self.labelled(self.value(args[0]), own) if own is not None else put(self.value(args[0]), str(f))
        if name == "input":
            return number(re.sub("[$,]", "", text(self.value(args[0])))) if not str(args[1][1]).startswith("$") else self.value(args[0])
        values = []
        for a in args:
            if a[0] == "list":
                from ..lang.expressions import expand_names

                values += [self.v.get(n.lower()) for n in expand_names(a[1], list(self.v), self.arrays)]
            else:
                values.append(self.value(a))
        f = FUNCTIONS.get(name)
        if f is None:
            raise ProgramError(f"function {name.upper()} has no row-wise form")
        return f(*values)


def _has(s, kind: str) -> bool:
    if not isinstance(s, (tuple, list)):
        return False
    if isinstance(s, tuple) and s and s[0] == kind:
        return True
    return any(_has(x, kind) for x in s)
