"""Scalar functions of the language, each built as Spark SQL text, so that calls stay inside code generation.

A builder takes the arguments as (text, kind) and gives (text, kind). Kinds: n number, c character, b truth value,
t timestamp, d date, x any other. Dates are days and datetimes seconds since 1960; native dates and timestamps are
accepted wherever a date or datetime is asked for. Missing is NULL; for character values an empty text is missing too.
"""

from __future__ import annotations

import re

Arg = tuple[str, str]
BUILDERS: dict = {}
DAYS, SECONDS = 3653, 315619200  # from 1960 to 1970


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def num(a: Arg) -> str:
    """As double: truth values as 1 and 0, character values if they read as a number."""
    text, kind = a
    if re.fullmatch(r"-?\d+(\.\d+)?(E[+-]?\d+)?D", text):
        return text
    if re.fullmatch(r"-?\d+", text):
        return text + "D"
    if kind == "c":
        return f"try_cast(trim({text}) AS DOUBLE)"
    if kind == "b":
        return f"CAST(CAST({text} AS INT) AS DOUBLE)"
    if kind == "t":
        return f"(unix_micros({text}) / 1000000D + {SECONDS}D)"
    if kind == "d":
        return f"CAST(unix_date({text}) + {DAYS} AS DOUBLE)"
    return f"CAST({text} AS DOUBLE)"


def integer(a: Arg) -> str:
    return a[0] if re.fullmatch(r"-?\d+", a[0]) else f"CAST({num(a)} AS INT)"


def char(a: Arg) -> str:
    """As text; numbers without a fraction have none."""
    text, kind = a
    if kind == "c":
        return text
    if kind in "nb":
        n = num(a)
        return f"CASE WHEN {n} = floor({n}) AND abs({n}) < 1e15D THEN CAST(CAST({n} AS BIGINT) AS STRING) ELSE CAST({n} AS STRING) END"
    return f"CAST({text} AS STRING)"


def day(a: Arg) -> str:
    """As a native date."""
    text, kind = a
    if kind == "d":
        return text
    if kind == "t":
        return f"CAST({text} AS DATE)"
    return f"date_add(DATE'1960-01-01', CAST(floor({num(a)}) AS INT))"


def stamp(a: Arg) -> str:
    if a[1] == "t":
        return a[0]
    return f"timestamp_micros(CAST(({num(a)} - {SECONDS}D) * 1000000D AS BIGINT))"


def truth(a: Arg) -> str:
    text, kind = a
    if kind == "b":
        return text
    if kind == "c":
        return f"coalesce({text} <> '', false)"
    return f"coalesce({text} <> 0, false)"


def constant(a: Arg):
    """The value of a literal argument, else None."""
    text = a[0]
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+(\.\d+)?(E[+-]?\d+)?D", text):
        return float(text[:-1])
    if re.fullmatch(r"'(?:[^'\\]|\\.)*'", text, re.S):
        return re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.S)
    return None


def function(*names: str, kind: str = "n"):
    """Register a builder that gives SQL text of this kind."""

    def add(build):
        for n in names:
            BUILDERS[n] = lambda *args, build=build: (out if isinstance(out := build(*args), tuple) else (out, kind))
        return build

    return add


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() and ord(c) < 128 and not c.isspace() else c for c in chars) + "]"


def _re(text: str) -> str:
    return quote(text)


# character

_DELIMS = " \t\n\r\f.-/,;:!?()[]{}"


@function("substr", "substrn", kind="c")
def substr(s, start, n=None):
    begin = f"greatest({integer(start)}, 1)"
    return f"substring({char(s)}, {begin})" if n is None else f"substring({char(s)}, {begin}, {integer(n)})"


def _words(s, delims, default):
    d = default if delims is None else constant(delims) or default
    return f"filter(split({char(s)}, {_re(_class(d) + '+')}), w -> w <> '')"


@function("scan", kind="c")
def scan(s, n, delims=None):
    k = integer(n)
    words = _words(s, delims, _DELIMS)
    return f"coalesce(CASE WHEN {k} > 0 THEN get({words}, {k} - 1) WHEN {k} < 0 AND size({words}) + {k} >= 0 THEN get({words}, size({words}) + {k}) END, '')"


@function("countw")
def countw(s, delims=None):
    return f"size({_words(s, delims, ' ' + chr(9) + chr(10))})"


@function("compress", kind="c")
def compress(s, chars=None, mods=None):
    m = (constant(mods) or "").upper() if mods else ""
    c = constant(chars) if chars else None
    text = char(s)
    if "K" in m and c:
        out = f"regexp_replace({text}, {_re('[^' + _class(c)[1:])}, '')"
    elif not c and chars is not None and c is None:
        out = f"translate({text}, {char(chars)}, '')"
    else:
        out = f"translate({text}, {quote(c or ' ')}, '')"
    return f"lower({out})" if "L" in m else f"upper({out})" if "U" in m else out


@function("upcase", kind="c")
def upcase(s):
    return f"upper({char(s)})"


@function("lowcase", kind="c")
def lowcase(s):
    return f"lower({char(s)})"


@function("strip", kind="c")
def strip(s):
    return f"regexp_replace({char(s)}, {_re('^\\s+|\\s+$')}, '')"


@function("trim", "trimn", kind="c")
def trim(s):
    return f"regexp_replace({char(s)}, {_re('\\s+$')}, '')"


@function("left", kind="c")
def left(s):
    return f"regexp_replace({char(s)}, {_re('^\\s+')}, '')"


@function("right", kind="c")
def right(s):
    return f"lpad(rtrim({char(s)}), length({char(s)}), ' ')"


@function("cat", kind="c")
def cat(*args):
    return f"concat({', '.join(f'coalesce({char(a)}, {quote("")})' for a in args)})"


@function("cats", kind="c")
def cats(*args):
    return f"concat({', '.join(f'coalesce(trim({char(a)}), {quote("")})' for a in args)})"


@function("catt", kind="c")
def catt(*args):
    return f"concat({', '.join(f'coalesce(rtrim({char(a)}), {quote("")})' for a in args)})"


@function("catx", kind="c")
def catx(sep, *args):
    return f"concat_ws({char(sep)}, {', '.join(f'nullif(nullif(trim({char(a)}), {quote("")}), {quote(".")})' for a in args)})"


@function("compbl", kind="c")
def compbl(s):
    return f"regexp_replace({char(s)}, {_re('\\s+')}, ' ')"


@function("tranwrd", kind="c")
def tranwrd(s, find, to):
    return f"replace({char(s)}, {char(find)}, {char(to)})"


@function("index")
def index(s, sub):
    return f"instr({char(s)}, {char(sub)})"


@function("find")
def find(s, sub, x=None, y=None):
    mods, start = "", "1"
    for a in (x, y):
        if a is not None:
            if isinstance(constant(a), str):
                mods = constant(a).lower()
            else:
                start = integer(a)
    a, b = (f"lower({char(s)})", f"lower({char(sub)})") if "i" in mods else (char(s), char(sub))
    return f"locate({b}, {a}, {start})"


@function("count")
def count(s, sub):
    return f"CAST(try_divide(length({char(s)}) - length(replace({char(s)}, {char(sub)}, '')), length({char(sub)})) AS INT)"


@function("countc")
def countc(s, chars):
    return f"(length({char(s)}) - length(translate({char(s)}, {char(chars)}, '')))"


@function("repeat", kind="c")
def repeat(s, n):
    return f"repeat({char(s)}, {integer(n)})"


@function("reverse", kind="c")
def reverse(s):
    return f"reverse({char(s)})"


@function("length")
def length(s):
    t = char(s)
    return f"CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE greatest(length(rtrim({t})), 1) END"


@function("lengthc", "lengthm")
def lengthc(s):
    return f"length({char(s)})"


@function("lengthn")
def lengthn(s):
    return f"length(rtrim(coalesce({char(s)}, '')))"


@function("missing")
def missing(a):
    return f"CAST({_missing(a)} AS INT)"


def _missing(a: Arg) -> str:
    return f"({a[0]} IS NULL OR {a[0]} = '')" if a[1] == "c" else f"({a[0]} IS NULL)"


@function("coalescec", kind="c")
def coalescec(*args):
    return f"coalesce({', '.join(f'nullif({char(a)}, {quote("")})' for a in args)})"


def perl(pattern: str) -> tuple[str, str, str]:
    """Pattern, replacement and flags of m/…/, s/…/…/ or a bare pattern."""
    m = re.fullmatch(r"\s*(m|s|)(\W)(.*)", pattern, re.S)
    if not m or m[2] in "^([.\\":
        return pattern, "", ""
    end = {"{": "}", "(": ")", "<": ">"}.get(m[2], m[2])
    parts, now, i, body = [], "", 0, m[3]
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            now += body[i + 1] if body[i + 1] == end and end not in "()[]{}.*+?|^$" else body[i : i + 2]
            i += 2
        elif body[i] == end and len(parts) < (2 if m[1] == "s" else 1):
            parts.append(now)
            now, i = "", i + 1
        else:
            now += body[i]
            i += 1
    if not parts:
        return pattern, "", ""
    return parts[0], parts[1] if len(parts) > 1 else "", now.strip()


def _java(pattern: str) -> str:
    p, _, flags = perl(pattern)
    inline = "".join(f for f in flags if f in "imsx")
    return (f"(?{inline})" if inline else "") + p


@function("prxmatch")
def prxmatch(pattern, s):
    return f"regexp_instr({char(s)}, {_re(_java(constant(pattern) or ''))})"


@function("prxchange", kind="c")
def prxchange(pattern, times, s):
    p, rep, _ = perl(constant(pattern) or "")
    rep = re.sub(r"\$\{(\d+)\}", r"$\1", rep).replace("\\\\", "\\")
    rep = re.sub(r"\\(\d)", r"$\1", rep)
    n = constant(times)
    java = _java(constant(pattern) or "")
    if n is not None and n < 0:
        return f"regexp_replace({char(s)}, {_re(java)}, {quote(rep)})"
    # the first n matches, one by one: what stands before a match is kept apart from what is still to search
    flags = re.match(r"\(\?[imsx]+\)", java)
    lead, body = (flags[0], java[flags.end() :]) if flags else ("", java)
    shifted = re.sub(r"(?<!\\)\\(\d)", lambda m: "\\" + str(int(m[1]) + 1), body)
    one = f"{lead}^((?s:.*?))(?:{shifted})((?s:.*))$"
    groups = re.compile(body).groups
    to = re.sub(r"\$(\d)", lambda m: "$" + str(int(m[1]) + 1), rep)
    step = (
        f"CASE WHEN NOT regexp_like(a.rest, {_re(one)}) THEN named_struct('done', concat(a.done, a.rest), 'rest', '') "
        f"ELSE named_struct('done', concat(a.done, regexp_replace(a.rest, {_re(one)}, {quote('$1' + to)})), 'rest', regexp_extract(a.rest, {_re(one)}, {groups + 2})) END"
    )
    return f"aggregate(sequence(1, greatest({integer(times)}, 1)), named_struct('done', '', 'rest', {char(s)}), (a, k) -> {step}, a -> CASE WHEN {integer(times)} = 0 THEN {char(s)} ELSE concat(a.done, a.rest) END)"


@function("propcase", kind="c")
def propcase(s, delims=None):
    d = (constant(delims) if delims else None) or " /-"
    words = f"regexp_extract_all({char(s)}, {_re(f'{_class(d)}|[^{_class(d)[1:]}+')}, 0)"
    return f"array_join(transform({words}, w -> concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))), '')"


@function("verify")
def verify(s, chars):
    c = constant(chars) or ""
    return f"CASE WHEN coalesce({char(s)}, '') = '' THEN 0 ELSE regexp_instr({char(s)}, {_re('[^' + _class(c)[1:] if c else '.')}) END"


@function("translate", kind="c")
def translate(s, to, frm):
    return f"translate({char(s)}, {char(frm)}, {char(to)})"


@function("like", kind="b")
def like(s, pattern):
    return f"coalesce({char(s)} LIKE {char(pattern)}, false)"


@function("rank")
def rank(s):
    return f"ascii({char(s)})"


@function("byte", kind="c")
def byte(n):
    return f"chr({integer(n)})"


@function("quote", kind="c")
def quote_(s):
    return f"concat('\"', replace({char(s)}, '\"', '\"\"'), '\"')"


@function("dequote", kind="c")
def dequote(s):
    t = char(s)
    return f"CASE WHEN length({t}) > 1 AND left({t}, 1) IN ('\"', '\\'') AND right({t}, 1) = left({t}, 1) THEN substring({t}, 2, length({t}) - 2) ELSE {t} END"


@function("compare")
def compare(a, b):
    return f"CASE WHEN {char(a)} <=> {char(b)} THEN 0 WHEN {char(a)} < {char(b)} THEN -1 ELSE 1 END"


# numbers


def _array(args) -> str:
    return f"filter(array({', '.join(map(num, args))}), v -> v IS NOT NULL)"


@function("sum")
def sum_(*args):
    return f"({' + '.join(f'coalesce({num(a)}, 0D)' for a in args)})"


@function("mean")
def mean(*args):
    return f"try_divide({sum_(*args)}, {n(*args)})"


@function("min")
def min_(*args):
    return f"least({', '.join(map(num, args))})" if len(args) > 1 else num(args[0])


@function("max")
def max_(*args):
    return f"greatest({', '.join(map(num, args))})" if len(args) > 1 else num(args[0])


@function("n")
def n(*args):
    return f"({' + '.join(f'CAST({num(a)} IS NOT NULL AS INT)' for a in args)})"


@function("nmiss")
def nmiss(*args):
    return f"({' + '.join(f'CAST({num(a)} IS NULL AS INT)' for a in args)})"


@function("cmiss")
def cmiss(*args):
    return f"({' + '.join(f'CAST(({a[0]} IS NULL OR trim({a[0]}) = {quote("")}) AS INT)' if a[1] == 'c' else f'CAST({a[0]} IS NULL AS INT)' for a in args)})"


@function("round")
def round_(x, unit=("1", "n")):
    v, u = num(x), num(unit)
    return f"(sign({v}) * floor(try_divide(abs({v}), {u}) + 0.5D) * {u})"


@function("int")
def int_(x):
    v = num(x)
    return f"CAST(CASE WHEN {v} >= 0 THEN floor({v}) ELSE ceil({v}) END AS DOUBLE)"


@function("mod")
def mod(a, b):
    return f"({num(a)} - {num(b)} * floor(try_divide({num(a)}, {num(b)})))"


def _plain(*names: str):
    for name in names:
        BUILDERS[name] = lambda x, name=name: (f"CAST({name}({num(x)}) AS DOUBLE)", "n")


_plain("ceil", "floor", "abs", "exp", "sin", "cos", "tan", "sign", "atan", "sinh", "cosh", "tanh")
for _name, _guard in (("sqrt", ">= 0"), ("ln", "> 0"), ("log10", "> 0"), ("log2", "> 0")):
    BUILDERS["log" if _name == "ln" else _name] = lambda x, f=_name, g=_guard: (f"CASE WHEN {num(x)} {g} THEN {f}({num(x)}) END", "n")


@function("exp")
def exp(x):
    return f"CASE WHEN {num(x)} < 709.78D THEN exp({num(x)}) END"


@function("std")
def std(*args):
    a = _array(args)
    m = f"try_divide(aggregate({a}, 0D, (s, v) -> s + v), size({a}))"
    return f"CASE WHEN size({a}) > 1 THEN sqrt(aggregate(transform({a}, v -> (v - {m}) * (v - {m})), 0D, (s, v) -> s + v) / (size({a}) - 1)) END"


@function("var")
def var(*args):
    return f"power({std(*args)}, 2)"


@function("range")
def range_(*args):
    return f"({max_(*args)} - {min_(*args)})"


@function("median")
def median(*args):
    a = f"array_sort({_array(args)})"
    return f"CASE WHEN size({a}) > 0 THEN (get({a}, CAST((size({a}) - 1) DIV 2 AS INT)) + get({a}, CAST(size({a}) DIV 2 AS INT))) / 2 END"


@function("coalesce")
def coalesce(*args):
    if all(a[1] == "c" for a in args):
        return coalescec(*args), "c"
    return f"coalesce({', '.join(map(num, args))})"


@function("ranuni", "uniform")
def ranuni(seed=("0", "n")):
    return f"rand({constant(seed) or 0})"


@function("rannor", "normal")
def rannor(seed=("0", "n")):
    return f"randn({constant(seed) or 0})"


@function("probnorm")
def probnorm(x):
    return f"rowloom_probnorm({num(x)})"


@function("probit")
def probit(p):
    return f"rowloom_probit({num(p)})"


@function("probt")
def probt(x, df):
    return f"rowloom_probt({num(x)}, {num(df)})"


@function("probf")
def probf(x, a, b):
    return f"rowloom_probf({num(x)}, {num(a)}, {num(b)})"


@function("probchi")
def probchi(x, df):
    return f"rowloom_probchi({num(x)}, {num(df)})"


# dates and times


@function("today", "date")
def today():
    return f"CAST(unix_date(current_date()) + {DAYS} AS DOUBLE)"


@function("datetime")
def datetime():
    return f"CAST(unix_seconds(current_timestamp()) + {SECONDS} AS DOUBLE)"


def _days(date: str) -> str:
    return f"CAST(unix_date({date}) + {DAYS} AS DOUBLE)"


@function("mdy")
def mdy(m, d, y):
    return _days(f"CAST(try_make_timestamp({integer(y)}, {integer(m)}, {integer(d)}, 0, 0, CAST(0 AS DECIMAL(8,6))) AS DATE)")


for _name, _sql in (("year", "year"), ("month", "month"), ("day", "day"), ("weekday", "dayofweek"), ("qtr", "quarter"), ("week", "weekofyear")):
    BUILDERS[_name] = lambda d, f=_sql: (f"{f}({day(d)})", "n")


def _unit(a) -> str:
    u = str(constant(a) or "").upper()
    u = {"QUARTER": "QTR", "QUARTERS": "QTR"}.get(u, u)
    return u[:-1] if u.endswith("S") else u


@function("intnx")
def intnx(unit, start, by, align=None):
    u, k, a = _unit(unit), integer(by), (str(constant(align) or "S") if align else "S").upper()[0]
    d = day(start)
    if u in ("HOUR", "MINUTE", "SECOND"):
        return f"({num(start)} + {integer(by)} * {dict(HOUR=3600, MINUTE=60, SECOND=1)[u]}D)"
    trunc = {"DAY": "DAY", "WEEK": "WEEK", "MONTH": "MONTH", "QTR": "QUARTER", "YEAR": "YEAR"}.get(u, "DAY")
    months = {"MONTH": 1, "QTR": 3, "YEAR": 12}.get(u)
    moved = lambda x, n: f"add_months({x}, {n} * {months})" if months else f"date_add({x}, {n} * {7 if u == 'WEEK' else 1})"
    if a == "S":
        return _days(moved(d, k))
    first = f"CAST(date_trunc('{trunc}', {moved(d, k)}) AS DATE)"
    if a == "B":
        return _days(first)
    last = f"date_sub({moved(first, '1')}, 1)"
    if a == "E":
        return _days(last)
    return f"floor(({_days(first)} + {_days(last)}) / 2)"


@function("intck")
def intck(unit, a, b):
    u = _unit(unit)
    d1, d2 = day(a), day(b)
    if u == "DTDAY":
        return f"CAST(datediff({d2}, {d1}) AS DOUBLE)"
    months = f"((year({d2}) - year({d1})) * 12 + month({d2}) - month({d1}))"
    quarters = f"((year({d2}) - year({d1})) * 4 + quarter({d2}) - quarter({d1}))"
    weeks = f"(datediff(CAST(date_trunc('WEEK', date_add({d2}, 1)) AS DATE), CAST(date_trunc('WEEK', date_add({d1}, 1)) AS DATE)) DIV 7)"  # from Sunday
    seconds = {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}.get(u)
    if seconds:
        return f"(floor({num(b)} / {seconds}) - floor({num(a)} / {seconds}))"
    out = {"MONTH": months, "QTR": quarters, "YEAR": f"(year({d2}) - year({d1}))", "WEEK": weeks}.get(u, f"datediff({d2}, {d1})")
    return f"CAST({out} AS DOUBLE)"


@function("datdif", "datedif")
def datedif(a, b, unit):
    return intck(unit if _unit(unit) not in ("D", "M", "Y") else (quote({"D": "DAY", "M": "MONTH", "Y": "YEAR"}[_unit(unit)]), "c"), a, b)


@function("datepart")
def datepart(x):
    return _days(day(x)) if x[1] in "td" else f"floor({num(x)} / 86400D)"


@function("timepart")
def timepart(x):
    return f"pmod({num(x)}, 86400D)"


@function("hour")
def hour(x):
    return f"CAST(floor(pmod({num(x)}, 86400D) / 3600) AS INT)"


@function("minute")
def minute(x):
    return f"CAST(floor(pmod({num(x)}, 3600D) / 60) AS INT)"


@function("second")
def second(x):
    return f"pmod({num(x)}, 60D)"


@function("dhms")
def dhms(d, h, m, s):
    return f"({num(d)} * 86400D + {num(h)} * 3600D + {num(m)} * 60D + {num(s)})"


@function("hms")
def hms(h, m, s):
    return f"({num(h)} * 3600D + {num(m)} * 60D + {num(s)})"


@function("yyq")
def yyq(y, q):
    return _days(f"CAST(try_make_timestamp({integer(y)}, {integer(q)} * 3 - 2, 1, 0, 0, CAST(0 AS DECIMAL(8,6))) AS DATE)")


# conversion

_ISO_DATE = {"E8601DA", "B8601DA", "YYMMDD", "IS8601DA"}
_ISO_STAMP = {"E8601DT", "IS8601DT", "B8601DT"}


def put_text(a: Arg, spec: str) -> str:
    """A number or text under a built-in format; a missing number reads '.'."""
    fmt = spec.upper()
    m = re.fullmatch(r"(\$?[A-Z_]*[A-Z_]|\$|)(\d*)\.?(\d*)", fmt) or re.fullmatch(r"(\$?[A-Z0-9_]*?[A-Z_]|\$|)(\d*)\.?(\d*)", fmt)
    base, width, dec = (m[1], int(m[2] or 0), int(m[3] or 0)) if m else (fmt.rstrip("."), 0, 0)
    if base.startswith("$") or a[1] == "c":
        t = char(a)
        return f"substring({t}, 1, {width})" if width else t
    v, none = num(a), "'.'"
    if base in _ISO_DATE or fmt.startswith(("E8601DA", "B8601DA", "YYMMDD")):
        out = f"date_format({day(a)}, 'yyyy-MM-dd')"
    elif base in _ISO_STAMP or fmt.startswith(("E8601DT", "IS8601DT")):
        out = f"date_format({stamp(a)}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    elif base == "DATE":
        out = f"upper(date_format({day(a)}, '{'ddMMMyy' if width == 7 else 'ddMMMyyyy'}'))"
    elif base == "MMDDYY":
        out = f"date_format({day(a)}, '{'MM/dd/yy' if width == 8 else 'MM/dd/yyyy'}')"
    elif base == "DDMMYY":
        out = f"date_format({day(a)}, '{'dd/MM/yy' if width == 8 else 'dd/MM/yyyy'}')"
    elif base == "MONYY":
        out = f"upper(date_format({day(a)}, '{'MMMyy' if width == 5 else 'MMMyyyy'}'))"
    elif base == "YEAR":
        out = f"date_format({day(a)}, 'yyyy')"
    elif base == "DATETIME":
        out = f"upper(date_format({stamp(a)}, 'ddMMMyyyy:HH:mm:ss'))"
    elif base == "TIME":
        out = f"format_string('%d:%02d:%02d', CAST(floor({v} / 3600) AS BIGINT), CAST(floor(pmod({v}, 3600D) / 60) AS BIGINT), CAST(floor(pmod({v}, 60D)) AS BIGINT))"
    elif base == "Z" and width:
        out = f"lpad(format_string('%.{dec}f', {v}), {width}, '0')"
    elif base in ("COMMA", "DOLLAR"):
        out = f"concat('{'$' if base == 'DOLLAR' else ''}', format_number({v}, {dec}))"
        out = f"lpad({out}, greatest({width}, length({out})), ' ')" if width else out
    elif base == "PERCENT":
        out = f"concat(format_string('%.{dec}f', {v} * 100), '%')"
    elif base.startswith("BEST"):
        out = char(a)
    elif base in ("", "F") and width:
        out = f"format_string('%{width}.{dec}f', {v})" if dec else f"CASE WHEN {v} = floor({v}) THEN lpad(CAST(CAST({v} AS BIGINT) AS STRING), greatest({width}, length(CAST(CAST({v} AS BIGINT) AS STRING))), ' ') ELSE format_string('%{width}.2f', {v}) END"
    else:
        out = char(a)
    return f"CASE WHEN {a[0]} IS NULL THEN {none} ELSE {out} END"


def input_number(a: Arg, spec: str) -> Arg:
    fmt = spec.upper().rstrip(".")
    if fmt.startswith("$"):
        return char(a), "c"
    t = f"trim({char(a)})"
    iso = f"CAST(try_to_timestamp({t}, 'yyyy-MM-dd') AS DATE)"
    if fmt.startswith(("E8601DA", "B8601DA", "YYMMDD", "IS8601DA")):
        return _days(f"coalesce({iso}, CAST(try_to_timestamp({t}, 'yyyyMMdd') AS DATE))"), "n"
    if fmt.startswith(("E8601DT", "IS8601DT", "B8601DT")):
        return f"CAST(unix_seconds(coalesce(try_to_timestamp({t}, \"yyyy-MM-dd'T'HH:mm:ss\"), try_to_timestamp({t}, 'yyyy-MM-dd HH:mm:ss'))) + {SECONDS} AS DOUBLE)", "n"
    if fmt.startswith("DATETIME"):
        return f"CAST(unix_seconds(try_to_timestamp(initcap({t}), 'ddMMMyyyy:HH:mm:ss')) + {SECONDS} AS DOUBLE)", "n"
    mon = f"concat(substring({t}, 1, 2), initcap(substring({t}, 3, 3)), substring({t}, 6))"
    if fmt.startswith("DATE"):
        return _days(f"CAST(try_to_timestamp({mon}, 'ddMMMyyyy') AS DATE)"), "n"
    if fmt.startswith("MMDDYY"):
        return _days(f"CAST(try_to_timestamp(translate({t}, '-.', '//'), 'MM/dd/yyyy') AS DATE)"), "n"
    if fmt.startswith("DDMMYY"):
        return _days(f"CAST(try_to_timestamp(translate({t}, '-.', '//'), 'dd/MM/yyyy') AS DATE)"), "n"
    if fmt.startswith("PERCENT"):
        return f"try_cast(replace({t}, '%', '') AS DOUBLE) / 100", "n"
    return f"try_cast(translate({t}, '$,', '') AS DOUBLE)", "n"


@function("ifc", kind="c")
def ifc(cond, yes, no=("''", "c"), none=None):
    out = f"CASE WHEN {truth(cond)} THEN {char(yes)} ELSE {char(no)} END"
    return f"CASE WHEN {_missing(cond)} THEN {char(none)} ELSE {out} END" if none else out


@function("ifn")
def ifn(cond, yes, no=("0", "n"), none=None):
    out = f"CASE WHEN {truth(cond)} THEN {num(yes)} ELSE {num(no)} END"
    return f"CASE WHEN {_missing(cond)} THEN {num(none)} ELSE {out} END" if none else out


def register(name: str, build, kind: str = "n") -> None:
    """Add a function: ``build`` takes SQL texts and gives one, as for ``spark.udf.register``-ed names."""
    BUILDERS[name.lower()] = lambda *args: (build(*(a[0] for a in args)), kind)
