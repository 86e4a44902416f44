"""Procedures: their statements, and which operators they run."""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.expressions import Cursor, expand_names
from ..lang.lexer import ProgramError
from ..lang.program import by_list, format_list, labels
from ..lang.sql import dataset_options, dotted
from ..operators import reshape, summary
from ..operators.quantile import same_group
from . import compile as C
from .dataset import OBS, Dataset, Variable, number, with_obs


def into_text(v) -> str:
    if v is None:
        return "."
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return str(v)


def header(c: Cursor) -> dict:
    """KEY=value pairs and flags. Dataset names come as (name, options)."""
    out: dict = {}
    while c.now.kind != "end":
        if c.now.kind not in ("name", "str"):
            c.take()
            continue
        key = c.take().low
        if not c.accept("="):
            out[key] = True
            continue
        if key in ("data", "out", "base", "compare", "comp", "outest", "outsurv", "cntlin", "cntlout", "outp", "outs", "outk", "new", "outstat") and c.now.kind == "name":
            name = dotted(c)
            out[key] = (name, dataset_options(c) if c.at("(") else {})
        elif c.now.kind == "str":
            out[key] = c.take().value[0]
        elif c.accept("-"):
            out[key] = -c.take().value
        else:
            t = c.take()
            out[key] = t.value if t.kind == "num" else t.text
    return out


def statements(step) -> dict[str, list[Cursor]]:
    """The procedure's statements by their first word."""
    out: dict[str, list[Cursor]] = {}
    for c in step.statements:
        c.i = 0
        out.setdefault(c.take().low, []).append(c)
    return out


def _input(engine, h: dict, st: dict, key: str = "data") -> Dataset:
    name, options = h.get(key) or (engine.macro.get("SYSLAST"), {})
    d = engine.apply_options(engine.find(name), options)
    for c in st.get("where", []):
        d = Dataset(d.df.filter(C.condition(c.expression(), engine.scope(d.df))), d.variables, d.order, d.sort_keys)
    return d


def _names(cs: list[Cursor], columns: list[str]) -> list[str]:
    out = []
    for c in cs:
        while c.now.kind in ("name", "str"):
            out += expand_names(c.name_list_item(), columns)
            if c.at("/"):
                break
    return out


def _by(st: dict, columns: list[str]) -> list[tuple[str, bool]]:
    return [(n, desc) for c in st.get("by", []) for item, desc in by_list(c) for n in expand_names(item, columns)]


def _numeric(d: Dataset, but=()) -> list[str]:
    return [f.name for f in d.visible.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def _put(engine, target, df: DataFrame, variables=None, order=None) -> None:
    name, options = target if isinstance(target, tuple) else (target, {})
    d = Dataset(df, dict(variables or {}), order or [])
    engine.put_dataset(name, engine.apply_options(d, options) if options else d)


def _ods(engine, table: str, df: DataFrame) -> None:
    engine.tables[table.lower()] = df
    if table.lower() in engine.ods:
        _put(engine, engine.ods.pop(table.lower()), df)


# data management


def sort(engine, step):
    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    keys = _by(st, d.columns)
    if not keys:
        raise ProgramError("PROC SORT needs BY")
    df = d.visible
    if "nodupkey" in h:
        df = reshape.first_per_key(df, keys)
    elif "noduprecs" in h or "nodup" in h:
        df = df.distinct()
    out = h.get("out") or h.get("data") or (engine.macro.get("SYSLAST"), {})
    made = Dataset(df, d.variables, reshape.total_order(df, keys), keys)
    name, options = out if "out" in h else (out[0], {})
    engine.put_dataset(name, engine.apply_options(made, options) if options else made)


def transpose(engine, step):
    h, st = header(step.header), statements(step)
    d = with_obs(_input(engine, h, st))
    by = [c for c, _ in _by(st, d.columns)]
    ids = _names(st.get("id", []), d.columns)[:1]
    variables = _names(st.get("var", []), d.columns) or [v for v in _numeric(d) if v not in (*by, *ids)]
    label = str(h["label"]) if "label" in h else None
    df = reshape.transpose(d.df, by, variables, ids[0] if ids else None, str(h.get("prefix", "")), str(h.get("name", "_NAME_")), label, {k: v.label for k, v in d.variables.items() if v.label})
    _put(engine, h.get("out", ("data1", {})), df, d.variables, [(c, False) for c in [*by, OBS]])


def compare(engine, step):
    h, st = header(step.header), statements(step)
    a, b = _input(engine, h, {}, "base"), _input(engine, h, {}, "compare" if "compare" in h else "comp")
    ids = _names(st.get("id", []), a.columns)
    low = {c.lower() for c in b.columns}
    x, y = a.df, b.df
    if not ids:
        a, b = with_obs(a), with_obs(b)
        x, y, ids = number(a.df, a.order, "_OBS_"), number(b.df, b.order, "_OBS_"), ["_OBS_"]
    variables = _names(st.get("var", []), a.columns) or [c for c in a.columns if c.lower() in low and c not in ids]
    out = reshape.compare(x, y, ids, variables, float(h.get("criterion", 1e-12)))
    engine.tables["compare"] = out
    if "out" in h:
        _put(engine, h["out"], out)


def append(engine, step):
    h = header(step.header)
    base, data = h["base"][0], _input(engine, h, {})
    if not engine.exists(base):
        engine.put_dataset(base, data)
        return
    b = engine.find(base)
    low = {c.lower(): c for c in data.columns}
    cols = [(F.col(low[f.name.lower()]).cast(f.dataType) if f.name.lower() in low else F.lit(None).cast(f.dataType)).alias(f.name) for f in b.visible.schema.fields]
    engine.put_dataset(base, Dataset(b.visible.unionByName(data.visible.select(*cols)), b.variables))


def copy(engine, step):
    h, st = header(step.header), statements(step)
    src, dst = engine.library(str(h["in"])), h["out"][0] if isinstance(h["out"], tuple) else str(h["out"])
    names = src.names()
    chosen = {n.upper() for n in _names(st.get("select", []), [])}
    gone = {n.upper() for n in _names(st.get("exclude", []), [])}
    for n in names:
        if (not chosen or n in chosen) and n not in gone:
            engine.put_dataset(f"{dst}.{n}", src.get(n))


def datasets(engine, step):
    h, st = header(step.header), statements(step)
    lib = engine.library(str(h.get("lib") or h.get("library") or h.get("in") or "WORK"))
    if "kill" in h:
        for n in lib.names():
            lib.remove(n)
    for c in st.get("delete", []):
        while c.now.kind == "name":
            item = c.name_list_item()
            for n in [x for x in lib.names() if x.lower().startswith(item[1].lower())] if item[0] == "prefix" else expand_names(item, []):
                lib.remove(n)
    for c in st.get("change", []):
        while c.now.kind == "name":
            old = c.name()
            c.expect("=")
            lib.put(c.name(), lib.get(old))
            lib.remove(old)
    if "modify" in st:
        d = lib.get(st["modify"][0].name())
        for c in st.get("rename", []):
            while c.now.kind == "name":
                old = c.name()
                c.expect("=")
                new = c.name()
                d = engine.apply_options(d, {"rename": [(old, new)]})
        for c in st.get("label", []):
            for n, t in labels(c):
                d.var(n).label = t
        for c in st.get("format", []):
            for items, f in format_list(c):
                for i in items:
                    for n in expand_names(i, d.columns):
                        d.var(n).format = f
        st["modify"][0].i = 1
        lib.put(st["modify"][0].name(), d)
    for c in st.get("contents", []):
        hh = header(c)
        if isinstance(hh.get("data"), tuple):
            engine.tables["contents"] = _contents(engine, engine.find(hh["data"][0]))


def _contents(engine, d: Dataset) -> DataFrame:
    rows = []
    for i, f in enumerate(d.visible.schema.fields, 1):
        v = d.variables.get(f.name.lower(), Variable())
        rows.append((i, f.name, "Char" if C.kind_of(f.dataType) == "c" else "Num", v.length or 8, v.format or "", v.informat or "", v.label or ""))
    return engine.spark.createDataFrame(rows, "varnum int, variable string, type string, length int, format string, informat string, label string")


def contents(engine, step):
    h = header(step.header)
    d = _input(engine, h, {})
    out = _contents(engine, d)
    _ods(engine, "variables", out)
    engine.tables["contents"] = out
    if "out" in h:
        _put(engine, h["out"], out)


def print_(engine, step):
    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    by = [c for c, _ in _by(st, d.columns)]
    ids = _names(st.get("id", []), d.columns)
    variables = _names(st.get("var", []), d.columns) or [c for c in d.columns if c not in ids]
    sums = _names(st.get("sum", []), d.columns)
    df = d.ordered.select(*dict.fromkeys([*by, *ids, *variables]))
    scope = engine.scope(df)
    formats = {n.lower(): f for c in st.get("format", []) for items, f in format_list(c) for i in items for n in expand_names(i, d.columns)}
    df = df.withColumns({c: F.expr(C.formatted(C.sql(("name", c), scope), formats[c.lower()], scope)) for c in df.columns if formats.get(c.lower())})
    engine.tables["print"] = df
    if sums:
        engine.tables["print_sums"] = d.visible.rollup(*by).agg(*(F.sum(s).alias(s) for s in sums)) if by else d.visible.agg(*(F.sum(s).alias(s) for s in sums))


def format_(engine, step):
    h, st = header(step.header), statements(step)
    for c in st.get("value", []):
        name = ("$" if c.accept("$") else "") + c.name().lower()
        entries = []
        while c.now.kind != "end":
            ranges = []
            while True:
                ranges.append(_range(c))
                if not c.accept(","):
                    break
            c.expect("=")
            t = c.take()
            label = t.value[0] if t.kind == "str" else t.text
            entries += [("other", label) if r == "other" else (*r, label) for r in ranges]
        engine.formats[name] = entries
    if "cntlin" in h:
        d = _input(engine, h, {}, "cntlin")
        low = {c.lower(): c for c in d.columns}
        for r in d.ordered.collect():  # a control table is as small as the formats it makes
            get = lambda k, r=r: r[low[k]] if k in low else None
            text = str(get("type") or "N").upper() == "C"
            name = str(get("fmtname")).strip().lower().lstrip("$")
            name = "$" + name if text else name
            hlo = str(get("hlo") or "").upper()
            entries = engine.formats.setdefault(name, []) if name in engine.formats and engine.formats[name] and engine.formats[name][0] == "cntlin" else engine.formats.setdefault(name, [])
            label = str(get("label"))
            if "O" in hlo:
                entries.append(("other", label))
                continue
            conv = (lambda v: str(v).strip()) if text else (lambda v: float(str(v).strip()))
            low_, high = (None if "L" in hlo else conv(get("start"))), (None if "H" in hlo else conv(get("end") if get("end") not in (None, "") else get("start")))
            entries.append((low_, high, str(get("sexcl") or "N").upper() == "Y", str(get("eexcl") or "N").upper() == "Y", label))


def _range(c: Cursor):
    if c.accept("other"):
        return "other"

    def bound():
        if c.accept("low", "high"):
            return None
        if c.accept("."):
            return "missing"
        neg = c.accept("-")
        t = c.take()
        return t.value[0] if t.kind == "str" else -t.value if neg else t.value

    is_low = c.at("low")
    a = bound()
    if a == "missing":
        return ("missing", "missing", False, False)
    open_a = open_z = False
    if c.at("-", "<"):
        open_a = c.accept("<")
        c.expect("-")
        open_z = c.accept("<")
        return (a, bound(), open_a, open_z)
    return (None, None, False, False) if is_low else (a, a, False, False)


def import_(engine, step):
    from ..sources import files

    h = header(step.header)
    path = str(h.get("datafile") or h.get("file"))
    st = statements(step)
    h |= {k: (cs[0].accept("="), cs[0].take())[1].text.strip("'\"") for k, cs in st.items() if k in ("getnames", "delimiter", "guessingrows")}
    dbms = str(h.get("dbms", Path(path).suffix.lstrip("."))).lower()
    names = str(h.get("getnames", "yes")).lower() != "no"
    if dbms in ("xlsx", "excel", "xls"):
        df = files.read_workbook(engine.spark, path, names)
    else:
        sep = h.get("delimiter") or ("\t" if dbms == "tab" else " " if dbms == "dlm" else ",")
        df = files.read_delimited(engine.spark, path, "\t" if sep in ("09", "\\t") else str(sep), names)
    _put(engine, h["out"], df)


def export(engine, step):
    from ..sources import files

    h = header(step.header)
    path = str(h.get("outfile") or h.get("file"))
    if Path(path).exists() and "replace" not in h:
        raise ProgramError(f"{path} exists; EXPORT needs REPLACE")
    d = _input(engine, h, {})
    dbms = str(h.get("dbms", Path(path).suffix.lstrip("."))).lower()
    if dbms in ("xlsx", "excel"):
        files.write_workbook(d, path, str(h.get("sheet", "Sheet1")), "label" in h)
    else:
        sep = h.get("delimiter") or ("\t" if dbms == "tab" else " " if dbms == "dlm" else ",")
        files.write_delimited(d, path, str(sep))


# descriptive


def means(engine, step):
    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    groups = [c for c, _ in _by(st, d.columns)] + _names(st.get("class", []), d.columns)
    variables = _names(st.get("var", []), d.columns) or _numeric(d, groups)
    stats = [k for k in h if k in summary.STATISTICS] or ["n", "mean", "std", "min", "max"]
    engine.tables["means"] = summary.means_long(d.visible, groups, variables, stats)
    if "out" in h:
        outs = [(s, v, f"{v}_{n}") for v in variables for s, n in (("n", "count"), ("mean", "mean"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("std", "std"))]
        _put(engine, h["out"], summary.means(d.visible, groups, outs), d.variables)
    for c in st.get("output", []):
        target, outs = None, []
        while c.now.kind != "end":
            if c.accept("/"):
                break
            key = c.name().lower()
            of = variables
            if c.accept("("):
                of = []
                while not c.accept(")"):
                    of += expand_names(c.name_list_item(), d.columns)
            c.expect("=")
            if key == "out":
                name = dotted(c)
                target = (name, dataset_options(c) if c.at("(") else {})
                continue
            names = []
            while c.now.kind == "name" and c.peek().text not in ("=", "("):
                names.append(c.name())
            if not names:
                names = of if len(of) == 1 else [f"{v}_{key}" for v in of]
            outs += [(key, v, n) for v, n in zip(of, names, strict=False)]
        _put(engine, target, summary.means(d.visible, groups, outs or [(s, v, f"{v}_{s}") for v in variables for s in stats]), d.variables, [(g, False) for g in groups])


def _requests(c: Cursor) -> tuple[list[list[str]], dict]:
    out = []
    while c.now.kind == "name":
        one = [c.name()]
        while c.accept("*"):
            one.append(c.name())
        out.append(one)
    options = {}
    if c.accept("/"):
        options = header(c)
    return out, options


def freq(engine, step):
    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    weight = (_names(st.get("weight", []), d.columns) or [None])[0]
    low = {c.lower(): c for c in d.columns}
    for c in st.get("tables", []) + st.get("table", []):
        requests, o = _requests(c)
        missing = "missing" in o
        for names in requests:
            names = [low[n.lower()] for n in names]
            if len(names) == 1:
                engine.tables["onewayfreqs"] = summary.freq_one(d.visible, names[0], missing, weight)
            else:
                cells = summary.freq_two(d.visible, names[-2], names[-1], missing)
                engine.tables["crosstab"] = cells
                if "chisq" in o:
                    _ods(engine, "chisq", summary.chi_square(cells, names[-2], names[-1]))
        if "out" in o:
            _put(engine, o["out"], summary.freq_out(d.visible, [low[n.lower()] for n in requests[-1]], missing, weight), d.variables)


def univariate(engine, step):
    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    groups = [c for c, _ in _by(st, d.columns)] + _names(st.get("class", []), d.columns)
    variables = _names(st.get("var", []), d.columns) or _numeric(d, groups)
    out = summary.univariate(d.visible, groups, variables)
    _ods(engine, "moments", out)
    engine.tables["univariate"] = out
    if len(variables) == 1:
        engine.tables["extremeobs"] = summary.extremes(d.visible, variables[0])


def tabulate(engine, step):
    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    classes = {n.lower(): n for n in _names(st.get("class", []), d.columns)}
    variables = {n.lower(): n for n in _names(st.get("var", []), d.columns)}
    for c in st.get("table", []) + st.get("tables", []):
        words = []
        while c.now.kind != "end" and not c.at("/"):
            t = c.take()
            if t.kind == "name":
                words.append(t.low)
        groups = [classes[w] for w in words if w in classes]
        of = [variables[w] for w in words if w in variables]
        stats = [w for w in words if w in summary.STATISTICS] or (["sum"] if of else ["n"])
        if of:
            engine.tables["tabulate"] = summary.means_long(d.visible, groups, of, stats)
        else:
            engine.tables["tabulate"] = d.visible.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))


def report(engine, step):
    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    low = {c.lower(): c for c in d.columns}
    columns = _names(st.get("column", []) + st.get("columns", []), d.columns) or d.columns
    use, stat, order = {}, {}, []
    for c in st.get("define", []):
        name = low[c.name().lower()]
        c.accept("/")
        while c.now.kind != "end":
            t = c.take()
            if t.low in ("group", "order", "analysis", "display", "across"):
                use[name] = t.low
            elif t.low in ("sum", "mean", "min", "max", "n", "std", "median"):
                stat[name] = t.low
                use.setdefault(name, "analysis")
    groups = [c for c in columns if use.get(c) == "group"]
    if groups:
        summed = [c for c in columns if c not in groups and (use.get(c) == "analysis" or isinstance(d.df.schema[c].dataType, T.NumericType))]
        df = summary.means(d.visible, groups, [(stat.get(c, "sum"), c, c) for c in summed])
        if plain := [c for c in columns if c not in groups and c not in summed]:
            df = same_group(df, d.visible.groupBy(*groups).agg(*(F.first(c).alias(c) for c in plain)), groups)
        df = df.select(*columns)
        order = [(g, False) for g in groups]
    else:
        df = d.visible.select(*columns)
        order = [(c, False) for c in columns if use.get(c) == "order"]
    engine.tables["report"] = df
    if "out" in h:
        _put(engine, h["out"], df, d.variables, order)


def sgrender(engine, step):
    h = header(step.header)
    if "data" in h:
        engine.find(h["data"][0])


# models


def _frame(engine, rows: list[tuple], schema: str) -> DataFrame:
    py = lambda v: None if v is None else float(v) if hasattr(v, "dtype") else v
    return engine.spark.createDataFrame([tuple(map(py, r)) for r in rows], schema)


def corr(engine, step):
    from ..stats import models as M

    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    variables = _names(st.get("var", []), d.columns) or _numeric(d)
    kinds = [k for k in ("pearson", "spearman", "kendall") if k in h] or ["pearson"]
    for kind in kinds:
        if kind == "kendall":
            rows = [(a, b, M.kendall(d.visible, a, b) if a != b else 1.0) for a in variables for b in variables]
            out = _frame(engine, rows, "variable string, with string, r double")
        else:
            out = M.pearson(d.visible, variables) if kind == "pearson" else M.spearman(d.visible, variables)
        _ods(engine, f"{kind}corr", out)
        target = h.get({"pearson": "outp", "spearman": "outs", "kendall": "outk"}[kind]) or (h.get("out") if kind == kinds[0] else None)
        if target:
            wide = out.groupBy(F.lit("CORR").alias("_TYPE_"), F.col("variable").alias("_NAME_")).pivot("with", variables).agg(F.first("r"))
            _put(engine, target, wide)


def ttest(engine, step):
    from ..stats import models as M

    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    results = []
    for c in st.get("paired", []):
        a = c.name()
        c.expect("*")
        b = c.name()
        results.append((f"{a} - {b}", M.t_one(d.visible.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), F.col(a).cast("double") - F.col(b).cast("double"))))
    groups = _names(st.get("class", []), d.columns)
    for v in _names(st.get("var", []), d.columns):
        results.append((v, M.t_two(d.visible, v, groups[0]) if groups else M.t_one(d.visible, v, float(h.get("h0", 0)))))
    _ods(engine, "ttests", _frame(engine, [(n, r["t"], float(r["df"]), r["p"]) for n, r in results], "variable string, tvalue double, df double, probt double"))
    engine.results = dict(results)


def _model(c: Cursor) -> tuple[list, list[str], dict]:
    left, depth = [], 0
    while depth or not c.at("="):
        depth += c.at("(") - c.at(")")
        left.append(c.take())
    c.expect("=")
    xs = []
    while c.now.kind in ("name", "str") and not c.at("/"):
        xs.append(c.name())
    o = header(c) if c.accept("/") else {}
    return left, xs, o


def reg(engine, step):
    from ..stats import models as M

    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    low = {c.lower(): c for c in d.columns}
    left, xs, o = _model(st["model"][0])
    y, xs = low[left[-1].low], [low[x.lower()] for x in xs]
    fit = M.ols(d.visible, y, xs, "noint" not in o)
    rows = list(zip(fit["names"], fit["estimate"], fit["stderr"], fit["t"], fit["p"], strict=True))
    _ods(engine, "parameterestimates", _frame(engine, rows, "variable string, estimate double, stderr double, tvalue double, probt double"))
    _ods(engine, "fitstatistics", _frame(engine, [(float(fit["n"]), fit["rsquare"], fit["adjrsq"], fit["rmse"], fit["f"], fit["pf"])], "n double, rsquare double, adjrsq double, rmse double, fvalue double, probf double"))
    engine.results = fit
    if "outest" in h:
        _put(engine, h["outest"], _frame(engine, [("PARMS", y, fit["rmse"], *fit["estimate"])], "_TYPE_ string, _DEPVAR_ string, _RMSE_ double, " + ", ".join(f"`{n}` double" for n in fit["names"])))
    _output(engine, st, d, M.linear_predictor(fit["names"], fit["estimate"]), F.col(y))


def _output(engine, st, d: Dataset, predicted, y=None) -> None:
    for c in st.get("output", []):
        o = header(c)
        df = d.df
        for k in ("p", "predicted", "pred"):
            if k in o:
                df = df.withColumn(str(o[k]), predicted)
        for k in ("r", "residual"):
            if k in o:
                df = df.withColumn(str(o[k]), y.cast("double") - predicted)
        _put(engine, o["out"], df, d.variables, d.order)


def _design(df: DataFrame, names: list[str], classes: dict, low: dict):
    from ..stats import models as M

    xs, effects = [], {}
    for n in names:
        c = low[n.lower()]
        cols = M.dummies(df, c, classes[n.lower()]) if n.lower() in classes else [(c, F.col(c).cast("double"))]
        effects[c] = [len(xs) + i for i in range(len(cols))]
        xs += cols
    return xs, effects


def _classes(st: dict, default: str) -> dict:
    out = {}
    for c in st.get("class", []):
        while c.now.kind == "name":
            n, ref = c.name().lower(), None
            if c.accept("("):
                while not c.accept(")"):
                    key = c.take().low
                    if c.accept("="):
                        t = c.take()
                        if key == "ref":
                            ref = t.value[0] if t.kind == "str" else t.text
            out[n] = ref or default
            if c.accept("/"):
                o = header(c)
                out = {k: str(o["ref"]) if "ref" in o else v for k, v in out.items()}
    return out


def _event(df: DataFrame, y: str, left, h: dict):
    """The condition that is modelled: the smallest level, unless told otherwise."""
    from ..stats import models as M

    values = M.levels(df, y, 2)
    text = " ".join(t.text for t in left)
    m = re.search(r"event\s*=\s*['\"]?([^'\")]+)", text, re.I)
    if m and m[1].strip().lower() not in ("first", "last"):
        return F.col(y) == F.lit(M.reference_level(values, m[1].strip()))
    down = "descending" in h or "desc" in h or re.search(r"desc", text, re.I) or m and m[1].strip().lower() == "last"
    return F.col(y) == F.lit(values[-1] if down else values[0])


def logistic(engine, step):
    from ..stats import models as M

    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    low = {c.lower(): c for c in d.columns}
    left, names, o = _model(st["model"][0])
    y = low[left[0].low]
    df = M._complete(d.visible, [y, *(low[n.lower()] for n in names)])
    xs, _ = _design(df, names, _classes(st, "first"), low)
    event = _event(df, y, left[1:], h)
    xs = ([("Intercept", F.lit(1.0))] if "noint" not in o else []) + xs
    fit = M.irls(df, event, xs)
    rows = list(zip(fit["names"], fit["estimate"], fit["stderr"], fit["chisq"], fit["p"], strict=True))
    _ods(engine, "parameterestimates", _frame(engine, rows, "variable string, estimate double, stderr double, waldchisq double, probchisq double"))
    import numpy as np

    z = 1.959963984540054
    _ods(engine, "oddsratios", _frame(engine, [(n, np.exp(b), np.exp(b - z * s), np.exp(b + z * s)) for n, b, s in zip(fit["names"], fit["estimate"], fit["stderr"], strict=True) if n != "Intercept"], "effect string, oddsratioest double, lowercl double, uppercl double"))
    engine.results = fit
    if "outest" in h:
        _put(engine, h["outest"], _frame(engine, [("PARMS", *fit["estimate"])], "_TYPE_ string, " + ", ".join(f"`{n}` double" for n in fit["names"])))
    eta = sum((F.lit(float(b)) * x for b, (_, x) in zip(fit["estimate"], xs, strict=True)), F.lit(0.0))
    _output(engine, st, d, 1 / (1 + F.exp(-eta)))


def genmod(engine, step):
    import numpy as np

    from ..stats import models as M
    from ..stats.special import probchi

    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    low = {c.lower(): c for c in d.columns}
    left, names, o = _model(st["model"][0])
    if str(o.get("dist", o.get("d", "binomial"))).lower() not in ("bin", "binomial", "b") or str(o.get("link", "logit")).lower() != "logit":
        raise ProgramError("PROC GENMOD: DIST=BINOMIAL with LINK=LOGIT only")
    by = [c for c, _ in _by(st, d.columns)]
    classes = _classes(st, "last")
    estimates = st.get("estimate", [])
    pe, an, es = [], [], []
    for key, part in _groups(d.visible, by):
        y = low[left[0].low]
        df = M._complete(part, [y, *(low[n.lower()] for n in names)])
        xs, effects = _design(df, names, classes, low)
        xs = [("Intercept", F.lit(1.0)), *xs]
        rows = M.equal_rows(df, {"__e": _event(df, y, left[1:], h), **{f"__c{i}": x for i, (_, x) in enumerate(xs)}})
        xs = [(n, F.col(f"__c{i}")) for i, (n, _) in enumerate(xs)]
        fit = M.irls(rows, F.col("__e"), xs)
        for i, n in enumerate(fit["names"]):
            lo, hi = M.profile_interval(fit, lambda others, start, offset, rows=rows: M.irls(rows, F.col("__e"), others, start=start, offset=offset), xs, i) if "lrci" in o else (fit["estimate"][i] - 1.959963984540054 * fit["stderr"][i], fit["estimate"][i] + 1.959963984540054 * fit["stderr"][i])
            pe.append((*key, n, 1.0, fit["estimate"][i], fit["stderr"][i], lo, hi, fit["chisq"][i], fit["p"][i]))
        if "type3" in o:
            for e, at in effects.items():
                less = M.irls(rows, F.col("__e"), [x for i, x in enumerate(xs) if i - 1 not in at])
                chi = max(0.0, 2 * (fit["loglik"] - less["loglik"]))
                an.append((*key, e, float(len(at)), chi, 1 - probchi(chi, len(at))))
        for c in estimates:
            c.i = 1
            label = c.take().value[0]
            weights = np.zeros(len(xs))
            now = None
            while c.now.kind != "end" and not c.at("/"):
                if c.now.kind == "name":
                    n = c.name().lower()
                    now = [0] if n == "intercept" else [1 + i for i in effects[low[n]]]
                    k = 0
                else:
                    neg = c.accept("-")
                    v = float(c.take().value) * (-1 if neg else 1)
                    if k < len(now):
                        weights[now[k]] = v
                    k += 1
            value, se = float(weights @ fit["estimate"]), float(np.sqrt(weights @ fit["cov"] @ weights))
            lo, hi = value - 1.959963984540054 * se, value + 1.959963984540054 * se
            es.append((*key, label, value, se, lo, hi, (value / se) ** 2, 1 - probchi((value / se) ** 2, 1)))
            if c.accept("/") and c.at("exp"):
                es.append((*key, f"Exp({label})", np.exp(value), np.exp(value) * se, np.exp(lo), np.exp(hi), None, None))
        engine.results = fit
    keys = "".join(f"`{b}` {d.df.schema[b].dataType.simpleString()}, " for b in by)
    _ods(engine, "parameterestimates", _frame(engine, pe, keys + "parameter string, df double, estimate double, stderr double, lowercl double, uppercl double, chisq double, probchisq double"))
    if an:
        _ods(engine, "modelanova", _frame(engine, an, keys + "source string, df double, chisq double, probchisq double"))
    if es:
        _ods(engine, "estimates", _frame(engine, es, keys + "label string, estimate double, stderr double, lowercl double, uppercl double, chisq double, probchisq double"))


def _groups(df: DataFrame, by: list[str], most: int = 1000):
    """(key, rows) of each BY group; their number is bounded, as each is a model of its own."""
    if not by:
        return [((), df)]
    keys = df.select(*by).distinct().orderBy(*by).limit(most + 1).collect()
    if len(keys) > most:
        raise ProgramError(f"more than {most} BY groups")
    out = []
    for k in keys:
        part = df
        for c in by:
            part = part.filter(F.col(c).eqNullSafe(F.lit(k[c])))
        out.append((tuple(k), part))
    return out


def _time(c: Cursor) -> tuple[str, str | None, list[float]]:
    t = c.name()
    if not c.accept("*"):
        return t, None, []
    e, values = c.name(), []
    c.expect("(")
    while not c.accept(")"):
        if c.at(","):
            c.take()
            continue
        neg = c.accept("-")
        values.append(float(c.take().value) * (-1 if neg else 1))
    return t, e, values


def lifetest(engine, step):
    from ..stats import models as M

    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    low = {c.lower(): c for c in d.columns}
    t, e, censored = _time(st["time"][0])
    t = low[t.lower()]
    event = ~F.col(low[e.lower()]).cast("double").isin(censored) if e else F.lit(True)
    # STRATA a b / GROUP=g: curves for each combination, and a test of g inside of the strata
    groups, within = _names(st.get("strata", []), d.columns), []
    for c in st.get("strata", []):
        if c.accept("/") and "group" in (o := header(c)):
            within, groups = groups, [*groups, low[str(o["group"]).lower()]]
    df = d.visible.filter(F.col(t).isNotNull() & (F.col(low[e.lower()]).isNotNull() if e else F.lit(True)))
    km = M.kaplan_meier(df, t, event, groups)
    _ods(engine, "survivalplot", km)
    _ods(engine, "productlimitestimates", km)
    _ods(engine, "quartiles", M.quartiles(km, groups))
    if "outsurv" in h:
        s, lo = F.col("survival"), F.log(-F.log("survival"))
        half = F.lit(1.959963984540054) * F.col("stderr") / (s * F.abs(F.log(s)))
        ok = (s > 0) & (s < 1)
        out = km.select(*groups, F.col("time").alias(t), (F.col("n_event") == 0).cast("int").alias("_CENSOR_"), s.alias("SURVIVAL"), F.when(ok, F.exp(-F.exp(lo + half))).alias("SDF_LCL"), F.when(ok, F.exp(-F.exp(lo - half))).alias("SDF_UCL"))
        _put(engine, h["outsurv"], out, order=[(c, False) for c in [*groups, t]])
    if groups:
        test = M.log_rank(df, t, event, [g for g in groups if g not in within], within)
        result = _frame(engine, [("Log-Rank", test["chisq"], float(test["df"]), test["p"])], "test string, chisq double, df double, probchisq double")
        for name in ("homtests", "logunichisq"):
            _ods(engine, name, result)
        engine.results = test


def phreg(engine, step):
    from ..stats import models as M
    from ..stats.special import probit

    h, st = header(step.header), statements(step)
    d = _input(engine, h, st)
    low = {c.lower(): c for c in d.columns}
    c = st["model"][0]
    t, e, censored = _time(c)
    c.expect("=")
    names = []
    while c.now.kind == "name":
        names.append(c.name())
    t, e = low[t.lower()], low[e.lower()]
    strata = _names(st.get("strata", []), d.columns)
    by = [x for x, _ in _by(st, d.columns)]
    classes = _classes(st, "last")
    wanted = []  # HAZARDRATIO 'label' variable / CL=PL ALPHA=
    for c in st.get("hazardratio", []):
        label = c.take().value[0] if c.now.kind == "str" else ""
        name = low[c.name().lower()]
        wanted.append((label or name, name, header(c) if c.accept("/") else {}))
    pe, hr = [], []
    for key, part in _groups(d.visible, by):
        df = M._complete(part, [t, e, *(low[n.lower()] for n in names)])
        xs, effects = _design(df, names, classes, low)
        event = ~F.col(e).cast("double").isin(censored)
        rows = M.risk_rows(df, t, event, [x for _, x in xs], strata)
        xs = [(n, F.col(f"x{i}")) for i, (n, _) in enumerate(xs)]
        fit = M.cox_fit(rows, xs)
        for i, n in enumerate(fit["names"]):
            pe.append((*key, n, 1.0, fit["estimate"][i], fit["stderr"][i], fit["chisq"][i], fit["p"][i], fit["hr"][i]))
        for label, name, o in wanted or [(n, n, {}) for n in effects]:
            alpha = float(o.get("alpha", 0.05))
            z = float(probit(1 - alpha / 2))
            for i in effects[name]:
                b, se = fit["estimate"][i], fit["stderr"][i]
                limits = M.profile_interval(fit, lambda others, start, offset, rows=rows: M.cox_fit(rows, others, start=start, offset=offset), xs, i, alpha) if str(o.get("cl", "")).lower() == "pl" else (None, None)
                hr.append((*key, label + fit["names"][i][len(name) :], fit["hr"][i], math.exp(b - z * se), math.exp(b + z * se), *(None if x is None else math.exp(x) for x in limits)))
        rows.df.unpersist()
        engine.results = fit
    keys = "".join(f"`{b}` {d.df.schema[b].dataType.simpleString()}, " for b in by)
    _ods(engine, "parameterestimates", _frame(engine, pe, keys + "parameter string, df double, estimate double, stderr double, chisq double, probchisq double, hazardratio double"))
    _ods(engine, "hazardratios", _frame(engine, hr, keys + "description string, hazardratio double, waldlower double, waldupper double, pllower double, plupper double"))


HANDLERS = {
    "sort": sort, "transpose": transpose, "compare": compare, "append": append, "copy": copy, "datasets": datasets, "contents": contents, "print": print_,
    "format": format_, "import": import_, "export": export, "means": means, "summary": means, "freq": freq, "univariate": univariate, "tabulate": tabulate,
    "report": report, "sgrender": sgrender, "corr": corr, "ttest": ttest, "reg": reg, "logistic": logistic, "genmod": genmod, "lifetest": lifetest, "phreg": phreg,
}
__all__ = ["HANDLERS", "OBS", "header", "into_text"]
