"""Data steps to DataFrames.

The body is executed symbolically: each assignment is a column, each condition a boolean column under which later
statements stand, each OUTPUT a snapshot of the variables. What depends on the order of observations is a window:
FIRST. and LAST., sum statements, carried values, LAG. Bodies beyond that go to the row interpreter, in parallel
where they have no state or a state that each BY group starts anew.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import char, num, quote
from ..lang.expressions import expand_names, walk
from ..lang.lexer import ProgramError
from ..operators import merge as M
from ..operators import prefix as P
from . import compile as C
from .dataset import OBS, Dataset, Variable, number, with_obs, with_place
from .interp import Interpreter, _has

_DECLARATIONS = {"set", "merge", "update", "by", "where", "keep", "drop", "rename", "retain", "array", "length", "format", "informat", "label", "attrib", "infile", "input", "datalines"}
MOST_UNROLLED = 400


class Sequential(Exception):
    """The body needs the row interpreter."""


@dataclass
class Plan:
    """What the declarations of a step say."""

    sets: list = field(default_factory=list)
    merge: tuple | None = None
    update: tuple | None = None
    by: list[tuple[str, bool]] = field(default_factory=list)
    by_items: list = field(default_factory=list)
    where: tuple | None = None
    keep: list = field(default_factory=list)
    drop: list = field(default_factory=list)
    rename: list = field(default_factory=list)
    retain: dict = field(default_factory=dict)
    retain_items: list = field(default_factory=list)
    arrays: dict = field(default_factory=dict)
    temporary: dict = field(default_factory=dict)
    lengths: list = field(default_factory=list)
    attrs: list = field(default_factory=list)
    end: str | None = None
    infile: dict = field(default_factory=dict)
    inputs: list = field(default_factory=list)
    datalines: int | None = None
    body: list = field(default_factory=list)
    array_items: list = field(default_factory=list)


def _plan(body) -> Plan:
    p = Plan()
    for s in body:
        k = s[0]
        if k == "set":
            p.sets.append(s[1])
            p.end = s[2].get("end", p.end)
        elif k == "merge":
            p.merge, p.end = s[1], s[2].get("end", p.end)
        elif k == "update":
            p.update = s[1]
        elif k == "by":
            p.by_items = s[1]
        elif k == "where":
            p.where = s[1] if p.where is None else ("and", p.where, s[1])
        elif k in ("keep", "drop", "rename"):
            getattr(p, k).extend(s[1])
        elif k == "retain":
            p.retain_items += s[1]
        elif k == "array":
            p.array_items.append(s[1:])
        elif k == "length":
            p.lengths += s[1]
        elif k in ("format", "informat", "label", "attrib"):
            p.attrs.append(s)
        elif k == "infile":
            p.infile = s[1]
        elif k == "input":
            p.inputs += s[1]
        elif k == "datalines":
            p.datalines = s[1]
        else:
            p.body.append(s)
    return p


class DataStepCompiler:
    """Runs one data step for an engine (its datasets, options, formats, macro values and log)."""

    def __init__(self, engine, step):
        self.engine, self.step, self.p = engine, step, _plan(step.body)
        self.spark = engine.spark
        self.labels: dict[str, Variable] = {}
        self.kept_order: list[tuple[str, bool]] = []  # of a single input
        self.flags: list[str] = []
        self.counter = 0

    # inputs

    def sources(self, items) -> list[tuple[Dataset, str | None]]:
        out = []
        for name, options in items:
            for d in self.engine.find_all(name):
                for k, v in d.variables.items():
                    self.labels.setdefault(k, Variable(v.label, v.format, v.informat, v.length))
                out.append((self.engine.apply_options(d, {k: v for k, v in options.items() if k != "in"}), options.get("in")))
        return out

    def by_columns(self, columns: list[str]) -> list[tuple[str, bool]]:
        return [(c, d) for item, d in self.p.by_items for c in expand_names(item, columns)]

    def input(self) -> DataFrame:
        """The rows that the body runs over, with OBS if their order is used."""
        p = self.p
        if p.datalines is not None or p.infile and p.inputs:
            return self.read_lines()
        if p.merge:
            return self.merged()
        if p.update:
            (master, _), (trans, _) = self.sources(p.update)
            by = [c for c, _ in self.by_columns(master.columns)]
            trans = self._same_names(with_place(trans), by)
            df = M.update_master(with_place(master), trans, by)
            self.by = [(c, False) for c in by]
            if self.needs_order:
                df = df.withColumnRenamed(OBS, "__o")
                return number(df, [*self.by, ("__o", False)], OBS).drop("__o")
            return df.drop(OBS)
        if len(p.sets) > 1:
            parts = []
            for items in p.sets:
                d = self._stacked(items)
                parts.append(number(d.drop("__src"), [(OBS, False)], "__k") if OBS in d.columns else d)
            df = M.zip_rows(parts, longest=False)
            return df.withColumn(OBS, F.col("__k")).drop("__k")
        if p.sets:
            self.needs_order = self.needs_order or bool(p.by_items)
            df = self._stacked(p.sets[0])
            self.by = self.by_columns([c for c in df.columns if not c.startswith("__")])
            many = "__src" in df.columns and len(p.sets[0]) > 1
            if self.needs_order and (many or self.by and many):
                keys = [*(self.by if many else []), ("__src", False), (OBS, False)]
                df = number(df.withColumnRenamed(OBS, "__o"), [(k if k != OBS else "__o", d) for k, d in keys], OBS).drop("__o")
            return df.drop("__src")
        return self.spark.range(1).select(F.col("id").alias(OBS))

    def _same_names(self, df: DataFrame, names: list[str]) -> DataFrame:
        low = {c.lower(): c for c in df.columns}
        return df.withColumnsRenamed({low[n.lower()]: n for n in names if n.lower() in low and low[n.lower()] != n})

    def _stacked(self, items) -> DataFrame:
        found = self.sources(items)
        flags = [f for _, f in found]
        self.flags += [f for f in flags if f]
        if self.needs_order or len(self.p.sets) > 1 or self.p.by_items:
            found = [(with_obs(d), f) for d, f in found]
        numbered = all(OBS in d.df.columns for d, _ in found) and (self.needs_order or len(self.p.sets) > 1 or self.p.by_items or len(found) == 1)
        dfs = [d.df if numbered else d.visible for d, _ in found]
        if len(dfs) == 1:
            df = dfs[0]
            self.kept_order = found[0][0].order
            return df.withColumns({f: F.lit(1) for f in flags if f})
        return M.stack(dfs, flags)

    def merged(self) -> DataFrame:
        found = self.sources(self.p.merge)
        flags = [f for _, f in found]
        self.flags += [f for f in flags if f]
        columns = found[0][0].columns
        by = [c for c, _ in self.by_columns(columns)]
        if not by:
            dfs = [with_obs(d).df for d, _ in found]
            parts = [number(df, [(OBS, False)], "__k") for df in dfs]
            for i, f in enumerate(flags):
                if f:
                    parts[i] = parts[i].withColumn(f, F.lit(1))
            df = M.zip_rows(parts, longest=True)
            df = df.withColumns({f: F.coalesce(f, F.lit(0)) for f in flags if f})
            return df.withColumn(OBS, F.col("__k")).drop("__k")
        dfs = [self._same_names(with_place(d), by) for d, _ in found]
        self.engine.note_many_to_many(dfs, by, [n for n, _ in self.p.merge])
        df = M.match_merge(dfs, by, flags)
        self.by = [(c, False) for c in by]
        if self.needs_order:
            return number(df, [*self.by, ("__row", False)], OBS).drop("__row")
        return df.withColumnRenamed("__row", "__row")

    def read_lines(self) -> DataFrame:
        from ..sources.lines import read

        df, variables = read(self.engine, self.p)
        for k, v in variables.items():
            self.labels[k] = v
        return df

    # the whole step

    def run(self) -> None:
        p, engine = self.p, self.engine
        self.by: list[tuple[str, bool]] = []
        # RETAIN, FIRST., LAG and others look at the order; plain rows do not
        self.needs_order = self._looks_at_order()
        df = self.input()
        if p.where is not None:
            df = df.filter(C.condition(p.where, self.scope(df)))
        self._declare(df)
        self.order = [(OBS, False)] if OBS in df.columns else [*self.by, ("__row", False)] if "__row" in df.columns else []
        self.inputs = [c for c in df.columns if not c.startswith("__")]
        try:
            outputs = self.symbolic(df)
        except Sequential as why:
            engine.log("note", f"the step runs row by row: {why}")
            outputs = self.sequential(df)
        self.store(outputs)

    def _looks_at_order(self) -> bool:
        p = self.p
        found = bool(p.retain_items or p.end or _has(p.body, "sum") or _has(p.body, "stop") or len(p.sets) > 1 or "symput" in str(p.body))

        def see(n):
            nonlocal found
            if n[0] == "call" and re.fullmatch(r"(lag|dif)\d*", str(n[1])) or n[0] == "qname" and n[1].lower() in ("first", "last") or n == ("name", "_n_") or n[0] == "name" and n[1].lower() == "_n_":
                found = True

        walk(p.body, see)
        return found

    def _declare(self, df: DataFrame) -> None:
        p, columns = self.p, [c for c in df.columns if not c.startswith("__")]
        self.chars = {f.name.lower() for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        self.declared: list[tuple[str, bool]] = []
        for items, is_char, n in p.lengths:
            for item in items:
                for c in expand_names(item, columns):
                    self.declared.append((c, is_char))
                    self.labels.setdefault(c.lower(), Variable()).length = n
                    if is_char:
                        self.chars.add(c.lower())
        for s in p.attrs:
            if s[0] == "label":
                for n, t in s[1]:
                    self.labels.setdefault(n.lower(), Variable()).label = t
            elif s[0] in ("format", "informat"):
                for items, f in s[1]:
                    for item in items:
                        for c in expand_names(item, columns):
                            setattr(self.labels.setdefault(c.lower(), Variable()), s[0], f)
                            if f and f.startswith("$"):
                                self.declared.append((c, True))
                                self.chars.add(c.lower())
            else:
                for items, key, value in s[1]:
                    for item in items:
                        for c in expand_names(item, columns):
                            v = self.labels.setdefault(c.lower(), Variable())
                            if key == "length":
                                self.declared.append((c, value[0]))
                                v.length = value[1]
                                if value[0]:
                                    self.chars.add(c.lower())
                            else:
                                setattr(v, key, value)
        for name, size, is_char, names, values in p.array_items:
            key = name.lower()
            if names is None:
                p.temporary[key] = list(values) + [None] * ((size or len(values)) - len(values))
                continue
            low = {c.lower() for c in columns}
            cols = []
            for item in names:
                if item[0] == "one" and item[1].lower() in ("_numeric_", "_character_"):
                    cols += [c for c in columns if (c.lower() in self.chars) == (item[1].lower() == "_character_")]
                else:
                    cols += expand_names(item, columns, p.arrays)
            if not cols:
                cols = [f"{name}{i + 1}" for i in range(size or 0)]
            p.arrays[key] = cols
            for i, c in enumerate(cols):
                if c.lower() not in low:
                    self.declared.append((c, is_char))
                    if is_char:
                        self.chars.add(c.lower())
                    if i < len(values):
                        p.retain.setdefault(c.lower(), values[i])
        for items, values in p.retain_items:
            names = [c for item in items for c in expand_names(item, columns, p.arrays)]
            for i, c in enumerate(names):
                p.retain[c.lower()] = None if values is None else values[i] if len(values) > 1 and i < len(values) else values[0] if len(values) == 1 else None
                self.declared.append((c, isinstance(p.retain[c.lower()], str)))
                if isinstance(p.retain[c.lower()], str):
                    self.chars.add(c.lower())

    def scope(self, df: DataFrame) -> C.Scope:
        kinds = {f.name.lower(): (f.name, C.kind_of(f.dataType)) for f in df.schema.fields}

        def column(table, name):
            key = (f"{table}.{name}" if table else name).lower()
            if table and table.lower() in ("first", "last"):
                key = f"__{table.lower()}_{name.lower()}"
            elif key == "_n_":
                key = "__n"
            if key in kinds:
                return C.name_sql(kinds[key][0]), kinds[key][1]
            return None

        s = C.Scope(column, arrays=self.p.arrays, temporary=self.p.temporary, columns=[c for c in df.columns if not c.startswith("__")], formats=self.engine.formats, call=self._call)
        for k, v in self.labels.items():
            if v.label:
                s.labels[k] = v.label
            if v.format:
                s.variable_formats[k] = v.format
        return s

    def _call(self, name, args, scope):
        if name in ("symget", "exist", "open", "close", "varnum", "varname", "vartype", "varlabel", "attrn"):
            values = [a[1] if a[0] in ("str", "num") else None for a in args]
            out = self.engine.session_function(name, values)
            return (quote(out), "c") if isinstance(out, str) else (str(out), "n")
        m = re.fullmatch(r"(lag|dif)(\d*)", name)
        if m:
            raise Sequential(f"{name.upper()} inside of an expression or a condition")
        return None

    # symbolic execution

    def symbolic(self, df: DataFrame) -> list[tuple[str | None, DataFrame]]:
        p = self.p
        if any(v is not None for k, v in p.retain.items()) or p.retain_items:
            self._check_retained()
        for c, is_char in self.declared:
            if c.lower() not in {x.lower() for x in df.columns} and c.lower() not in self._summed():
                v = p.retain.get(c.lower())
                df = df.withColumn(c, F.lit(v).cast("string" if is_char else "double"))
        df = self._order_columns(df)
        self.live: str | None = None
        self.snaps: list[tuple[list[str] | None, str]] = []
        self.assigned: set[str] = set()
        df = self._carried(df)
        for s in p.body:
            df = self._do(df, s, None)
        return self._collect(df)

    def _summed(self) -> set[str]:
        out = set()

        def see(n):
            if n[0] == "sum" and isinstance(n[1], str):
                out.add(n[1].lower())

        walk(self.p.body, see)
        return out

    def _check_retained(self) -> None:
        pass

    def _order_columns(self, df: DataFrame) -> DataFrame:
        used: set[tuple[str, str]] = set()
        names: set[str] = set()

        def see(n):
            if n[0] == "qname" and n[1].lower() in ("first", "last"):
                used.add((n[1].lower(), n[2].lower()))
            if n[0] == "name":
                names.add(n[1].lower())

        walk(self.p.body, see)
        by = self.by
        order = [F.col(c) for c, _ in (self.order or [])]
        for kind, var in sorted(used):
            keys = [c for c, _ in by]
            low = [k.lower() for k in keys]
            if var not in low:
                raise ProgramError(f"{kind.upper()}.{var.upper()}: not a BY variable")
            prefix = keys[: low.index(var) + 1]
            w = Window.partitionBy(*prefix).orderBy(*(o.desc() if kind == "last" else o for o in order))
            df = df.withColumn(f"__{kind}_{var}", (F.row_number().over(w) == 1).cast("int"))
        if "_n_" in names or self.p.end:
            if OBS not in df.columns:
                df = number(df, self.order, OBS) if self.order else df.withColumn(OBS, F.monotonically_increasing_id())
            df = number(df, [(OBS, False)], "__n")
        if self.p.end:
            last = df.agg(F.max("__n").alias("__max"))
            df = df.crossJoin(F.broadcast(last)).withColumn(self.p.end, (F.col("__n") == F.col("__max")).cast("int")).drop("__max")
            self.flags.append(self.p.end)
        return df

    def _reads(self, e) -> set[str]:
        out = set()

        def see(n):
            if n[0] == "name":
                out.add(n[1].lower())
            elif n[0] == "idx":
                out.update(c.lower() for c in self.p.arrays.get(n[1].lower(), []))

        walk(e, see)
        return out

    def _assignments(self, statements, path=()) -> list[tuple[tuple, tuple]]:
        out = []
        for s in statements:
            if s is None:
                continue
            if s[0] in ("assign", "sum"):
                out.append((path, s))
            elif s[0] == "if":
                out += self._assignments([s[2]], (*path, s[1])) + self._assignments([s[3]], (*path, ("not", s[1])))
            elif s[0] == "do":
                out += self._assignments(s[2], (*path, ("loop",)) if s[1] else path)
        return out

    def _first_flags(self, cond) -> str | None:
        """x, if the condition is FIRST.x (or FIRST.x = 1)."""
        if cond[0] == "cmp" and cond[1] == "=" and cond[3] == ("num", 1):
            cond = cond[2]
        return cond[2].lower() if cond[0] == "qname" and cond[1].lower() == "first" else None

    def _carried(self, df: DataFrame) -> DataFrame:
        """Start-of-row values of retained variables whose new values depend on the row's input alone."""
        p = self.p
        every = self._assignments(p.body)
        written = {s[1][1].lower() if s[0] == "assign" and s[1][0] == "name" else s[1].lower() if s[0] == "sum" else None for _, s in every}
        for var in [k for k in p.retain if k in written and k not in self._summed()]:
            own = [(path, s) for path, s in every if s[0] == "assign" and s[1][0] == "name" and s[1][1].lower() == var]
            if OBS not in df.columns:
                df = number(df, self.order, OBS) if self.order else df.withColumn(OBS, F.monotonically_increasing_id())
            inputs = {c.lower() for c in self.inputs}
            extreme = self._extreme(own, var)
            name = self._fresh("carry")
            if extreme:
                how, e, path = extreme
                text = self._under(df, path, num(C.sql(e, self.scope(df))))
                running = P.running_last(df, OBS, F.expr(text), name, how)
            else:
                text = None
                for path, s in own:
                    if ("loop",) in path or any((self._reads(x) - inputs) - {"_n_"} for x in (*path, s[2])):
                        raise Sequential(f"the retained {var.upper()} depends on values made in the step")
                    v = C.sql(s[2], self.scope(df))
                    v = char(v) if var in self.chars else num(v)
                    new = self._under(df, path, f"named_struct('v', {v})")
                    text = new if text is None else f"coalesce({new}, {text})"
                running = P.running_last(df, OBS, F.expr(text), name).withColumn(name, F.col(name)["v"])
            # what the row starts with is what the row before ended with
            before = P.lag(running, OBS, F.struct(F.col(name).alias("x")), 1, f"{name}_before")
            init = F.lit(p.retain[var])
            start = F.coalesce(F.col(f"{name}_before")["x"], init.cast("string" if var in self.chars else "double"))
            df = before.withColumn(var if var not in {c.lower() for c in df.columns} else next(c for c in df.columns if c.lower() == var), start).drop(name, f"{name}_before")
        return df

    def _extreme(self, own, var):
        if len(own) != 1:
            return None
        path, s = own[0]
        e = s[2]
        if e[0] == "call" and e[1] in ("max", "min") and len(e[2]) == 2 and ("name", var) in [(a[0], str(a[1]).lower()) for a in e[2]]:
            other = next(a for a in e[2] if (a[0], str(a[1]).lower()) != ("name", var))
            if self._reads(other) <= {c.lower() for c in self.inputs}:
                return e[1], other, path
        return None

    def _under(self, df, path, text: str) -> str:
        conds = [C.condition(c, self.scope(df), False) for c in path]
        return f"CASE WHEN {' AND '.join(conds)} THEN {text} END" if conds else text

    def _fresh(self, word: str) -> str:
        self.counter += 1
        return f"__{word}{self.counter}"

    def _path(self, path: str | None) -> str:
        parts = [C.name_sql(x) for x in (path, self.live) if x]
        return " AND ".join(parts) or "true"

    def _narrow(self, df: DataFrame, path: str | None, cond: str) -> tuple[DataFrame, str]:
        name = self._fresh("c")
        text = f"coalesce({cond}, false)"
        return df.withColumn(name, F.expr(f"{C.name_sql(path)} AND {text}" if path else text)), name

    def _set(self, df: DataFrame, name: str, value, path: str | None) -> DataFrame:
        low = {c.lower(): c for c in df.columns}
        col = low.get(name.lower(), name)
        is_char = name.lower() in self.chars
        if value[1] == "b":
            value = (f"CAST({value[0]} AS INT)", "n")
        if col in df.columns:
            old = df.schema[col].dataType
            if is_char or isinstance(old, T.StringType):
                value = (char(value) if value[0] != "NULL" else "CAST(NULL AS STRING)", "c")
            elif value[1] == "c":
                value = (num(value), "n")
        elif value[1] == "c":
            self.chars.add(name.lower())
        if value[0] == "NULL":
            value = ("CAST(NULL AS STRING)" if is_char else "CAST(NULL AS DOUBLE)", value[1])
        self.assigned.add(name.lower())
        if path is None:
            return df.withColumn(col, F.expr(value[0]))
        other = C.name_sql(col) if col in df.columns else "NULL"
        if other != "NULL" and C.kind_of(df.schema[col].dataType) in "td" and value[1] == "n":
            other = num((other, C.kind_of(df.schema[col].dataType)))
        return df.withColumn(col, F.expr(f"CASE WHEN {C.name_sql(path)} THEN {value[0]} ELSE {other} END"))

    def _do(self, df: DataFrame, s, path: str | None) -> DataFrame:
        if s is None:
            return df
        kind = s[0]
        if kind == "assign":
            return self._assign(df, s[1], s[2], path)
        if kind == "sum":
            return self._sum(df, s[1], s[2], path)
        if kind == "if":
            self._diagnose(df, s[1], path)
            df, yes = self._narrow(df, path, C.condition(s[1], self.scope(df), False))
            df2 = self._do(df, s[2], yes)
            if s[3] is not None:
                no = self._fresh("c")
                df2 = df2.withColumn(no, F.expr(f"{C.name_sql(path) + ' AND ' if path else ''}NOT {C.name_sql(yes)}"))
                df2 = self._do(df2, s[3], no)
            return df2
        if kind in ("subif", "delete", "return"):
            gone = C.name_sql(path) if path else "true"
            if kind == "subif":
                gone = f"({gone} AND NOT coalesce({C.condition(s[1], self.scope(df), False)}, false))"
            name = self._fresh("live")
            df = df.withColumn(name, F.expr(f"{C.name_sql(self.live) + ' AND ' if self.live else ''}NOT {gone}"))
            self.live = name
            return df
        if kind == "output":
            return self._output(df, s[1], path)
        if kind == "do":
            return self._loop(df, s[1], s[2], path)
        if kind == "stop":
            if OBS not in df.columns:
                raise Sequential("STOP without an order")
            name = self._fresh("stop")
            here = F.when(F.expr(self._path(path)), F.col(OBS))
            first = df.agg(F.min(here).alias(name))
            df = df.crossJoin(F.broadcast(first))
            keep = self._fresh("live")
            df = df.withColumn(keep, F.expr(f"{C.name_sql(self.live) + ' AND ' if self.live else ''}({name} IS NULL OR {OBS} < {name})"))
            # what came before STOP in its own row stays, if it was put out
            self.snaps = [(t, c) for t, c in self.snaps]
            df = df.withColumn(self._fresh("cut"), F.expr(f"{name} IS NULL OR {OBS} <= {name}"))
            self.cut = f"__cut{self.counter}"
            self.live = keep
            return df
        if kind == "call":
            return self._call_routine(df, s, path)
        if kind == "put":
            self.engine.put(df.filter(self._path(path)), s[1], self)
            return df
        raise Sequential(kind.upper())

    def _assign(self, df, target, e, path):
        if target[0] == "idx":
            names = self.p.arrays.get(target[1].lower())
            if names is None:
                raise Sequential("a temporary array is written")
            scope = self.scope(df)
            if target[2][0] == "num":
                k = int(target[2][1])
                return self._assign(df, ("name", names[k - 1]), e, path) if 1 <= k <= len(names) else df
            at, value = C.sql(target[2], scope), C.sql(e, scope)
            i = self._fresh("i")
            v = self._fresh("v")
            df = df.withColumn(i, F.expr(num(at))).withColumn(v, F.expr(value[0]))
            for k, n in enumerate(names, 1):
                df, here = self._narrow(df, path, f"{i} = {k}")
                df = self._set(df, n, (v, value[1]), here)
            return df
        if target[0] == "substr":
            args = target[1]
            old = char(C.sql(args[0], self.scope(df)))
            a = num(C.sql(args[1], self.scope(df)))
            n = num(C.sql(args[2], self.scope(df))) if len(args) > 2 else f"(length({old}) - {a} + 1)"
            new = char(C.sql(e, self.scope(df)))
            text = f"concat(substring({old}, 1, CAST({a} AS INT) - 1), rpad(substring({new}, 1, CAST({n} AS INT)), CAST({n} AS INT), ' '), substring({old}, CAST({a} + {n} AS INT)))"
            return self._set(df, args[0][1], (text, "c"), path)
        if target[0] != "name":
            raise ProgramError(f"can't assign to {target}")
        e, df = self._lags(df, e, path)
        self._diagnose(df, e, path)
        return self._set(df, target[1], C.sql(e, self.scope(df)), path)

    def _diagnose(self, df: DataFrame, e: tuple, path) -> None:
        """With OPTIONS DIAGNOSTICS: warnings of an expression, counted over the rows that reach it, which is a pass of its own."""
        if "diagnostics" not in self.engine.options:
            return
        scope = self.scope(df)
        checks: dict[str, str] = {}

        def see(n) -> None:
            if n[0] == "name" and scope.column(None, n[1]) is None:
                checks[f"Variable {n[1]} is uninitialized"] = "true"
            elif n[0] == "bin":
                a, b = C.sql(n[2], scope), C.sql(n[3], scope)
                if n[1] == "||":
                    if "n" in (a[1], b[1]):
                        checks["Numeric-to-character conversion in concatenation"] = "true"
                    return
                for side in (a, b):
                    if side[1] == "c":
                        checks["Character-to-numeric conversion in arithmetic"] = "true"
                        checks[f"Invalid numeric data in operator {n[1]}"] = f"trim({side[0]}) NOT IN ('', '.') AND ({num(side)}) IS NULL"
                if n[1] == "/":
                    checks["Division by zero"] = f"({num(b)}) = 0"
                checks[f"Missing value generated by operator {n[1]}"] = f"({num(a)}) IS NULL OR ({num(b)}) IS NULL"
            elif n[0] == "cmp" and {C.sql(n[2], scope)[1], C.sql(n[3], scope)[1]} == {"c", "n"}:
                checks["Character-to-numeric conversion in comparison"] = "true"
            elif n[0] == "call" and n[1] in ("sqrt", "log", "log10") and n[2]:
                x = num(C.sql(n[2][0], scope))
                checks[f"Invalid argument of function {n[1].upper()}"] = f"({x}) < 0" if n[1] == "sqrt" else f"({x}) <= 0"

        walk([e], see)
        if not checks:
            return
        reached = df.filter(self._path(path)) if path or self.live else df
        counts = reached.agg(*(F.count_if(F.expr(c)).alias(f"c{i}") for i, c in enumerate(checks.values()))).first()
        for text, n in zip(checks, counts, strict=True):
            if n:
                self.engine.log("warning", f"{text} occurred {n} time{'s' * (n > 1)}")

    def _lags(self, df, e, path):
        """Replaces LAG and DIF calls by columns. A call under a condition sees only the rows that reach it."""
        if not isinstance(e, tuple):
            return e, df
        m = re.fullmatch(r"(lag|dif)(\d*)", str(e[1])) if e[0] == "call" else None
        if m:
            n = int(m[2] or 1)
            value = C.sql(e[2][0], self.scope(df))
            if OBS not in df.columns:
                df = number(df, self.order, OBS) if self.order else df.withColumn(OBS, F.monotonically_increasing_id())
            name = self._fresh("lag")
            if path or self.live:
                reach = self._fresh("r")
                df = df.withColumn(reach, F.expr(self._path(path)))
                hit = P.lag(df.filter(reach), OBS, F.expr(value[0]), n, name)
                df = hit.unionByName(df.filter(f"NOT {reach}"), allowMissingColumns=True)
            else:
                df = P.lag(df, OBS, F.expr(value[0]), n, name)
            node = ("name", name)
            if m[1] == "dif":
                node = ("bin", "-", e[2][0], node)
            return node, df
        parts = []
        for x in e:
            if isinstance(x, tuple) and x and isinstance(x[0], str):
                x, df = self._lags(df, x, path)
            elif isinstance(x, list):
                made = []
                for y in x:
                    if isinstance(y, tuple) and y and isinstance(y[0], str):
                        y, df = self._lags(df, y, path)
                    made.append(y)
                x = made
            parts.append(x)
        return tuple(parts), df

    def _sum(self, df, var, e, path):
        key = var.lower()
        every = self._assignments(self.p.body)
        own = [(pt, s) for pt, s in every if s[0] == "sum" and s[1].lower() == key]
        resets = [(pt, s) for pt, s in every if s[0] == "assign" and s[1][0] == "name" and s[1][1].lower() == key]
        if len(own) != 1 or len(resets) > 1 or any(("loop",) in pt for pt, _ in own):
            raise Sequential(f"{var.upper()} is summed in several places")
        e, df = self._lags(df, e, path)
        if key in self._reads(e):
            raise Sequential(f"{var.upper()} is part of its own increment")
        add = f"CASE WHEN {self._path(path)} THEN coalesce({num(C.sql(e, self.scope(df)))}, 0D) ELSE 0D END"
        init = self.p.retain.get(key) or 0
        col = next((c for c in df.columns if c.lower() == key), var)
        if resets:
            rpath, r = resets[0]
            first = self._first_flags(rpath[0]) if len(rpath) == 1 else None
            if first is None or r[2][0] != "num":
                raise Sequential(f"{var.upper()} is set anew in another way than at FIRST.")
            keys = [c for c, _ in self.by]
            prefix = keys[: [k.lower() for k in keys].index(first) + 1]
            w = Window.partitionBy(*prefix).orderBy(*(F.col(c).desc() if d else F.col(c) for c, d in self.order)).rowsBetween(Window.unboundedPreceding, 0)
            total = F.sum(F.expr(add)).over(w) + F.lit(float(r[2][1]))
        else:
            if OBS not in df.columns:
                df = number(df, self.order, OBS) if self.order else df.withColumn(OBS, F.monotonically_increasing_id())
            name = self._fresh("sum")
            df = P.running_sum(df, OBS, F.expr(add), name)
            total = F.col(name) + F.lit(float(init))
        self.assigned.add(key)
        return df.withColumn(col, total)

    def _loop(self, df, spec, body, path):
        if spec is None:
            for s in body:
                df = self._do(df, s, path)
            return df
        if spec[0] != "for":
            raise Sequential("DO " + spec[0].upper())
        values, after = [], None
        for a, z, by, cond in spec[2]:
            a, z, by = (self._constant(x) for x in (a, z, by))
            if cond or a is None or isinstance(a, str) and z is not None:
                raise Sequential("a DO loop with a bound that is not a constant")
            if z is None:
                values.append(a)
                continue
            if z == "?" or a == "?" or by == "?":
                raise Sequential("a DO loop with a bound that is not a constant")
            step, x = by if by is not None else 1, a
            while (x <= z if step > 0 else x >= z) and len(values) <= MOST_UNROLLED:
                values.append(x)
                x += step
            after = x
        if "?" in values or len(values) > MOST_UNROLLED or any(_has(s, "sum") for s in body):
            raise Sequential("a long DO loop, or one with a sum statement")
        for v in values:
            df = self._set(df, spec[1], (quote(v), "c") if isinstance(v, str) else (f"{float(v)!r}D", "n"), path)
            inner = [self._fix(s, spec[1].lower(), v) for s in body]
            for s in inner:
                df = self._do(df, s, path)
        if after is not None:
            df = self._set(df, spec[1], (f"{float(after)!r}D", "n"), path)
        return df

    def _fix(self, s, var: str, value):
        """The statement with the loop's variable as a constant inside of subscripts."""
        if isinstance(s, list):
            return [self._fix(x, var, value) for x in s]
        if not isinstance(s, tuple):
            return s
        if s and s[0] == "idx" and not isinstance(value, str):
            inner = self._replace(s[2], var, value)
            k = self._constant(inner)
            return ("idx", s[1], ("num", int(k)) if isinstance(k, (int, float)) else inner)
        return tuple(self._fix(x, var, value) if isinstance(x, (tuple, list)) else x for x in s)

    def _replace(self, e, var, value):
        if e == ("name", var) or e[0] == "name" and e[1].lower() == var:
            return ("num", value)
        return tuple(self._replace(x, var, value) if isinstance(x, tuple) else x for x in e)

    def _constant(self, e):
        """A number or text; None for nothing; '?' if it is no constant."""
        if e is None:
            return None
        if e[0] in ("num", "str"):
            return e[1]
        if e[0] == "call" and e[1] == "dim":
            k = e[2][0][1].lower()
            return len(self.p.arrays.get(k) or self.p.temporary.get(k) or [])
        if e[0] == "bin" and e[1] in "+-*":
            a, b = self._constant(e[2]), self._constant(e[3])
            if isinstance(a, (int, float)) and isinstance(b, (int, float)):
                return {"+": a + b, "-": a - b, "*": a * b}[e[1]]
        return "?"

    def _call_routine(self, df, s, path):
        name, args = s[1], s[2]
        if name == "missing":
            for a in args:
                names = expand_names(a[1], [c for c in df.columns if not c.startswith("__")], self.p.arrays) if a[0] == "list" else [a[1]]
                for n in names:
                    df = self._set(df, n, ("''", "c") if n.lower() in self.chars else ("CAST(NULL AS DOUBLE)", "n"), path)
            return df
        if name in ("symput", "symputx"):
            value = char(C.sql(args[1], self.scope(df)))
            target = char(C.sql(args[0], self.scope(df)))
            rows = df.filter(self._path(path)).withColumn("__name", F.expr(target)).withColumn("__value", F.expr(value))
            if OBS not in rows.columns:
                rows = rows.withColumn(OBS, F.monotonically_increasing_id())
            for r in rows.groupBy("__name").agg(F.max_by("__value", OBS).alias("v")).collect():
                self.engine.macro.set_global(r[0].strip(), (r["v"] or "").strip() if name == "symputx" else r["v"] or "")
            return df
        self.engine.log("warning", f"CALL {name.upper()} is not known and does nothing")
        return df

    def _visible(self, df: DataFrame) -> list[str]:
        hidden = {f.lower() for f in self.flags}
        return [c for c in df.columns if not c.startswith("__") and c.lower() not in hidden]

    def _output(self, df, names, path):
        snap = self._fresh("snap")
        cols = self._visible(df)
        on = self._path(path)
        df = df.withColumn(snap, F.when(F.expr(on), F.struct(*(F.col(c).alias(c) for c in cols))))
        self.snaps.append((names or None, snap))
        return df

    def _collect(self, df: DataFrame) -> list[tuple[str | None, DataFrame]]:
        """(target or None for all, rows) of the step."""
        cut = getattr(self, "cut", None)
        if not self.snaps and not any(_has(s, "output") for s in self.p.body):
            out = df.filter(C.name_sql(self.live)) if self.live else df
            if self.order and OBS not in out.columns and "__row" in out.columns:
                self.result_order = self.order
                keep = [*self._visible(df), "__row"]
            else:
                keep = [*self._visible(df), *([OBS] if OBS in out.columns else [])]
            return [(None, out.select(*keep))]
        if cut:
            df = df.filter(cut)
        cols = self._visible(df)
        types = {c: df.schema[c].dataType for c in cols}
        rows = []
        for k, (names, snap) in enumerate(self.snaps):
            has = {f.name.lower(): f.name for f in df.schema[snap].dataType.fields}
            fields = [(F.col(f"{snap}.{has[c.lower()]}") if c.lower() in has else F.lit(None)).cast(types[c]).alias(c) for c in cols]
            rows.append(F.when(F.col(snap).isNotNull(), F.struct(F.lit(k).alias("__k"), F.lit(",".join(n.lower() for n in names) if names else "").alias("__to"), *fields)))
        base = df.select(*([OBS] if OBS in df.columns else []), F.explode(F.array_compact(F.array(*rows))).alias("__r"))
        flat = base.select(*([OBS] if OBS in df.columns else []), "__r.*")
        routed = any(names for names, _ in self.snaps)
        if OBS in df.columns and len(self.snaps) > 1:
            flat = flat.withColumn(OBS, F.col(OBS) * len(self.snaps) + F.col("__k"))
        if not routed:
            return [(None, flat.drop("__k", "__to"))]
        out = []
        for name, _ in self.step.targets:
            short = name.lower().rpartition(".")[2]
            mine = flat.filter((F.col("__to") == "") | F.array_contains(F.transform(F.split("__to", ","), lambda x: F.regexp_replace(x, r"^.*\\.", "")), short))
            out.append((name, mine.drop("__k", "__to")))
        return out

    # row by row

    def sequential(self, df: DataFrame) -> list[tuple[str | None, DataFrame]]:
        p = self.p
        by = [c for c, _ in self.by]
        summed = self._summed()
        retained = sorted(set(p.retain) | summed)
        initial = {k: p.retain.get(k) for k in retained} | {k: p.retain.get(k) or 0.0 for k in summed}
        stateful = bool(retained or p.end or self._looks_at_order() or self.p.temporary and any(_has(s, "assign") and s[1][0] == "idx" for s in p.body if s[0] == "assign"))
        names = [c for c in df.columns if not c.startswith("__")]
        hidden = {f.lower() for f in self.flags} | {f"{k}.{b.lower()}" for k in ("first", "last") for b in by}
        columns = list(names)
        kinds = {f.name.lower(): f.dataType for f in df.schema.fields}
        for c, is_char in [*self.declared, *[(k, False) for k in retained], *self._made()]:
            if c.lower() not in {x.lower() for x in columns} and not c.startswith("_n_"):
                columns.append(c)
                kinds[c.lower()] = T.StringType() if is_char or c.lower() in self.chars else T.DoubleType()
        columns = [c for c in columns if c.lower() not in hidden]
        schema = T.StructType([T.StructField("__to", T.StringType()), T.StructField("__n", T.LongType()), *(T.StructField(c, kinds[c.lower()] if not isinstance(kinds[c.lower()], T.NumericType) or c in names and c.lower() not in {x.lower() for x, _ in self._made()} else T.DoubleType()) for c in columns)])
        if (p.end or "_n_" in str(p.body).lower()) and OBS not in df.columns:
            df = df.withColumn(OBS, F.monotonically_increasing_id())
        if by:
            order = [F.col(c).desc() if d else F.col(c) for c, d in self.order]
            for kind in ("first", "last"):
                for i, b in enumerate(by):
                    w = Window.partitionBy(*by[: i + 1]).orderBy(*(o if kind == "first" else (F.col(c).asc() if d else F.col(c).desc()) for o, (c, d) in zip(order, self.order, strict=True)))
                    df = df.withColumn(f"__{kind}_{b.lower()}", F.row_number().over(w) == 1)
        body, arrays, temporary, chars, formats = p.body, p.arrays, p.temporary, set(self.chars), dict(self.engine.formats)
        end = p.end.lower() if p.end else None
        lows = [b.lower() for b in by]

        def rows(frames, last_of_all: bool):
            held = None
            for f in frames:
                for r in f.to_dict("records"):
                    r = {k.lower(): (None if isinstance(v, float) and v != v or v is pd.NaT else v) for k, v in r.items()}
                    r["__first"] = [b for b in lows if r.get(f"__first_{b}")]
                    r["__last"] = [b for b in lows if r.get(f"__last_{b}")]
                    if held is not None:
                        yield held
                    held = r | ({"__flags": {end: 0}} if end else {})
            if held is not None:
                yield held | ({"__flags": {end: 1}} if end else {})

        def made(frames):
            it = Interpreter(body, arrays, temporary, retained, initial, lows, chars, formats)
            buffer, n = [], 0
            for to, v in it.run(rows(frames, True)):
                n += 1
                buffer.append([to, n, *(v.get(c.lower()) for c in columns)])
                if len(buffer) >= 20_000:
                    yield frame(buffer)
                    buffer = []
            if buffer:
                yield frame(buffer)

        def frame(buffer):
            out = pd.DataFrame(buffer, columns=schema.names)
            for f in schema.fields[2:]:
                if isinstance(f.dataType, T.NumericType):
                    out[f.name] = pd.to_numeric(out[f.name], errors="coerce").astype("float64" if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else "Int64")
                elif isinstance(f.dataType, T.StringType):
                    out[f.name] = out[f.name].map(lambda x: None if x is None else str(x)).astype(object)
            return out

        if not stateful:
            # by count, as rows that are few bytes can be long work; in order, as the rows' places number them
            place = df if OBS in df.columns else df.withColumn(OBS, F.monotonically_increasing_id())
            dealt = place.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), OBS).sortWithinPartitions(OBS)
            out = (dealt if OBS in df.columns else dealt.drop(OBS)).mapInPandas(made, schema).persist()  # a sort of the result runs over it twice
        elif by and self._starts_anew(retained):

            def group(f):
                parts = list(made([f]))
                return pd.concat(parts) if parts else pd.DataFrame(columns=schema.names)

            ordered = [c for c, _ in self.order]
            out = df.groupBy(by[0]).applyInPandas(lambda f: group(f.sort_values(ordered)), schema)
        else:
            keys = [F.col(c).desc() if d else F.col(c) for c, d in self.order]
            out = (df.orderBy(*keys) if keys else df).coalesce(1).mapInPandas(made, schema)
        if not stateful or by:
            out = out.withColumn(OBS, F.monotonically_increasing_id())
        else:
            out = out.withColumn(OBS, F.col("__n"))
        if any(_has(s, "output") for s in p.body) and len(self.step.targets) > 1:
            return [(n, out.filter(F.col("__to").isNull() | (F.lower(F.regexp_replace("__to", r"^.*\.", "")) == n.lower().rpartition(".")[2])).drop("__to", "__n")) for n, _ in self.step.targets]
        return [(None, out.drop("__to", "__n"))]

    def _made(self) -> list[tuple[str, bool]]:
        """Variables that the body makes, with whether they hold text."""
        out: dict[str, list] = {}

        def texts(e) -> bool:
            if e[0] == "str" or e[0] == "bin" and e[1] == "||":
                return True
            if e[0] == "name":
                return e[1].lower() in self.chars
            if e[0] == "call":
                return e[1] in ("substr", "scan", "upcase", "lowcase", "strip", "trim", "left", "cat", "cats", "catx", "compress", "put", "ifc", "coalescec", "tranwrd", "reverse", "repeat", "propcase") or e[1].startswith("lag") and texts(e[2][0])
            return e[0] == "case" and any(texts(t) for _, t in e[2])

        def see(s):
            if not isinstance(s, (tuple, list)):
                return
            if isinstance(s, tuple) and s:
                if s[0] == "assign" and s[1][0] == "name":
                    name, is_char = s[1][1], texts(s[2])
                    if is_char:
                        self.chars.add(name.lower())
                    out.setdefault(name.lower(), [name, is_char])
                elif s[0] == "do" and s[1] and s[1][0] == "for":
                    out.setdefault(s[1][1].lower(), [s[1][1], s[1][2][0][0][0] == "str"])
            for x in s:
                see(x)

        see(self.p.body)
        return [tuple(v) for v in out.values()]

    def _starts_anew(self, retained) -> bool:
        """Whether each retained variable is set at FIRST. of the first BY variable before anything else."""
        first = self.by[0][0].lower()
        anew = set()
        for s in self.p.body:
            if s[0] == "if" and self._first_flags(s[1]) == first:
                for path, a in self._assignments([s[2]]):
                    if not path and a[0] == "assign" and a[1][0] == "name":
                        anew.add(a[1][1].lower())
        return set(retained) <= anew and not _has(self.p.body, "stop") and not self.p.end and "lag" not in str(self.p.body) and "_n_" not in str(self.p.body).lower()

    # results

    def store(self, outputs) -> None:
        engine, p = self.engine, self.p
        if [n.lower() for n, _ in self.step.targets] == ["_null_"]:
            return
        by_name = {n: df for n, df in outputs}
        for name, options in self.step.targets:
            if name.lower() == "_null_":
                continue
            df = by_name.get(name, by_name.get(None))
            columns = [c for c in df.columns if not c.startswith("__")]
            kept = columns
            if "where" in options:
                df = df.filter(C.condition(options["where"], self.scope(df)))
            if p.keep:
                chosen = {c.lower() for i in p.keep for c in expand_names(i, columns)}
                kept = [c for c in kept if c.lower() in chosen]
            if p.drop:
                gone = {c.lower() for i in p.drop for c in expand_names(i, columns)}
                kept = [c for c in kept if c.lower() not in gone]
            if "keep" in options:
                chosen = {c.lower() for i in options["keep"] for c in expand_names(i, columns)}
                kept = [c for c in kept if c.lower() in chosen]
            if "drop" in options:
                gone = {c.lower() for i in options["drop"] for c in expand_names(i, columns)}
                kept = [c for c in kept if c.lower() not in gone]
            renames = {a.lower(): b for a, b in [*p.rename, *options.get("rename", [])]}
            hidden = [c for c in (OBS, "__row") if c in df.columns]
            out = df.select(*(F.col(C.name_sql(c)).alias(renames.get(c.lower(), c)) for c in kept), *hidden)
            order = [(OBS, False)] if OBS in out.columns else [(c, d) for c, d in self.by if c in out.columns] if p.update else []
            if not order and self.kept_order and "__row" not in out.columns and all(c in self.inputs and c.lower() not in getattr(self, "assigned", set()) for c, _ in self.kept_order):
                held = [(renames.get(c.lower(), c), d) for c, d in self.kept_order]
                order = held if all(c in out.columns for c, _ in held) else []
            if "__row" in out.columns:
                low = {c.lower() for c in out.columns}
                out = out.drop("__row")
                order = [(c, d) for c, d in self.by if c.lower() in low]
            variables = {renames.get(k, k).lower(): v for k, v in self.labels.items()}
            engine.put_dataset(name, Dataset(out, {k: v for k, v in variables.items() if k in {c.lower() for c in out.columns}}, order, list(self.by)))
