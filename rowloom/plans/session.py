"""The engine: programs in, datasets out."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..lang import program as Program
from ..lang.expressions import EPOCH, Cursor, expand_names
from ..lang.lexer import ProgramError
from ..lang.macro import MacroProcessor
from ..lang.sql import Select
from ..sources.libraries import Library, open_library
from ..stats import special
from . import compile as C
from . import procs
from . import sql as S
from .dataset import OBS, Dataset, Variable, load, number, with_obs
from .datastep import DataStepCompiler


@dataclass
class StepResult:
    kind: str
    ok: bool
    error: str | None = None
    outputs: list[str] = field(default_factory=list)


@dataclass
class RunSummary:
    steps: list[StepResult] = field(default_factory=list)
    log: list[tuple[str, str]] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(s.ok for s in self.steps)


class Engine:
    """``fail_fast``: stop at the first step that fails. ``profiles``: functions that change a program's text before it runs. ``reporter``: hears what goes to the log, and may stop a run."""

    def __init__(self, spark: SparkSession, workdir: str | None = None, fail_fast: bool = True, profiles=(), reporter=None):
        self.spark, self.workdir, self.fail_fast, self.profiles = spark, workdir, fail_fast, list(profiles)
        self.libraries: dict[str, Library] = {"WORK": Library("WORK", self)}
        self.formats: dict[str, list] = {}
        self.options: dict[str, str] = {}
        self.filerefs: dict[str, str] = {}
        self.ods: dict[str, str] = {}
        self.log_lines: list[tuple[str, str]] = []
        self.tables: dict[str, DataFrame] = {}  # what procedures print, by name
        self.handles: list[str] = []
        self.blocks: list[list[str]] = []
        self.reporter = reporter
        self.procs = dict(procs.HANDLERS)
        self.macro = MacroProcessor(self.sysfunc, self.log)
        special.register(spark)

    def log(self, kind: str, text: str) -> None:
        self.log_lines.append((kind, text))
        if self.reporter:
            self.reporter.say(kind, text)

    def warnings(self) -> list[str]:
        return [t for k, t in self.log_lines if k == "warning"]

    # running

    def execute(self, text: str, source: str | None = None) -> RunSummary:
        summary = RunSummary()
        begin = len(self.log_lines)
        for p in self.profiles:
            text = p(text)
        text = self._include(text, Path(source).parent if source else Path(self.workdir or "."), [])
        text, blocks = Program.lift_datalines(text)
        shift = len(self.blocks)
        self.blocks += blocks
        if shift:
            text = re.sub(r"\bdatalines (\d+);", lambda m: f"datalines {int(m[1]) + shift};", text)

        def run(part: str) -> None:
            for step in Program.parse(part):
                if self.reporter and self.reporter.stops:
                    return
                result = StepResult(type(step).__name__, True)
                summary.steps.append(result)
                try:
                    self._step(step)
                except Exception as e:
                    result.ok, result.error = False, f"{type(e).__name__}: {e}"
                    self.log("error", result.error)
                    self.macro.set_global("SYSERR", "1")
                    if self.fail_fast:
                        raise

        self.macro.stream(text, run)
        summary.log = self.log_lines[begin:]
        return summary

    def execute_file(self, path: str, encoding: str = "utf-8") -> RunSummary:
        return self.execute(Path(path).read_text(encoding=encoding), source=path)

    def _include(self, text: str, base: Path, stack: list[str]) -> str:
        def one(m):
            out = []
            for t in re.findall(r"'([^']*)'|\"([^\"]*)\"|(\w+)", m[1]):
                name = t[0] or t[1] or self.filerefs.get(t[2].lower(), t[2])
                path = (base / name).resolve()
                if str(path) in stack:
                    raise ProgramError(f"%INCLUDE of {name} includes itself")
                out.append(self._include(path.read_text(), path.parent, [*stack, str(path)]))
            return "\n".join(out)

        return re.sub(r"%inc(?:lude)?\s+([^;]*);", one, text, flags=re.I)

    def _step(self, step) -> None:
        if isinstance(step, Program.DataStep):
            DataStepCompiler(self, step).run()
        elif isinstance(step, Program.SqlStep):
            self._sql(step)
        elif isinstance(step, Program.ProcStep):
            handler = self.procs.get(step.name)
            if handler is None:
                raise ProgramError(f"unknown procedure {step.name.upper()}")
            handler(self, step)
        else:
            self._global(step)

    def _global(self, step) -> None:
        c = step.cursor
        if step.kind == "libname":
            ref = c.name().upper()
            engine = "" if c.now.kind in ("str", "end") else c.name().lower()
            if engine == "clear" or c.now.kind == "end" and engine == "":
                if ref != "WORK":
                    self.libraries.pop(ref, None)
                return
            path = c.take().value[0] if c.now.kind == "str" else ""
            self.libraries[ref] = open_library(ref, engine, path, self)
        elif step.kind == "filename":
            ref = c.name().lower()
            self.filerefs[ref] = c.take().value[0] if c.now.kind == "str" else ""
            self.macro.set_global(f"_FILEREF_{ref}", self.filerefs[ref])
        elif step.kind in ("options", "option"):
            while c.now.kind != "end":
                key = c.take().low
                self.options[key] = c.take().text if c.accept("=") else "on"
        elif step.kind == "ods":
            if c.accept("output"):
                while c.now.kind == "name":
                    table = c.name().lower()
                    if c.accept("="):
                        from ..lang.sql import dotted

                        self.ods[table] = dotted(c)

    # datasets

    def _split(self, name: str) -> tuple[str, str]:
        lib, _, member = name.rpartition(".")
        return (lib or "WORK").upper(), member.upper()

    def library(self, ref: str) -> Library:
        if ref.upper() not in self.libraries:
            raise ProgramError(f"library {ref.upper()} is not assigned")
        return self.libraries[ref.upper()]

    def find(self, name: str) -> Dataset:
        lib, member = self._split(name)
        if lib == "DICTIONARY":
            return self._dictionary(member)
        if member == "_LAST_":
            return self.find(self.macro.get("SYSLAST"))
        found = self.library(lib).get(member)
        if found is None:
            raise ProgramError(f"dataset {lib}.{member} does not exist")
        return found

    def find_all(self, name: str) -> list[Dataset]:
        """One dataset, or all whose names begin as in LIB.PREFIX:"""
        if not name.endswith(":"):
            return [self.find(name)]
        lib, member = self._split(name[:-1])
        names = [m for m in self.library(lib).names() if m.startswith(member)]
        if not names:
            raise ProgramError(f"no dataset begins with {lib}.{member}")
        return [self.library(lib).get(m) for m in names]

    def exists(self, name: str) -> bool:
        lib, member = self._split(name)
        return lib in self.libraries and self.libraries[lib].get(member) is not None

    def put_dataset(self, name: str, d: Dataset) -> None:
        lib, member = self._split(name)
        self.library(lib).put(member, d)
        self.macro.set_global("SYSLAST", f"{lib}.{member}")

    def create_dataset(self, name: str, df, libref: str = "WORK", order: list[str] | None = None) -> None:
        """From a Spark or pandas DataFrame. ``order``: columns that the observations are in order of."""
        if not isinstance(df, DataFrame):
            df = self.spark.createDataFrame(df.reset_index(drop=True).assign(**{OBS: range(1, len(df) + 1)}))
        self.library(libref).put(name.upper(), Dataset(load(df), {}, [(c, False) for c in order or []] or ([(OBS, False)] if OBS in df.columns else [])))

    def get_dataset(self, name: str, libref: str = "WORK") -> DataFrame:
        """The rows as a DataFrame, in order."""
        return self.find(name if "." in name else f"{libref}.{name}").ordered

    def import_csv(self, path: str, name: str) -> None:
        from ..sources.files import read_delimited

        self.put_dataset(name, Dataset(read_delimited(self.spark, path)))

    def export_csv(self, name: str, path: str) -> None:
        from ..sources.files import write_delimited

        write_delimited(self.find(name), path)

    def _dictionary(self, member: str) -> Dataset:
        if member not in ("COLUMNS", "TABLES"):
            raise ProgramError(f"DICTIONARY.{member} does not exist")
        rows = []
        for lib, library in self.libraries.items():
            for name in library.names():
                d = library.get(name)
                fields = d.visible.schema.fields
                if member == "TABLES":
                    rows.append((lib, name, len(fields)))
                    continue
                for i, f in enumerate(fields, 1):
                    v = d.variables.get(f.name.lower(), Variable())
                    is_char = C.kind_of(f.dataType) == "c"
                    rows.append((lib, name, f.name, "char" if is_char else "num", float(v.length or 8), i, v.label or "", v.format or ""))
        if member == "TABLES":
            return Dataset(self.spark.createDataFrame(rows, "libname string, memname string, nvar int"))
        return Dataset(self.spark.createDataFrame(rows, "libname string, memname string, name string, type string, length double, varnum int, label string, format string"))

    def apply_options(self, d: Dataset, options: dict) -> Dataset:
        """FIRSTOBS= and OBS= take a slice, WHERE= filters it, then RENAME=, KEEP= and DROP= as written."""
        df, order = d.df, d.order
        variables = dict(d.variables)
        if options.get("firstobs") is not None or options.get("obs") is not None:
            d2 = with_obs(d)
            df, order = d2.df, d2.order
            first, last = options.get("firstobs") or 1, options.get("obs")
            df = number(df, [(OBS, False)], "__k")
            df = df.filter(F.col("__k") >= first)
            if last is not None:
                df = df.filter(F.col("__k") <= last)
            df = df.drop("__k")
        if "where" in options:
            df = df.filter(C.condition(options["where"], self.scope(df)))
        # KEEP= and DROP= come before RENAME=; they may name a variable by its new name too
        renames = {b.lower(): a for a, b in options.get("rename", [])}
        for key, value in sorted(options.items(), key=lambda kv: kv[0] == "rename"):
            columns = [c for c in df.columns if c != OBS]
            if key in ("keep", "drop"):
                low = {c.lower() for c in columns}
                value = [("one", renames[i[1].lower()]) if i[0] == "one" and i[1].lower() not in low and i[1].lower() in renames else i for i in value]
            hidden = [OBS] if OBS in df.columns else []
            if key == "rename":
                low = {c.lower(): c for c in columns}
                pairs = {low[a.lower()]: b for a, b in value if a.lower() in low}
                df = df.withColumnsRenamed(pairs)
                variables |= {b.lower(): variables[a.lower()] for a, b in pairs.items() if a.lower() in variables}
                order = [(pairs.get(c, c), x) for c, x in order]
            elif key == "keep":
                chosen = {c.lower() for i in value for c in expand_names(i, columns)}
                df = df.select(*[c for c in columns if c.lower() in chosen], *hidden)
            elif key == "drop":
                gone = {c.lower() for i in value for c in expand_names(i, columns)}
                df = df.select(*[c for c in columns if c.lower() not in gone], *hidden)
        order = order if all(c in df.columns for c, _ in order) else []
        return Dataset(df, variables, order, d.sort_keys, d.label)

    def scope(self, df: DataFrame) -> C.Scope:
        kinds = {f.name.lower(): (C.name_sql(f.name), C.kind_of(f.dataType)) for f in df.schema.fields}
        return C.Scope(lambda t, n: kinds.get(n.lower()), columns=[c for c in df.columns if c != OBS], formats=self.formats)

    # SQL

    def sql_compiler(self) -> S.SqlCompiler:
        return S.SqlCompiler(self.spark, self.find, self.apply_options, self.formats, lambda t: self.log("warning", t))

    def _sql(self, step) -> None:
        for st in step.statements:
            kind = st[0]
            if kind == "select":
                d = self._limited(self.sql_compiler().run(st[1]), step.options)
                if isinstance(st[1], Select) and st[1].into:
                    self._into(st[1], d)
                elif not step.options.get("noprint"):
                    self.tables["sql"] = d.ordered
            elif kind == "create":
                d = self._limited(self.sql_compiler().run(st[2]), step.options)
                self.put_dataset(st[1], self.apply_options(d, st[3]) if st[3] else d)
            elif kind == "insert":
                d = self.find(st[1])
                if isinstance(st[3], list):
                    df = S.insert_rows(self.spark, d, st[2], st[3])
                else:
                    new = self.sql_compiler().run(st[3]).visible
                    low = {c.lower(): c for c in d.columns}
                    names = st[2] or [low.get(c.lower(), c) for c in new.columns]
                    new = new.toDF(*[low.get(c.lower(), c) for c in names])
                    df = d.visible.unionByName(new.select(*[F.col(c).cast(d.df.schema[c].dataType).alias(c) for c in new.columns if c in d.columns]), allowMissingColumns=True)
                self.put_dataset(st[1], Dataset(df, d.variables))
            elif kind == "update":
                d = self.find(st[1])
                self.put_dataset(st[1], Dataset(S.update_rows(d, st[2], st[3], self.scope), d.variables, d.order, d.sort_keys))
            elif kind == "delete":
                d = self.find(st[1])
                self.put_dataset(st[1], Dataset(S.delete_rows(d, st[2], self.scope), d.variables, d.order, d.sort_keys))
            elif kind == "drop":
                for n in st[1]:
                    lib, member = self._split(n)
                    self.library(lib).remove(member)

    @staticmethod
    def _limited(d: Dataset, options: dict) -> Dataset:
        n = options.get("outobs")
        if n in (None, "max", "MAX"):
            return d
        keys = [F.col(c).desc() if x else F.col(c).asc() for c, x in d.order]
        return Dataset((d.df.orderBy(*keys) if keys else d.df).limit(int(n)), d.variables, d.order, d.sort_keys)

    def _into(self, q: Select, d: Dataset) -> None:
        """The first row, or as many as named variables; all rows only for SEPARATED BY and open ranges."""
        whole = any(sep is not None or last == "" for _, last, sep, _ in q.into)
        most = max([int(re.search(r"\d+$", last)[0]) - int(re.search(r"\d+$", first)[0]) + 1 for first, last, _, _ in q.into if last] + [1])
        df = d.ordered
        rows = df.collect() if whole else df.limit(most).collect()
        for i, (first, last, sep, trimmed) in enumerate(q.into):
            values = [procs.into_text(r[i]) for r in rows]
            if last is not None:
                m = re.fullmatch(r"(.*?)(\d+)", first)
                n = len(values) if last == "" else int(re.search(r"\d+$", last)[0]) - int(m[2]) + 1
                for k, v in enumerate(values[:n]):
                    self.macro.set_global(f"{m[1]}{int(m[2]) + k}", v)
            elif sep is not None:
                self.macro.set_global(first, sep.join(v.strip() for v in values))
            elif values:
                self.macro.set_global(first, values[0].strip() if trimmed else values[0])
        self.macro.set_global("SQLOBS", str(len(rows)))

    # what programs ask the session

    def session_function(self, name: str, args: list):
        if name == "symget":
            return self.macro.get(str(args[0])) or ""
        if name == "exist":
            return int(self.exists(str(args[0])))
        if name == "open":
            if not self.exists(str(args[0])):
                return 0
            self.handles.append(str(args[0]))
            return len(self.handles)
        if name == "close":
            return 0
        d = self.find(self.handles[int(args[0]) - 1])
        columns = d.columns
        if name == "varnum":
            return next((i for i, c in enumerate(columns, 1) if c.lower() == str(args[1]).lower()), 0)
        if name == "attrn":
            what = str(args[1]).lower()
            return len(columns) if what in ("nvars", "nvar") else d.df.count() if what in ("nobs", "nlobs") else 0
        c = columns[int(args[1]) - 1]
        v = d.variables.get(c.lower(), Variable())
        return {"varname": c, "vartype": "C" if C.kind_of(d.df.schema[c].dataType) == "c" else "N", "varlabel": v.label or "", "varfmt": v.format or ""}[name]

    def sysfunc(self, name: str, args: list[str], fmt: str | None) -> str:
        """%SYSFUNC: a session's function, or a scalar one evaluated on a single row."""
        if name in ("exist", "open", "close", "varnum", "varname", "vartype", "varlabel", "attrn", "symget"):
            out = str(self.session_function(name, args))
        else:
            import datetime

            if name in ("today", "date"):
                value = (str(float((datetime.date.today() - EPOCH).days)) + "D", "n")
            else:
                build = scalar.BUILDERS.get(name)
                if name in ("putn", "putc", "inputn"):
                    a = (scalar.quote(args[0]), "c") if name != "putn" else (f"{float(args[0])!r}D", "n")
                    value = (scalar.put_text(a, args[1]), "c") if name != "inputn" else scalar.input_number(a, args[1])
                else:
                    if build is None:
                        raise ProgramError(f"unknown function {name.upper()}")
                    value = build(*((a if re.fullmatch(r"-?\d+(\.\d+)?", a) else scalar.quote(a.strip("'\"") if a[:1] in "'\"" else a), "n" if re.fullmatch(r"-?\d+(\.\d+)?", a) else "c") for a in args))
            if fmt and not fmt.startswith("$"):
                value = (scalar.put_text(value, fmt), "c")
            r = self.spark.sql(f"SELECT {value[0]} AS v").first()[0]
            out = procs.into_text(r)
        return out.strip()

    def put(self, df: DataFrame, items, compiler) -> None:
        """PUT: lines to the log. The rows are read in order, one partition after the other."""
        scope = compiler.scope(df)
        parts = []
        for it in items:
            if it[0] == "text":
                parts.append(scalar.quote(it[1]))
            elif it[0] == "all":
                parts += [f"concat({scalar.quote(c + '=')}, {scalar.char(C.sql(('name', c), scope))})" for c in scope.columns]
            else:
                a = C.sql(("name", it[1]), scope)
                t = C.formatted(a, it[3] or scope.variable_formats.get(it[1].lower(), ""), scope)
                t = f"coalesce({t}, '{'.' if a[1] == 'n' else ' '}')"
                parts.append(f"concat({scalar.quote(it[1] + '=')}, {t})" if it[2] else t)
        lines = df.select(*([OBS] if OBS in df.columns else []), F.expr(f"concat_ws(' ', {', '.join(parts)})").alias("line"))
        for r in (lines.orderBy(OBS) if OBS in df.columns else lines).select("line").toLocalIterator():
            self.log("put", r[0])

    def note_many_to_many(self, dfs: list[DataFrame], by: list[str], names: list[str], most: int = 20) -> None:
        """With OPTIONS MERGEWARN: a warning that lists the keys (``most`` of them) of which two inputs or more of a merge have several rows. It counts by key, which is a pass of its own."""
        if "mergewarn" not in self.options:
            return
        counts = None
        for i, df in enumerate(dfs):
            one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").withColumn("__i", F.lit(i))
            counts = one if counts is None else counts.unionByName(one)
        several = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("__k"), F.array_sort(F.collect_list(F.struct("__i", "__n"))).alias("__of")).filter("__k > 1")  # a row for each input at most
        rows = several.orderBy(*by).limit(most + 1).collect()
        for r in rows[:most]:
            key = ", ".join(f"{k.upper()}={procs.into_text(r[k])}" for k in by)
            of = ", ".join("{}.{} ({} observations)".format(*self._split(names[x["__i"]]), x["__n"]) for x in r["__of"])
            self.log("warning", f"Many-to-many MERGE: BY group {key} has several rows in {of}; they are paired by position, not as a product")
        if len(rows) > most:
            self.log("warning", f"Many-to-many MERGE: more than {most} BY groups")

    def options_of(self, c: Cursor) -> dict:
        return procs.header(c)
