"""PROC SQL to Spark SQL: one statement, one query text over temporary views, which Catalyst plans."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import char, num, quote
from ..lang.lexer import ProgramError
from ..lang.sql import Item, Join, Select, SetOp, Table
from . import compile as C
from .dataset import OBS, Dataset, Variable

_names = itertools.count()


class SqlCompiler:
    """Compiles queries over the datasets that ``find`` gives by name."""

    def __init__(self, spark, find, options, formats=None, warn=lambda text: None):
        self.spark, self.find, self.options, self.formats, self.warn = spark, find, options, formats or {}, warn
        self.sources: list[Dataset] = []

    def view(self, df: DataFrame) -> str:
        name = f"rowloom_{next(_names)}"
        df.createOrReplaceTempView(name)
        return name

    def _table(self, t: Table, outer) -> tuple[str, str, list[tuple[str, str]]]:
        """(text, alias, columns with kinds)."""
        alias = t.alias or (t.name.rpartition(".")[2] if t.name else f"__d{next(_names)}")
        if t.sub is not None:
            text, columns = self.query(t.sub, outer)
            return f"({text}) AS {C.name_sql(alias)}", alias, columns
        d = self.options(self.find(t.name), t.options) if t.options else self.find(t.name)
        self.sources.append(d)
        df = d.visible
        return f"{self.view(df)} AS {C.name_sql(alias)}", alias, [(f.name, C.kind_of(f.dataType)) for f in df.schema.fields]

    def query(self, q, outer: C.Scope | None = None) -> tuple[str, list[tuple[str, str]]]:
        if isinstance(q, SetOp):
            return self._set(q, outer)
        return self._select(q, outer)

    def _set(self, q: SetOp, outer):
        left, columns = self.query(q.left, outer)
        right, other = self.query(q.right, outer)
        if len(columns) != len(other):
            raise ProgramError(f"{q.op.upper()}: {len(columns)} columns against {len(other)}")
        text = f"({left}) {q.op.upper()}{' ALL' if q.all else ''} ({right})"
        text = f"SELECT * FROM ({text}) AS __s({', '.join(C.name_sql(c) for c, _ in columns)})"
        if q.order:
            low = {c.lower(): c for c, _ in columns}
            keys = [(C.name_sql(columns[e[1] - 1][0]) if e[0] == "num" else C.name_sql(low[e[-1].lower()])) + (" DESC" if d else "") for e, d in q.order]
            text += " ORDER BY " + ", ".join(keys)
        return text, columns

    def _select(self, q: Select, outer: C.Scope | None):
        parts, tables = [], []
        if q.table:
            text, alias, columns = self._table(q.table, outer)
            parts.append(text)
            tables.append((alias, columns))
        joins: list[tuple[Join, str]] = []
        for j in q.joins:
            text, alias, columns = self._table(j.table, outer)
            tables.append((alias, columns))
            joins.append((j, text))
        several = len(tables) > 1 or outer is not None

        def column(table, name):
            for alias, columns in tables:
                if table is None or alias.lower() == table.lower():
                    for c, k in columns:
                        if c.lower() == name.lower():
                            return (f"{C.name_sql(alias)}.{C.name_sql(c)}" if several else C.name_sql(c)), k
            return outer.column(table, name) if outer else None

        scope = C.Scope(column, formats=self.formats, columns=[c for _, cs in tables for c, _ in cs])
        for d in self.sources:
            for n, v in d.variables.items():
                if v.label:
                    scope.labels.setdefault(n, v.label)
                if v.format:
                    scope.variable_formats.setdefault(n, v.format)

        def subquery(inner, s):
            text, cols = self.query(inner, scope)
            subquery.kind = cols[0][1]
            return text

        scope.subquery = subquery
        for j, text in joins:
            if j.on is None:
                parts.append(f"CROSS JOIN {text}")
            else:
                kind = {"full": "FULL OUTER", "cross": "INNER"}.get(j.kind, j.kind.upper())
                parts.append(f"{kind} JOIN {text} ON {C.condition(j.on, scope)}")

        items: list[Item] = []
        for it in q.items:
            if it.expr[0] == "star":
                seen = set()
                for alias, columns in tables:
                    for c, _ in columns:
                        if c.lower() not in seen:
                            seen.add(c.lower())
                            items.append(Item(("qname", alias, c), c))
            elif it.expr[0] == "qstar":
                items += [Item(("qname", it.expr[1], c), c) for alias, columns in tables if alias.lower() == it.expr[1].lower() for c, _ in columns]
            else:
                items.append(it)
        names, used = [], set()
        for i, it in enumerate(items):
            n = it.alias or (it.expr[-1] if it.expr[0] in ("name", "qname") else f"_TEMA{i + 1:03d}")
            if it.expr[0] == "calc" and not it.alias:
                n = it.expr[1]
            names.append(n)
        kept = [i for i, n in enumerate(names) if not (n.lower() in used or used.add(n.lower()))]
        items, names = [items[i] for i in kept], [names[i] for i in kept]
        scope.calculated = {n.lower(): it.expr for n, it in zip(names, items, strict=True) if it.expr != ("name", n)}

        def named(e):  # an alias or a place in the list stands for its expression
            if e[0] == "num" and isinstance(e[1], int) and 1 <= e[1] <= len(items):
                return items[e[1] - 1].expr
            if e[0] == "name" and column(None, e[1]) is None and e[1].lower() in scope.calculated:
                return scope.calculated[e[1].lower()]
            if e[0] == "calc":
                return scope.calculated.get(e[1].lower(), ("name", e[1]))
            return e

        where = C.condition(q.where, scope) if q.where else None
        group = [named(g) for g in q.group]
        group_sql = [C.sql(g, scope)[0] for g in group]
        scope.aggregates = True
        grouped = bool(group) or any(C.has_aggregate(it.expr) or self._calculated_aggregate(it.expr, scope) for it in items) or (q.having is not None and C.has_aggregate(q.having))
        out, columns, aggregated = [], [], []
        for n, it in zip(names, items, strict=True):
            text, kind = C.sql(it.expr, scope)
            own = C.has_aggregate(it.expr) or self._calculated_aggregate(it.expr, scope)
            if grouped and not own and text not in group_sql and it.expr[0] not in ("num", "str", "miss", "sub", "over") and not self._of_groups(it.expr, group):
                text = f"first({text})"
            if text == "NULL":
                text = "CAST(NULL AS DOUBLE)"
            out.append(f"{text} AS {C.name_sql(n)}")
            columns.append((n, kind))
            aggregated.append(text)
        having = C.condition(self._aliases(q.having, scope, column), scope) if q.having else None
        text = f"SELECT {'DISTINCT ' if q.distinct else ''}{', '.join(out)}"
        if parts:
            text += " FROM " + " ".join(parts)
        if where:
            text += f" WHERE {where}"
        if group_sql:
            text += f" GROUP BY {', '.join(dict.fromkeys(group_sql))}"
        if having:
            text += f" HAVING {having}" if grouped else f"{' AND' if where else ' WHERE'} {having}"
        if q.order:
            low = {n.lower(): n for n in names}
            keys = []
            for e, d in q.order:
                if e[0] == "num" and isinstance(e[1], int) and 1 <= e[1] <= len(names):
                    k = C.name_sql(names[e[1] - 1])
                elif e[0] in ("name", "calc") and e[1].lower() in low:
                    k = C.name_sql(low[e[1].lower()])
                else:
                    k = C.sql(named(e), scope)[0]
                    k = C.name_sql(names[aggregated.index(k)]) if k in aggregated else k
                keys.append(k + (" DESC" if d else ""))
            text += " ORDER BY " + ", ".join(keys)
        for u in dict.fromkeys(scope.unknown):
            self.warn(f"column {u.upper()} is not in the tables of the query; it is missing")
        return text, columns

    def _calculated_aggregate(self, e, scope) -> bool:
        found = []

        def see(n):
            if n[0] == "calc" and n[1].lower() in scope.calculated and C.has_aggregate(scope.calculated[n[1].lower()]):
                found.append(n)

        from ..lang.expressions import walk

        walk(e, see)
        return bool(found)

    @staticmethod
    def _of_groups(e, group) -> bool:
        """Whether an expression is built from group keys and constants alone."""
        if e in group:
            return True
        if e[0] in ("name", "qname"):
            return any(g[0] in ("name", "qname") and g[-1].lower() == e[-1].lower() for g in group)
        parts = [x for x in e[1:] if isinstance(x, tuple)] + [y for x in e[1:] if isinstance(x, list) for y in x if isinstance(y, tuple)]
        return all(SqlCompiler._of_groups(p, group) if p and isinstance(p[0], str) else all(SqlCompiler._of_groups(q, group) for q in p if isinstance(q, tuple)) for p in parts)

    def _aliases(self, e, scope, column):
        if isinstance(e, list):
            return [self._aliases(x, scope, column) for x in e]
        if not isinstance(e, tuple):
            return e
        if e[:1] == ("name",) and column(None, e[1]) is None and e[1].lower() in scope.calculated:
            return ("calc", e[1])
        return tuple(self._aliases(x, scope, column) if isinstance(x, (tuple, list)) else x for x in e)

    def run(self, q) -> Dataset:
        """The query's result; ordered, if the query says so."""
        self.sources = []
        text, columns = self.query(q)
        order = q.order
        keys: list[tuple[str, bool]] = []
        low = {n.lower(): n for n, _ in columns}
        total = True
        for e, d in order:
            if e[0] == "num" and isinstance(e[1], int):
                keys.append((columns[e[1] - 1][0], d))
            elif e[0] in ("name", "calc", "qname") and e[-1].lower() in low:
                keys.append((low[e[-1].lower()], d))
            else:
                total = False
        df = self.spark.sql(text)
        if order and not total:  # sorted by what is not kept: the sorted rows' places stay
            df = df.withColumn(OBS, F.monotonically_increasing_id())
            keys = [(OBS, False)]
        variables = {}
        known = {}
        for d in self.sources:
            for n, v in d.variables.items():
                known.setdefault(n, v)
        items = q.items if isinstance(q, Select) else []
        for n, _ in columns:
            if n.lower() in known:
                v = known[n.lower()]
                variables[n.lower()] = Variable(v.label, v.format, v.informat, v.length)
        for it in items:
            if it.attrs:
                n = (it.alias or it.expr[-1]).lower()
                v = variables.setdefault(n, Variable())
                v.label, v.format = it.attrs.get("label", v.label), it.attrs.get("format", v.format)
                v.length = int(str(it.attrs["length"]).lstrip("$")) if "length" in it.attrs else v.length
        return Dataset(df, variables, keys)


def insert_rows(spark, d: Dataset, columns: list[str], rows: list[list[tuple]]) -> DataFrame:
    """The dataset with literal rows added; columns that are not given are missing."""
    scope = C.Scope(lambda t, n: None)
    low = {c.lower(): c for c in d.columns}
    columns = [low.get(c.lower(), c) for c in columns] or d.columns
    selects = []
    for row in rows:
        given = {c: C.sql(e, scope) for c, e in zip(columns, row, strict=False)}
        parts = []
        for f in d.visible.schema.fields:
            v = given.get(f.name, ("NULL", "n"))[0]
            parts.append(f"CAST({v} AS {f.dataType.simpleString()}) AS {C.name_sql(f.name)}")
        selects.append("SELECT " + ", ".join(parts))
    return d.visible.unionByName(spark.sql(" UNION ALL ".join(selects)))


def update_rows(d: Dataset, pairs: list[tuple[str, tuple]], where, scope_of) -> DataFrame:
    """Assignments run from left to right, later ones see earlier ones; the condition is that of the row before."""
    df = d.df
    cond = C.condition(where, scope_of(df)) if where else "true"
    df = df.withColumn("__hit", F.expr(f"coalesce({cond}, false)"))
    low = {c.lower(): c for c in df.columns}
    for name, e in pairs:
        col = low.get(name.lower(), name)
        value = C.sql(e, scope_of(df))
        old = df.schema[col].dataType if col in df.columns else None
        text = value[0]
        if old is not None:
            k = C.kind_of(old)
            text = char(value) if k == "c" else num(value) if k == "n" and value[1] != "n" else text
            new = f"CASE WHEN __hit THEN {text} ELSE {C.name_sql(col)} END"
        else:
            new = f"CASE WHEN __hit THEN {text} END"
        df = df.withColumn(col, F.expr(new))
    return df.drop("__hit")


def delete_rows(d: Dataset, where, scope_of) -> DataFrame:
    return d.df.limit(0) if where is None else d.df.filter(f"NOT coalesce({C.condition(where, scope_of(d.df))}, false)")


__all__ = ["SqlCompiler", "delete_rows", "insert_rows", "quote", "update_rows"]
