"""INPUT over data lines of the program or of text files."""

from __future__ import annotations

import csv
import re
import shlex

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import input_number
from ..lang.expressions import expand_names
from ..plans.dataset import OBS, Variable


def _tokens(lines: list[str]) -> list[str]:
    out = []
    for line in lines:
        try:
            lex = shlex.shlex(line, posix=True)
            lex.whitespace_split, lex.commenters, lex.escape = True, "", ""
            out += list(lex)
        except ValueError:
            out += line.split()
    return out


def read(engine, p):
    """(rows with OBS, variables) for the INPUT statements of a plan."""
    inputs = [(c, is_char, fmt, cols) for item, is_char, fmt, cols in p.inputs for c in expand_names(item, [])]
    chars = {c.lower() for items, t, _ in p.lengths if t for i in items for c in expand_names(i, [])}
    inputs = [(c, is_char or c.lower() in chars or bool(fmt and fmt.startswith("$")), fmt, cols) for c, is_char, fmt, cols in inputs]
    file = str(p.infile.get("file", "datalines")).lower()
    inline = p.datalines is not None and file in ("datalines", "cards", "lines", "datalines4", "cards4")
    by_column = any(cols for *_, cols in inputs)
    variables = {c.lower(): Variable(informat=fmt) for c, _, fmt, _ in inputs if fmt}
    sep = p.infile.get("dlm") or p.infile.get("delimiter")
    dsd = bool(p.infile.get("dsd"))
    names = [c for c, *_ in inputs]
    if inline:
        lines = engine.blocks[p.datalines]
        if by_column:
            rows = [(i, line) for i, line in enumerate(lines, 1)]
            df = engine.spark.createDataFrame(rows, f"{OBS} long, value string")
            return _columns(df, inputs), variables
        if dsd or sep:
            cells = [next(csv.reader([line], delimiter=(sep or ",")[0])) if dsd else [x for x in re.split("[" + re.escape(sep) + "]+", line)] for line in lines if line.strip() or not inputs]
        else:  # lines run on until all variables have a value
            words = _tokens(lines)
            cells = [words[i : i + len(names)] for i in range(0, len(words), len(names))]
        rows = [(i, *[(x.strip() if x is not None else None) for x in (*c[: len(names)], *[None] * (len(names) - len(c)))]) for i, c in enumerate(cells, 1)]
        df = engine.spark.createDataFrame(rows, T.StructType([T.StructField(OBS, T.LongType()), *(T.StructField(c, T.StringType()) for c in names)]))
    else:
        path = engine.filerefs.get(file, p.infile.get("file"))
        df = engine.spark.read.text(path).withColumn(OBS, F.monotonically_increasing_id())
        first, last = int(p.infile.get("firstobs", 1)), p.infile.get("obs")
        if first > 1 or last:
            from ..plans.dataset import number

            df = number(df, [(OBS, False)], "__k").filter(F.col("__k") >= first)
            df = (df.filter(F.col("__k") <= int(last)) if last else df).drop("__k")
        if by_column:
            return _columns(df, inputs), variables
        if dsd:
            schema = ", ".join(f"`{c}` string" for c in names)
            df = df.select(OBS, F.from_csv("value", schema, {"sep": (sep or ",")[0], "mode": "PERMISSIVE"}).alias("r")).select(OBS, "r.*")
        else:
            parts = F.filter(F.split("value", f"[{re.escape(sep or ' ')}\\t]+" if not sep else f"[{re.escape(sep)}]+"), lambda x: x != "")
            df = df.select(OBS, *(F.get(parts, i).alias(c) for i, c in enumerate(names)))
    return _typed(df, inputs), variables


def _typed(df, inputs):
    cols = []
    for c, is_char, fmt, _ in inputs:
        q = "`" + c + "`"
        if is_char:
            w = re.match(r"\$(\d+)", fmt or "")
            text = f"CASE WHEN {q} IS NULL OR trim({q}) = '.' THEN '' ELSE {q} END"
            cols.append(F.expr(f"substring({text}, 1, {w[1]})" if w else text).alias(c))
        else:
            cols.append(F.expr(input_number((q, "c"), fmt or "best.")[0]).cast("double").alias(c))
    return df.select(*cols, OBS)


def _columns(df, inputs):
    out, at = [], 1
    for c, is_char, fmt, cols in inputs:
        m = re.fullmatch(r"\$?[A-Za-z_]*(\d+)\.?\d*", fmt or "")
        a, z = cols or (at, at + (int(m[1]) if m else 8) - 1)
        at = z + 1
        text = f"trim(substring(value, {a}, {z - a + 1}))"
        out.append(F.expr(text if is_char else input_number((text, "c"), fmt or "best.")[0]).alias(c))
    return df.select(*out, OBS)
