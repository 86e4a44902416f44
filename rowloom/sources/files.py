"""Delimited text, workbooks and transport files."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import put_text
from ..lang.lexer import ProgramError
from ..plans.dataset import Dataset, load

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    df = spark.read.options(sep=sep, header=str(header).lower(), inferSchema="true", enforceSchema="false", quote='"', escape='"', multiLine="false").csv(path)
    if not header:
        df = df.toDF(*(f"VAR{i + 1}" for i in range(len(df.columns))))
    return load(df)


def rendered(d: Dataset) -> DataFrame:
    """The ordered rows as text: dates by their formats, missing as nothing, whole numbers without a fraction."""
    df = d.ordered
    cols = []
    for f in df.schema.fields:
        q = "`" + f.name + "`"
        fmt = (d.variables.get(f.name.lower()).format if f.name.lower() in d.variables else None) or ""
        is_date = re.match(r"(?i)(date|datetime|mmddyy|ddmmyy|yymmdd|monyy|time|e8601|is8601|b8601)", fmt)
        if isinstance(f.dataType, T.NumericType) and is_date:
            cols.append(F.expr(f"CASE WHEN {q} IS NOT NULL THEN {put_text((q, 'n'), fmt)} END").alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.expr(f"CASE WHEN {q} = floor({q}) AND abs({q}) < 1e15 THEN CAST(CAST({q} AS BIGINT) AS STRING) ELSE CAST({q} AS STRING) END").alias(f.name))
        else:
            cols.append(F.col(q).cast("string").alias(f.name))
    return df.select(*cols)


def write_delimited(d: Dataset, path: str, sep: str = ",", folder: bool = False) -> None:
    """One file at ``path``, of part files that tasks write and that are joined byte by byte; or, with ``folder``, the part files themselves."""
    df = rendered(d)
    options = dict(sep=sep, emptyValue="", nullValue="", quote='"', escape='"')
    if folder:
        df.write.mode("overwrite").options(header="true", **options).csv(path)
        return
    spark = df.sparkSession
    parts = f"{path}.parts"
    df.write.mode("overwrite").options(header="false", **options).csv(parts)
    heads = spark.createDataFrame([tuple(df.columns)], ", ".join(f"c{i} string" for i in range(len(df.columns))))
    heads.write.mode("overwrite").options(header="false", **options).csv(f"{parts}.head")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(conf)
    out = fs.create(place(path), True)
    try:
        for folder_ in (f"{parts}.head", parts):  # parts are in order of their names, as the rows are
            for p in sorted(str(x.getPath().toString()) for x in fs.listStatus(place(folder_))):
                if "/part-" in p:
                    data = fs.open(place(p))
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, conf, False)
                    data.close()
    finally:
        out.close()
    for folder_ in (f"{parts}.head", parts):
        fs.delete(place(folder_), True)


def _column(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(d: Dataset, path: str, sheet: str = "Sheet1", labels: bool = False) -> None:
    """One sheet; rows stream from the driver's iterator."""
    df = d.ordered
    heads = [(d.variables[c.lower()].label if labels and c.lower() in d.variables else None) or c for c in df.columns]

    def cell(r, k, v):
        at = f"{_column(k)}{r}"
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetData>'.encode())
            f.write(("<row>" + "".join(cell(1, k, h) for k, h in enumerate(heads, 1)) + "</row>").encode())
            for r, row in enumerate(df.toLocalIterator(), 2):
                f.write(("<row>" + "".join(cell(r, k, v) for k, v in enumerate(row, 1)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")


def read_workbook(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The first sheet."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        name = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        rows = []
        for row in ElementTree.fromstring(z.read(name)).iter(f"{{{_NS['m']}}}row"):
            values: dict[int, object] = {}
            for k, c in enumerate(row.findall("m:c", _NS)):
                ref = re.match(r"[A-Z]+", c.get("r", ""))
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref[0]))) - 1 if ref else k
                v, kind = c.find("m:v", _NS), c.get("t")
                if kind == "inlineStr":
                    values[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is not None and v.text is not None:
                    values[at] = shared[int(v.text)] if kind == "s" else v.text if kind == "str" else float(v.text)
            rows.append(values)
    width = max((max(r, default=-1) for r in rows), default=-1) + 1
    heads = [str(rows[0].get(i) or f"VAR{i + 1}") for i in range(width)] if header and rows else [f"VAR{i + 1}" for i in range(width)]
    body = rows[1:] if header else rows
    text = [any(isinstance(r.get(i), str) for r in body) for i in range(width)]
    schema = T.StructType([T.StructField(h, T.StringType() if t else T.DoubleType()) for h, t in zip(heads, text, strict=True)])
    return spark.createDataFrame([tuple((str(r[i]) if t and r.get(i) is not None else r.get(i)) for i, t in enumerate(text)) for r in body], schema)


def read_sas_file(spark: SparkSession, path: str) -> DataFrame:
    """A transport (.xpt) or native (.sas7bdat) file."""
    import pandas as pd

    kind = "xport" if path.lower().endswith((".xpt", ".xport")) else "sas7bdat"
    pdf = pd.read_sas(path, format=kind, encoding="utf-8")
    for c in pdf.columns:
        if str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = (pdf[c] - pd.Timestamp("1960-01-01")).dt.total_seconds()
    df = load(spark.createDataFrame(pdf))
    return df.withColumnsRenamed(read_names(path, list(pdf.columns))) if kind == "xport" else df


def names_path(path: str) -> Path:
    """Beside a transport file: the long names of its columns."""
    return Path(f"{path}.names.json")


def write_names(path: str, aliases: dict[str, str]) -> None:
    if aliases:
        mark = hashlib.sha256(Path(path).read_bytes()).hexdigest()
        names_path(path).write_text(json.dumps({"sha256": mark, "names": aliases}, indent=1))
    else:
        names_path(path).unlink(missing_ok=True)


def read_names(path: str, columns: list[str]) -> dict[str, str]:
    """The long names of a transport file's columns. A file that was changed since its names were written is refused, as they may be of other columns."""
    if not names_path(path).exists():
        return {}
    try:
        kept = json.loads(names_path(path).read_text())
        names, mark = dict(kept["names"]), kept["sha256"]
    except (ValueError, KeyError, TypeError) as e:
        raise ProgramError(f"{names_path(path)} is no table of names: {e}") from e
    if mark != hashlib.sha256(Path(path).read_bytes()).hexdigest():
        raise ProgramError(f"{path} was changed after {names_path(path)} was written")
    all_ = [names.get(c, c).lower() for c in columns]
    if not set(names) <= set(columns) or len(set(all_)) < len(all_):
        raise ProgramError(f"{names_path(path)} does not fit the columns of {path}")
    return names


def write_transport(d: Dataset, path: str, member: str) -> None:
    """A version 5 transport file: 80-byte records, numbers as IBM doubles. Names are cut to 8 characters; those that change are kept beside the file."""
    import struct
    from datetime import datetime

    def ibm(x) -> bytes:
        if x is None:
            return b"." + b"\0" * 7
        x = float(x)
        if x == 0:
            return b"\0" * 8
        sign = 0x80 if x < 0 else 0
        x = abs(x)
        exp = 64
        while x >= 1:
            x /= 16
            exp += 1
        while x < 1 / 16:
            x *= 16
            exp -= 1
        return struct.pack(">Q", (sign | exp) << 56 | int(x * (1 << 56)))

    df = d.ordered
    rows = df.collect()  # the format is one file of one machine
    names, used = [], set()
    for c in df.columns:
        n = re.sub(r"\W", "_", c).upper()[:8]
        k = 1
        while n in used:
            n = n[: 8 - len(str(k))] + str(k)
            k += 1
        used.add(n)
        names.append(n)
    chars = [isinstance(f.dataType, T.StringType) for f in df.schema.fields]
    widths = [max([1, *(len((r[i] or "").encode()) for r in rows)]) if t else 8 for i, t in enumerate(chars)]
    stamp = datetime.now().strftime("%d%b%y:%H:%M:%S").upper().encode()
    pad = lambda b: b + b" " * (-len(b) % 80)
    head = b"HEADER RECORD*******%-8sHEADER RECORD!!!!!!!%-30s  "
    out = [pad(head % (b"LIBRARY", b"0" * 30)), pad(b"SAS     SAS     SASLIB  9.4     LINUX   " + b" " * 24 + stamp), pad(stamp)]
    out += [pad(head % (b"MEMBER", b"0" * 17 + b"1600000000140")), pad(head % (b"DSCRPTR", b"0" * 30))]
    out += [pad(b"SAS     %-8sSASDATA 9.4     LINUX   " % member.upper()[:8].encode() + b" " * 24 + stamp), pad(stamp + b" " * 16 + b" " * 40 + b" " * 8)]
    out.append(pad(head % (b"NAMESTR", b"000000%04d" % len(names) + b"0" * 20)))
    desc, at = b"", 0
    for i, n in enumerate(names):
        v = d.variables.get(df.columns[i].lower())
        label = ((v.label if v else None) or df.columns[i]).encode()[:40]
        desc += struct.pack(">hhhh8s40s8shhh2s8shhl52s", 2 if chars[i] else 1, 0, widths[i], i + 1, n.encode().ljust(8), label.ljust(40), b" " * 8, 0, 0, 0, b"\0\0", b" " * 8, 0, 0, at, b"\0" * 52)
        at += widths[i]
    out += [pad(desc), pad(head % (b"OBS", b"0" * 30))]
    body = b"".join((r[i] or "").encode().ljust(w) if t else ibm(r[i]) for r in rows for i, (t, w) in enumerate(zip(chars, widths, strict=True)))
    Path(path).write_bytes(b"".join([*out, pad(body)]))
    write_names(path, {n: c for n, c in zip(names, df.columns, strict=True) if n != c})
