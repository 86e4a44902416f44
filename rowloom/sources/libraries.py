"""Libraries: names of datasets to where they are kept."""

from __future__ import annotations

import os
import re
from pathlib import Path

from ..lang.lexer import ProgramError
from ..plans.dataset import OBS, Dataset, load, number
from . import files


class Library:
    """In the session: datasets are lazy plans."""

    def __init__(self, name: str, engine):
        self.name, self.engine = name, engine
        self.members: dict[str, Dataset] = {}

    def names(self) -> list[str]:
        return sorted(self.members)

    def get(self, member: str) -> Dataset | None:
        return self.members.get(member.upper())

    def put(self, member: str, d: Dataset) -> None:
        self.members[member.upper()] = d

    def remove(self, member: str) -> None:
        self.members.pop(member.upper(), None)


class FileLibrary(Library):
    """A folder with a file (or a folder of part files) for each dataset; names without case.

    kind: parquet (any path that Spark opens), csv, or xport (a local folder; transport files are written, native ones read too).
    """

    SUFFIXES = {"parquet": (".parquet",), "csv": (".csv",), "xport": (".xpt", ".sas7bdat")}

    def __init__(self, name: str, engine, kind: str, path: str):
        super().__init__(name, engine)
        self.kind, self.path = kind, path
        if "://" not in path:
            os.makedirs(path, exist_ok=True)

    def _entries(self) -> dict[str, str]:
        sc = self.engine.spark.sparkContext
        jvm = sc._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        out: dict[str, str] = {}
        found = [str(x.getPath().toString()) for x in fs.listStatus(folder)] if fs.exists(folder) else []
        for suffix in reversed(self.SUFFIXES[self.kind]):
            for p in found:
                if p.lower().endswith(suffix):
                    out[p.rpartition("/")[2][: -len(suffix)].upper()] = p
        return out

    def names(self) -> list[str]:
        return sorted({*self._entries(), *self.members})

    def get(self, member: str) -> Dataset | None:
        if (d := self.members.get(member.upper())) is not None:
            return d
        path = self._entries().get(member.upper())
        if path is None:
            return None
        spark = self.engine.spark
        if self.kind == "parquet":
            df = load(spark.read.parquet(path))
            if OBS in df.columns:  # the order that the dataset was written in
                return Dataset(df, {}, [(OBS, False)])
        elif self.kind == "csv":
            df = files.read_delimited(spark, path)
        else:
            df = files.read_sas_file(spark, re.sub(r"^file:(//)?", "", path))
        return Dataset(df)

    def put(self, member: str, d: Dataset) -> None:
        if self.kind == "parquet":
            path = f"{self.path}/{member.lower()}.parquet"
            tmp = f"{path}.new"
            df = number(d.df.drop(OBS) if (OBS, False) not in d.order else d.df.withColumnRenamed(OBS, "__o"), [("__o" if c == OBS else c, x) for c, x in d.order], OBS).drop("__o") if d.order else d.visible
            df.write.mode("overwrite").parquet(tmp)  # the dataset may be read from the old files
            jvm, sc = self.engine.spark.sparkContext._jvm, self.engine.spark.sparkContext
            a, b = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(path)
            fs = b.getFileSystem(sc._jsc.hadoopConfiguration())
            fs.delete(b, True)
            fs.rename(a, b)
        elif self.kind == "csv":
            files.write_delimited(d, str(Path(self.path) / f"{member.lower()}.csv"))
        else:
            files.write_transport(d, str(Path(self.path) / f"{member.lower()}.xpt"), member)

    def remove(self, member: str) -> None:
        path = self._entries().get(member.upper())
        if path:
            sc = self.engine.spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            if self.kind == "xport":
                files.write_names(re.sub(r"^file:(//)?", "", path), {})


def open_library(ref: str, engine_name: str, path: str, engine) -> Library:
    kind = {"": "parquet", "parquet": "parquet", "base": "parquet", "sas": "xport", "xport": "xport", "csv": "csv", "memory": "memory"}.get(engine_name)
    if kind is None:
        raise ProgramError(f"unknown library engine {engine_name}")
    return Library(ref, engine) if kind == "memory" or not path else FileLibrary(ref, engine, kind, path)
