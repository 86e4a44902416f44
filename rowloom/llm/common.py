"""Helpers that the operators of this folder share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where it is unset (tests, one machine) a folder of our own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = tempfile.mkdtemp(prefix="rowloom-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STORED: list[str] = []  # by this driver


@contextlib.contextmanager
def stored_meanwhile(spark: SparkSession):
    """Gives a ``store``; at the end, what others stored since is deleted. For results that need nothing of it, as they are written."""
    mark, own = len(_STORED), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = store(df, name)
        own.append(_STORED[-1])
        return out

    yield keep
    for path in _STORED[mark:]:
        if path not in own:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _STORED[mark:] = own


def bounded_batches(spark: SparkSession, mb: int = 1) -> None:
    """Arrow batches are cut by bytes too, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores behind those that the table has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


@contextlib.contextmanager
def held_conf(spark: SparkSession, key: str, value: str):
    """A setting of the session for what runs inside; the one before comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def prefix_offsets(parts: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Per row of a table of a bounded number of parts: the sums over the parts before it, as ``<name>_before``.

    One task; callers pass one row per physical part, never one per record.
    """
    from pyspark.sql import Window

    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", *(F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long").alias(f"{c}_before") for c in sums))


def byte_texts(batch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column of an Arrow batch."""
    import pyarrow as pa

    return batch.column(name).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def release_memory() -> None:
    """Gives what this process has freed back to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: dict = {}  # by worker process


def kept_by_worker(key, make):
    """What a worker keeps between tasks of one operator. Another operator's goes first, so that the stages of a pipeline don't add up in a reused worker."""
    if key not in _KEPT:
        _KEPT.clear()
        release_memory()
        _KEPT[key] = make()
    return _KEPT[key]
