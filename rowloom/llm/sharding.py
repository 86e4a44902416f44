"""Sharding by sampled splitters, with DataFrame functions only.

Documents are ordered by a 64-bit hash of id and text. A size-weighted sample of the keys gives quantile boundaries
for many more ranges than shards; every document falls into its range, ranges that came out overfull are cut into
equal parts of their key interval, and running sums inside the ranges plus the ranges' offsets place each document
on the line of all bytes. That line is cut into ``n_shards`` equal lengths: a document belongs to the shard that holds
its middle. So each shard is within one document at either end of an equal share of bytes, whatever the sample was; the sample
only spreads the work.

Law ``bytes``. Equal rows (copies with equal ids) are one row with a count until the end, so no group of copies
meets in a task; documents of equal text have different keys and spread over all shards.

Defined cases: null text has no bytes (size 16, crc 0); null or repeated doc_ids are ordered by the hash of the rest
like others; texts of any length count whole; a table without rows gives none; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prefix_offsets, store, table


def range_of(key: Column, splitters: list[int]) -> Column:
    """How many of the sorted splitters are at or below a key: among the first of each block of them, then inside of one block."""
    if not splitters:
        return F.lit(0)
    block = max(1, int(len(splitters) ** 0.5))
    array = lambda xs: F.array(*map(F.lit, xs))
    heads, blocks = array(splitters[::block]), F.array(*(array(splitters[i : i + block]) for i in range(0, len(splitters), block)))
    at = F.size(F.filter(heads, lambda s: s <= key))
    return F.when(at == 0, 0).otherwise((at - 1) * block + F.size(F.filter(F.get(blocks, at - 1), lambda s: s <= key)))


def shard(docs: DataFrame, n_shards: int = 40, ranges_per_shard: int = 8, sample: int = 20_000, overfull: float = 2.0, range_rows: int = 1_000_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text); ``slot`` counts from 0 in each shard."""
    text = F.coalesce("text", F.lit(""))
    meta = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64("doc_id", text).alias("key"))
    meta = store(meta.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count(F.lit(1)).alias("n")), "meta")
    total, records = meta.agg(F.sum(F.col("n") * F.col("size")), F.count(F.lit(1))).first()
    total = total or 1
    n_ranges = max(n_shards * ranges_per_shard, -(-(records or 0) // range_rows))  # a range is one task's work
    sample = max(sample, 20 * n_ranges)
    # a key is drawn with a chance in proportion to its bytes: about ``sample`` keys, whatever the input
    draw = (F.shiftrightunsigned(F.xxhash64("key", F.lit(7)), 11) / F.lit(float(1 << 53))) < F.lit(float(sample)) * F.col("n") * F.col("size") / F.lit(float(total))
    quantiles = [i / n_ranges for i in range(1, n_ranges)]
    splitters = sorted(set(meta.filter(draw).agg(F.percentile_approx("key", quantiles, 100_000)).first()[0] or []))
    ranged = meta.withColumn("range", range_of(F.col("key"), splitters))
    # ranges with more than ``overfull`` times their share of records are cut into equal parts of their key interval
    most = max(1, int(overfull * (records or 1) / n_ranges))
    ranges = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("records"), F.min("key").alias("low"), F.max("key").alias("high"))
    ranges = ranges.select("range", F.ceil(F.col("records") / most).cast("int").alias("parts"), "low", "high")
    width = F.col("high").cast("double") - F.col("low").cast("double") + 1
    part = F.least(F.floor((F.col("key").cast("double") - F.col("low").cast("double")) / width * F.col("parts")).cast("int"), F.col("parts") - 1)
    placed = ranged.join(F.broadcast(ranges), "range").withColumn("part", part)  # at most n_ranges rows are sent
    w = Window.partitionBy("range", "part").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    bytes_ = F.col("n") * F.col("size")
    line = placed.select("doc_id", "size", "text_crc32", "n", "range", "part", F.coalesce(F.sum(bytes_).over(w), F.lit(0)).alias("b"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("r"))
    parts = placed.groupBy("range", "part").agg(F.sum(bytes_).alias("bytes"), F.sum("n").alias("rows"))
    offsets = prefix_offsets(parts, ["range", "part"], ["bytes", "rows"]).select("range", "part", "bytes_before", "rows_before")
    line = line.join(F.broadcast(offsets), ["range", "part"])
    # copies of equal rows come back here, in blocks
    block = 1 << 16
    line = line.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    line = line.withColumn("i", F.explode(F.sequence("from", F.least(F.col("from") + block - 1, F.col("n") - 1))))
    at = F.col("bytes_before") + F.col("b") + F.col("i") * F.col("size")
    which = F.least(F.lit(n_shards - 1), F.floor(((2 * at + F.col("size")) * n_shards).cast("decimal(38,0)") / F.lit(2 * total)).cast("int")).cast("int")
    line = store(line.select("doc_id", "size", "text_crc32", which.alias("shard"), (F.col("rows_before") + F.col("r") + F.col("i")).alias("rank")), "line")
    first = line.groupBy("shard").agg(F.min("rank").alias("first"))  # n_shards rows
    return line.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
