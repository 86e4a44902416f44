"""SimHash near-duplicates by BK-trees.

Every document gets a 64-bit fingerprint of its word shingles. Equal fingerprints are one node. Two fingerprints
with at most ``radius`` = 2 differing bits agree in two of four 16-bit blocks, so the nodes are dealt to shards by
each pair of blocks and its 32 bits; any link has both ends in one shard. A shard's BK-tree keys children by their
Hamming distance to the parent, and a query follows only edges within the radius. A tree gives the links that join
its members to classes (never all pairs); components over all shards give each document the smallest doc_id it reaches.

The trees stay where their shard is, since all trees together have no size bound and can't be sent to every task.
A shard of more than ``most`` nodes (near copies that differ little) is dealt again by thirds of its other 32 bits, of
which one must agree, and again, so a tree has at most 2^14 nodes, or ``most`` if that is more.

Defined cases: null or empty text, or one of white space only, has fingerprint zero and links as any other; fewer
words than a shingle make one shingle; rows with equal doc_ids each get their row (``keep_one`` keeps one row of a class,
whatever their ids); null doc_ids join classes but name none unless alone in it; a table without rows gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, byte_texts, free_names, store, table
from .components import components

_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or b"").lower().split()  # ASCII only, as these are bytes
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    return bit_majority(np.array(hashes, "<u8"))


def bit_majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        h = np.ascontiguousarray(hashes[at : at + 8192], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def text_hash() -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id (and th, if docs have it), fp (the 64 bits as a signed long)."""
    also = [c for c in docs.columns if c == "th"]
    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in byte_texts(b)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *also)), pa.array(fp)], names=["doc_id", *also, "fp"])

    return docs.select("doc_id", *also, "text").mapInArrow(of, ", ".join(f"{c} long" for c in ("doc_id", *also, "fp")))


class BKTree:
    """Integers by Hamming distance; children keyed by their distance to the parent."""

    def __init__(self):
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.nodes.append(value)
        self.children.append({})
        if len(self.nodes) == 1:
            return
        at = 0
        while True:
            d = (self.nodes[at] ^ value).bit_count()
            if (to := self.children[at].get(d)) is None:
                self.children[at][d] = len(self.nodes) - 1
                return
            at = to

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the nodes within the radius."""
        found, todo = [], [0] if self.nodes else []
        while todo:
            at = todo.pop()
            d = (self.nodes[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius:
                todo += [to for k, to in children.items() if d - radius <= k <= d + radius]
            else:
                todo += [to for k in range(d - radius, d + radius + 1) if (to := children.get(k)) is not None]
        return found


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the values' classes under distance <= radius; at most len(values) - 1."""
    tree, up, links = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = root(i), root(j)
            if a != b:
                up[a] = b
                links.append((v, values[j]))
        tree.add(v)
    return links


def _bits(fp, low: int, n: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1))


def near_links(nodes: DataFrame, most: int = 4096) -> DataFrame:
    """Links a, b among distinct fingerprints (column fp) that give the classes under 2 or fewer differing bits."""
    fp = F.col("fp")
    # the bits of a pair of blocks as the key, the other 32 bits as what may differ
    other = lambda i, j: sorted({0, 1, 2, 3} - {i, j})
    join = lambda a, b: F.shiftleft(_bits(fp, 16 * a, 16), 16).bitwiseOR(_bits(fp, 16 * b, 16))
    dealt = F.explode(F.array(*(F.struct(F.lit(str(k)).alias("way"), join(i, j).alias("key"), join(*other(i, j)).alias("rest")) for k, (i, j) in enumerate(_PAIRS))))
    shards = nodes.select("fp", dealt.alias("s")).select("fp", F.col("s.way").alias("way"), F.col("s.key").alias("key"), F.col("s.rest").alias("rest"))
    found, bits = [], 32
    while True:
        sizes = shards.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shards = store(shards.join(sizes, ["way", "key"]), "shards")
        hot = (F.col("n") > most) & F.lit(bits > 14)
        found.append(_shard_links(shards.filter(~hot)))
        shards = shards.filter(hot)
        if bits <= 14 or shards.isEmpty():
            break
        third = [(0, bits // 3), (bits // 3, bits // 3), (2 * (bits // 3), bits - 2 * (bits // 3))]
        rest = F.col("rest")
        thirds = []
        for k, (low, n) in enumerate(third):
            left = _bits(rest, 0, low) if low else F.lit(0).cast("long")
            left = left.bitwiseOR(F.shiftleft(_bits(rest, low + n, bits - low - n) if bits > low + n else F.lit(0).cast("long"), low))
            thirds.append(F.struct(F.concat("way", F.lit(f"/{bits}.{k}:"), F.col("key").cast("string")).alias("way"), _bits(rest, low, n).alias("key"), left.alias("rest")))
        shards = shards.select("fp", F.explode(F.array(*thirds)).alias("s")).select("fp", F.col("s.way").alias("way"), F.col("s.key").alias("key"), F.col("s.rest").alias("rest"))
        bits -= bits // 3
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _shard_links(shards: DataFrame, radius: int = 2) -> DataFrame:
    """Each task has whole shards, one after the other, and builds their trees."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        now = None
        links: list[tuple[int, int]] = []
        signed = lambda rows: pa.RecordBatch.from_arrays([pa.array(np.array([x[k] for x in rows], "u8").view("i8")) for k in (0, 1)], names=["a", "b"])
        for b in batches:
            fps = b.column("fp").to_numpy().view("u8").tolist()
            for shard, fp in zip(zip(b.column("way").to_pylist(), b.column("key").to_pylist(), strict=True), fps, strict=True):
                if shard != now:
                    links += tree_links(held, radius) if len(held) > 1 else []
                    now, held = shard, []
                held.append(fp)
            if links:
                yield signed(links)
                links = []
        links += tree_links(held, radius) if len(held) > 1 else []
        if links:
            yield signed(links)

    return shards.select("way", "key", "fp").repartition("way", "key").sortWithinPartitions("way", "key").mapInArrow(of, "a long, b long")


def _rooted(docs: DataFrame, shingle: int, most: int) -> DataFrame:
    """The fingerprints of docs with root (of the class) and component_id."""
    fps = store(fingerprints(docs, shingle), "fp")
    nodes = store(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    linked = components(near_links(nodes.select("fp"), most))
    roots = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = store(roots.join(named, "root").select("fp", "root", "component_id"), "classes")
    return fps.join(ids, "fp")


def near_classes(docs: DataFrame, shingle: int = 3, most: int = 4096) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text)."""
    return _rooted(docs.select("doc_id", "text"), shingle, most).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs with one row of each class (classes: doc_id, th, root for each row): the least doc_id, null ones last, then the least text hash.

    A class follows from the text, so the kept id and text name rows of one class only; of equal ones the first stays.
    """
    least = classes.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th")).alias("k"))
    id_, kept, th = free_names(docs, "__id", "__kept", "__th")
    least = least.select(F.col("k.doc_id").alias(id_), F.col("k.th").alias(kept))
    rows = docs.withColumn(th, text_hash())
    chosen = rows.join(least, rows["doc_id"].eqNullSafe(least[id_]) & (rows[th] == least[kept]), "left_semi")
    return chosen.dropDuplicates(["doc_id", th]).select(*docs.columns)


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id."""
    return one_of_each(docs, _rooted(docs.select("doc_id", text_hash().alias("th"), "text"), shingle, 4096))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
