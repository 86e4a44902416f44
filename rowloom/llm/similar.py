"""Near copies by SimHash fingerprints and BK-trees in min-hash shards, with an exact check of the Jaccard similarity.

A text is the set of its shingles (5 words; a text of fewer is one). Equal sets are one node with a 64-bit SimHash
fingerprint. Sets with a Jaccard of 0.8 differ in 10 of 64 bits on average and 19 at the most that matter (RADIUS), and so few equal
bits can't be found by equal blocks. So shards are not made of bits here, but of min-hashes: sets that agree in ROWS of them, in one
of BANDS ways. A pair of a Jaccard of 0.8 shares no shard with a chance of 0.0007, one of 0.85 with 0.00001.

1. In each shard every node meets the least and the greatest; of these partners, the two that are nearest by their
   fingerprints are checked on whole sets. Large groups of near copies become few classes here, and are not paired with themselves.
2. In shards that still have several classes, a task builds the BK-tree of the fingerprints; nodes outside of the shard's largest
   class ask it for neighbours within the radius, and links between classes are taken nearest first, as many as join them.
   A shard of more than ``most`` nodes is dealt to several trees, and the nodes that ask go to each of them.
3. Links are kept if the whole sets have the similarity; components over them are the classes.

So no link is wrong; what can be lost is a class that hangs together only by a pair that met in no shard, or whose nearer neighbours failed the check.

Defined cases: null or empty text, or one of white space only, is the empty set, and all empty sets are equal; words are
lower-cased in ASCII only; repeated rows and rows of one id are told apart by their texts; a table without rows gives none;
texts of any length are whole (memory grows with the text, not its square); other columns pass through ``keep_one_similar``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_texts, kept_by_worker, store
from .components import components
from .simhash import BKTree, bit_majority, one_of_each, text_hash
from .suffixes import WordHashes, gram_hashes, mix

#: The least similarity as a fraction, the most bits in which fingerprints of such sets differ, and the min-hash shards.
NUM, DEN = 4, 5
RADIUS = 19
BANDS, ROWS = 24, 6


def shingle_set(text: bytes | None, known: WordHashes, shingle: int) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    h = known.of((text or b"").lower().split())
    return np.unique(gram_hashes(h, min(shingle, len(h)))) if len(h) else np.empty(0, np.uint64)


_SALTS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
_FACTORS, _MASKS = _SALTS[0] | np.uint64(1), _SALTS[1]


def shard_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set's shards, one for each band of its min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, ((found[at : at + 2048, None] ^ _MASKS) * _FACTORS).min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


ROWS_SCHEMA = "doc_id long, th long, node long, size int, fp long, keys array<long>"


def _rows(docs: DataFrame, shingle: int) -> DataFrame:
    """Each row's set by its hash (node), with the set's size, fingerprint and shard keys."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker("hashes", WordHashes)
        for b in batches:
            sets = [shingle_set(t, known, shingle) for t in byte_texts(b)]
            signed = lambda values: pa.array(np.array(values, "u8").view("i8"))
            keys = [shard_keys(x).view("i8") if len(x) else None for x in sets]
            cols = [signed([xxhash.xxh64_intdigest(x.tobytes(), 1) for x in sets]), pa.array([len(x) for x in sets], pa.int32()), signed([bit_majority(x) for x in sets]), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *cols], names=[x.split()[0] for x in ROWS_SCHEMA.split(", ")])

    return docs.select("doc_id", "th", "text").mapInArrow(of, ROWS_SCHEMA)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node and set of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker("hashes", WordHashes)
        for b in batches:
            sets = [shingle_set(t, known, shingle) for t in byte_texts(b)]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), 1) for x in sets], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.view("i8") for x in sets], pa.list_(pa.int64()))], names=["node", "set"])

    return docs.select("text").mapInArrow(of, "node long, set array<long>")


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b: nodes) with the similarity."""
    whole = lambda k, n: sets.select(F.col("node").alias(k), F.col("set").alias(f"s{n}"))
    both = pairs.join(whole("a", 1), "a").join(whole("b", 2), "b")
    shared = F.size(F.array_intersect("s1", "s2"))
    return both.filter(DEN * shared >= NUM * (F.size("s1") + F.size("s2") - shared)).select("a", "b")


def class_links(nodes: list[int], fps: list[int], roots: list[int], asks: list[bool], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between classes (roots) of one tree's nodes, nearest first, as many as join what is within the radius of nodes that ask."""
    tree, held = BKTree(), []
    place: dict[int, int] = {}
    for i, fp in enumerate(fps):
        if fp not in place:
            place[fp] = len(held)
            held.append([])
            tree.add(fp)
        held[place[fp]].append(i)
    found = []
    for i, fp in enumerate(fps):
        if not asks[i]:
            continue
        nearest: dict[int, int] = {}  # by class: distance and node
        for at in tree.within(fp, radius):
            far = (tree.nodes[at] ^ fp).bit_count() << 32
            for j in held[at]:
                if roots[j] != roots[i] and nearest.get(roots[j], far | j) >= far | j:
                    nearest[roots[j]] = far | j
        found += [(x >> 32, i, x & 0xFFFFFFFF) for x in nearest.values()]
    up = {r: r for r in roots}

    def root(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    links = []
    for _, i, j in sorted(found):
        a, b = root(roots[i]), root(roots[j])
        if a != b:
            up[a] = b
            links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return links


def _tree_links(shards: DataFrame) -> DataFrame:
    """shards: key, part, node, fp, root, asks. Each task has whole parts of shards, one after the other."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def links() -> pa.RecordBatch:
            nodes, fps, roots, asks = zip(*held, strict=True)
            out = class_links(list(nodes), [x & 0xFFFFFFFFFFFFFFFF for x in fps], list(roots), list(asks))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for key, part, *row in zip(*(b.column(c).to_pylist() for c in ("key", "part", "node", "fp", "root", "asks")), strict=True):
                if (key, part) != now:
                    if len(held) > 1:
                        yield links()
                    now, held = (key, part), []
                held.append(tuple(row))
        if len(held) > 1:
            yield links()

    return shards.select("key", "part", "node", "fp", "root", "asks").repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(of, "a long, b long")


def similar_classes(docs: DataFrame, shingle: int = 5, most: int = 1024) -> DataFrame:
    """doc_id, th, root for each row of docs (doc_id, text): rows of one root are linked by pairs of a Jaccard of 0.8 or more."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text")
    rows = store(_rows(docs, shingle), "rows")
    nodes = rows.filter("size > 0").groupBy("node").agg(F.min("th").alias("th"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    shards = nodes.select("node", "th", "size", "fp", F.explode("keys").alias("key"))
    one = F.struct("node", "size", "fp")
    ends = shards.groupBy("key").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    runs = store(shards.join(ends, "key"), "runs")
    # the two nearest partners among the ends of a node's shards
    met = runs.select("node", "size", "fp", F.explode(F.array("lo", "hi")).alias("to")).filter("node <> to.node")
    near = met.withColumn("far", F.bit_count(F.col("fp").bitwiseXOR(F.col("to.fp")))).filter((F.col("far") <= RADIUS) & (DEN * F.least("size", "to.size") >= NUM * F.greatest("size", "to.size")))
    best = near.groupBy("node").agg(F.min(F.struct("far", "to.node")).alias("x"), F.min(F.struct("far", (-F.col("to.node")).alias("less"), "to.node")).alias("y"))
    pairs = best.select("node", F.explode(F.array("x.node", "y.node")).alias("to")).select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()
    asked = runs.groupBy("node").agg(F.first("th").alias("th")).select("th")
    sets = store(_sets(docs.join(asked, "th", "left_semi").dropDuplicates(["th"]), shingle), "sets")
    links = store(_verified(sets, pairs), "links")
    classes = store(components(links), "classes")
    # shards of several classes: their largest, and how many trees they take
    named = runs.join(classes, "node", "left").select("key", "n", "node", "fp", F.coalesce("root", "node").alias("root"))
    by_class = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_class.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("c", "root")).alias("top")).filter("classes > 1").select("key", F.col("top.root").alias("top"))
    named = named.join(mixed, "key").withColumns({"asks": F.col("root") != F.col("top"), "parts": F.ceil(F.col("n") / most).cast("int")})
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = named.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))))
    more = _verified(sets, store(_tree_links(dealt), "near").distinct())
    classes = components(links.union(more))
    return rows.join(classes, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def keep_one_similar(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs with one row of each class of near copies: that of the smallest doc_id."""
    return one_of_each(docs, similar_classes(docs, shingle))
