"""Repeated passages by sparse suffix arrays.

The suffixes of the corpus that start at minimisers (the least hash of three words in a window of ``W`` places) are
kept, cut to ``T`` words and sorted by (hash of these, place in corpus order: doc_id, then place in the text), in ranges of this whole key,
so the suffixes of one passage in a third of all documents are many tasks' work. Equal neighbours are the same T words and make a run; each is compared with
the first of its run, which for runs that go on from one range to the next is one small row for each range. Along a repeated passage such matches follow each other at
one distance and join to one span, which is then extended word by word to the left and right. A span of 50
words or more (LEAST) is a repeat of an earlier passage. A text's repeats of itself are found the same way where the text is read;
only the first of equal suffixes of a text meets those of others. W + T is 50, so any repeated passage of 50 words has a minimiser whose
T words lie inside, no more than W - 1 words from its start and from its end; W words to either side complete it.

The first of a run need not be the place that shares most. So where a run has three places or more, its places are also compared
by whole windows of 50 words: those around its suffixes that no span has explained yet. A window's place is explained only if an earlier one
has the same words, so the earliest place of any window is asked too, and equal windows meet by their hash. To keep their number small,
first their common cores of 43 words meet, one for each 8 windows; only windows whose core stands in two places are looked at.
So all words inside a passage of 50 that an earlier place has go, and no others.

Words are compared by 64-bit hashes. A passage's first occurrence stays; at least one copy of every passage stays,
since a span is only ever removed in favour of an earlier place.

Defined cases: null or short texts have no repeats; null doc_ids come first in corpus order; rows equal in doc_id and
text are one document and share their result (neither repeats the other); rows of one doc_id with other texts are
documents of their own; a text that repeats inside itself keeps the first; columns of any other name pass through.

Very long texts are one row of a task, with 8 bytes for each word. Counts of a core or window are summed before the shuffle and the joins by them are plain equi-joins that adaptive execution
splits; nothing is paired within a run. A table without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .common import bounded_batches, byte_texts, free_names, kept_by_worker, store, table

M, W, T = 3, 30, 20
LEAST = 50
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 0)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, by doubling: every place has the same weights, so equal words give equal hashes wherever they stand."""
    out, have, at = None, h, 0
    size = 1
    while True:
        if n & size:
            out = have[: len(h) - n + 1] if out is None else mix(out * np.uint64(_BASE) + have[at : at + len(h) - n + 1])
            at += size
        size *= 2
        if size > n:
            return out
        have = mix(have[: -(size // 2)] * np.uint64(_BASE) + have[size // 2 :]) if len(have) > size // 2 else have[:0]


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes of a text (word hashes h), and the hashes of their first T words."""
    if len(h) < T:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    order = gram_hashes(h, M)
    if len(order) <= W:
        places = np.array([int(order.argmin())])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(order, W)
        places = np.concatenate([np.unique(windows[i : i + 65536].argmin(1) + np.arange(i, min(i + 65536, len(windows)))) for i in range(0, len(windows), 65536)])
        places = np.unique(places)
    places = places[places + T <= len(h)]
    return places, gram_hashes(h, T)[places]


def own_repeats(h: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Which kept suffixes are the first of their T words in the text, and the spans that repeat an earlier place of the text itself."""
    order = np.lexsort((places, hashes))
    same = hashes[order][1:] == hashes[order][:-1]
    first = np.ones(len(places), bool)
    first[order[1:][same]] = False
    if not same.any():
        return first, []
    at, shift = places[order[1:][same]], places[order[1:][same]] - places[order[:-1][same]]
    order = np.lexsort((at, shift))
    at, shift = at[order], shift[order]
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(shift) != 0) | (np.diff(at) > T)]))
    spans = []
    for k, z in zip(begins.tolist(), [*(begins[1:] - 1).tolist(), len(at) - 1], strict=True):
        a, end, d = int(at[k]), int(at[z]) + T, int(shift[k])
        while a > d and h[a - 1] == h[a - 1 - d]:
            a -= 1
        while end < len(h) and h[end] == h[end - d]:
            end += 1
        if end - a >= LEAST:
            spans.append((a, end))
    return first, union_spans(spans)


#: A row is a kept suffix that n places of its text have, or with ``end`` a span that repeats an earlier place of its own text.
ANCHORS = "did long, th long, at int, h long, end int, n int"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = kept_by_worker("hashes", WordHashes)
    for b in batches:
        rows, at, hashes, ends, counts = [], [], [], [], []
        for i, t in enumerate(byte_texts(b)):
            h = known.of((t or b"").split())
            places, of = anchors(h)
            if not len(places):
                continue
            first, spans = own_repeats(h, places, of)
            n = int(first.sum())
            rows += [i] * (n + len(spans))
            at += [places[first], np.array([a for a, _ in spans], np.int64)]
            hashes += [of[first], np.zeros(len(spans), np.uint64)]
            ends += [np.full(n, -1), np.array([z for _, z in spans], np.int64)]
            _, which, many = np.unique(of, return_inverse=True, return_counts=True)
            counts += [many[which][first], np.zeros(len(spans), np.int64)]
        if rows:
            take = lambda c: b.column(c).take(pa.array(rows))  # noqa: E731, B023
            end = np.concatenate(ends)
            cols = [take("did"), take("th"), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(hashes).view("i8")), pa.array(end.astype(np.int32), mask=end < 0), pa.array(np.concatenate(counts).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in ANCHORS.split(", ")])


#: Rows of runs (kind 0) with the run's first place, and whether it has three places or more. Of a range's first and last run both are open (kind 1);
#: such a run has one more row (kind 2), its first place in the range and its numbers of rows and places there.
RUNS = "did long, th long, at int, h long, fd long, ft long, fa int, more boolean, kind int, rows long, places long"


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares neighbours of a sorted range of suffixes; what has no equal neighbour goes."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    h, did, th, at, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("h", "did", "th", "at", "n"))
    del held
    new = np.ones(len(h), bool)  # a repeated row is the same document's
    new[1:] = (h[1:] != h[:-1]) | (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (at[1:] != at[:-1])
    h, did, th, at, n = h[new], did[new], th[new], at[new], n[new].astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes, places = np.diff(np.append(begins, len(h))), np.add.reduceat(n, begins)
    is_open = np.zeros(len(begins), bool)
    is_open[[0, -1]] = True
    first = np.repeat(begins, sizes)
    keep = np.repeat((sizes > 1) | (places > 2) | is_open, sizes)
    open_ = np.repeat(is_open, sizes)[keep]
    first = first[keep]
    rows = {"did": did[keep], "th": th[keep], "at": at[keep], "h": h[keep]}
    cols = [pa.array(rows[c]) for c in ("did", "th", "at", "h")] + [pa.array(x[first], mask=open_) for x in (did, th, at)]
    cols += [pa.array(np.repeat(places > 2, sizes)[keep], mask=open_), pa.array(open_.astype(np.int32)), pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int64())]
    whole = pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RUNS.split(", ")])
    for k in range(0, len(first), 100_000):
        yield whole.slice(k, 100_000)
    ends = begins[is_open]
    none = lambda t: pa.nulls(len(ends), t)
    cols = [pa.array(x[ends]) for x in (did, th, at, h)] + [none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.bool_()), pa.array(np.full(len(ends), 2, np.int32)), pa.array(sizes[is_open].astype(np.int64)), pa.array(places[is_open])]
    yield pa.RecordBatch.from_arrays(cols, names=whole.schema.names)


def _runs(found: DataFrame) -> DataFrame:
    """did, th, at, h, fd, ft, fa, more: the suffixes whose T words stand in several places, with the first of these."""
    key = ["h", "did", "th", "at"]
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = store(found.repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(_run_rows, RUNS), "runs")
    ends = found.filter("kind = 2").groupBy("h").agg(F.min(F.struct("did", "th", "at")).alias("f"), F.sum("rows").alias("rows"), F.sum("places").alias("places")).filter("rows > 1 or places > 2")
    ends = ends.select("h", F.col("f.did").alias("fd"), F.col("f.th").alias("ft"), F.col("f.at").alias("fa"), (F.col("places") > 2).alias("more"))
    inner = found.filter("kind = 0").select(*key, "fd", "ft", "fa", "more")
    return inner.unionByName(found.filter("kind = 1").select(*key).join(F.broadcast(ends), "h"))  # two rows for each range are sent


CONTEXT = "did long, th long, at int, side int, words array<long>"


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The W words before (side 0, nearest first) or from (side 1) each asked place."""
    known = kept_by_worker("hashes", WordHashes)
    for b in batches:
        rows = []
        for did, th, asked, text in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), b.column("asked").to_pylist(), byte_texts(b), strict=True):
            if asked:
                h = known.of((text or b"").split()).view("i8")
                rows += [(did, th, a["at"], a["side"], h[a["at"] : a["at"] + W] if a["side"] else h[max(0, a["at"] - W) : a["at"]][::-1]) for a in asked]
        if rows:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["did", "th", "at", "side", "words"])


#: Windows of LEAST words whose distance to their minimiser has the same quotient by STEP share a core.
STEP = 8
CORE = LEAST - STEP + 1


def unexplained(h: np.ndarray, asked: list[int], spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of a text whose minimiser's suffix is one of those at ``asked`` and that are in none of the spans; their cores' hashes and starts."""
    none = np.empty(0, np.int64)
    if len(h) < LEAST:
        return none, none, none
    order = gram_hashes(h, M)
    windows = np.lib.stride_tricks.sliding_window_view(order, W)[: len(h) - LEAST + 1]
    at = np.concatenate([windows[i : i + 65536].argmin(1) + np.arange(i, min(i + 65536, len(windows))) for i in range(0, len(windows), 65536)])
    known = np.zeros(len(at) + 1, np.int64)
    for a, z in spans:
        if z - a >= LEAST:
            known[a] += 1
            known[z - LEAST + 1] -= 1
    suffix = gram_hashes(h, T)
    starts = np.flatnonzero(np.isin(suffix[at], suffix[asked]) & (np.cumsum(known)[:-1] == 0))
    step = (at[starts] - starts) // STEP
    begins = at[starts] - STEP * step
    return starts, mix(gram_hashes(h, CORE)[begins] + step.astype(np.uint64)).view("i8"), begins


CORES = "did long, th long, at int, core long"
WINDOWS = "did long, th long, at int, h long"


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cores of each document's unexplained windows; where the batch has ``cores``, the windows of these."""
    known = kept_by_worker("hashes", WordHashes)
    for b in batches:
        whole = "cores" in b.schema.names
        asks, sure, texts = b.column("asked").to_pylist(), b.column("sure").to_pylist(), byte_texts(b)
        rows, at, hashes = [], [], []
        for i, text in enumerate(texts):
            h = known.of((text or b"").split())
            starts, cores, begins = unexplained(h, asks[i], [(x["start"], x["end"]) for x in sure[i] or ()])
            if not len(starts):
                continue
            if whole:
                starts = starts[np.isin(cores, b.column("cores")[i].values.to_numpy())]
                at.append(starts)
                hashes.append(gram_hashes(h, LEAST)[starts].view("i8"))
            else:
                pick = np.flatnonzero(np.concatenate([[True], (np.diff(begins) != 0) | (np.diff(cores) != 0)]))  # a core's windows follow each other
                at.append(begins[pick])
                hashes.append(cores[pick])
            rows += [i] * len(at[-1])
        if rows:
            cols = [b.column(c).take(pa.array(rows)) for c in ("did", "th")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(hashes))], names=["did", "th", "at", "h" if whole else "core"])


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with did and th, which name a document and are never null."""
    return docs.withColumns({"did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "th": F.xxhash64("text")})


def repeats(docs: DataFrame) -> DataFrame:
    """did, th, first_did, start, end (words, end excluded): each row is a span of a document that repeats an earlier place."""
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs.select("doc_id", "text"))
    kept = store(keyed.mapInArrow(_anchor_rows, ANCHORS), "anchors")
    own = kept.filter("end is not null").select("did", "th", F.col("did").alias("first_did"), F.col("at").alias("start"), "end")
    runs = _runs(kept.filter("end is null").select("did", "th", "at", "h", "n"))
    later = runs.filter("not (did = fd and th = ft and at = fa)").select("did", "th", "at", "fd", "ft", (F.col("at") - F.col("fa")).alias("shift"))
    # matches of one document with one other at one distance, no further apart than they reach, are one span (a repeated row's matches coincide)
    w = Window.partitionBy("did", "th", "fd", "ft", "shift").orderBy("at")
    gaps = later.withColumn("new", (F.col("at") - F.coalesce(F.lag("at").over(w), F.lit(-1 << 30)) > T).cast("int"))
    spans = gaps.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = store(spans.groupBy("did", "th", "fd", "ft", "shift", "island").agg(F.min("at").alias("start"), (F.max("at") + T).alias("end")).drop("island"), "spans")
    # the words around both ends, here and at the first place, each asked for once
    ends = spans.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("here")), F.struct(F.lit(1).alias("side"), F.col("end").alias("here")))).alias("e")).select("*", "e.side", "e.here").drop("e")
    ends = ends.withColumn("there", F.col("here") - F.col("shift"))
    asked = ends.select("did", "th", F.col("here").alias("at"), "side").union(ends.select("fd", "ft", "there", "side")).distinct()
    asked = asked.groupBy("did", "th").agg(F.collect_list(F.struct("at", "side")).alias("asked"))
    context = store(keyed.join(asked, ["did", "th"]).select("did", "th", "asked", "text").mapInArrow(_context_rows, CONTEXT).dropDuplicates(["did", "th", "at", "side"]), "context")
    here = context.select("did", "th", F.col("at").alias("here"), "side", F.col("words").alias("w1"))
    there = context.select(F.col("did").alias("fd"), F.col("th").alias("ft"), F.col("at").alias("there"), "side", F.col("words").alias("w2"))
    both = ends.join(here, ["did", "th", "here", "side"]).join(there, ["fd", "ft", "there", "side"])
    differs = F.array_position(F.zip_with("w1", "w2", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    more = F.when(differs > 0, differs - 1).otherwise(F.size("w1")).cast("int")
    grown = both.groupBy("did", "th", "fd", "ft", "shift", "start", "end").agg(F.max(F.when(F.col("side") == 0, more)).alias("left"), F.max(F.when(F.col("side") == 1, more)).alias("right"))
    grown = grown.select("did", "th", F.col("fd").alias("first_did"), (F.col("start") - F.col("left")).cast("int").alias("start"), (F.col("end") + F.col("right")).cast("int").alias("end"))
    sure = store(grown.filter(F.col("end") - F.col("start") >= LEAST).unionByName(own), "sure")
    return sure.unionByName(_others(keyed, runs.filter("more"), sure))


def _others(keyed: DataFrame, runs: DataFrame, sure: DataFrame) -> DataFrame:
    """What the comparison with the first of each run has missed, in rows as ``repeats`` has them."""
    asked = runs.groupBy("did", "th").agg(F.collect_set("at").alias("asked"))
    spans = sure.groupBy("did", "th").agg(F.collect_set(F.struct("start", "end")).alias("sure"))
    asked = store(asked.join(spans, ["did", "th"], "left"), "asked")
    place = F.xxhash64("did", "th", "at")
    cores = store(keyed.join(asked, ["did", "th"]).select("did", "th", "asked", "sure", "text").mapInArrow(_window_rows, CORES), "cores")
    shared = cores.groupBy("core").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo < hi").select("core")
    shared = cores.join(shared, "core").groupBy("did", "th").agg(F.collect_set("core").alias("cores"))
    asked = store(asked.join(shared, ["did", "th"]), "asked")
    windows = store(keyed.join(asked, ["did", "th"]).select("did", "th", "asked", "sure", "cores", "text").mapInArrow(_window_rows, WINDOWS), "windows")
    first = windows.groupBy("h").agg(F.min(F.struct("did", "th", "at")).alias("f"), F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo < hi").select("h", F.col("f.did").alias("first_did"), F.col("f.th").alias("ft"), F.col("f.at").alias("fa"))
    later = windows.join(first, "h").filter("not (did = first_did and th = ft and at = fa)")
    return later.select("did", "th", "first_did", F.col("at").alias("start"), (F.col("at") + LEAST).alias("end"))


def union_spans(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def cut_words(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, z in spans:
        out.append(text[at : places[a][0]])
        at = places[z - 1][1]
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeats cut from text, and n_words, n_removed (long), removed (array of [start, end] in words), repeats_of (array of doc_ids of first places)."""
    new = T_.StructType([T_.StructField("n_words", T_.LongType()), T_.StructField("n_removed", T_.LongType()), T_.StructField("removed", T_.ArrayType(T_.ArrayType(T_.LongType()))), T_.StructField("repeats_of", T_.ArrayType(T_.LongType()))])
    docs = docs.drop(*new.names)
    did, th, own, of_ = free_names(docs, "__did", "__th", "__spans", "__of")
    spans = repeats(docs).groupBy("did", "th").agg(F.collect_set(F.struct("start", "end")).alias(own), F.array_sort(F.collect_set("first_did")).alias(of_))
    columns = docs.columns
    joined = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), th: F.xxhash64("text")})
    spans = spans.withColumnsRenamed({"did": did, "th": th})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_texts(b)
            n_words, n_removed, removed, of = [], [], [], []
            for i, (spans, first) in enumerate(zip(b.column(own).to_pylist(), b.column(of_).to_pylist(), strict=True)):
                n_words.append(len((texts[i] or b"").split()))
                found = union_spans([(s["start"], s["end"]) for s in spans or ()])
                if found:
                    texts[i] = cut_words(texts[i], found)
                removed.append(found)
                n_removed.append(sum(z - a for a, z in found))
                of.append(first or [])
            text = pa.array(texts, pa.binary()).cast(pa.string())
            cols = [text if c == "text" else b.column(c) for c in columns]
            cols += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(of, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, *new.names])

    return joined.join(spans, [did, th], "left").select(*columns, own, of_).mapInArrow(cut, T_.StructType([*docs.schema.fields, *new.fields]))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "removed", "repeats_of", F.crc32("text").alias("kept_crc32"))
