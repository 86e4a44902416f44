"""SentencePiece encoding and decoding by a relational lattice.

Texts are written with the blank sign U+2581 for blanks and one before the text, and cut into words that no piece
crosses: a run of blank signs with what follows, or a line end. The distinct words of the corpus are exploded to
substrings of at most the longest piece, which are joined to the piece table by equality; matches are the edges of
the word's lattice. Edges are grouped by word and a higher-order aggregate folds them in order of their ends to the
best path (Viterbi): the highest sum of scores; of equal sums, the one whose last piece starts first. A character
without a piece is an edge of its UTF-8 bytes' pieces, with a score below every piece's.

Words are first cut where no piece has the two characters beside each other, which every path must respect. The fold
keeps one edge for each end and reads the path once, from the last end on; words of more than ``SHORT`` characters are
cut to blocks before they are exploded and folded in chunks, so cost and memory grow with a word's length, not its square.

Words come back to documents in two ways that together are exact: the most frequent words and their ids, ``head_bytes`` of them, are
sent to all workers (found by 64-bit hash); where the corpus has more, each document's other words are joined to the encoded words and
meet their document again by its key. Decoding looks ids up in the piece table.

Defined cases: null or empty text has no ids, and decodes to empty text; a U+2581 in a text reads back as a blank
(as in the format itself); a word of up to 2^24 characters is one lattice, of some 40 bytes of memory for each edge; repeated rows are encoded each; null doc_ids
are ids like others; a table without rows gives none; other columns pass through, but for one of the result's name, which is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_names, held_conf, kept_by_worker, release_memory, store, table

BLANK = "▁"
_WORDS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


@dataclass
class Pieces:
    """A piece table: text and score by id; which ids are bytes; which can't be produced from text."""

    text: list[str]
    score: list[float]
    byte_ids: dict[int, int]
    control: set[int]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(p.get_piece_size())
        text = [p.id_to_piece(i) for i in n]
        out = cls(text, [p.get_score(i) for i in n], {int(text[i][3:5], 16): i for i in n if p.is_byte(i)}, {i for i in n if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)})
        for i in out.plain():
            if BLANK in text[i].lstrip(BLANK) or "\n" in text[i]:
                raise ValueError(f"piece {i} crosses words; the lattice needs pieces inside of words")
        return out

    def plain(self) -> list[int]:
        bytes_ = set(self.byte_ids.values())
        return [i for i in range(len(self.text)) if i not in bytes_ and i not in self.control]

    def bytes_of(self) -> list[bytes]:
        """What each id stands for, in UTF-8."""
        own = {i: bytes([b]) for b, i in self.byte_ids.items()}
        return [own.get(i, b"" if i in self.control else t.replace(BLANK, " ").encode()) for i, t in enumerate(self.text)]


def words_of(text: str) -> list[str]:
    """The words of a text; joined, they are the text as the pieces see it."""
    return _WORDS.findall(BLANK + text.replace(" ", BLANK)) if text else []


#: Texts in which each blank and line end stands alone between words need no pattern to be cut.
_NOT_SIMPLE = f"^[ \n]|[ \n]$|[ \n][ \n]|{BLANK}"


def split_words(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The distinct words of a batch, which of them follow each other, and where each text's begin and end."""
    pa.default_memory_pool().release_unused()  # of the batch before
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    simple = pc.and_(pc.invert(pc.match_substring_regex(texts, _NOT_SIMPLE)), pc.not_equal(texts, ""))
    some = texts.filter(simple)
    marked = pc.replace_substring(pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (BLANK, some, ""))), " ", " " + BLANK)
    split = pc.split_pattern(pc.replace_substring(marked, "\n", " \n "), " ")
    if len(some) < len(texts):
        is_simple = simple.to_numpy(zero_copy_only=False)
        other = pa.array([words_of(t) for t in texts.filter(pc.invert(simple)).to_pylist()], pa.list_(pa.large_string())).cast(split.type)
        place = np.where(is_simple, np.cumsum(is_simple) - 1, len(some) + np.cumsum(~is_simple) - 1)
        split = pa.concat_arrays([split, other]).take(pa.array(place))
    coded = split.flatten().dictionary_encode()
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    return coded.dictionary, coded.indices, bounds


class Cutter:
    """Cuts words where no piece has the two characters beside each other: every path ends there."""

    def __init__(self, pieces: Pieces):
        inside = {t[i : i + 2] for k in pieces.plain() for t in [pieces.text[k]] for i in range(len(t) - 1)}
        chars = sorted({c for p in inside for c in p})
        self.number = np.zeros(0x110000, np.uint16)  # 0: in no pair
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        at = {c: i for i, c in enumerate(chars, 1)}
        for a, z in inside:
            self.joins[at[a], at[z]] = True

    def __call__(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct parts of the words, all words' parts one after the other as places among these, and how many each word has."""
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = memoryview(words.buffers()[2] or b"")[at[0] : at[-1]].tobytes()
        code = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        n = self.number[code]
        begins = np.zeros(len(code) + 1, bool)
        if len(code):
            begins[1:-1] = ~self.joins[n[:-1], n[1:]]
        first = np.concatenate([[0], np.cumsum(sizes)])
        begins[first] = True
        if len(code):
            begins[-1] = False
        cuts = np.flatnonzero(begins)
        width = np.concatenate([[0], np.cumsum(1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF))])
        offsets = width[np.append(cuts, len(code))]
        parts = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)).dictionary_encode()
        counts = np.diff(np.searchsorted(cuts, first))
        return parts.dictionary, parts.indices.to_numpy(), counts


def corpus_words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """word, n: the distinct cut words of all texts and how often they occur. Batches are counted where they are read."""
    cut = Cutter(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("pieces", dict)
        for b in batches:
            words, which, _ = split_words(b.column("text"))
            parts, codes, sizes = cut(words)
            seen = np.repeat(np.bincount(which.to_numpy(), minlength=len(words)), sizes)
            n = np.bincount(codes, seen, len(parts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([parts.cast(pa.string()), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """piece, id, score: bounded by the model. An Arrow table needs no Python workers, which rows would."""
    plain = pieces.plain()
    columns = [pa.array([pieces.text[i] for i in plain], pa.string()), pa.array(plain, pa.int32()), pa.array([pieces.score[i] for i in plain], pa.float64())]
    return spark.createDataFrame(pa.table(columns, names=["piece", "id", "score"]))


#: An edge is packed as end, 255 - size and id in 24, 8 and 31 bits; the id of a character without a piece is _UNKNOWN and its code point until the path is known.
_UNKNOWN = 1 << 30
#: Words of up to so many characters are folded at once; longer ones are exploded by blocks and folded by chunks of so many edges.
SHORT, BLOCK, CHUNK = 64, 256, 512


def _end(e: Column) -> Column:
    return F.shiftright(e, 39).cast("int")


def _size(e: Column) -> Column:
    return 255 - F.shiftright(e, 31).bitwiseAND(F.lit(255)).cast("int")


def _id(e: Column) -> Column:
    return e.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def viterbi(edges: Column, score_of) -> Column:
    """The ids of the best path through sorted edges that reach every end, for a short word. ``score_of``: an id's score.

    The fold's state has, for each end in turn, the best score and its ids.
    """
    state = F.array(F.struct(F.lit(0.0).alias("score"), F.expr("cast(array() as array<int>)").alias("ids")))

    def step(acc: Column, e: Column) -> Column:
        n = F.size(acc)
        before = F.get(acc, _end(e) - _size(e))
        score = before["score"] + score_of(_id(e))
        new = F.array(F.struct(score.alias("score"), F.array_append(before["ids"], _id(e)).alias("ids")))
        return F.when(_end(e) == n, F.concat(acc, new)).when(score > F.get(acc, n - 1)["score"], F.concat(F.slice(acc, 1, n - 1), new)).otherwise(acc)

    return F.element_at(F.aggregate(edges, state, step), -1)["ids"]


def long_viterbi(edges: Column, size: Column, score_of, longest: int) -> Column:
    """The same for a word of any ``size``; ``longest``: the longest piece's characters.

    The first fold has the scores of the last ``longest`` ends and appends the best edge of each end to the open chunk;
    the second walks these edges back from the last end. Arrays that grow are closed after each chunk.
    """
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")

    def relax(s: Column, e: Column) -> Column:
        fresh = _end(e) != s["end"]
        kept = F.slice(s["scores"], F.greatest(F.lit(1), F.size(s["scores"]) - (longest - 2)), F.lit(longest - 1))
        scores = F.when(fresh, F.concat(kept, F.array(s["score"]))).otherwise(s["scores"])
        score = F.element_at(scores, -_size(e)) + score_of(_id(e))
        better = fresh | (score > s["score"])
        return F.struct(
            _end(e).alias("end"),
            F.when(better, score).otherwise(s["score"]).alias("score"),
            F.when(better, e).otherwise(s["edge"]).alias("edge"),
            scores.alias("scores"),
            F.when(fresh & (s["end"] > 0), F.concat(s["open"], F.array(s["edge"]))).otherwise(s["open"]).alias("open"),
        )

    def chunk(s: Column, i: Column) -> Column:
        now = s["now"]
        begin = F.struct(*(now[c].alias(c) for c in ("end", "score", "edge", "scores")), none("bigint").alias("open"))
        return F.struct(F.aggregate(F.slice(edges, i * CHUNK + 1, F.lit(CHUNK)), begin, relax).alias("now"), F.concat(s["done"], F.array(now["open"])).alias("done"))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("edge"), none("double").alias("scores"), none("bigint").alias("open"))
    state = F.struct(zero.alias("now"), none("array<bigint>").alias("done"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / CHUNK).cast("int"))
    best = F.aggregate(chunks, state, chunk, lambda s: F.concat(s["done"], F.array(F.concat(s["now"]["open"], F.array(s["now"]["edge"])))))

    def back(s: Column, e: Column) -> Column:
        on = _end(e) == s["want"]
        return F.struct(F.when(on, s["want"] - _size(e)).otherwise(s["want"]).alias("want"), F.when(on, F.concat(s["open"], F.array(_id(e)))).otherwise(s["open"]).alias("open"))

    def back_chunk(s: Column, es: Column) -> Column:
        begin = F.struct(s["now"]["want"].alias("want"), none("int").alias("open"))
        return F.struct(F.aggregate(F.reverse(es), begin, back).alias("now"), F.concat(s["done"], F.array(s["now"]["open"])).alias("done"))

    state = F.struct(F.struct(size.alias("want"), none("int").alias("open")).alias("now"), none("array<int>").alias("done"))
    return F.aggregate(F.reverse(best), state, back_chunk, lambda s: F.reverse(F.flatten(F.concat(s["done"], F.array(s["now"]["open"])))))


def encode_words(words: DataFrame, pieces: Pieces, words_per_task: int = 5_000) -> DataFrame:
    """words (word, n; distinct and stored) with ids: array<int>.

    The words are dealt to tasks once, by hash; explosion, join with the broadcast piece table and grouping stay inside of them.
    Edges carry the word's 64-bit hash and 32-bit checksum, the word itself only the first one.
    """
    spark = words.sparkSession
    n_tasks = max(1, -(-words.count() // words_per_task))
    plain = pieces.plain()
    longest = max(len(pieces.text[i]) for i in plain)
    worst = min(pieces.score[i] for i in plain if pieces.score[i] > -1e8) - 10.0
    table_ = F.broadcast(piece_table(spark, pieces).select(F.xxhash64("piece").alias("known_h"), F.col("piece").alias("known"), "id"))
    key = ["h", "c"]
    dealt = words.select(F.xxhash64("word").alias("h"), F.crc32("word").alias("c"), "word", "n", F.length("word").alias("size")).repartition(n_tasks, "h")
    blocks = dealt.select(*key, "n", "size", "word", F.explode(F.expr(f"sequence(0, size - 1, {BLOCK})")).alias("from"))
    blocks = blocks.select(*key, "n", "size", "from", F.expr(f"substring(word, from + 1, {BLOCK + longest - 1})").alias("part"), F.expr("if(from = 0, word, null)").alias("word"))
    starts = blocks.select("*", F.explode(F.expr(f"sequence(0, least({BLOCK}, size - from) - 1)")).alias("i"))
    starts = starts.select(*key, "n", (F.col("from") + F.col("i")).alias("start"), F.expr(f"substring(part, i + 1, {longest})").alias("part"), F.expr("if(i = 0, word, null)").alias("word"))
    subs = starts.select("*", F.explode(F.expr("sequence(1, length(part))")).alias("len"))
    subs = subs.select(*key, "n", "start", "len", F.expr("substring(part, 1, len)").alias("piece"), F.expr("if(len = 1, word, null)").alias("word")).withColumn("piece_h", F.xxhash64("piece"))
    hits = subs.join(table_, (subs["piece_h"] == table_["known_h"]) & (subs["piece"] == table_["known"]), "left").filter("id is not null or len = 1")
    code = F.coalesce("id", F.ascii("piece") + _UNKNOWN).cast("long")
    edge = F.shiftleft((F.col("start") + F.col("len")).cast("long"), 39).bitwiseOR(F.shiftleft((255 - F.col("len")).cast("long"), 31)).bitwiseOR(code)
    scores = F.lit(np.array(pieces.score, np.float64))
    score_of = lambda k: F.when(k < _UNKNOWN, F.get(scores, k)).otherwise(F.lit(worst))
    lattices = hits.groupBy(*key).agg(F.max("word").alias("word"), F.max("n").alias("n"), F.sort_array(F.collect_list(edge)).alias("edges")).withColumn("size", F.length("word"))
    path = F.when(F.col("size") <= SHORT, viterbi(F.col("edges"), score_of)).otherwise(long_viterbi(F.col("edges"), F.col("size"), score_of, longest))
    paths = lattices.select("word", "n", path.alias("ids"))
    byte_ids = F.array(*(F.lit(pieces.byte_ids.get(b, 0)) for b in range(256)))
    spelt = F.flatten(F.transform("ids", lambda k: F.when(k < _UNKNOWN, F.array(k)).otherwise(F.transform(_utf8(k - _UNKNOWN), lambda b: F.element_at(byte_ids, b + 1)))))
    return paths.select("word", "n", F.when(F.exists("ids", lambda k: k >= _UNKNOWN), spelt).otherwise(F.col("ids")).alias("ids"))


def _utf8(c: Column) -> Column:
    """The bytes of a code point."""
    tail = lambda shift: F.shiftright(c, shift).bitwiseAND(F.lit(63)) + 128
    return (
        F.when(c < 0x80, F.array(c))
        .when(c < 0x800, F.array(F.shiftright(c, 6) + 0xC0, tail(0)))
        .when(c < 0x10000, F.array(F.shiftright(c, 12) + 0xE0, tail(6), tail(0)))
        .otherwise(F.array(F.shiftright(c, 18) + 0xF0, tail(12), tail(6), tail(0)))
    )


@dataclass
class Head:
    """Words by hash, with their ids end to end: 12 bytes for a word, and its ids."""

    hashes: np.ndarray
    begins: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, words: DataFrame, dtype) -> Head:
        """words: word, ids. Tasks pack their rows, and the driver frees what it has sorted, so that it holds some twice the table at most."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column("ids")
                data = (b.column("h").to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(dtype))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in data], names=["h", "n", "ids"])

        held = [bytearray(), bytearray(), bytearray()]
        for row in words.select(F.xxhash64("word").alias("h"), "ids").coalesce(16).mapInArrow(pack, "h binary, n binary, ids binary").toLocalIterator():
            for part, data in zip(held, row, strict=True):
                part += data
        hashes, n, ids = np.frombuffer(held.pop(0), "<u8"), np.frombuffer(held[0], "<i4"), np.frombuffer(held[1], dtype)
        order = np.argsort(hashes, kind="stable").astype(np.int32)
        hashes = hashes[order]
        begins, out, at = np.cumsum(n, dtype=np.int32) - n, np.empty(len(ids), dtype), 0
        bounds = np.zeros(len(order) + 1, np.int32)
        np.cumsum(n[order], out=bounds[1:])
        for k in range(0, len(order), 1 << 16):
            some = order[k : k + (1 << 16)]
            m = n[some].astype(np.int64)
            own = np.cumsum(m) - m
            size = int(m.sum())
            out[at : at + size] = ids[np.arange(size) + np.repeat(begins[some] - own, m)]
            at += size
        return cls(hashes, bounds, out)

    def find(self, words: pa.Array) -> np.ndarray:
        """Each word's place, or -1."""
        texts = words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in texts), np.uint64, len(words))
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def head_of(words: DataFrame, width: int, head_bytes: int) -> tuple[DataFrame, bool]:
    """The most frequent of words (word, n, ids) that take ``head_bytes`` together, and whether these are all. Sizes are summed by frequency, some 16 steps for each doubling."""
    step = F.floor(16 * F.log2("n")).cast("int")
    sizes = words.groupBy(step.alias("step")).agg(F.sum(12 + width * F.size("ids")).alias("bytes")).orderBy(F.desc("step")).collect()  # 1,100 rows at most
    total = np.cumsum([r.bytes for r in sizes])
    fits = int((total <= head_bytes).sum())
    if fits == len(sizes):
        return words, True
    return words.filter(step >= sizes[fits - 1].step if fits else F.lit(False)), False


def encode(docs: DataFrame, pieces: Pieces, head_bytes: int = 64 << 20, column: str = "ids", finish=None, finish_schema: str | None = None) -> DataFrame:
    """docs (doc_id, text and others) with the ids of text as array<int>. ``head_bytes``: the size of the table of most frequent words that all workers get.

    ``finish`` turns each encoded batch into another of ``finish_schema`` in the same worker.
    """
    spark = docs.sparkSession
    bounded_batches(spark)  # a worker takes some 40 bytes for each byte of a batch's texts
    docs = docs.drop(column)
    columns, cut = docs.columns, Cutter(pieces)
    did, th, met_words = free_names(docs, "__did", "__th", "__tail")
    counts = store(corpus_words(docs, pieces), "counts")
    per_task = 5_000
    with held_conf(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(10 * per_task)):  # grouping inside a task needs no sort
        words = store(encode_words(counts, pieces, per_task), "words")
    dtype = np.uint16 if len(pieces.text) <= 1 << 16 else np.int32
    top, whole = head_of(words, np.dtype(dtype).itemsize, head_bytes)
    sent = spark.sparkContext.broadcast(Head.of(top, dtype))
    release_memory()  # the driver keeps no copy

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each document that the head does not have."""
        for b in batches:
            words, which, bounds = split_words(b.column("text"))
            parts, codes, sizes = cut(words)
            lost = sent.value.find(parts)[codes] < 0
            per_word = np.bincount(np.repeat(np.arange(len(words)), sizes)[lost], minlength=len(words))
            begins, lost = np.concatenate([[0], np.cumsum(per_word)]), codes[lost]
            which = which.to_numpy()
            n = per_word[which]
            own = np.concatenate([[0], np.cumsum(n)])
            part = lost[np.arange(own[-1]) + np.repeat(begins[which] - own[:-1], n)]
            owner = np.repeat(np.repeat(np.arange(b.num_rows), np.diff(bounds)), n)
            owner, part = np.divmod(np.unique(owner * max(1, len(parts)) + part), max(1, len(parts)))
            if len(part):
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([b.column(did).take(at), b.column(th).take(at), parts.take(pa.array(part)).cast(pa.string())], names=[did, th, "word"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("pieces", dict)
        known = sent.value
        for b in batches:
            words, which, bounds = split_words(b.column("text"))
            parts, codes, sizes = cut(words)
            place = known.find(parts)
            begins, ends = known.begins[place].astype(np.int64), known.begins[place + 1].astype(np.int64)
            ids = known.ids
            if (place < 0).any():  # these came with their documents
                tail = {x["word"]: x["ids"] for t in b.column(met_words).to_pylist() for x in t or ()}
                extra = [tail[parts[k].as_py()] for k in np.flatnonzero(place < 0).tolist()]
                at = len(ids) + np.cumsum([0, *map(len, extra)])
                ids = np.concatenate([ids, *(np.array(x, dtype) for x in extra)])
                begins[place < 0], ends[place < 0] = at[:-1], at[1:]
            n = ends - begins
            own = np.concatenate([[0], np.cumsum(n)])
            flat = pa.array(ids[np.arange(own[-1]) + np.repeat(begins - own[:-1], n)])  # the batch's parts end to end
            per_part = pa.LargeListArray.from_arrays(pa.array(own), flat).take(pa.array(codes)).flatten()
            word_ends = np.concatenate([[0], np.cumsum(n[codes])])[np.concatenate([[0], np.cumsum(sizes)])]
            lists = pa.LargeListArray.from_arrays(pa.array(word_ends), per_part)
            ends = np.concatenate([[0], np.cumsum(np.diff(word_ends)[which.to_numpy()])])[bounds]
            out = lists.take(which).flatten().cast(pa.int32())
            made = pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), out)], names=[*columns, column])
            yield finish(made) if finish else made

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])
    schema = finish_schema or schema
    if whole:
        return docs.mapInArrow(write, schema)
    keyed = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), th: F.xxhash64("text")})
    tail = keyed.select(did, th, "text").mapInArrow(rest, f"{did} long, {th} long, word string").distinct()  # repeated rows ask once
    met = tail.join(words.select("word", "ids"), "word").groupBy(did, th).agg(F.collect_list(F.struct("word", "ids")).alias(met_words))
    return keyed.join(met, [did, th], "left").select(*columns, met_words).mapInArrow(write, schema)


def decode_lists(lists: pa.Array, parts: pa.Array) -> pa.Array:
    """The texts of lists of ids; ``parts``: what each id stands for."""
    lists = lists.fill_null([]) if lists.null_count else lists
    spelt = parts.take(lists.flatten())
    at = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    ends = np.frombuffer(spelt.buffers()[1], np.int64)[spelt.offset + at] if len(spelt) else np.zeros(len(at), np.int64)
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), spelt.buffers()[2] or pa.py_buffer(b"")])
    texts = pc.if_else(pc.starts_with(texts, b" "), pc.binary_replace_slice(texts, 0, 1, b""), texts)
    try:
        return texts.cast(pa.large_string())
    except pa.ArrowInvalid:  # ids that no text has
        return pa.array([t.decode(errors="replace") for t in texts.to_pylist()], pa.large_string())


def decode(docs: DataFrame, pieces: Pieces, column: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of the ids; what is no UTF-8 reads as U+FFFD."""
    docs = docs.drop(out)
    columns, parts = docs.columns, pa.array(pieces.bytes_of(), pa.large_binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), decode_lists(b.column(column), parts).cast(pa.string())], names=[*columns, out])

    return docs.mapInArrow(read, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


DIGEST = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decodes boolean"


def digest_of(pieces: Pieces):
    """A function from encoded batches to DIGEST: counts, the checksum of little-endian 32-bit ids, and whether they decode to the text again."""
    parts = pa.array(pieces.bytes_of(), pa.large_binary())
    is_byte = np.zeros(len(pieces.text), np.int64)
    is_byte[list(pieces.byte_ids.values())] = 1

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column("ids")
        ids, at = lists.flatten().to_numpy().astype("<i4"), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64)
        spelt = np.concatenate([[0], np.cumsum(is_byte[ids])])
        cols = [np.diff(at), spelt[at[1:]] - spelt[at[:-1]], [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(at[:-1], at[1:], strict=True)]]
        same = pc.equal(pc.fill_null(b.column("text").cast(pa.large_string()), ""), decode_lists(lists, parts))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols), same], names=[x.split()[0] for x in DIGEST.split(", ")])

    return digest


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = Pieces.load(model_path())
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, finish=digest_of(pieces), finish_schema=DIGEST)
