"""Token-id output: documents to files of concatenated ids with Elias-Fano coded document boundaries.

Documents are range-partitioned by id; each task writes segments, in ascending order. A segment is one row of a
Parquet container (so that Spark's commit protocol guards it and any store can hold it): the ids of its documents end
to end as little-endian 16- or 32-bit integers, and two Elias-Fano sequences: the boundaries between documents, and the document
ids less the first of them. Low bits are packed, high bits in unary, with the place of each 64th one. That takes about
2 + log2(tokens / documents) bits for a boundary; readers ask ``EliasFano.select`` for the offsets they need and make no table of them.

Defined cases: null text is empty (just the end id); null doc_ids come first; rows of one doc_id are ordered by a hash
of their text; a segment ends with the batch that fills it, so a document is never cut; a table without rows gives an empty folder
of files that reads back as no rows; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, kept_by_worker, prefix_offsets, shared_dir, table

SEGMENTS = "part int, seq int, n_docs long, n_tokens long, width int, n_null long, first_id long, doc_ids binary, bounds binary, ids binary"


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    SAMPLE = 64
    HEAD = struct.Struct("<QQB")

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.array(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        k = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (v >> np.uint64(k)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, top, k, low, np.packbits(unary, bitorder="little"), ones[:: cls.SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value; reads a few bytes from the nearest sampled one on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // self.SAMPLE]), i % self.SAMPLE
        byte, bit = divmod(at, 8)
        word = int(self.high[byte]) >> bit << bit
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        low = sum((int(self.low[b >> 3]) >> (b & 7) & 1) << j for j, b in enumerate(range(first, first + self.low_bits)))
        return (place - i) << self.low_bits | low

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        low = (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits) | low

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.top, self.low_bits) + self.low.tobytes() + struct.pack("<Q", len(self.high)) + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, k = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        n_low = (n * k + 7) // 8
        low = np.frombuffer(data, np.uint8, n_low, at)
        (n_high,) = struct.unpack_from("<Q", data, at + n_low)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low + 8)
        return cls(n, top, k, low, high, np.frombuffer(data, "<u4", -1, at + n_low + 8 + n_high))


#: Texts of these characters only are cut beforehand as the tokenizer cuts them: nothing but lower case changes them.
_NOT_PLAIN = r"[^\t\n -~À-ÖØ-öø-ÿ]|<\|"
#: Of these, texts whose only marks are single commas and full stops behind words need no pattern to be cut.
_NOT_SIMPLE = r"[^a-zA-ZÀ-ÖØ-öø-ÿ ,.\n]|[.,][^ \n]"
_RUN = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n a-z0-9ß-öø-ÿ]+)[\t\n ]*"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordCoder:
    """Whole texts to ids by the tokenizers library; each distinct word once, where the tokenizer's own settings allow that.

    For that its settings must be those below; texts go whole to any other tokenizer. This one splits at white space before its merges and its normaliser works on characters, so the ids of a
    text are those of its words, split at blanks and line ends, one after the other. Texts of plain characters are
    further lower-cased and cut into the runs of letters, digits and marks that this kind of tokenizer merges in, and the
    runs go to the same merges without the normaliser. Two generations of both are kept: memory is bounded, and
    frequent ones stay.
    """

    def __init__(self, path: str, width: int, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.keep = Tokenizer.from_file(path), np.dtype(f"<u{width}"), keep
        self.words: list[dict[str, bytes]] = [{}, {}]
        self.runs: list[dict[str, bytes]] = [{}, {}]
        self.code = "H" if width == 2 else "I"
        self.merges = None
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        lower = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if lower and len(steps) == 2 and steps[0].get("pattern") == {"Regex": _PATTERN} and steps[1]["type"] == "ByteLevel":
            self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": steps[1], "added_tokens": []}))

    def _ids_of(self, store: list[dict[str, bytes]], tokenizer, asked: list[str]) -> list[bytes]:
        """The bytes of the ids of each of these distinct words."""
        if len(store[0]) > self.keep:
            store[:] = [{}, store[0]]
        new, old = store
        out = list(map(new.get, asked))
        missed = [i for i, ids in enumerate(out) if ids is None]
        for i in missed:
            if (known := old.get(asked[i])) is not None:
                new[asked[i]] = known
        fresh = [asked[i] for i in missed if asked[i] not in new]
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            if tokenizer is self.merges:  # one call, as no run meets its neighbours
                e = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                ids = array(self.code, e.ids).tobytes()
                bounds = (np.searchsorted(np.array(e.word_ids), np.arange(len(part) + 1)) * self.dtype.itemsize).tolist()
                new.update(zip(part, (ids[a:z] for a, z in itertools.pairwise(bounds)), strict=True))
                continue
            for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                new[w] = array(self.code, e.ids).tobytes()
        for i in missed:
            out[i] = new[asked[i]]
        return out

    def _coded(self, texts: pa.Array, store, tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Texts whose words a blank separates: all ids end to end, and where each text ends."""
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        data = self._ids_of(store, tokenizer, coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, data), np.int32, len(data)) // self.dtype.itemsize
        known = pa.array(np.frombuffer(b"".join(data), self.dtype))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), known)
        ends = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()], dtype=np.int64)])
        return lists.take(coded.indices).flatten().to_numpy(), ends[split.offsets.to_numpy()]

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and each text's number of ids; with ``end`` behind each text, where given."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.merges:
            parts = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return self._ended(np.concatenate([np.empty(0, self.dtype), *parts]), np.cumsum([0, *map(len, parts)]), end)
        kind = np.full(len(texts), 2)
        for k, pattern in ((1, _NOT_PLAIN), (0, _NOT_SIMPLE)):
            kind[~pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)] = k
        parts: list[np.ndarray | None] = [None] * len(texts)
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            some = texts.take(pa.array(at))
            if k == 2:
                ids, bounds = self._coded(pc.replace_substring(some, "\n", " "), self.words, self.tokenizer)
            else:
                some = pc.utf8_lower(some)
                if k == 1:
                    some = pc.replace_substring_regex(pc.utf8_ltrim_whitespace(some), _RUN, r"\1 ")
                else:
                    for a, z in ((",", " ,"), (".", " ."), ("\n", " ")):
                        some = pc.replace_substring(some, a, z)
                ids, bounds = self._coded(some, self.runs, self.merges)
            for i, at_ in enumerate(at.tolist()):
                parts[at_] = ids[bounds[i] : bounds[i + 1]]
        ids = np.concatenate([np.empty(0, self.dtype), *parts])
        return self._ended(ids, np.cumsum([0, *map(len, parts)]), end)

    @staticmethod
    def _ended(ids: np.ndarray, bounds: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(bounds)
        return (ids, counts) if end is None else (np.insert(ids, bounds[1:], end), counts + 1)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, segment_tokens: int = 1 << 20) -> None:
    """Encode docs (doc_id, text) and write segments under ``path``. ``tokenizer``: a file that each worker can open."""
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_file(tokenizer).get_vocab_size(), (end_id or 0) + 1)
    width = 2 if top <= 1 << 16 else 4
    spark = docs.sparkSession
    bounded_batches(spark, 6)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_by_worker(("coder", tokenizer, width), lambda: WordCoder(tokenizer, width))
        part, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            bounds = np.cumsum([0, *lengths])
            known = [d for d in doc_ids if d is not None]  # null ones come first
            after = EliasFano.encode([d - known[0] for d in known]).to_bytes()
            row = [part, seq, len(lengths), int(bounds[-1]), width, len(doc_ids) - len(known), known[0] if known else 0, after, EliasFano.encode(bounds).to_bytes(), np.concatenate(held).tobytes()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            ids, counts = coder.encode(b.column("text"), end_id)
            held.append(ids)
            lengths += counts.tolist()
            doc_ids += b.column("doc_id").to_pylist()
            if sum(map(len, held)) >= segment_tokens:
                yield flush()
                seq, held, doc_ids, lengths = seq + 1, [], [], []
        if lengths:
            yield flush()

    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    dealt.select("doc_id", "text").mapInArrow(segments, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(SEGMENTS).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                bounds, doc_ids = EliasFano.from_bytes(row["bounds"]), EliasFano.from_bytes(row["doc_ids"])
                ids, size, none = memoryview(row["ids"]), row["width"], row["n_null"]
                found, at = [], bounds.select(0)
                for i in range(row["n_docs"]):
                    begin, at = at, bounds.select(i + 1)
                    own = np.frombuffer(ids[begin * size : at * size], f"<u{size}").astype("<u4")
                    found.append((None if i < none else row["first_id"] + doc_ids.select(i - none), begin, at - begin, zlib.crc32(own.tobytes())))
                cols = [pa.array([row[k]] * len(found), pa.int32()) for k in ("part", "seq")] + [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    # where a segment starts: sums inside its part, and the parts before (one row for each task that wrote)
    heads = files.select("part", "seq", "n_tokens")
    parts = prefix_offsets(heads.groupBy("part").agg(F.sum("n_tokens").alias("n")), ["part"], ["n"])
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = heads.select("part", "seq", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("b")).join(parts, "part").select("part", "seq", (F.col("b") + F.col("n_before")).alias("base"))
    docs = files.mapInArrow(documents, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{os.urandom(8).hex()}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path)
