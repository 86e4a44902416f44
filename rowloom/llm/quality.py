"""Quality rules, and line labelling by a linear-chain conditional random field.

Counts over a whole text give the base rules. The lines of a text that passes them are labelled content or boilerplate
by Viterbi decoding of a two-state chain whose emissions are linear in features of a line; the text is kept if the
words in content lines are at least ``least_content`` of its words.

The field's weights maximise the likelihood of lines of a bounded sample of rated documents (``train_docs`` of each
rating, those whose ids hash lowest, whole texts): lines of well rated documents are content, those of badly rated ones
boilerplate. As ratings are of whole documents, half of the chains are spliced: runs of lines of the other kind are put into
a document, so labels change inside of chains and the field learns what a change costs. Gradients come from forward-backward sums in numpy.

Defined cases: null or empty text has no words and fails the base rules; text without line ends is one line; ratings
that are null or of unknown documents are not used; a document rated twice counts by its lower rating; without
ratings of both kinds, the base rules alone decide; repeated rows each get their row; null doc_ids are rows like others; very long
texts are one chain (13 numbers and a label for each line); a table without rows gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, byte_texts, table

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_MARKS = bytes(c for c in range(256) if chr(c) not in "!?;:()[]{}\"'_-=+~^/\\@")
_NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_CONT = bytes(range(128)) + bytes(range(192, 256))  # all but UTF-8's continuation bytes
FEATURES = 13


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words inside n-word windows that the text has twice or more."""
    if len(words) < n + 1:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    base = len(codes)
    m = len(ids) - n + 1
    if base**n < 1 << 62:
        key = np.zeros(m, np.int64)
        for k in range(n):
            key = key * base + ids[k : k + m]
    else:  # exact ranks, one word at a time
        key = ids[:m]
        for k in range(1, n):
            _, key = np.unique(key * base + ids[k : k + m], return_inverse=True)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(ids) + 1, np.int64)
    step[:m] += twice
    step[n:] -= twice
    return int((np.cumsum(step[:-1]) > 0).sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or b""
    words = t.split()
    points = len(t) - len(t.translate(None, _CONT))
    chars = points - (len(t) - len(t.translate(None, SPACES)))
    symbols = len(t) - len(t.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in t.split(b"\n"):
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """[line, feature] and the number of words, for each line with a word."""
    rows, sizes = [], []
    seen: set[bytes] = set()
    past: set[bytes] = set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        count = lambda others: len(line.translate(None, others))  # noqa: E731, B023
        distinct = set(words)
        end = line.rstrip()[-1:]
        rows.append(
            (
                1.0,
                min(n, 60) / 30,
                n < 4,
                size / n / 8,
                count(_NOT_UPPER) / size * 3,
                (size - count(SYMBOLS)) / size * 10,
                count(_NOT_MARKS) / size * 10,
                count(_NOT_DIGITS) / size * 5,
                end in b".!?" and end != b"",
                line in seen,
                len(distinct & past) / len(distinct),
                len(distinct) / n,
                len(line.translate(None, _NOT_LETTERS)) / size,
            )
        )
        seen.add(line)
        past |= distinct
        sizes.append(n)
    return np.minimum(np.array(rows, np.float64).reshape(-1, FEATURES), 4), np.array(sizes, np.int64)


@dataclass
class LineCRF:
    """States 0 (boilerplate) and 1 (content)."""

    emit: np.ndarray  # [feature, state]
    step: np.ndarray  # [state, state]

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best labels of the whole sequence; content on a tie."""
        e, (s00, s01), (s10, s11) = (x @ self.emit).tolist(), *self.step.tolist()
        a, b = e[0]
        back = []
        for ea, eb in e[1:]:
            a0, b0, a1, b1 = a + s00, b + s10, a + s01, b + s11
            back.append((b0 >= a0, b1 >= a1))
            a, b = max(a0, b0) + ea, max(a1, b1) + eb
        at = b >= a
        out = [at]
        for pointers in reversed(back):
            at = pointers[at]
            out.append(at)
        return np.array(out[::-1], bool)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the labels y and its gradients, by forward-backward."""
        e = x @ self.emit
        n = len(x)
        f, b = np.empty((n, 2)), np.zeros((n, 2))
        f[0] = e[0]
        for t in range(1, n):
            f[t] = np.logaddexp(f[t - 1][0] + self.step[0], f[t - 1][1] + self.step[1]) + e[t]
        for t in range(n - 2, -1, -1):
            nxt = e[t + 1] + b[t + 1]
            b[t] = np.logaddexp(self.step[:, 0] + nxt[0], self.step[:, 1] + nxt[1])
        z = np.logaddexp(*f[-1])
        p = np.exp(f + b - z)
        own = np.eye(2)[y]
        g_emit = x.T @ (own - p)
        g_step = np.zeros((2, 2))
        if n > 1:
            pair = np.exp(f[:-1, :, None] + self.step[None] + (e + b)[1:, None, :] - z)
            np.add.at(g_step, (y[:-1], y[1:]), 1)
            g_step -= pair.sum(0)
        score = float(e[np.arange(n), y].sum() + self.step[y[:-1], y[1:]].sum() - z)
        return score, g_emit, g_step


def spliced(x: np.ndarray, y: int, others: list[np.ndarray], r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A chain of lines of one kind with one or two runs of lines of the other kind put in, and the labels."""
    labels = np.full(len(x), y)
    for _ in range(r.integers(1, 3)):
        z = others[r.integers(len(others))]
        n = int(r.integers(1, min(len(z), 8) + 1))
        first, at = int(r.integers(len(z) - n + 1)), int(r.integers(len(x) + 1))
        x = np.concatenate([x[:at], z[first : first + n], x[at:]])
        labels = np.concatenate([labels[:at], np.full(n, 1 - y), labels[at:]])
    return x, labels


def fit(docs: list[tuple[np.ndarray, int]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-3, most_lines: int = 64, seed: int = 0) -> LineCRF:
    """docs: features of a document's lines, and 1 for content. Long documents are cut to chains of ``most_lines`` lines, of which half are spliced; each chain's gradient is a mean over its lines."""
    crf = LineCRF(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    chains = [(x[i : i + most_lines], y) for x, y in docs for i in range(0, len(x), most_lines)]
    kinds = [[x for x, y in chains if y == k] for k in (0, 1)]
    r, se, ss = np.random.default_rng(seed), np.full((FEATURES, 2), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(epochs):
        for i in r.permutation(len(chains)):
            x, y = chains[i]
            labels = np.full(len(x), y)
            if kinds[1 - y] and r.random() < 0.5:
                x, labels = spliced(x, y, kinds[1 - y], r)
            _, ge, gs = crf.gradient(x, labels)
            ge, gs = ge / len(x) - decay * crf.emit, gs / len(x) - decay * crf.step
            se, ss = se + ge * ge, ss + gs * gs
            crf.emit = crf.emit + rate * ge / np.sqrt(se)
            crf.step = crf.step + rate * gs / np.sqrt(ss)
    return crf


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = 150) -> LineCRF | None:
    """A field from docs (doc_id, text) and labels (doc_id, quality); None without ratings of both kinds."""
    rated = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = None
    for q in (0, 1):  # bounded: 2 * train_docs ids
        part = rated.filter((F.col("quality") > 0) == bool(q)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        chosen = part if chosen is None else chosen.union(part)
    features = docs.filter("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("quality") > 0).cast("int").alias("quality"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [line_features(t)[0].astype(np.float32).tobytes() for t in byte_texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(found, pa.binary())], names=["doc_id", "quality", "x"])

    rows = sorted(features.mapInArrow(lines, "doc_id long, quality int, x binary").collect(), key=lambda r: (r.doc_id, r.quality, bytes(r.x)))
    data = [(np.frombuffer(bytes(r.x), np.float32).reshape(-1, FEATURES).astype(np.float64), r.quality) for r in rows if len(r.x)]
    return fit(data) if len({y for _, y in data}) == 2 else None


def judge(docs: DataFrame, crf: LineCRF | None, least_content: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, content_words, line_labels (array of booleans, for lines with a word)."""
    bounded_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in byte_texts(b):
                counts = base_counts(text)
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                content, labels = counts[0], None
                if not failed and crf is not None:
                    x, sizes = line_features(text)
                    is_content = crf.viterbi(x)
                    content, labels = int(sizes[is_content].sum()), is_content.tolist()
                rows.append((*counts, failed, not failed and content >= least_content * counts[0], 0 if failed else content, labels))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.bool_())]
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names, "base_failed", "kept", "content_words", "line_labels"])

    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, content_words long, line_labels array<boolean>")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels"))).withColumn("n_boilerplate_lines", F.coalesce(F.size(F.filter("line_labels", lambda x: ~x)), F.lit(0)).cast("long")).drop("line_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules of the same operator, without a field: what SQL can express of it."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), None).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, line, count(*) - 1 as more from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id, line),
x as (select doc_id, i, array_to_string(w[i : i + 4], ' ') as win from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from d where len(w) > 5)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from x) where n > 1),
h as (select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(i, i + 4)) as p from r) group by doc_id),
k as (select doc_id, sum(more) as n from l group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(coalesce(k.n, 0) as bigint) as n_dup_lines, cast(coalesce(h.n, 0) as bigint) as n_repeat_words,
  len(w) < 10 or 100 * coalesce(h.n, 0) > 20 * len(w) as base_failed
from d left join h using (doc_id) left join k using (doc_id)
"""
