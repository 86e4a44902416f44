"""Benchmark decontamination by a generalised suffix automaton of the test items.

The normalised words of all items build one automaton. Each document's words are streamed through it; at each word the
state and the longest matching length are known. A match of ``window`` words or more is a window of the items that
share the state; an item of fewer words counts as a whole. Words that no item has break every match, so only runs of
known words are walked.

The automaton is sent to all workers: items of at most ``most_words`` words go into one automaton (200,000 words are some 135 MB in a worker; a single
item of more is one automaton too, so items should be far shorter); a larger benchmark
is dealt to as many automata as needed, which the documents pass one after the other, without a shuffle.

Defined cases: null text has no words and no hits; items without words or with null text take no part; repeated items
count each by its id; a null item_id counts as the string of nothing; repeated rows of documents are separate;
columns of any other name pass through, and result columns that clash with input columns replace them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, byte_texts, free_names, table

#: Lower-cases A-Z; all other ASCII but digits and letters becomes a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over words; see the module."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for k, ws in items if ws]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.least = min((min(window, len(ids)) for _, ids in coded), default=window)
        # which items have the window that ends in a state; which whole short items a state's match ends with
        self.items: dict[int, set[str]] = {}
        short: dict[int, dict[int, set[str]]] = {}
        for k, ids in coded:
            n, state = min(window, len(ids)), 0
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i >= n - 1:
                    u = self._ending(state, n)
                    (self.items.setdefault(u, set()) if n == window else short.setdefault(u, {}).setdefault(n, set())).add(k)
        self.at = [self._ending(u, window) if self.len[u] >= window else -1 for u in range(len(self.len))]
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        if short:
            for u in sorted(range(1, len(self.len)), key=self.len.__getitem__):
                own = sorted(short.get(u, {}).items())
                if both := [*self.short.get(self.link[u], []), *own]:
                    self.short[u] = both

    def _ending(self, state: int, n: int) -> int:
        """The state of the last n words of a state's longest string."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, to: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(to)
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string with c behind it, which some item has had."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        own = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = own
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = own
            p = self.link[p]
        return own

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        now, p = self._new(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = now
            p = self.link[p]
        if p >= 0:
            self.link[now] = self._split(p, c)
        return now

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None: none), and by which items."""
        get = self.vocab.get
        ids = [get(w, -1) for w in words]
        known = np.zeros(len(ids) + 2, np.int8)
        known[1:-1] = np.array(ids, np.int64) >= 0
        edge = np.flatnonzero(np.diff(known))
        begins, ends = edge[::2], edge[1::2]
        long = ends - begins >= self.least
        hits, found = [], set()
        nxt, link, length, at, short, window = self.next, self.link, self.len, self.at, self.short, self.window
        for a, z in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            v = n = 0
            for i in range(a, z):
                c = ids[i]
                while c not in nxt[v] and v:
                    v = link[v]
                    n = length[v]
                if c in nxt[v]:
                    v = nxt[v][c]
                    n += 1
                    if n >= window:
                        hits.append((i - window + 1, i + 1))
                        found.add(at[v])
                    if v in short:
                        for k, names in short[v]:
                            if k <= n:
                                hits.append((i - k + 1, i + 1))
                                found.update((("", x) for x in names))
        if not hits:
            return None, set()
        step = np.zeros(len(words) + 1, np.int32)
        h = np.array(hits)
        np.add.at(step, h[:, 0], 1)
        np.add.at(step, h[:, 1], -1)
        names: set[str] = set()
        for x in found:
            names |= {x[1]} if isinstance(x, tuple) else self.items[x]
        return np.cumsum(step[:-1]) > 0, names


def _automata(items: DataFrame, window: int, most_words: int) -> list[Automaton]:
    """One automaton for each ``most_words`` words of items, as fewer words cross to the driver at a time."""
    text = F.coalesce("text", F.lit(""))
    sized = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text.alias("text"), (F.octet_length(text) / 2 + 1).alias("most"))
    n = max(1, -(-int(sized.agg(F.sum("most")).first()[0] or 0) // most_words))
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield Automaton([(r.item_id, words_of(r.text.encode())) for r in sized.filter(deal == k).select("item_id", "text").collect()], window)


def scan(docs: DataFrame, items: DataFrame, window: int = 8, most_words: int = 200_000) -> DataFrame:
    """docs and n_words, n_hit (long), hit_items (sorted array of strings), hit_bits (binary, a bit for each word; null: none)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    new = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_bits", T.BinaryType())])
    df = docs.drop(*new.names)
    for k, automaton in enumerate(_automata(items, window, most_words)):
        sent = spark.sparkContext.broadcast(automaton)

        def look(batches: Iterator[pa.RecordBatch], sent=sent, first=k == 0) -> Iterator[pa.RecordBatch]:
            found = sent.value
            for b in batches:
                rows = []
                before = [None] * b.num_rows if first else b.select(["hit_items", "hit_bits"]).to_pylist()
                for text, old in zip(byte_texts(b), before, strict=True):
                    words = words_of(text)
                    hit, names = found.scan(words) if words else (None, set())
                    if old and old["hit_bits"] is not None:
                        was = np.unpackbits(np.frombuffer(old["hit_bits"], np.uint8), count=len(words)).astype(bool)
                        hit, names = was if hit is None else was | hit, names | set(old["hit_items"])
                    rows.append((len(words), 0 if hit is None else int(hit.sum()), sorted(names), None if hit is None else np.packbits(hit).tobytes()))
                n, h, i, bits = zip(*rows, strict=True) if rows else ([], [], [], [])
                kept = [c for c in b.schema.names if c not in new.names]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(i, pa.list_(pa.string())), pa.array(bits, pa.binary())], names=[*kept, *new.names])

        df = df.mapInArrow(look, T.StructType([*docs.drop(*new.names).schema.fields, *new.fields]))
    return df


def cut_spans(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its runs of hit words."""
    places = [m.span() for m in _WORD.finditer(text.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, at = [], 0
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(text[at : places[a][0]])
        at = places[z - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, min_span: int = 8, max_coverage: float = 0.5, most_words: int = 200_000) -> DataFrame:
    """docs without what test items share with them: all hit spans leave the text, those of whole short items whatever their length; documents with more than ``max_coverage`` of their words hit go.

    ``min_span`` counts as ``window`` at most, so every run of windows has it, and shorter runs are short items: no hit stays.
    """
    columns, schema = docs.columns, docs.schema
    clash = [c for c in columns if c in ("n_words", "n_hit", "hit_items", "hit_bits")]
    other = dict(zip(clash, free_names(docs, *(f"__{c}" for c in clash)), strict=True))
    found = scan(docs.withColumnsRenamed(other), items, window, most_words).filter(F.col("n_hit") <= max_coverage * F.col("n_words"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_texts(b)
            for i, bits in enumerate(b.column("hit_bits").to_pylist()):
                if bits is not None:
                    n = b.column("n_words")[i].as_py()
                    texts[i] = cut_spans(texts[i], np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool))
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else b.column(other.get(c, c)) for c in columns], names=columns)

    return found.mapInArrow(cut, schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n = F.size("hit_items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


OP3_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(8, len(w)) as n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(generate_series(1, len(w) - least(8, len(w)) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d cross join sizes where len(w) >= n)),
m as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from m) group by doc_id),
k as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as s from (select distinct doc_id, item_id from m) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(k.n_items, 0) as n_items,
  coalesce(k.s, sha256('')) as items_sha256, coalesce(k.n_items, 0) >= 2 as contaminated
from d left join h using (doc_id) left join k using (doc_id)
"""
