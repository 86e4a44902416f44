"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of the whole lower-cased text, blanks, digits and marks included, forwards and backwards, and gives every
position a distribution over the languages. A document's probabilities are the mean over the positions of its letters. Texts are
read as windows of ``CORE`` bytes, all of which count, with ``CONTEXT`` bytes more on either side from which the states come,
so long texts run as many rows beside each other, and a window's result does not depend on what it is batched with.

The network is trained in numpy by backpropagation through time on windows from a bounded sample of labelled rows:
``train_docs`` documents of each language at most (those whose ids hash lowest), ``train_windows`` windows from each, spread over the text.

Defined cases: null text, or text without a letter (Unicode category L), is ``und`` with score 0; repeated rows each get their row; null doc_ids
are rows like others; texts of any length are read whole; languages are counted whatever their number of rows; without any labelled row every document is ``und``
(and ``keep_languages`` keeps those that have a letter); a table without rows gives none; other columns pass through, those of the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, kept_by_worker, release_memory, table

CORE, CONTEXT = 256, 24
_LETTER = regex.compile(r"\p{L}")
_IS_LETTER = np.array([c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])


def windows_of(texts: list[bytes], core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[window, byte] with zeros outside of a text, the text of each window, and how many bytes of its core it has."""
    sizes = np.array([len(t) for t in texts], np.int64)
    many = -(-sizes // core)
    owner = np.repeat(np.arange(len(texts)), many)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    filled = np.minimum(core, sizes[owner] - part * core)
    # all texts end to end, with zeros between them that are wider than the context and a core's empty rest
    gap = core + CONTEXT
    begins = gap + np.cumsum(sizes + gap) - sizes - gap
    flat = np.zeros(int(sizes.sum()) + gap * (len(texts) + 1) + core, np.uint8)
    for t, at in zip(texts, begins.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    first = begins[owner] + part * core - CONTEXT
    return np.lib.stride_tricks.sliding_window_view(flat, core + 2 * CONTEXT)[first], owner, filled


def _sigmoid(x: np.ndarray) -> None:
    """In place."""
    np.negative(x, x)
    np.exp(x, x)
    x += 1
    np.reciprocal(x, x)


@dataclass
class ByteGRU:
    languages: list[str]
    hidden: int = 16
    width: int = 12
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def init(self, seed: int = 0) -> None:
        r, h, d, c = np.random.default_rng(seed), self.hidden, self.width, len(self.languages)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": draw(256, d) * 8, "Wo": draw(2 * h, c), "bo": np.zeros(c, np.float32)}
        for k in "fb":
            self.p |= {f"Wx{k}": draw(d, 3 * h), f"Wh{k}": draw(h, 3 * h), f"b{k}": np.zeros(3 * h, np.float32)}

    def _run(self, k: str, x: np.ndarray, keep: list | None) -> np.ndarray:
        """What one direction adds to the outputs, [place, window, language]; keep: what BPTT needs. Places run from the first or (k = b) the last.

        The gates are arrays of their own, as numpy is fastest on whole ones.
        """
        h_, (wide, rows) = self.hidden, x.shape
        table_ = self.p["E"] @ self.p[f"Wx{k}"] + self.p[f"b{k}"]  # the input's share by byte
        table_[0] = 0  # outside of the text a state of zeros stays so, however many places that are
        gates = [slice(g * h_, (g + 1) * h_) for g in range(3)]
        tz, tr, tn = (np.ascontiguousarray(table_[:, g]) for g in gates)
        wz, wr, wn = (np.ascontiguousarray(self.p[f"Wh{k}"][:, g]) for g in gates)
        wo = self.p["Wo"][slice(0, h_) if k == "f" else slice(h_, 2 * h_)]
        h = np.zeros((rows, h_), table_.dtype)
        out = np.empty((wide, rows, len(self.languages)), table_.dtype)
        for t in range(wide) if k == "f" else range(wide - 1, -1, -1):
            z, r, n = tz.take(x[t], 0), tr.take(x[t], 0), tn.take(x[t], 0)
            for gate, w in ((z, wz), (r, wr)):
                gate += h @ w
                _sigmoid(gate)
            ghn = h @ wn
            n += r * ghn
            np.tanh(n, n)
            now = h - n
            now *= z
            now += n
            if keep is not None:
                keep.append((h, z, r, n, ghn, now))
            h = now
            np.matmul(h, wo, out=out[t])
        return out

    def scores(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The outputs before they are made probabilities, by place, window and language, for bytes [place, window]."""
        kf, kb = ([], []) if keep is not None else (None, None)
        o = self._run("f", x, kf)
        o += self._run("b", x, kb)
        o += self.p["bo"]
        if keep is not None:
            keep |= {"f": kf, "b": kb}
        return o

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients, by backpropagation through time, of the mean cross-entropy over the positions of mask [place, window]; y: the windows' languages."""
        keep: dict = {}
        prob = self.scores(x, keep)
        prob -= prob.max(axis=2, keepdims=True)
        np.exp(prob, prob)
        prob /= prob.sum(axis=2, keepdims=True)
        total = max(1, mask.sum())
        rows = np.arange(x.shape[1])
        loss = float(-(np.log(prob[:, rows, y] + 1e-9) * mask).sum() / total)
        do = prob
        do[:, rows, y] -= 1
        do *= (mask / total)[:, :, None].astype(do.dtype)
        h_, wide = self.hidden, len(x)
        g = {"bo": do.sum((0, 1)), "Wo": np.zeros_like(self.p["Wo"]), "E": np.zeros_like(self.p["E"])}
        for k, half in (("f", slice(0, h_)), ("b", slice(h_, 2 * h_))):
            wo, wh = self.p["Wo"][half], self.p[f"Wh{k}"]
            gx, gwh, carry = np.empty((*x.shape, 3 * h_), wh.dtype), np.zeros_like(wh), np.zeros((x.shape[1], h_), wh.dtype)
            for step in range(wide - 1, -1, -1):  # from the state that was made last
                t = step if k == "f" else wide - 1 - step
                h, z, r, c, ghn, now = keep[k][step]
                g["Wo"][half] += now.T @ do[t]
                d = do[t] @ wo.T + carry
                dn = d * (1 - z) * (1 - c * c)
                dz = d * (h - c) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                gx[t] = np.concatenate([dz, dr, dn], 1)
                gh = np.concatenate([dz, dr, dn * r], 1)
                gwh += h.T @ gh
                carry = d * z + gh @ wh.T
            gx[x == 0] = 0
            flat = gx.reshape(-1, 3 * h_)
            g |= {f"Wh{k}": gwh, f"Wx{k}": self.p["E"][x].reshape(-1, self.width).T @ flat, f"b{k}": flat.sum(0)}
            by_byte = np.zeros((256, 3 * h_), wh.dtype)
            np.add.at(by_byte, x.ravel(), flat)
            g["E"] += by_byte @ self.p[f"Wx{k}"].T
        return loss, g

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = 200, batch: int = 64, rate: float = 0.02, seed: int = 0) -> float:
        """Adam on windows [window, byte], as many of each language in a batch; returns the mean loss of the last steps."""
        self.init(seed)
        r = np.random.default_rng(seed + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        by_language = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        each, losses = max(1, -(-batch // len(self.languages))), []
        for step in range(1, steps + 1):
            pick = np.concatenate([r.choice(own, each) for own in by_language if len(own)])
            x = np.ascontiguousarray(windows[pick].T)
            loss, g = self.gradients(x, labels[pick], _IS_LETTER[x])
            losses.append(loss)
            now = rate * (1 - step / (steps + 1))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))

    def pool(self, texts: list[bytes], rows: int = 1024) -> np.ndarray:
        """Mean probabilities of the positions of letters, [text, language]; zeros for a text without any. So many windows run at a time."""
        x, owner, filled = windows_of(texts)
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        order = np.argsort(filled, kind="stable")
        for at in range(0, len(order), rows):
            pick = order[at : at + rows]
            wide = int(filled[pick[-1]])
            bytes_ = np.ascontiguousarray(x[pick, : wide + 2 * CONTEXT].T)
            core = bytes_[CONTEXT : CONTEXT + wide]
            counted = _IS_LETTER[core] & (np.arange(wide)[:, None] < filled[pick])
            o = self.scores(bytes_)[CONTEXT : CONTEXT + wide].reshape(-1, len(self.languages)).T.astype(np.float32, order="C")
            o -= o.max(0)
            np.exp(o, o)
            o *= counted.ravel() / o.sum(0)
            np.add.at(sums, owner[pick], o.reshape(-1, wide, len(pick)).sum(1, dtype=np.float64).T)
            np.add.at(counts, owner[pick], counted.sum(0))
        return sums / np.maximum(counts, 1)[:, None]


def learn(docs: DataFrame, train_docs: int = 200, train_windows: int = 4, steps: int = 200) -> ByteGRU | None:
    """A network from docs (doc_id, text, lang); None without labels. Gathers ``train_docs`` times ``train_windows`` windows of each language at most."""
    labelled = docs.filter("lang is not null and text is not null").select("lang", "doc_id", "text")
    h = F.xxhash64("doc_id")
    low = Window.partitionBy("lang").orderBy("h", "doc_id", "th")  # Spark keeps the least rows of each task before it deals them
    chosen = labelled.select("lang", "doc_id", h.alias("h"), F.xxhash64("text").alias("th")).withColumn("k", F.row_number().over(low)).filter(F.col("k") <= train_docs).select("lang", "doc_id", "th").distinct()
    size = F.length("text")
    # windows of characters, spread over the text, with a rest for the context
    at = F.transform(F.sequence(F.lit(0), F.lit(train_windows - 1)), lambda i: F.floor(i * F.greatest(size - CORE, F.lit(0)) / max(1, train_windows - 1)).cast("int") + 1)
    parts = labelled.withColumn("th", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "doc_id", "th"]).select("lang", F.explode(F.array_distinct(at)).alias("at"), "text")
    rows = parts.select("lang", F.lower(F.expr(f"substring(text, at, {CORE})")).alias("part")).filter("part <> ''").distinct().collect()
    rows = sorted((r.lang, r.part) for r in rows if _LETTER.search(r.part))
    if not rows:
        return None
    net = ByteGRU(sorted({k for k, _ in rows}))
    code = {k: i for i, k in enumerate(net.languages)}
    x, owner, _ = windows_of([part.encode() for _, part in rows], 96)
    has = _IS_LETTER[x].any(1)
    net.train(x[has], np.array([code[k] for k, _ in rows])[owner][has], steps)
    release_memory()
    return net


def predict(docs: DataFrame, net: ByteGRU | None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns (which replace columns of their names)."""
    bounded_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in (pred, score)]
    docs = docs.select(*columns)
    if net is None:
        return docs.withColumns({pred: F.lit("und"), score: F.lit(0.0)})

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("language", dict)
        for b in batches:
            texts = b.column("text").to_pylist()
            has = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
            p = net.pool([t.lower().encode() if ok else b"" for t, ok in zip(texts, has, strict=True)])
            names = pa.array(np.where(has, np.array(net.languages, object)[p.argmax(1)], "und"), pa.string())
            scores = np.where(has, np.clip(p.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), names, pa.array(scores, pa.float64())], names=[*columns, pred, score])

    return docs.mapInArrow(label, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def keep_languages(docs: DataFrame, net: ByteGRU | None, least: float = 0.4) -> DataFrame:
    """docs without those that have no letter, or no language with a mean probability of ``least``; without a network, letters alone decide."""
    if net is None:
        return docs.filter(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    taken = "__lang_pred", "__lang_score"
    return predict(docs, net, *taken).filter((F.col(taken[0]) != "und") & (F.col(taken[1]) >= least)).drop(*taken)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = learn(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
