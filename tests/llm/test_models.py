import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import langid, pieces, quality

P = pytest.importorskip("public_tokenizers")


def test_gru_gradients_are_those_of_the_loss():
    net = langid.ByteGRU(["a", "b", "c"], hidden=3, width=4)
    net.init(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.array([list(b"abcde"), list(b"d    "), list(b"efghi")], np.uint8).T
    y, mask = np.array([0, 2, 1]), langid._IS_LETTER[x]
    _, g = net.gradients(x, y, mask)
    r = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(6):
            at = tuple(r.integers(s) for s in v.shape)
            if k == "E":
                at = (int(x[0, 0]), at[1])
            old, e = v[at], 1e-3
            v[at] = old + e
            up = net.gradients(x, y, mask)[0]
            v[at] = old - e
            down = net.gradients(x, y, mask)[0]
            v[at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-4, k


def test_gru_reads_whole_texts_whatever_they_are_batched_with():
    net = langid.ByteGRU(["a", "b"])
    net.init(0)
    texts = [b"word", b"much longer " * 400, b"", b"12 34", b"x" * langid.CORE]
    both = net.pool(texts, rows=7)
    assert np.allclose(both, np.concatenate([net.pool([t]) for t in texts]), atol=1e-5)
    assert not both[2].any() and not both[3].any() and np.allclose(both[[0, 1, 4]].sum(1), 1)
    x, owner, filled = langid.windows_of(texts)
    for k, t in enumerate(texts):
        own = [bytes(w[langid.CONTEXT : langid.CONTEXT + n]) for w, n, o in zip(x, filled, owner, strict=True) if o == k]
        assert b"".join(own) == t
    assert bytes(x[2][: langid.CONTEXT]) == texts[1][langid.CORE - langid.CONTEXT : langid.CORE]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("score"))
    net = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))), train_docs=100, steps=120)
    odd = spark.createDataFrame([(-1, None, "en", ""), (-2, "", "en", ""), (-3, "123 !?", "en", ""), (-4, "漢字" * 5000, None, ""), (-5, "½ ² Ⅷ", "en", "")], docs.schema)
    got = langid.predict(docs.unionByName(odd), net).filter(langid.held_out(F.col("doc_id")) | (F.col("doc_id") < 0)).select("doc_id", "lang", "lang_pred", "score").collect()
    own = [r for r in got if r.doc_id >= 0]
    assert np.mean([r.lang == r.lang_pred for r in own]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id < 0 and r.doc_id != -4} == dict.fromkeys((-1, -2, -3, -5), ("und", 0.0))
    assert langid.learn(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(docs.limit(3), None).collect()} == {"und"}


def _base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(wins)
    hit = {p for i, x in enumerate(wins) if c[x] > 1 for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_base_counts_are_brute_force():
    r = random.Random(1)
    texts = [None, "", "\n\n", "a\n a\na\n\x0b\n\x0b", "é漢<|> x", "a b c d e a b c d e a", "w " * 3000]
    texts += ["".join(r.choice(["a", "b", "\n", " ", "#", "Ü ", "cc\n"]) for _ in range(r.randrange(200))) for _ in range(150)]
    texts.append(" ".join(str(r.randrange(9000)) for _ in range(20_000)) + " 1 2 3 4 5 6 1 2 3 4 5 6")
    for t in texts:
        assert quality.base_counts(None if t is None else t.encode()) == _base(t)


def test_crf_decodes_and_learns():
    r = np.random.default_rng(0)
    crf = quality.LineCRF(r.standard_normal((quality.FEATURES, 2)), r.standard_normal((2, 2)))
    x = r.standard_normal((7, quality.FEATURES))
    e = x @ crf.emit
    score = lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(crf.step[a, b] for a, b in itertools.pairwise(y))
    paths = list(itertools.product((0, 1), repeat=7))
    assert crf.viterbi(x).astype(int).tolist() == list(max(paths, key=score))
    y = np.array([0, 1, 1, 0, 0, 1, 0])
    value, ge, gs = crf.gradient(x, y)
    assert np.isclose(value, score(y) - np.log(sum(np.exp(score(p)) for p in paths)))
    for g, w in ((ge, crf.emit), (gs, crf.step)):
        at = tuple(r.integers(s) for s in w.shape)
        w[at] += 1e-5
        assert np.isclose((crf.gradient(x, y)[0] - value) / 1e-5, g[at], atol=1e-3)
        w[at] -= 1e-5


def test_quality_of_rated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit(1).alias("n_words"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    crf = quality.learn(docs, labels)
    got = quality.judge(docs, crf).join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good[~good.base_failed].kept.mean() > 0.97 and bad.kept.mean() < 0.2
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "a b c d e f g h i j k")], "doc_id long, text string")
    assert sorted((r.n_words, r.base_failed, r.kept) for r in quality.judge(odd, None).collect()) == [(0, True, False), (0, True, False), (1, True, False), (11, False, True)]
    assert quality.learn(docs, labels.limit(0)) is None and quality.judge(odd.limit(0), crf).collect() == []


def test_lines_of_mixed_documents_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    crf = quality.learn(docs, labels)
    rated = docs.join(labels, "doc_id").orderBy("doc_id").collect()
    lines = {q: [x for r in rated if r.quality == q for x in r.text.split("\n") if 20 <= len(x.split()) <= 60] for q in (0, 1)}
    r = random.Random(4)
    right = total = 0
    kept = {0: 0, 1: 0}
    for k in range(60):
        most = k % 2
        parts = [(most, x) for x in r.sample(lines[most], 6)] + [(1 - most, x) for x in r.sample(lines[1 - most], 2)]
        at = r.randrange(7)
        parts = parts[:at] + parts[6:] + parts[at:6]
        x, sizes = quality.line_features("\n".join(p for _, p in parts).encode())
        found = crf.viterbi(x)
        right += sum(int(a) == b for a, (b, _) in zip(found, parts, strict=True))
        total += len(parts)
        kept[most] += sizes[found].sum() >= 0.5 * sizes.sum()
    assert right / total > 0.9 and kept[1] >= 27 and kept[0] <= 3, (right / total, kept)


def _best(word, pieces_):
    by = {pieces_.text[i]: i for i in pieces_.plain()}
    worst = min(pieces_.score[i] for i in pieces_.plain() if pieces_.score[i] > -1e8) - 10.0
    best = [(0.0, ())] + [None] * len(word)
    for z in range(1, len(word) + 1):
        for a in range(max(0, z - 16), z):
            p = word[a:z]
            if p in by:
                s, ids = pieces_.score[by[p]], (by[p],)
            elif z - a == 1:
                s, ids = worst, tuple(pieces_.byte_ids[b] for b in p.encode())
            else:
                continue
            if best[z] is None or best[a][0] + s > best[z][0]:
                best[z] = (best[a][0] + s, (*best[a][1], *ids))
    return best[-1][1]


TEXTS = ["Hello world", "  two  blanks ", "line\n\nend\n ", "", None, "漢字 ünï \U0001f600", "a\tb", "x" * 300, "▁ under ▁", "the the the of", " \n \n", "abcdefg" * 40 + "\u6f22" * 30 + "the" * 300]


def test_pieces_are_the_best_path_and_decode(spark):
    model = pieces.Pieces.load(pieces.model_path())
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, "again", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for head_bytes in (0, 60, 1 << 20):
        got = pieces.decode(pieces.encode(docs, model, head_bytes=head_bytes), model).collect()
        assert len(got) == len(rows)
        for r in got:
            words = pieces._WORDS.findall("▁" + r.text.replace(" ", "▁")) if r.text else []
            assert tuple(r.ids) == tuple(k for w in words for k in _best(w, model)), r.text
            assert r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.encode(docs.limit(0), model).collect() == []


def test_a_word_of_a_million_characters(spark):
    model = pieces.Pieces.load(pieces.model_path())
    r = random.Random(8)
    blob = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, "a " + blob + " z"), (2, "a")], "doc_id long, text string")
    got = pieces.decode(pieces.encode(docs, model), model).orderBy("doc_id").collect()
    assert got[0].decoded == got[0].text and len(got[0].ids) > 300_000
    own = model.bytes_of()
    assert [own[k] for k in got[1].ids] == [b" a"]


def test_repeated_rows_outside_of_the_head(spark):
    model = pieces.Pieces.load(pieces.model_path())
    docs = spark.createDataFrame([(None, "many words here"), (5, "many words here")] * 40, "doc_id long, text string")
    got = pieces.encode(docs, model, head_bytes=0).collect()
    assert len(got) == 80 and len({tuple(x.ids) for x in got}) == 1


def test_workers_encode_small_batches(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    def sizes(b):
        return pa.RecordBatch.from_arrays([pa.array([pc.sum(pc.binary_length(b.column("text"))).as_py()]), pa.array([b.num_rows])], names=["size", "n"])

    docs = spark.range(600).selectExpr("id as doc_id", "repeat('some words ', 2000) as text").coalesce(1)
    got = pieces.encode(docs, pieces.Pieces.load(pieces.model_path()), finish=sizes, finish_schema="size long, n long").collect()
    assert sum(x.n for x in got) == 600 and max(x.size for x in got) < 2 << 20


def test_the_driver_holds_the_head_twice_at_most(spark):
    import tracemalloc

    import pyarrow as pa

    words = spark.range(200_000).selectExpr("cast(id as string) as word", "transform(sequence(0, cast(id % 5 as int)), x -> cast((id + x) % 30000 as int)) as ids")
    tracemalloc.start()
    head = pieces.Head.of(words, np.uint16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = head.hashes.nbytes + head.begins.nbytes + head.ids.nbytes
    assert peak < 2.5 * size + (6 << 20)  # beside it rows on their way, and a part of 65,536 words
    at = head.find(pa.array(["0", "4", "199999", "none"]))
    assert at[3] == -1 and [head.ids[head.begins[k] : head.begins[k + 1]].tolist() for k in at[:3]] == [[0], [4, 5, 6, 7, 8], [(199999 + x) % 30000 for x in range(5)]]


def test_word_splitting_paths_agree():
    import pyarrow as pa

    r = random.Random(4)
    texts = ["".join(r.choice("ab \n▁") for _ in range(r.randrange(9))) for _ in range(3000)] + [None]
    words, which, bounds = pieces.split_words(pa.array(texts))
    words, which = words.to_pylist(), which.to_pylist()
    for i, t in enumerate(texts):
        assert [words[k] for k in which[bounds[i] : bounds[i + 1]]] == pieces.words_of(t or "")


def test_pipeline_runs_its_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert 0.7 * before.count() < len(out) <= before.count() and out.doc_id.is_unique
    assert (out.ids.map(len) > 0).all() and (out.text.str.len() == out.n_chars).all()
