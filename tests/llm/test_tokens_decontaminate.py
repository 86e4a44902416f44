import random
import zlib

import numpy as np
import pytest

from rowloom.llm import decontaminate as D
from rowloom.llm import tokens

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), sorted(random.Random(1).randrange(10**9) for _ in range(777)), [0, 10**12]])
def test_elias_fano(values):
    e = tokens.EliasFano.from_bytes(tokens.EliasFano.encode(values).to_bytes())
    assert e.decode().tolist() == values
    assert [e.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(100, 3000, 5000))
    assert len(tokens.EliasFano.encode(values).to_bytes()) * 8 < 5000 * (2 + np.log2(3000) + 1.5)


def test_token_files_hold_what_the_library_gives(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["Hello  World!\nit's 42 km", "", None, "é́ İΣ x <|endoftext|>a<|startoftext|>", "word " * 9000, "\t\x1c\x85 x", "same", "same", "IT'S it'll !'s ''s x'd9 É,è.. ß÷×ÿ a\tb\n\n 12ab <b> 'RE", " \n lead", "µª ǅ ﬁ K", "tail \n ", "Only words, and stops.\nÉté. Fin.", ".x", ", a", "a. ", "a.b", "a,, b"]
    rows = [(i * 3 % 7, x, "part") for i, x in enumerate(texts)] + [(None, "no id", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    tokens.write_tokens(docs, str(tmp_path / "t"), P.path("word_bpe_49k.json"), end_id=1, segment_tokens=50)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(spark, str(tmp_path / "t")).collect()))
    ids = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x, _ in rows]
    want = sorted((d is not None, d or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids)
    assert sorted((d is not None, d or 0, n, c) for _, d, n, c in got) == want
    assert [s for s, *_ in got] == np.cumsum([0, *(n for _, _, n, _ in got)])[:-1].tolist()
    order = [(d is not None, d or 0) for _, d, _, _ in got]
    assert order == sorted(order)


def test_token_files_of_nothing(spark, tmp_path):
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), P.path("word_bpe_49k.json"), end_id=None)
    assert tokens.read_tokens(spark, str(tmp_path / "t")).collect() == []


def _brute(text, items, window):
    words = D.words_of(text.encode() if text is not None else None)
    hit, names = set(), set()
    for k, t in items:
        ws = D.words_of((t or "").encode())
        n = min(window, len(ws))
        wins = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add("" if k is None else str(k))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("most", [10**6, 40])
def test_scan_is_brute_force(spark, most):
    r = random.Random(5)
    text = lambda n, v: " ".join(r.choice("abcdefgh"[:v]) for _ in range(n))
    items = [(i, text(r.randrange(0, 14), 2 + i % 3)) for i in range(30)] + [(30, None), (31, "..!"), (None, "A b, C d"), (2, "zz Ünï 9"), (2, "zz Ünï 9")]
    docs = [(i, text(r.randrange(0, 60), 2 + i % 5)) for i in range(80)] + [(80, None), (81, ""), (82, "ZZ ünï-9 zz Ünï;9"), (82, "a"), (None, "a b c d")]
    got = D.scan(spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_hit int"), spark.createDataFrame(items, "item_id long, text string"), window=4, most_words=most)
    rows = got.select("doc_id", "text", "n_words", "n_hit", "hit_items").collect()
    assert len(rows) == len(docs)
    for x in rows:
        assert (x.n_words, x.n_hit, x.hit_items) == _brute(x.text, items, 4), x.text


def test_decontaminate_cuts_and_drops(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"Start of it: {item.upper()}! And a long clean rest of words that nobody has asked for at all here."), (2, f"x {item}"), (3, "nothing here"), (4, None)]
    got = {r.doc_id: r.text for r in D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: "Start of it: ! And a long clean rest of words that nobody has asked for at all here.", 3: "nothing here", 4: None}


def test_decontaminate_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in D.scan(docs, items).collect()] == [(2, 0)]
    assert D.scan(docs.limit(0), items).collect() == []
