"""Each stage of the pipeline on rows with nulls, empty and very long texts, ties, repeated rows and extra columns, and on a table without rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
CLASHES = ["did", "th", "node", "root", "fp", "key", "keys", "n", "h", "ids", "start", "end", "n_words", "n_removed", "removed", "repeats_of", "hit_items", "hit_bits", "n_hit", "lang_pred", "score", "word", "__th", "__id", "__spans", "__of", "__did", "__tail"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    own = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 300").orderBy("doc_id").limit(40).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    rows = [(x.doc_id + 1000, x.text, x.lang) for x in own]
    words = [f"wort{r.randrange(4000)}" for _ in range(30_000)]
    rows += [(1, " ".join(words), "de"), (2, None, "en"), (3, "", None), (4, " \n\t", "en"), (5, "12 34 ½", "en"), (None, "a text without an id but with words", "en"), (None, None, None)]
    rows += [(6, rows[0][1], "en")] * 3 + [(7, "".join(c.upper() if c.isascii() else c for c in rows[0][1]), "en"), (6, "another text of the same id, which is no copy of it", None)]
    rows += [(8, " ".join(words[100:180]), "de"), (9, "some words before " + item + " and some behind it " + " ".join(f"x{i}" for i in range(80)), "en")]
    return spark.createDataFrame([(d, t, k, None, None if t is None else len(t), *["x"] * len(CLASHES)) for d, t, k in rows], SCHEMA)


def _rows(df):
    return sorted(((x.doc_id, x.text) for x in df.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_a_table_without_rows(spark, docs, name, stage):
    out = stage(spark, docs.limit(0), SF)
    assert out.collect() == [] and {"doc_id", "text", "source", "lang"} <= set(out.columns)
    if name != "encode":
        assert out.columns == docs.columns


def test_language(spark, docs):
    out = cp.language(spark, docs, SF)
    kept = _rows(out)
    assert out.columns == docs.columns
    gone = [x for x in _rows(docs) if x not in kept]
    assert all(t is None or not any(c.isalpha() for c in t) for _, t in gone)
    assert sum(1 for x in kept if x[0] == 6) == 4 and (1, docs.filter("doc_id = 1").first().text) in kept


def test_near_duplicates(spark, docs):
    out = cp.near_duplicates(spark, docs, SF)
    kept = _rows(out)
    assert out.columns == docs.columns and len(kept) == len(set(kept))
    texts = [t for _, t in kept]
    first = docs.filter("doc_id = 1000").first() or docs.orderBy(F.desc("doc_id")).first()
    assert sum(1 for t in texts if t is None or not t.split()) == 1  # all empty sets are equal
    assert (6, "another text of the same id, which is no copy of it") in kept and (None, "a text without an id but with words") in kept
    assert first is not None and sum(1 for d, _ in kept if d == 7) == 0 and sum(1 for d, _ in kept if d == 6) == 2
    assert out.filter("doc_id = 8").count() == 1  # a passage of a long text is no near copy of it


def test_repeated_passages(spark, docs):
    out = cp.repeated_passages(spark, docs, SF)
    assert out.columns == docs.columns
    assert out.filter("doc_id = 8").count() == 0  # nothing but a passage of document 1
    assert out.filter("doc_id = 1").first().text == docs.filter("doc_id = 1").first().text
    assert out.filter("text is null").count() == 2 and out.filter("text = ''").count() == 1
    assert out.filter("n_chars is distinct from length(text)").count() == 0 and set(out.filter("doc_id = 9").first()[5:]) == {"x"}


def test_benchmark_passages(spark, docs):
    out = cp.benchmark_passages(spark, docs, SF)
    assert out.columns == docs.columns
    nine = out.filter("doc_id = 9").first().text
    assert nine.startswith("some words before") and nine.endswith("x79") and len(nine) < len(docs.filter("doc_id = 9").first().text)
    left = _rows(out)
    assert [x for x in _rows(docs.filter("doc_id <= 6 or doc_id is null")) if x not in left] == []


def test_encode(spark, docs):
    out = cp.encode(spark, docs, SF)
    assert out.columns == [c for c in docs.columns if c != "ids"] + ["ids"] and out.count() == docs.count()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=cp.pieces.model_path())
    for x in out.collect():
        assert model.decode(x.ids) == (x.text or "").lstrip(" ") if x.text and x.text.strip() and not x.text.startswith(" ") else len(x.ids) >= 0
        assert (len(x.ids) > 0) == bool(x.text)
    six = [tuple(x.ids) for x in out.filter("doc_id = 6").collect()]
    assert len(six) == 4 and len(set(six)) == 2
