"""Cases that each operator defines: repeated rows, null ids, very long texts, tables without rows."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import chat, decontaminate, langid, quality, sharding, suffixes, tokens, urls

P = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"w{i}" for i in range(60_000))


def test_very_long_conversation(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"text {k}") for k in range(3000)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("turns", chat.parse_turns(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in out.turns] == [(r, t) for _, _, r, t in rows] and len(out.loss_mask) == 1000


def test_items_in_very_long_and_repeated_texts(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    docs = spark.createDataFrame([(1, LONG + " " + item), (1, LONG + " " + item), (None, item), (2, LONG)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (1, item), (None, "w1 w2 w3"), (3, None)], "item_id long, text string")
    for most in (10, 200_000):
        got = sorted(((x.doc_id or 0, x.n_words, x.n_hit, x.hit_items) for x in decontaminate.scan(docs, items, most_words=most).collect()))
        assert got == [(0, 9, 9, ["1"]), (1, 60_009, 12, ["", "1"]), (1, 60_009, 12, ["", "1"]), (2, 60_000, 3, [""])]
    assert decontaminate.scan(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_pages_repeated_long_and_none(spark):
    html = "<a href='http://bad.com/x'>" * 20_000
    rows = [(1, "http://a.net/", html), (1, "http://a.net/", html), (2, "http://bad.com/de/1", None), (None, None, html), (3, "no scheme", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((x.page_id or 0, x.host, x.verdict) for x in urls.judge_urls(pages).collect())
    assert got == [(0, "", "allow"), (1, "a.net", "block"), (1, "a.net", "block"), (2, "bad.com", "block"), (3, "", "allow")]
    assert urls.judge_urls(pages.limit(0)).collect() == []


@pytest.mark.parametrize("rows_", [1_000_000, 3])
def test_shards_of_long_repeated_and_null_rows(spark, rows_):
    rows = [(k, "x" * (k % 50)) for k in range(300)] + [(7, LONG)] + [(5, "same")] * 100 + [(None, None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(docs, 4, range_rows=rows_).collect()
    assert len(out) == len(rows) and sorted(x.text_crc32 for x in out) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    for k in range(4):
        own = [x for x in out if x["shard"] == k]
        assert sorted(x.slot for x in own) == list(range(len(own)))
    total = sum(x["size"] for x in out)
    assert total == sum(len((t or "").encode()) + 16 for _, t in rows)
    assert sharding.shard(docs.limit(0)).collect() == []


def test_two_step_ranges(spark):
    cuts = [3, 5, 6, 10, 11, 50, 70]
    df = spark.range(-1, 80).select(F.col("id"), sharding.range_of(F.col("id"), cuts).alias("r"))
    assert all(x.r == sum(c <= x.id for c in cuts) for x in df.collect())


def test_quality_of_repeated_rows_and_long_texts(spark):
    rows = [(1, LONG), (1, LONG), (None, "a b"), (2, "line of words here\n" * 5000)]
    got = sorted((x.doc_id or 0, x.n_words, x.n_dup_lines, x.base_failed) for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), None).collect())
    assert got == [(0, 2, 0, True), (1, 60_000, 0, False), (1, 60_000, 0, False), (2, 20_000, 4999, True)]


def test_languages_of_repeated_rows_and_long_texts(spark):
    net = langid.ByteGRU(["a", "b"])
    net.init(0)
    rows = [(1, LONG), (1, LONG), (None, "a b"), (None, "a b"), (2, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = langid.predict(docs, net).collect()
    assert len(got) == 5 and len({(x.doc_id, x.lang_pred, x.score) for x in got}) == 3
    assert langid.predict(docs.limit(0), net).collect() == [] and len(langid.keep_languages(docs, None).collect()) == 5


def test_repeats_of_null_ids_and_long_texts(spark):
    part = " ".join(LONG.split()[500:600])
    rows = [(1, LONG), (None, part), (None, part), (None, "x y z " + part + " and more"), (2, part), (3, LONG[:-1])]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted(((x.doc_id or 0, x.n_words, x.n_removed) for x in got))
    # null ids come first; the two equal rows are one document, and one of the null texts keeps the passage
    assert [r for r in removed if r[0] == 2] == [(2, 100, 100)] and [r for r in removed if r[0] == 1] == [(1, 60_000, 100)]
    none = [r for r in removed if r[0] == 0]
    assert none in ([(0, 100, 0), (0, 100, 0), (0, 105, 100)], [(0, 100, 100), (0, 100, 100), (0, 105, 0)])
    assert [r for r in removed if r[0] == 3][0][2] >= 59_998


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = ["two  blanks and\nlines", "", None, "ünï 漢字 x", LONG[:5000]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "no id")], "doc_id long, text string")
    tokens.write_tokens(docs, str(tmp_path / "t"), path, end_id=None)
    tk = Tokenizer.from_file(path)
    got = {x.doc_id: x for x in tokens.read_tokens(spark, str(tmp_path / "t")).collect()}
    start = 0
    for k, t in [(None, "no id"), *enumerate(texts)]:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert json.loads(tk.to_str())["pre_tokenizer"]["type"] == "ByteLevel"
