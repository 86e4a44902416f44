from rowloom.llm import simhash


def test_one_row_of_each_class(spark):
    base = " ".join(f"word{i}" for i in range(400))
    other = " ".join(f"third{i}" for i in range(30))
    rows = [(1, base, "a"), (1, base, "a"), (1, base, "b"), (1, base.upper(), "a"), (2, base.upper(), "a")]
    rows += [(3, "quite another text", "x"), (3, base, "x"), (None, other, "x"), (None, other, "x"), (None, base, "x"), (None, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = simhash.keep_one(docs).collect()
    assert sorted((x.doc_id or 0, len(x.text or "") > 20) for x in got) == [(0, False), (0, True), (1, True), (3, False)]
    assert {x.text for x in got} >= {base, other} or {x.text for x in got} >= {base.upper(), other}
    assert simhash.keep_one(docs.limit(0)).collect() == []
