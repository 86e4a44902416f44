import pytest

from rowloom.llm import decontaminate as D


@pytest.mark.parametrize("most", [2_000_000, 5])
def test_short_items_leave_long_documents(spark, most):
    rest = "and a long clean rest of words that nobody has asked for at all here"
    items = [(1, "Where is the red fox?"), (2, "zebra"), (3, "one two three four five six seven eight nine")]
    docs = [(1, f"Start, where is THE red fox? {rest}"), (2, f"a Zebra, {rest}"), (3, f"{rest} where is the red"), (4, f"{rest} one two three four five six seven {rest}")]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_words=most)
    assert {r.doc_id: r.text for r in got.collect()} == {1: f"Start, ? {rest}", 2: f"a , {rest}", 3: docs[2][1], 4: docs[3][1]}
