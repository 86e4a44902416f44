import pytest
from pyspark.sql import functions as F

from rowloom.llm import urls

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("blocked", [100_000, 1_000_000])
def test_verdicts_do_not_depend_on_the_size_of_the_table(spark, blocked):
    rows = [(-1, "http://pop.example.org/es/x", None)] + [(-2 - i, f"http://h{i}.net/", '<a href="http://pop.example.org/">') for i in range(200)]
    many = spark.range(blocked).select(F.col("id").alias("page_id"), F.lit("http://big.example.org/es/y").alias("url"), F.lit(None).cast("string").alias("html"))
    got = urls.judge_urls(spark.createDataFrame(rows, SCHEMA).union(many)).filter("page_id < -1")
    assert [(r.verdict, r["count"]) for r in got.groupBy("verdict").count().collect()] == [("block", 200)]


def test_a_chain_is_walked_to_its_end(spark):
    rows = [(0, "http://a.example.org/es/x", None), (99, "http://far.net/", None)]
    rows += [(i, f"http://h{i}.net/", f'<a href="http://{"a.example.org" if i == 1 else f"h{i - 1}.net"}/">') for i in range(1, 16)]
    rows += [(50, "http://c1.net/", '<a href="http://c2.net/"><a href="http://h15.net/">'), (51, "http://c2.net/", '<a href="http://c1.net/">')]  # and round a circle
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "allow" if i == 99 else "block" for i in got}
