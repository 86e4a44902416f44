from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rowloom.llm import chat, sharding, urls

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[SEP]", "[ROLE]", "[TEXT]", "[/ROLE]"]


def _chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_chat_round_trip_of_odd_rows(spark):
    odd = [*MARKS, *(m[0] + "\\" + m[1:] for m in MARKS), "[/\\\\INST]", "a[INST]<\\s>" * 3, "<", "[/", "s>", "", None, "é\n漢\U0001f600", "INST]", "\\"]
    rows = [(1, i, ["user", "assistant", "assistant", "system", None, "[TEXT]x[/ROLE]"][i % 6], t, "clash") for i, t in enumerate(odd)]
    rows += [(None, 0, "user", "no id", ""), (2, None, "assistant", "null turn", ""), (2, 1, "assistant", "b", ""), (2, 1, "assistant", "a", ""), (2, 1, "assistant", "a", "")]
    out = chat.format_chats(_chats(spark, rows))
    got = {r.conv_id: r for r in out.withColumn("turns", chat.parse_turns(F.col("formatted"))).collect()}
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    for c in (1, 2, None):
        own = sorted((r for r in rows if r[0] == c), key=key)
        assert [tuple(t) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(got[c].formatted[m.start : m.start + m.length] for m in got[c].loss_mask)
        assert len(got[c].loss_mask) == sum(r[2] == "assistant" for r in own)
        if c == 2:
            assert loss == "null turnaab"
            assert got[c].formatted == "<s>null turn[SEP]a[SEP]a[SEP]b</s>"  # one block of merged turns


def test_chat_escapes_every_mark(spark):
    text = "".join(MARKS)
    r = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert r.u == text and not any(m in r.e for m in MARKS)


def test_chat_empty(spark):
    assert chat.format_chats(_chats(spark, [])).collect() == []


def test_url_parts_and_rules(spark):
    cases = {
        "https://A.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/"),
        "http://example.org/en/12#z": ("example.org", "/en/12", "example.org/en/1"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/"),
        "http://notexample.org?q=/es/": ("notexample.org", "", None),
        "http://borg/": ("borg", "/", None),
        "http://x.com/fr/a": ("x.com", "/fr/a", "com/fr/"),
        "x.com/fr/": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
        "ftp://h#://g/": ("h", "", None),
    }
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(cases)], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(cases))] == list(cases.values())
    assert {got[i].verdict for i in range(len(cases)) if got[i].rule is None} <= {"allow", "block"}


def test_rank_spreads_as_by_hand(spark):
    edges = [("t", "a", 1), ("t", "b", 3), ("a", "b", 1), ("b", "a", 1), ("c", "x", 2), ("c", "a", 2), ("d", "c", 1)]
    seeds = [("t", "trust", 1.0), ("x", "distrust", 1.0)]
    got = urls.host_scores(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, kind string, seed double"), steps=7)
    got = {(r.host, r.kind): r.score for r in got.collect()}
    want = {}
    for kind, arcs in (("trust", edges), ("distrust", [(b, a, n) for a, b, n in edges])):
        own = {h: s for h, k, s in seeds if k == kind}
        all_ = Counter()
        for a, _, n in arcs:
            all_[a] += n
        now = dict(own)
        for _ in range(7):
            nxt = defaultdict(float)
            for a, b, n in arcs:
                nxt[b] += 0.85 * now.get(a, 0) * n / all_[a]
            for h, s in own.items():
                nxt[h] += 0.15 * s
            now = nxt
        want |= {(h, kind): s for h, s in now.items()}
    assert {k for k, v in got.items() if v} == {k for k, v in want.items() if v}
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items() if v)


def test_links_block_who_links_to_blocked(spark):
    page = lambda i, url, *to: (i, url, "".join(f'<a href="{u}">' for u in to))
    rows = [page(1, "http://bad.com/de/1"), page(2, "http://spam.net/1", "http://bad.com/q", "/own"), page(3, "http://good.org/1", "//fine.net/x"), page(4, "http://fine.net/2"), page(5, "http://lone.net/")]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


@pytest.mark.parametrize("copies", [1, 70_000])
def test_sharding_is_whole_and_even(spark, copies):
    rows = [(i, "x" * (i * 7 % 301), "clash") for i in range(500)] + [(None, None, ""), (3, None, ""), (3, "", ""), (3, "ü", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").unionByName(spark.range(copies).selectExpr("77L doc_id", "'same' text", "'' shard"))
    got = sharding.shard(docs, n_shards=7, ranges_per_shard=3, sample=50, overfull=1.2).toPandas()
    assert len(got) == len(rows) + copies
    by = got.groupby("shard")
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in by)
    sizes = by["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()
    assert sorted(got["size"]) == sorted([len((r[1] or "").encode()) + 16 for r in rows] + [20] * copies)


def test_sharding_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
