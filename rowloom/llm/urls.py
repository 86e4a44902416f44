"""URL filter: rules first, then trust and distrust that spread over the links between hosts. DataFrame functions only.

A page's host and path are taken from its url. The longest rule that fits decides. Hosts without a rule get two scores
by personalised PageRank: trust spreads along links from the hosts that the rules allow, distrust spreads against
links from the hosts that they block (who links to a blocked host is distrusted). A host is blocked if it has
distrust, and more than ``ratio`` times its trust. The steps go on until no host's score changes by more than ``tolerance`` of itself,
so scores reach as far as links do, and no bound depends on the size of the table. Mass at a host without links in the walked direction is lost,
for both scores alike.

Defined cases: null url, or one without ``://``: host and path are empty, no rule fits, verdict ``allow`` unless links
say otherwise (the empty host takes no part in the graph); null html has no links; repeated rows and page_ids each
get their row; html of any length is read whole; a table without rows gives none. Links without ``://`` stay on their host and say nothing about others.
Edges are counted before they are shuffled, so a host with a third of the pages is one row for each of its targets.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, store, table

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that wins, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: the links of whole pages to other hosts."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""), F.lit(1))
    hosts = F.transform(links, lambda x: host_of(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x)).otherwise(x)))
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(hosts).alias("dst"))
    return found.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def host_scores(edges: DataFrame, seeds: DataFrame, steps: int | None = None, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """seeds: host, kind (trust or distrust), seed (sums to 1 by kind). Returns host, kind, score, after ``steps`` or (None) when all have settled.

    Trust walks the edges, distrust walks them backwards; both go in one pass per step.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    )
    out = both.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    walk = store(both.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("p")), "walk")
    seeds = store(seeds, "seeds")
    now = last = seeds.withColumnRenamed("seed", "score")
    if walk.isEmpty():  # no link leaves its host: every step gives the seeds' own share again
        return now.withColumn("score", F.col("score") * (1 - damping))
    for k in count() if steps is None else range(steps):
        sent = walk.join(now.withColumnRenamed("host", "a"), ["kind", "a"]).groupBy("kind", F.col("b").alias("host")).agg(F.sum(F.col("p") * F.col("score")).alias("got"))
        now = seeds.join(sent, ["kind", "host"], "full").select("host", "kind", (damping * F.coalesce("got", F.lit(0.0)) + (1 - damping) * F.coalesce("seed", F.lit(0.0))).alias("score"))
        before, now = last, store(now, f"rank{k}")
        if steps is None:
            old = before.select("kind", "host", F.col("score").alias("old"))
            change = F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))) > tolerance * F.col("score")
            if now.join(old, ["kind", "host"], "left").filter(change).isEmpty():
                break
        last = now
    return now


def judge_urls(pages: DataFrame, rules=RULES, steps: int | None = None, ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages (page_id, url, html)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "said": said})
    kinds = judged.filter("said is not null").groupBy("host", F.when(F.col("said") == "allow", "trust").otherwise("distrust").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    all_of = kinds.groupBy("kind").agg(F.sum("n").alias("all"))  # two rows
    seeds = kinds.join(F.broadcast(all_of), "kind").select("host", "kind", (F.col("n") / F.col("all")).alias("seed"))
    scores = host_scores(host_edges(pages), seeds, steps)
    by_host = scores.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("said", F.when((d > 0) & (d > ratio * t) & (F.col("host") != ""), "block").otherwise("allow"))
    no_score = judged.filter("host = ''").withColumns({"trust": F.lit(0.0), "distrust": F.lit(0.0)})  # they meet no host, in no one task
    scored = judged.filter("host <> ''").join(by_host, "host", "left").unionByName(no_score)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), t.alias("trust"), d.alias("distrust"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


#: The same with a hundred steps for both scores, after which nothing changes by a millionth.
OP4_SQL = r"""
with recursive u as (select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from (select page_id, html, coalesce(url, '') as url from pages)),
p as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
rules as (select * from (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) as t(what, h, s)),
fits as (select page_id, arg_max(h || s, length(h || s)) as rule, arg_max(what, length(h || s)) as said from (select distinct page_id, host, path from p) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by page_id),
judged as (select p.page_id, html, host, path, rule, said from p left join fits on p.page_id = fits.page_id),
kinds as (select host, case said when 'allow' then 'trust' else 'distrust' end as kind, count(*) as n from judged where said is not null group by 1, 2),
seeds as (select host, kind, n / sum(n) over (partition by kind) as seed from kinds),
links as (select host as src, unnest(regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*["'']?\s*((?:https?:)?//[^"''\s<>]+)', 1)) as l from judged),
edges as (select src, translate(regexp_extract(regexp_replace(l, '^[^/]*//', ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst, count(*) as n from links group by 1, 2),
far as (select * from edges where src <> '' and dst <> '' and src <> dst),
both_ways as (select 'trust' as kind, src as a, dst as b, n from far union all select 'distrust', dst, src, n from far),
walk as (select kind, a, b, n / sum(n) over (partition by kind, a) as p from both_ways),
score as (
  select 0 as step, kind, host, seed as score from seeds
  union all
  select step, kind, host, sum(got) from (
    select s.step + 1 as step, s.kind, w.b as host, 0.85 * w.p * s.score as got from score s join walk w on w.kind = s.kind and w.a = s.host where s.step < 100
    union all
    select s.step + 1, d.kind, d.host, 0.15 * d.seed from (select distinct step from score where step < 100) s, seeds d) group by 1, 2, 3),
last as (select host, coalesce(sum(score) filter (where kind = 'trust'), 0) as t, coalesce(sum(score) filter (where kind = 'distrust'), 0) as d from score where step = 100 group by 1)
select page_id, j.host, path, rule, coalesce(said, case when d > 0 and d > t and j.host <> '' then 'block' else 'allow' end) as verdict from judged j left join last on j.host = last.host
"""
