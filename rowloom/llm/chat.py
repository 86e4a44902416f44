"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, and adjacent turns of one role are merged into blocks by
an array aggregation; the blocks are concatenated to one string. Control strings that occur inside a text or a role
get a backslash behind their opening bracket (one more where there are some already), which is undone on reading.
No control string can arise where a text meets a marker: a control string has its only opening bracket in front.

Defined cases: a null text or role is empty text; rows of one (conv_id, turn) are ordered by role, then text, and a
repeated row is a turn of its own; a null turn comes first; a null conv_id is a conversation like any other; a table
without rows gives none. A conversation is one output value, so it is the unit of work; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The control strings: block starts and ends by role, and what separates merged turns.
USER = ("[INST]", "[/INST]")
ASSISTANT = ("<s>", "</s>")
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
SEP = "[SEP]"
_NAMES = r"s>|INST\]|SEP\]|ROLE\]|TEXT\]"
_BLOCK = r"(?s)(?:\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[]/?)(\\*)({_NAMES})", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[]/?)\\(\\*)({_NAMES})", "$1$2$3")


def _open(role: Column) -> Column:
    other = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    return F.when(role == "user", USER[0]).when(role == "assistant", ASSISTANT[0]).otherwise(other)


def _close(role: Column) -> Column:
    return F.when(role == "user", USER[1]).when(role == "assistant", ASSISTANT[1]).otherwise(OTHER[2])


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to conv_id, formatted, loss_mask: array of (start, length), in code points of ``formatted``, one for each assistant text."""
    t = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # blocks: adjacent turns of one role, their texts in an array
    none = F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)")

    def merge(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(escape(x["text"]))).alias("texts"))
        new = F.struct(x["role"].alias("role"), F.array(escape(x["text"])).alias("texts"))
        return F.when((F.size(acc) > 0) & (last["role"] == x["role"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    blocks = F.aggregate("ts", none, merge)
    # pieces: what is written for each block's texts, and whether it bears loss
    def pieces(b: Column) -> Column:
        n = F.size(b["texts"])
        return F.transform(
            b["texts"],
            lambda x, i: F.struct(
                F.when(i == 0, _open(b["role"])).otherwise(F.lit("")).alias("head"),
                x.alias("text"),
                F.when(i == n - 1, _close(b["role"])).otherwise(F.lit(SEP)).alias("tail"),
                (b["role"] == "assistant").alias("loss"),
            ),
        )

    state = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,length:long>>)").alias("mask"))

    def place(acc: Column, p: Column) -> Column:
        start, n = acc["at"] + F.length(p["head"]), F.length(p["text"]).cast("long")
        span = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n + F.length(p["tail"])).alias("at"), F.when(p["loss"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return (
        chats.select("conv_id", F.flatten(F.transform(blocks, pieces)).alias("ps"))
        .select(
            "conv_id",
            F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["text"], p["tail"])), "").alias("formatted"),
            F.aggregate("ps", state, place)["mask"].alias("loss_mask"),
        )
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as it was before merging and escaping: array of (role, text)."""

    def turns(block: Column) -> Column:
        body = lambda head, tail: F.substring(block, len(head) + 1, F.length(block) - len(head) - len(tail))
        inner = F.substring_index(body(OTHER[0], OTHER[2]), OTHER[1], 1)
        kind = F.when(F.startswith(block, F.lit(USER[0])), F.struct(F.lit("user").alias("role"), body(*USER).alias("texts")))
        kind = kind.when(F.startswith(block, F.lit(ASSISTANT[0])), F.struct(F.lit("assistant").alias("role"), body(*ASSISTANT).alias("texts")))
        rest = F.substring(block, len(OTHER[0]) + F.length(inner) + len(OTHER[1]) + 1, F.length(block) - len(OTHER[0]) - F.length(inner) - len(OTHER[1]) - len(OTHER[2]))
        kind = kind.otherwise(F.struct(unescape(inner).alias("role"), rest.alias("texts")))
        return F.transform(F.split(kind["texts"], r"\[SEP\]", -1), lambda x: F.struct(kind["role"].alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(0)), turns))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], chats.schema)
    out = format_chats(chats.unionByName(extra)).withColumn("turns", parse_turns(F.col("formatted")))
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring("formatted", m["start"].cast("int") + 1, m["length"].cast("int")))), "")
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (
  select *, regexp_replace(text, '([<\[]/?)(\\*)(s>|INST\]|SEP\]|ROLE\]|TEXT\])', '\1\\\2\3', 'g') as esc,
    lag(role) over w as before
  from t window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(length(esc) + case
    when before = role then 5
    when role = 'user' then 13 when role = 'assistant' then 7
    else 19 + length(regexp_replace(role, '([<\[]/?)(\\*)(s>|INST\]|SEP\]|ROLE\]|TEXT\])', '\1\\\2\3', 'g')) end) as bigint) as formatted_chars
from o group by conv_id
"""
