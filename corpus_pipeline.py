"""The corpus pipeline: documents in, clean encoded documents out.

Language identification, near-duplicates, repeated passages, benchmark passages, and piece ids. Each stage gets what
its predecessor kept, written and read again; all but the last return the columns of documents, whatever their names. What operators
stored on the way goes once a stage's rows are written. Every stage returns no rows for a table without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, langid, pieces, similar, suffixes
from rowloom.llm.common import stored_meanwhile, table


def _aside(docs: DataFrame) -> DataFrame:
    """docs whose columns but doc_id and text have names that no operator uses."""
    return docs.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")})


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs by their own names again; n_chars follows the text."""
    cols = [F.col(c if c in ("doc_id", "text") else f"__c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, cols, strict=True)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or with no language that is clear, go."""
    net = langid.learn(docs.select("doc_id", "text", "lang").filter(~langid.held_out(F.col("doc_id"))))
    return _back(langid.keep_languages(_aside(docs), net), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays (5-word shingles, a Jaccard of 0.8 or more), repeated rows and null texts among them: the smallest doc_id, null ones last."""
    return similar.keep_one_similar(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier place has leave the text; documents of nothing else go, those without a word stay."""
    out = suffixes.remove_repeats(_aside(docs))
    return _back(out.filter("n_removed = 0 or n_removed < n_words"), docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What test items share with a document leaves its text; documents that consist of it for the most part go, those without a word stay."""
    return _back(decontaminate.decontaminate(_aside(docs), table(spark, sf_dir, "benchmark")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids in ``ids``, which replaces a column of that name; null and empty texts have none."""
    return pieces.encode(docs, pieces.Pieces.load(pieces.model_path()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("encode", encode),
]

#: No SQL can express these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with stored_meanwhile(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
