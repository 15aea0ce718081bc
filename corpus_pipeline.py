"""A training corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents.

Defined cases of every stage: an empty table gives an empty one; extra columns are kept, whatever their names, up to the last stage; a repeated row is
judged like its like, so all its copies stay or go (in near-dedup too: rows of the id that is kept); very long texts are taken whole. A null or
empty text has no words and goes with the quality rules; in the other stages it stays as it is. A row without an id is judged by its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality_rules
from lexigauge.llm.queries import table, tokenizer
from lexigauge.llm.shared import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; n_chars counts what is left."""
    out = line_dedup.drop_recurring_lines(docs)
    return out.select(*(F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else c for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return byte_bpe.encode_digest(docs, *tokenizer())


STAGES = [
    ("quality rules", good_quality),
    ("line dedup", without_recurring_lines),
    ("near-dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]

#: Trained models, sketches and BPE aren't expressible in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each staged in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
