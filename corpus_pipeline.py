"""A corpus pipeline over ``documents``: rules, classifier, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; it is written as Parquet and
read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.llm import classifier, mixing, rules, simhash
from linkrank.llm.common import stored, table
from linkrank.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by base rules and by the share of lines labelled as content."""
    return rules.kept(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored under the threshold. It learns from all labelled documents, as few bad ones are left."""
    return classifier.kept(docs, table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of near copies."""
    return simhash.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays the documents out so that sources interleave by their target weights."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token ids of each document."""
    out = tokenizer(spark).encode(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("tokens", tokens),
]

#: No stage but the base rules can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are stored in the folder that executors share."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
