"""Corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.llm import decontaminate, exact_dedup, keyed, labelled, near_join, packing, quality
from panelflow.llm.queries import table, tokenizer_path
from panelflow.session import key_table, stored


def _identified(docs: DataFrame) -> tuple[DataFrame, str, list[str]]:
    """The documents, a column that tells their rows apart, and the columns added for it.

    The column is doc_id, or a number under a name that the table does not have where ids are missing or repeated.
    """
    if keyed.plain(docs, "doc_id"):
        return docs, "doc_id", []
    name = "_row_number"
    while name in docs.columns:
        name += "_"
    return keyed.numbered(docs, "doc_id", "text", name), name, [name]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject.

    Null and empty texts are scored by the model's bias alone; without labels nothing is rejected. Each row is judged
    by itself, so repeated rows share their fate; an empty table stays empty; all columns are kept.
    """
    sample = labelled.sample(docs, table(spark, sf_dir, "labels"), "quality", 3, 1, quality.SAMPLE)
    return quality.keep_good(docs, quality.fit(sample))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside): the longest, then that with the smallest id.

    Null and empty texts are one group. Null and repeated ids are rows of their own; all columns are kept.
    """
    docs, key, added = _identified(docs)
    copies = exact_dedup.deduplicate(docs, key).filter("NOT kept").select(key)
    return docs.join(key_table(copies, "copies"), key, "left_anti").drop(*added)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle similarity 0.8: the one with the smallest id.

    Texts without words are linked with nothing and stay. Null and repeated ids are rows of their own; all columns are kept.
    """
    docs, key, added = _identified(docs)
    classes = near_join.near_classes(docs, near_join.Join(k=5, num=4, den=5), key)
    copies = classes.filter(F.col(key) != F.col("component_id")).select(key)
    return docs.join(key_table(copies, "near-copies"), key, "left_anti").drop(*added)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none. Rows are judged one by one, also where ids are null or repeated; all columns are kept.
    """
    docs, key, added = _identified(docs)
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), key).select(key).distinct()
    # kept first: Spark then knows the size of the ids and need not shuffle the texts to drop a few
    leaks = stored(leaks, "leaks")
    return docs.join(leaks, key, "left_anti").drop(*added)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    Null and empty texts are one piece of one id, repeated rows are packed each, an empty table gives no piece.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality), ("exact_dedup", drop_copies), ("near_join", drop_near_copies),
    ("decontamination", drop_leaks), ("packing", pack),
]

# the classifier's training and the packing plan are beyond SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
