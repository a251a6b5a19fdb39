"""Corpus pipeline: what a corpus goes through on its way to training.

Each stage works on all that the stage before kept, and its output is written as Parquet and
read again.  ORACLE_SQL is None: SQL can't express the classifier nor the encoder; the tests
hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.bpe import op4_bpe
from granary.llm.common import cut, drop, small, table
from granary.llm.decontaminate import ADDED, decontaminate
from granary.llm.jaccard_join import JaccardJoin
from granary.llm.line_dedup import deduplicate_lines
from granary.llm.quality import THRESHOLD, fit_quality, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, accepts.

    Null and empty texts are scored like any other; rows that repeat are kept or go together; an empty table stays empty.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).filter(F.col("score") >= THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that occur earlier, in runs of one or more.

    Null texts and rows with a null id stay as they are; rows that repeat one id with one text are one document and lose the same lines; a text
    may become empty; an empty table stays empty; ``n_chars`` follows the text.
    """
    cleaned = deduplicate_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least id.

    Null and empty texts and rows with a null id are in no group and stay; rows that repeat an id stay or go together; an empty table stays empty.
    """
    groups = JaccardJoin(docs).components()
    gone = cut(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "copies")
    return docs.join(small(gone, gone.count() * 16), "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts hold none; rows that repeat stay or go together; an
    empty table stays empty, and an empty benchmark takes nothing out."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("items") == 0).drop(*ADDED).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each document, and digest of what they decode to; null counts as empty, rows that repeat give
    rows that repeat, an empty table gives none."""
    return op4_bpe(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage wrote goes once the next one has written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
