"""Documents to a training set: quality, near duplicates, repeated passages, mixing, pieces.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the
last give the columns of ``documents``. Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import minhash, mixing, pieces, quality, suffixes
from gleaner.llm.common import held_out, restored
from gleaner.llm.queries import piece_model, table
from gleaner.session import settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of ``docs``."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return quality.accepted(docs, quality.fitted(docs, labels, "quality"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.deduplicated(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go from every text; n_chars is counted anew where it is there."""
    rows = restored(suffixes.reduced(docs), docs, text="_text")
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    return restored(mixing.taken(docs), docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its piece ids."""
    return pieces.encoded(docs, piece_model())


STAGES = [("quality", quality_stage), ("near_duplicates", near_stage), ("passages", passages_stage), ("mixing", mixing_stage), ("pieces", pieces_stage)]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
