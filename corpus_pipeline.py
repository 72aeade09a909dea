"""A corpus pipeline of the training-data operators.

Toxic documents go, repeated line runs go, one document of each near-duplicate group stays,
documents that leak benchmark items go, and what is left is encoded. Each stage works on
all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontamination, jaccard_join, line_dedup, toxicity
from millrace.llm.cluster import cut, table

#: Every stage but the last returns these, whatever else the input has.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Words of a line that goes as a repeat wherever it stands; shorter ones need a second line.
LONG_LINE = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under their language's threshold; the model is fitted on
    labelled rows of the same documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.rejected(docs.select(*COLUMNS), model).where(~F.col("reject")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs, and the single lines of ``LONG_LINE`` words or more,
    that an earlier place has; a document of which nothing is left goes, one that had no
    lines to begin with stays."""
    out = line_dedup.remove_repeated_runs(docs.select(*COLUMNS), alone=LONG_LINE)
    left = F.coalesce("text", F.lit("")).rlike(r"\S")
    out = out.where((F.col("n_removed") == 0) | left)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each Jaccard component, and rows without an id; rows that
    share an id stay or go together."""
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    gone = found.where(F.col("doc_id") > F.col("component_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is leaked."""
    leaks = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    gone = leaks.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids_sha256, decoded_sha256)."""
    return bpe.encode(docs.select(*COLUMNS), bpe.default_vocabulary(), digest=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

#: Learned scores and greedy tiling are beyond SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
