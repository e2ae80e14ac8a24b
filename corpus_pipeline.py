"""A corpus pipeline of the training-data operators: from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last keep the columns of ``documents``.  ``run`` writes each result as Parquet
in the shared folder and reads it again as the next stage's ``docs``, so a lost
executor costs the work of one stage at most.  When a stage is written, the
tables that it made on the way and its own input are deleted.

Cases, for every stage: a null text counts as an empty one; a row with a null
doc_id stays a row of its own; repeated rows, ties, empty and very long texts and
an empty table give what the stage's operator defines for them; other columns,
whatever their names, are passed on.

No SQL counterpart: fingerprints, cuts and token ids are not to be had in SQL.
The tests hold every stage against a brute-force version instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, near_copies, packing, quality_rules, simhash, substrings
from ledgerloom.llm.workspace import documents, remove, scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike by 80 percent of their five-word shingles, or with fingerprints as close as op1's, the one with the smallest id stays."""
    close = simhash.near_duplicates(docs).select("doc_id", "component_id").filter("doc_id <> component_id").distinct()
    return near_copies.deduplicated(docs, also=close)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut; documents stay."""
    return substrings.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, cut or left out as the target weights say, in training order."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a packed sequence. Sequences follow the training order, in which the mixture was written: files by number, rows by place."""
    if not docs.inputFiles():  # rows that no file holds have no place
        return packing.pack(docs)
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long")
    return packing.pack(docs, order=[number, name, F.col("_metadata.row_index")])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing to target weights", mixture),
    ("packing", packed),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", keep=True)
        if before is not None:
            remove(before)
        before = docs
    return docs
