"""Intermediate tables, the width of shuffles, and the table that most operators read.

Intermediate results are written as Parquet tables under the folder that the
session names in ``spark.checkpoint.dir``.  That cuts lineage and survives the
loss of an executor, because every executor and the driver see that folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.staging import remove, scratch, shared_folder, staged

__all__ = ["documents", "remove", "scratch", "shared_dir", "shuffle_width", "written"]
shared_dir, written = shared_folder, staged


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them for its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
