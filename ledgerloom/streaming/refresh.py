"""Findings kept up to date as entries arrive.

``keep_fresh`` computes over the whole table, if a micro-batch changed it;
``keep_slices_fresh`` over the rows of those keys alone that a batch touches: entries
lie in folders by a hash of their key, so a batch reads the folders of its own keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

HASH = "n_rows long, content string"


def content_hash(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash of all rows: equal tables have equal values."""
    count, total = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return int(count), int(total)


def _kept_hash(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """The hash that an earlier run left at ``path``; None if there is none."""
    try:
        row = spark.read.schema(HASH).parquet(path).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (row["n_rows"], int(row["content"])) if row else None


class Refresh:
    """Runs ``compute`` only if the data differ from the last run.

    With ``state``, a path, the hash of the last run is kept there, so a restart
    does not compute again. It is written after ``compute``: a run that was lost on
    the way is repeated.
    """

    def __init__(self, compute: Callable[[DataFrame], None], state: str | None = None) -> None:
        self.compute, self.state, self.last = compute, state, None
        self.runs = 0

    def __call__(self, df: DataFrame) -> bool:
        now = content_hash(df)
        if self.last is None and self.state:
            self.last = _kept_hash(df.sparkSession, self.state)
        if now == self.last:
            return False
        self.compute(df)
        if self.state:
            df.sparkSession.createDataFrame([(now[0], str(now[1]))], HASH).coalesce(1).write.mode("overwrite").parquet(self.state)
        self.last = now
        self.runs += 1
        return True


def keep_fresh(entries: DataFrame, table_path: str, compute: Callable[[DataFrame], None], checkpoint: str, state: str | None = None) -> StreamingQuery:
    """Append each batch of a stream to a table and recompute over the whole table if it changed.

    A batch that is delivered again overwrites its own part, so nothing counts
    twice. ``state``: where the table's hash is kept between runs.
    """
    refresh = Refresh(compute, state)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        refresh(rows.sparkSession.read.parquet(table_path).drop("batch"))

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


BUCKETS = 256  #: Folders that entries are dealt to by their key


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def append_batch(rows: DataFrame, table_path: str, key: str, number: int, buckets: int = BUCKETS) -> None:
    """Write a batch below the table, in folders by its key. A batch that is delivered again overwrites its own part."""
    rows.withColumn("bucket", _bucket(key, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{table_path}/batch={number}")


def slices(spark: SparkSession, table_path: str, touched: DataFrame, key: str, number: int, buckets: int = BUCKETS) -> DataFrame:
    """All entries up to batch ``number`` whose key is in ``touched`` (one column), from the folders that can have them."""
    folders = [r[0] for r in touched.select(_bucket(touched.columns[0], buckets)).distinct().collect()]  # ``buckets`` at most
    table = spark.read.parquet(table_path).filter((F.col("batch") <= number) & F.col("bucket").isin(folders)).drop("batch", "bucket")
    named = touched.toDF("touched_key")
    return table.join(named, F.col(key).eqNullSafe(F.col("touched_key")), "left_semi")


def keep_slices_fresh(entries: DataFrame, table_path: str, key: str, compute: Callable[[DataFrame], DataFrame], findings_path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Append each batch of a stream to a table and compute the findings of the values of ``key`` in it, from all their rows.

    ``compute`` has to work within each key, and to return the key. Findings are
    written per batch, with the keys that it touched; ``latest_slices`` reads what
    stands. A batch that is delivered again overwrites its own parts. ``buckets`` of a
    table must not change. Entries must not have columns ``batch`` and ``bucket``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark, own = rows.sparkSession, f"batch={number}"
        append_batch(rows, table_path, key, number, buckets)
        if not rows.isEmpty():
            spark.read.parquet(f"{table_path}/{own}").select(key).distinct().write.mode("overwrite").parquet(f"{findings_path}/keys/{own}")
            part = slices(spark, table_path, spark.read.parquet(f"{findings_path}/keys/{own}"), key, number, buckets)
            compute(part).write.mode("overwrite").parquet(f"{findings_path}/found/{own}")

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_slices(spark: SparkSession, findings_path: str, key: str) -> DataFrame:
    """The findings of every key as the last batch that touched it left them."""
    last = spark.read.parquet(f"{findings_path}/keys").groupBy(F.col(key).alias("touched_key")).agg(F.max("batch").alias("last"))
    found = spark.read.parquet(f"{findings_path}/found")
    return found.join(last, F.col(key).eqNullSafe(F.col("touched_key")) & (F.col("batch") == F.col("last")), "left_semi").drop("batch")
