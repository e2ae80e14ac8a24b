"""Tables written between the steps of a long computation, so that plans stay small and lost executors cost one step.

They go to the shared folder in ``spark.checkpoint.dir``.  A local session
without that setting gets a temporary folder; on a cluster it must be set.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_TEMPORARY: ContextVar[list[str] | None] = ContextVar("temporary", default=None)


def shared_folder(spark: SparkSession) -> str:
    path = spark.conf.get(SETTING, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
    spark.conf.set(SETTING, path)
    return path


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """``df``, written once and read back. Within ``scratch`` the table is temporary, unless ``keep`` is set."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if not keep and _TEMPORARY.get() is not None:
        _TEMPORARY.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, root: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def exists(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def remove(df: DataFrame) -> None:
    """Delete a table made by ``staged`` that nothing reads any more."""
    for root in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _delete(df.sparkSession, root)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside, but for kept ones, are deleted at the end; so what reads them has to be written inside."""
    made: list[str] = []
    token = _TEMPORARY.set(made)
    try:
        yield
    finally:
        _TEMPORARY.reset(token)
        for root in made:
            _delete(spark, root)
