"""Remembered records as a table: appended to, read anew for each operation, and looked up by joins.

``memory.Memory`` holds the records of one client at hand; a ``RecordLog`` holds
those of all clients at a path.  Nothing is changed in place: an entry is appended, the
latest entry of a client and signature counts, and one without a label says that the
record is gone.  So writers do not overwrite each other, and a lost write repeats.

``lookup`` finds the records for many sheets at once, as ``Memory.exact`` and
``Memory.similar`` do for one: column tags become letters, so their similarity is the
edit distance of two short strings, tried for sheets of one client that differ by three
columns at most; headers are compared for what is left.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import memory
from ledgerloom.plans.fixed import COLUMN_DRIFT, HEADER_SIMILARITY, TAG_SIMILARITY
from ledgerloom.plans.staging import exists

_LOG = logging.getLogger(__name__)
KEY = ["client_id", "signature"]
FIELDS = [*KEY, "headers", "sheet", "label", "created_at"]
ENTRY = f"{memory.SCHEMA}, written_at timestamp"
TAGS = ("BLANK", "DATE_PERIODIC", "DATE_TRANSACTIONAL", "NUM_LOW", "NUM_HIGH_NONNETTING", "NUM_HIGH_SIGNED", "TEXT_UNIQUE", "TEXT_CATEGORICAL", "TEXT_MODERATE", "TEXT_OTHER")


class RecordLog:
    """The records of all clients below a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def current(self) -> DataFrame:
        """The records that stand, one for each client and signature; ``created_at`` is that of the first entry since the record was last gone, or of the first entry."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], memory.SCHEMA)
        entries = self.spark.read.schema(ENTRY).parquet(self.path)
        gone = entries.filter("label is null").groupBy(*KEY).agg(F.max("written_at").alias("gone_at"))
        live = entries.filter("label is not null").join(gone, KEY, "left").filter("gone_at is null or written_at > gone_at")
        last = live.groupBy(*KEY).agg(F.max_by(F.struct("headers", "sheet", "label"), "written_at").alias("r"), F.min("created_at").alias("created_at"))
        return last.select(*KEY, "r.*", "created_at")

    def _append(self, rows: DataFrame) -> None:
        rows.withColumn("written_at", F.current_timestamp()).select(*FIELDS, "written_at").write.mode("append").parquet(self.path)

    def remember(self, records: DataFrame) -> None:
        """Add or change records (columns as ``memory.SCHEMA``). ``ValueError`` if a label is blank."""
        if not records.filter("label is null or trim(label) = ''").isEmpty():
            raise ValueError("a label must not be blank")
        self._append(records)

    def forget(self, keys: DataFrame) -> None:
        """Records of these clients and signatures are gone from now on."""
        none = F.lit(None).cast("string")
        self._append(keys.select(*KEY, none.alias("headers"), none.alias("sheet"), none.alias("label"), none.alias("created_at")))

    def of_client(self, client_id: str) -> memory.Memory:
        """One client's records at hand: one for each layout of its sheets."""
        rows = self.current().filter(F.col("client_id") == client_id).orderBy("created_at", "signature").collect()
        return memory.Memory([memory.Record(*(r[name] for name in FIELDS)) for r in rows])


class Tiers:
    """Logs by priority. Every one is written to, each by itself; of those in reach, earlier ones count before later ones."""

    def __init__(self, *logs: RecordLog) -> None:
        self.logs = logs

    def _each(self, write) -> None:
        failed: list[Exception | None] = []
        for log in self.logs:
            try:
                write(log)
                failed.append(None)
            except Exception as error:  # noqa: BLE001  the other tiers are written all the same
                _LOG.warning("records were not written to %s: %s", log.path, error)
                failed.append(error)
        if failed and failed[0] is not None:  # the first tier is the one that counts
            raise failed[0]

    def remember(self, records: DataFrame) -> None:
        self._each(lambda log: log.remember(records))

    def forget(self, keys: DataFrame) -> None:
        self._each(lambda log: log.forget(keys))

    def lookup(self, requests: DataFrame) -> DataFrame:
        found = []
        for log in self.logs:
            try:
                found.append(log.current())
            except Exception as error:  # noqa: BLE001
                _LOG.warning("records at %s are out of reach: %s", log.path, error)
        return lookup(requests, found)


def _tags() -> Column:
    letters = F.create_map(*(F.lit(x) for n, tag in enumerate(TAGS) for x in (tag, chr(ord("A") + n))))
    return F.transform(F.split(F.element_at(F.split("signature", ":"), 2), ","), lambda tag: F.coalesce(letters[tag], F.lit("?")))


def lookup(requests: DataFrame, tiers: Sequence[DataFrame]) -> DataFrame:
    """For each request (``request_id, client_id, signature, headers``) with a record: ``via`` (``exact`` or ``fuzzy``), ``tier``, and the record's ``found_signature, sheet, label, created_at``.

    A record of the same signature counts before one alike, then earlier tiers before later
    ones, then the more similar record, the older one, and the lesser signature.
    """

    @F.pandas_udf("double")
    def headers_alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([memory.header_similarity(x.split("|"), y.split("|")) for x, y in zip(a, b, strict=True)], dtype="float64")

    spark = requests.sparkSession
    records = spark.createDataFrame([], f"{memory.SCHEMA}, tier int")
    for n, rows in enumerate(tiers):
        records = records.unionByName(rows.withColumn("tier", F.lit(n)))
    tags = _tags()
    asked = requests.select("request_id", "client_id", F.col("signature").alias("asked_signature"), F.col("headers").alias("asked_headers"), F.array_join(tags, "").alias("asked_tags"))
    known = records.withColumn("tags", F.array_join(tags, ""))
    about = ["tier", F.col("signature").alias("found_signature"), "sheet", "label", "created_at"]
    exact = asked.join(known, [asked["client_id"] == known["client_id"], asked["asked_signature"] == known["signature"]]).select("request_id", F.lit("exact").alias("via"), F.lit(1.0).alias("score"), *about)
    sizes = F.sequence(F.length("asked_tags") - COLUMN_DRIFT, F.length("asked_tags") + COLUMN_DRIFT)
    near = asked.withColumn("n", F.explode(sizes)).join(known.withColumn("n", F.length("tags")), ["client_id", "n"])
    near = near.withColumn("score", 1 - F.levenshtein("asked_tags", "tags") / F.greatest(F.length("asked_tags"), F.length("tags"))).filter(F.col("score") >= TAG_SIMILARITY)
    near = near.filter(headers_alike("asked_headers", "headers") >= HEADER_SIMILARITY).select("request_id", F.lit("fuzzy").alias("via"), "score", *about)
    # The least of what counts first, which is combined before the shuffle.
    order = F.struct(F.col("via") == "fuzzy", "tier", -F.col("score"), "created_at", "found_signature")
    best = exact.unionByName(near).groupBy("request_id").agg(F.min_by(F.struct("via", "tier", "found_signature", "sheet", "label", "created_at"), order).alias("r"))
    return best.select("request_id", "r.*")
