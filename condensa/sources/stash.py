"""The stash: originals of lossy blocks in a table (key, content, stored_at), found by the hash of their content.

Entries lie in folders by the time from which all of them have expired. So expired ones go by whole folders, nothing
that is live is ever rewritten, and a job that fails at any step leaves every live entry where it is.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.config import STASH
from condensa.functions.core import line_slice, valid_key

SCHEMA = "key string, content string, stored_at timestamp"
#: A line hint names an entry of the stash by this, a slash and its key.
SCHEME = "stash:"
#: The column by which the folders are named: seconds since 1970 from which the entries there have expired.
UNTIL = "expired_from"


def stash_dir() -> str:
    """Where the stash is if nobody says: ``CONDENSA_STASH_DIR``, else a folder of the user."""
    return os.environ.get("CONDENSA_STASH_DIR") or os.path.join(os.path.expanduser("~"), ".condensa", "stash")


class Stash:
    """A folder of Parquet files, any store that Spark writes. Entries of equal key have equal content."""

    def __init__(self, spark: SparkSession, path: str | None = None, ttl_seconds: int = STASH.ttl_seconds):
        self.spark, self.path, self.ttl = spark, (path or stash_dir()).rstrip("/"), ttl_seconds
        #: Expired entries stay on disk for so long at most.
        self.slot = max(1, ttl_seconds // 6)

    def _place(self):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        place, fs = self._place()
        return fs.exists(place)

    def _stored(self) -> DataFrame:
        schema = f"{SCHEMA}, {UNTIL} bigint"
        return self.spark.read.schema(schema).parquet(self.path) if self.exists() else self.spark.createDataFrame([], schema)

    def table(self) -> DataFrame:
        return self._stored().drop(UNTIL)

    def _now(self, now: Column | None) -> Column:
        return now if now is not None else F.current_timestamp()

    def _fresh(self, now: Column | None, seconds: int) -> DataFrame:
        """Entries of the last ``seconds``; folders that are older than the time to live are not listed."""
        cutoff = self._now(now) - F.make_interval(secs=F.lit(seconds))
        return self._stored().where((F.col(UNTIL) > F.unix_seconds(self._now(now))) & (F.col("stored_at") >= cutoff))

    def put(self, rows: DataFrame, now: Column | None = None) -> None:
        """Store (key, content) rows; returns when they are durable. Keys of a wrong form are an error.

        What was stored within the first half of the time to live is not stored again, so that a replayed batch adds
        nothing.
        """
        rows = rows.where(F.assert_true(valid_key("key"), F.lit("a stash key has 24 hex digits")).isNull())
        rows = rows.select("key", "content").dropDuplicates(["key"]).join(self._fresh(now, self.ttl // 2).select("key"), "key", "left_anti")
        rows = rows.withColumn("stored_at", self._now(now).cast("timestamp"))
        # the slot ends after the entry was stored; its entries have expired a time to live later
        until = (F.floor(F.unix_seconds("stored_at") / self.slot) + 1) * self.slot + self.ttl
        rows.withColumn(UNTIL, until.cast("bigint")).write.mode("append").partitionBy(UNTIL).parquet(self.path)

    def has(self, keys: DataFrame, now: Column | None = None) -> DataFrame:
        """The ``keys`` (key) that are stored and live; no content is read."""
        return keys.join(self._fresh(now, self.ttl).select("key"), "key", "left_semi")

    def live(self, now: Column | None = None) -> DataFrame:
        """(key, content, stored_at) of the entries that have not expired, the newest of each key."""
        rows = self._fresh(now, self.ttl)
        return rows.groupBy("key").agg(F.max(F.struct("stored_at", "content")).alias("e")).select("key", "e.content", "e.stored_at")

    def get(self, keys: DataFrame, now: Column | None = None) -> DataFrame:
        """``keys`` with content, null where there is none."""
        return keys.join(self.live(now).select("key", "content"), "key", "left")

    def get_lines(self, keys: DataFrame, start: int, count: int, now: Column | None = None) -> DataFrame:
        """``keys`` with the struct slice (text, start_line, line_count, total_lines, has_more); null beyond the end."""
        return self.get(keys, now).withColumn("slice", line_slice("content", start, count)).drop("content")

    def retrieve(self, key: str, now: Column | None = None) -> str | None:
        """Content of a key, or of what a line hint names as its file."""
        row = self.get(self.spark.createDataFrame([(self.key_of(key),)], "key string"), now).first()
        return row and row["content"]

    def purge_expired(self, now: Column | None = None) -> int:
        """Delete the folders of which all entries have expired; returns how many entries that were."""
        if not self.exists():
            return 0
        old = self._stored().where(F.col(UNTIL) <= F.unix_seconds(self._now(now))).groupBy(UNTIL).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a slot
        place, fs = self._place()
        for row in old:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, f"{UNTIL}={row[UNTIL]}"), True)
        return sum(row["n"] for row in old)

    @staticmethod
    def file_path(key: str) -> str:
        """What line hints name as the file of an entry; ``retrieve`` and ``Condenser.retrieve_lines`` read it."""
        return f"{SCHEME}/{key}"

    @staticmethod
    def key_of(name: str) -> str:
        return name.removeprefix(f"{SCHEME}/")
