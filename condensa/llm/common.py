"""Pieces that several training-data operators share: scratch space, chunks of texts, word cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts are handled in chunks of about so many bytes, so that a Python worker holds few words at a time.
CHUNK_BYTES = 2_000_000

#: Maps A-Z to a-z and every ASCII byte that is not a letter or digit to a space; bytes over 0x7F are word bytes.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


#: Folders that this process has named and not removed.
_named: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A fresh folder name under the shared scratch folder of the session (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder of its own.
    """
    _named.append(f"{shared_dir(spark)}/condensa-{uuid.uuid4().hex}")
    return _named[-1]


def remove_scratch(spark: SparkSession) -> int:
    """Delete the folders named so far, with all that was written to names that begin like them; returns how many.

    Results are lazy and may still read them: for when they are written or no longer needed.
    """
    n, path = 0, spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _named:
        every = path(_named.pop() + "*")
        fs = every.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.globStatus(every) or []:
            n += bool(fs.delete(found.getPath(), True))
    return n


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if where:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(where)
        return where.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="condensa-")
    sc.setCheckpointDir(where)
    return where


#: Rows of a few numbers for each file of a checkpoint whose number of rows is known.
ROWS_PER_FILE = 250_000


def cut(df: DataFrame, rows: int | None = None, few: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    With ``rows``, the most rows that ``df`` can have, a small result is not written as a file for each partition. With
    ``few``, for results that are small against what they are made from, it is dealt out to a sixteenth of the partitions.
    """
    shared_dir(df.sparkSession)
    if few:
        df = df.repartition(-(-shuffle_partitions(df.sparkSession) // 16))
    return (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))).checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Give up the files of shuffles that nothing refers to any more.

    Spark removes them when the driver's garbage is collected, which by itself may be when the disks are full.
    """
    spark.sparkContext._jvm.System.gc()


#: Rows of a batch, between Spark and Python and of the Parquet reader. Those of the defaults take tens of megabytes of
#: texts, several times over, in each worker and executor.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def lean(df: DataFrame) -> DataFrame:
    """``df``, after setting ``BATCHES`` in its session, but for what the session or its start has set itself.

    This outlives the query: plans are made when a result is asked for, so the settings have to hold then.
    """
    spark = df.sparkSession
    own, started = spark._jsparkSession.sessionState().conf().settings(), spark.sparkContext.getConf()
    for key, value in BATCHES.items():
        if not own.containsKey(key) and not started.contains(key):
            spark.conf.set(key, value)
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes together, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and bytes over 0x7F."""
    return text.translate(ALNUM_TABLE).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiply and shift, twice)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash by word; forgets all beyond a bounded number of words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
