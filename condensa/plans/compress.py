"""The block pipeline over tables: cheap gates first, one pass through the kernel, stash before publishing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condensa.functions.core import has_marker, over_gate
from condensa.sources.requests import candidates, rebuild
from condensa.sources.stash import SCHEME, Stash

RESULT = T.StructType(
    [
        T.StructField("text", T.StringType()), T.StructField("status", T.StringType()), T.StructField("content_type", T.StringType()),
        T.StructField("tokens_before", T.LongType()), T.StructField("tokens_after", T.LongType()), T.StructField("key", T.StringType()),
        T.StructField("stash", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("content", T.StringType())]))),
    ]
)


#: A batch holds whole blocks: by the default of 10,000 rows it would grow with the blocks and with the rows of a task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Unless the session or its start has set sizes of batches, those that a kernel has room for."""
    for key, size in BATCH.items():
        if not spark._jsparkSession.sessionState().conf().contains(key):
            spark.conf.set(key, size)


def shrink(text: Column, query: Column, source_path: Column, stash_dir: str | None = None, conservative: bool = False, ratio: float | None = None) -> Column:
    """The kernel as a column: one struct a block. Declared nondeterministic, so that Spark evaluates it once."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from condensa.kernels.block import shrink_block

        for texts, queries, paths in batches:
            rows = []
            for t, q, p in zip(texts, queries, paths, strict=True):
                o = shrink_block(t, q or "", p or None, stash_dir, conservative=conservative, ratio=ratio)
                rows.append((o.text, o.status, o.content_type, o.tokens_before, o.tokens_after, o.key, [{"key": k, "content": c} for k, c in o.stash]))
            yield pd.DataFrame(rows, columns=[f.name for f in RESULT.fields])

    return F.pandas_udf(run, RESULT).asNondeterministic()(text, query, source_path)


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly over all cores, whatever files and row groups they come from.

    A row group is read by one task, however many splits its file has, and a kernel costs far more than a shuffle.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def compress_blocks(blocks: DataFrame, stash_dir: str | None = None, conservative: bool = False, ratio: float | None = None) -> DataFrame:
    """``blocks`` (text; query and source_path if there are such columns) with the struct ``result``.

    Blocks that are short, or hold a marker already, never reach Python: they are told apart by built-in functions, and
    their result is null. ``stash_dir``: line hints name lines left out by a file there and the key of the block;
    ``condensa.sources.stash.SCHEME`` for names that ``Stash.retrieve`` reads. ``conservative``: of plain text only exact
    repeats are left out; ``ratio``: else the share of its bytes that is kept.
    """
    small_batches(blocks.sparkSession)
    has = lambda c: F.col(c) if c in blocks.columns else F.lit(None).cast("string")
    fit = F.coalesce(over_gate("text") & ~has_marker("text"), F.lit(False))
    rows = blocks.withColumn("__fit", fit)
    ready = spread(rows.where("__fit"))
    done = ready.withColumn("result", shrink(F.col("text"), F.coalesce(has("query"), F.lit("")), F.coalesce(has("source_path"), F.lit("")), stash_dir, conservative, ratio))
    rest = rows.where(~F.col("__fit")).withColumn("result", F.lit(None).cast(RESULT))
    return done.unionByName(rest).drop("__fit")


def publish(compressed: DataFrame, stash: Stash, now: Column | None = None) -> DataFrame:
    """Store the originals, then publish: lossy texts whose keys are not all stored go back to the original.

    ``compressed`` is read twice, so it is stored between (checkpoint); returns its rows with output, status and
    tokens_saved.
    """
    from condensa.plans.scratch import cut

    rows = cut(compressed)
    entries = rows.where("result.status = 'lossy'").select(F.explode("result.stash").alias("e")).select("e.*")
    try:
        stash.put(entries, now)
    except Exception:  # noqa: BLE001  (any failure of the store means that nothing lossy may be published)
        stored = rows.sparkSession.createDataFrame([], "key string")
    else:
        stored = None
    needed = rows.where("result.status = 'lossy'").select(F.explode("result.stash.key").alias("key")).distinct()
    stored = stash.has(needed, now) if stored is None else stored
    missing = needed.join(stored, "key", "left_anti").select("key", F.lit(True).alias("missing"))
    # a block depends on several keys only if markers stand within its text
    blocked = (
        rows.where("result.status = 'lossy'").select(F.col("result.key").alias("__of"), F.explode("result.stash.key").alias("key"))
        .join(missing, "key").select("__of").distinct().withColumn("__blocked", F.lit(True))
    )
    out = rows.join(blocked, F.col("result.key") == F.col("__of"), "left").drop("__of")
    status = F.when(F.col("__blocked"), "reverted").otherwise(F.coalesce("result.status", F.lit("unchanged")))
    good = status.isin("lossless", "lossy")
    return out.select(
        *[c for c in compressed.columns if c != "result"], F.when(good, F.col("result.text")).otherwise(F.col("text")).alias("output"), status.alias("status"),
        F.col("result.content_type").alias("content_type"), F.when(status == "lossy", F.col("result.key")).alias("stash_key"),
        F.when(good, F.col("result.tokens_before") - F.col("result.tokens_after")).otherwise(F.lit(0)).alias("tokens_saved"),
    )


def compress_requests(requests: DataFrame, stash: Stash, now: Column | None = None, hints: bool = True) -> tuple[DataFrame, DataFrame]:
    """(requests with their blocks shrunk, counters by request). Messages are never dropped, the frozen prefix stays.

    ``hints``: lines that are left out are named by the entry of the stash that holds them.
    """
    blocks = candidates(requests)
    if "query" in requests.columns:
        blocks = blocks.join(requests.select("request_id", "query"), "request_id")
    done = publish(compress_blocks(blocks, SCHEME if hints else None), stash, now)
    changed = done.where(F.col("status").isin("lossless", "lossy")).select("request_id", "msg_idx", "part_idx", "field", F.col("output").alias("text"))
    return rebuild(requests, changed), counters(done, "request_id")


def counters(done: DataFrame, by: str) -> DataFrame:
    """examined, compressed, reverted, stash_stored and tokens_saved of published blocks."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return done.groupBy(by).agg(
        F.count_if(over_gate("text")).alias("examined"), n("lossless", "lossy").alias("compressed"), n("reverted").alias("reverted"),
        n("lossy").alias("stash_stored"), F.sum("tokens_saved").alias("tokens_saved"), (n("lossless", "lossy") > 0).alias("changed"),
    )
