"""Requests as a stream: each micro-batch is shrunk, stashed and then published, so that a replay does no harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from condensa.plans.compress import compress_blocks, compress_requests, publish
from condensa.sources.stash import SCHEME, Stash


def _run(stream: DataFrame, path: str, checkpoint: str, batch: Callable[[DataFrame], DataFrame], available_now: bool) -> StreamingQuery:
    def write(rows: DataFrame, batch_id: int) -> None:
        # one folder a batch: a replayed batch overwrites what it wrote before; entries of the stash go by content
        batch(rows).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_requests(requests: DataFrame, stash: Stash, path: str, checkpoint: str, available_now: bool = True, hints: bool = True) -> StreamingQuery:
    """Write the requests (request_id, body) with their blocks shrunk; ``hints`` as in ``compress_requests``."""
    return _run(requests, path, checkpoint, lambda rows: compress_requests(rows, stash, hints=hints)[0], available_now)


def stream_blocks(blocks: DataFrame, stash: Stash, path: str, checkpoint: str, available_now: bool = True, hints: bool = True) -> StreamingQuery:
    """Write the blocks (any columns with text) with output, status and tokens_saved; ``hints`` as for requests."""
    return _run(blocks, path, checkpoint, lambda rows: publish(compress_blocks(rows, SCHEME if hints else None), stash), available_now)
