"""Single texts and requests, without a table: for notebooks and tests. Tables go through ``condensa.plans``."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from condensa.kernels.block import Outcome, shrink_block
from condensa.plans.compress import compress_blocks, compress_requests, publish
from condensa.sources.stash import SCHEME, Stash


@dataclass
class Condenser:
    """An engine bound to one stash."""

    spark: SparkSession
    stash: Stash
    #: Lines that are left out are named by the entry of the stash that holds them.
    hints: bool = True

    @classmethod
    def create(cls, spark: SparkSession, stash_dir: str | None = None, hints: bool = True) -> Condenser:
        return cls(spark, Stash(spark, stash_dir), hints)

    def text(self, text: str, query: str | None = None, source_path: str | None = None, conservative: bool = False, ratio: float | None = None) -> dict:
        row = self.spark.createDataFrame([(text, query, source_path)], "text string, query string, source_path string")
        return publish(compress_blocks(row, SCHEME if self.hints else None, conservative, ratio), self.stash).first().asDict()

    def request(self, body: str, query: str | None = None) -> tuple[str, dict]:
        row = self.spark.createDataFrame([("1", body, query)], "request_id string, body string, query string")
        out, counts = compress_requests(row, self.stash, hints=self.hints)
        found = counts.first()
        return out.first()["body"], found.asDict() if found else {"changed": False}

    def retrieve(self, key: str) -> str | None:
        return self.stash.retrieve(key)

    def retrieve_lines(self, key: str, start: int, count: int):
        """Lines of an entry, by its key or by the name that a line hint gives."""
        row = self.stash.get_lines(self.spark.createDataFrame([(self.stash.key_of(key),)], "key string"), start, count).first()
        return row["slice"]


def preview(text: str, query: str = "", source_path: str | None = None) -> Outcome:
    """What the pipeline would make of a text; nothing is stored."""
    return shrink_block(text, query, source_path)


def register(spark: SparkSession) -> None:
    """Make the column functions callable from SQL: condensa_tokens, condensa_key, condensa_type."""
    @F.pandas_udf("string")
    def kind(texts: pd.Series) -> pd.Series:
        from condensa.kernels.detect import content_type

        return texts.map(lambda t: content_type(t or ""))

    spark.udf.register("condensa_type", kind)
    for name, sql in {
        "condensa_tokens(x STRING) RETURNS BIGINT": "ceil(octet_length(x) / 4.0D * 1.2D)",
        "condensa_key(x STRING) RETURNS STRING": "substring(sha2(x, 256), 1, 24)",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURN {sql}")
