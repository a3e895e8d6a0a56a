"""Conversations: which messages belong together, what may be touched, and what a plan costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.functions.signals import CACHE_MULTIPLIERS, POLICY


def tool_pairs(messages: DataFrame, by: str, order: str, calls: Column, answers: Column) -> DataFrame:
    """by, tool_use_index, tool_result_index: a call directly followed by a message with its answer."""
    w = Window.partitionBy(by).orderBy(order)
    rows = messages.select(by, order, calls.alias("__call"), F.lead(answers).over(w).alias("__answered"), F.lead(order).over(w).alias("__next"))
    return rows.where(F.col("__call") & F.col("__answered")).select(by, F.col(order).alias("tool_use_index"), F.col("__next").alias("tool_result_index"))


def frozen_count(messages: DataFrame, by: str, order: str, cached: Column) -> DataFrame:
    """by, frozen: messages up to the last one with a cache mark, or 0."""
    return messages.groupBy(by).agg(F.coalesce(F.max(F.when(cached, F.col(order) + 1)), F.lit(0)).alias("frozen"))


def live_zone(messages: DataFrame, by: str, order: str, role: str, cached: Column) -> DataFrame:
    """by, floor, ceiling: from the first message that is not frozen to the last one of the user; without one no row."""
    zone = messages.groupBy(by).agg(
        F.coalesce(F.max(F.when(cached, F.col(order) + 1)), F.lit(0)).alias("floor"), F.max(F.when(F.col(role) == "user", F.col(order))).alias("ceiling")
    )
    return zone.where("ceiling >= floor")


def policy(plan: Column) -> tuple[Column, Column]:
    """(tokens that may go without a look, largest lossy ratio) of a plan."""
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in POLICY.items() for x in (k, float(v[i]))]), plan)
    return pick(0).cast("int"), pick(1)


def cache_cost(tokens: Column, kind: str) -> Column:
    """Cost of tokens in plain input tokens when they are written to, or read from, a prompt cache."""
    return tokens * F.lit(CACHE_MULTIPLIERS[kind])
