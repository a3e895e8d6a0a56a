"""Relevance and redundancy of text segments: BM25, salience, selection within a budget, shingles, repeated blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.config import TEXT
from condensa.functions.core import let
from condensa.kernels.prose import CJK, SALIENT

TOKEN = rf"[{CJK}]|[\p{{L}}\p{{N}}_&&[^{CJK}]]+"


def segments(text: Column) -> Column:
    """Sentences of the lines of a text: cut after . ! ? before white space, and after full-width ends."""
    cut = F.split(F.replace(text, F.lit("\n"), F.lit("\x00")), r"(?<=[.!?])[\s\x00]|(?<=[。！？])|\x00", -1)
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Lower-cased words; characters of scripts without spaces one by one; full-width forms folded."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    return F.regexp_extract_all(F.lower(F.translate(text, wide, narrow)), F.lit(TOKEN), F.lit(0))


def explode_segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), segment, of every text."""
    return docs.select(key, F.posexplode(segments(F.col(text))).alias("pos", "segment"))


def bm25(segs: DataFrame, key: str, pos: str, words: Column, query: list[str], normal: bool = True) -> DataFrame:
    """key, pos, relevance: of each segment for the distinct words of a query, the segments of a key being the corpus.

    The words of a segment are counted where it stands; only counts of documents are shuffled.
    """
    asked = sorted(set(query))

    def count(word: str) -> Column:
        return F.size(F.filter(F.col("__w"), lambda x: x == word))

    tf = [count(q) for q in asked]
    rows = segs.withColumn("__w", words).select(key, pos, F.size("__w").alias("len"), F.array(*tf).alias("tf"))
    corpus = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("mean"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(asked))]).alias("df")
    )

    def part(i: int) -> Column:
        idf = F.log((F.col("n") - F.col("df")[i] + 0.5) / (F.col("df")[i] + 0.5) + 1)
        f = F.col("tf")[i].cast("double")
        return F.when(f > 0, idf * (f * (TEXT.k1 + 1)) / (f + TEXT.k1 * (1 - TEXT.b + TEXT.b * F.col("len") / F.col("mean")))).otherwise(F.lit(0.0))

    total = sum((part(i) for i in range(len(asked))), F.lit(0.0))
    scored = rows.join(corpus, key).select(key, pos, total.alias("relevance"))
    if not normal:
        return scored
    top = scored.groupBy(key).agg(F.max("relevance").alias("top"))
    return scored.join(top, key).select(key, pos, F.when(F.col("top") > 0, F.col("relevance") / F.col("top")).otherwise(F.lit(0.0)).alias("relevance"))


def relevance_alone(document: Column, query: str) -> Column:
    """BM25 of one document that is the whole corpus; words of the query count as often as they stand in it."""
    asked = re.findall(r"[^\W_]+", query.lower())

    def score(ws: Column) -> Column:
        n = F.size(ws)
        norm = TEXT.k1 * (1 - TEXT.b + TEXT.b * n / F.greatest(n, F.lit(1)))

        def part(word: str) -> Column:
            f = F.size(F.filter(ws, lambda x: x == word))
            return F.when(f > 0, F.log(F.lit(0.5 / 1.5 + 1)) * f * (TEXT.k1 + 1) / (f + norm)).otherwise(F.lit(0.0))

        return sum((part(w) for w in asked), F.lit(0.0))

    return let(F.regexp_extract_all(F.lower(document), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), score)


def salience(words: Column) -> Column:
    """Share of words that are numbers or words of trouble."""
    hit = lambda w: w.rlike("[0-9]") | F.regexp_replace(w, "^_+|_+$", "").isin(*sorted(SALIENT))
    return let(words, lambda ws: F.size(F.filter(ws, hit)) / (F.size(ws) + 1.0))


def segment_score(pos: Column, n: Column, relevance: Column, salient: Column, nbytes: Column) -> Column:
    s = TEXT.recency * (pos + 1.0) / n + TEXT.relevance * relevance + TEXT.salience * salient
    return F.when(nbytes < TEXT.short_bytes, s * 0.25).otherwise(s)


def select_within(scored: DataFrame, key: str, pos: str, score: str, nbytes: str, ratio: float = TEXT.ratio) -> DataFrame:
    """Best segments until their bytes reach a share of all; the one that reaches it stays. Without redundancy rules."""
    w = Window.partitionBy(key)
    ranked = w.orderBy(F.desc(score), F.col(pos)).rowsBetween(Window.unboundedPreceding, -1)
    target = F.greatest(F.floor(F.sum(nbytes).over(w) * F.lit(ratio)), F.lit(1))
    kept = F.coalesce(F.sum(nbytes).over(ranked), F.lit(0)) < target
    return scored.withColumn("kept", kept).where("kept").drop("kept")


def shingles(words: Column, k: int = 3) -> Column:
    """Distinct runs of k words; of fewer words all shorter runs."""

    def runs(w: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), "\u0001"))
        return F.when(F.size(w) >= n, every).otherwise(F.array().cast("array<string>"))

    return let(words, lambda w: F.array_distinct(F.when(F.size(w) >= k, runs(w, k)).otherwise(F.concat(*[runs(w, n) for n in range(1, k)]))))


def containment(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_shingles: Column, right_shingles: Column, least: float = TEXT.near_dup) -> DataFrame:
    """left_key, right_key, share: how much of a right text's shingles a left text has, from ``least`` on.

    Met by 64-bit hashes of the shingles, so only texts that share one are compared, and no strings are shuffled; shingles
    that no right text has leave before anything is counted. Counts are added up, no text is collected.
    """
    hashed = lambda xs: F.array_distinct(F.transform(xs, lambda x: F.xxhash64(x)))
    b = right.select(right_key, hashed(right_shingles).alias("h")).select(right_key, F.size("h").alias("size"), F.explode("h").alias("s"))
    a = left.select(left_key, F.explode(hashed(left_shingles)).alias("s"))
    met = a.join(b, "s").groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    return met.select(left_key, right_key, (F.col("n") / F.col("size")).alias("share")).where(F.col("share") >= least)


def repeated_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, first_pos: paragraphs (parts between blank lines) that stand earlier in the same text."""
    parts = docs.select(key, F.posexplode(F.split(F.col(text), r"\n\s*\n", -1)).alias("pos", "block")).where(F.trim("block") != "")
    hashed = parts.select(key, "pos", F.sha2("block", 256).alias("h"))
    firsts = hashed.groupBy(key, "h").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return hashed.join(firsts, [key, "h"]).where(F.col("pos") > F.col("first_pos")).select(key, "pos", "first_pos")
