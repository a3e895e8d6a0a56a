"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct buckets of its lower-cased words, of pairs of neighbours and of pairs with one
word between them. Weights are learned with per-coordinate rates and an L1 term (McMahan et al., 2013), so that few
buckets keep a weight; those few are what is broadcast.

The bias starts at the log-odds of the sample, smoothed, so that few labels do not make every text look doubtful.

Defined results: a null or empty text has the bias as its only feature; labels of a doc_id that occurs more than once
count as toxic if one of them is; null labels and null ids teach nothing; without any label every score is the
smoothed prior of an empty sample (0.1). Other columns of the input are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from condensa.llm.common import WordHashes, alnum_words, as_bytes, chunks, cut, lean, mix


@dataclass(frozen=True)
class FtrlConfig:
    bits: int = 20
    alpha: float = 0.7
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0
    #: How often the sample is streamed past the learner.
    epochs: int = 2
    #: The classifier is fitted on this many labelled rows at most (those of smallest hash of the id),
    max_train_rows: int = 16_384
    #: and of them on those whose buckets, four bytes each, take so many bytes together at most.
    max_train_bytes: int = 128_000_000


def buckets(words: list[bytes], hashes: WordHashes, bits: int) -> np.ndarray:
    """Buckets of the words, of neighbours and of words at a distance of two, repeats included."""
    h = hashes.of(words)
    left, skip = h * np.uint64(0x9E3779B97F4A7C15), h * np.uint64(0xC2B2AE3D27D4EB4F)
    every = np.concatenate([mix(h), mix(left[:-1] + h[1:]), mix(skip[:-2] + h[2:] + np.uint64(1))])
    return (every >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """State of the learner: z and n by bucket; the last coordinate is the bias, which is added to ``offset``."""

    def __init__(self, config: FtrlConfig, offset: float = 0.0):
        self.c, self.offset = config, offset
        self.z, self.n = (np.zeros((1 << config.bits) + 1) for _ in range(2))

    def weights(self, at: np.ndarray) -> np.ndarray:
        c, z = self.c, self.z[at]
        w = (np.sign(z) * c.l1 - z) / ((c.beta + np.sqrt(self.n[at])) / c.alpha + c.l2)
        return np.where(np.abs(z) <= c.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, self.offset + float(w.sum()))))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.c.alpha * w
        self.n[at] = n + g * g


def prior(toxic: int, rows: int) -> float:
    """Log-odds of the share of toxic rows, as if ten more had been seen and one of them were toxic."""
    return math.log((toxic + 1) / (rows - toxic + 9))


def fit(docs: DataFrame, labels: DataFrame, config: FtrlConfig = FtrlConfig()) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); returns buckets, weights and bias.

    Features are made where the texts are; one task then holds the state and the buckets of the sample, both of bounded
    size, and streams over them once for each epoch.
    """
    c = config
    sample = (
        labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(c.max_train_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            texts = as_bytes(b.column("text"))
            out = [np.unique(buckets(alnum_words(t), hashes, c.bits)).astype(np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("toxic"), pa.array(out, pa.binary())], ["h", "toxic", "at"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += [(int(label > 0), np.frombuffer(at, np.int32)) for label, at in zip(b.column("toxic").to_pylist(), b.column("at").to_pylist(), strict=True)]
        model = Ftrl(c, prior(sum(label for label, _ in rows), len(rows)))
        for _ in range(c.epochs):
            for label, at in rows:
                model.learn(at.astype(np.int64), label)
        if rows:
            w = model.weights(np.arange(len(model.z)))
            w[-1] += model.offset
            keep = np.union1d(np.flatnonzero(w), [len(w) - 1])
            yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(w[keep])], ["at", "w"])

    # one task sees the rows in a fixed order, so that the model does not depend on the layout of the input
    made = cut(lean(texts).select("h", "toxic", "text").mapInArrow(features, "h long, toxic int, at binary"))
    sizes = made.groupBy("h").agg(F.sum(F.octet_length("at") + 16).alias("size"))  # max_train_rows rows at most
    upto = sizes.select("h", F.sum("size").over(Window.orderBy("h")).alias("upto")).where(F.col("upto") <= c.max_train_bytes).agg(F.max("h")).first()[0]
    own = made.where(F.col("h") <= (F.lit(None).cast("long") if upto is None else F.lit(upto)))
    model = own.repartition(1).sortWithinPartitions("h", "at").mapInArrow(learn, "at long, w double").toPandas()
    if model.empty:
        return np.zeros(0, np.int64), np.zeros(0), prior(0, 0)
    at, w = model["at"].to_numpy(), model["w"].to_numpy()
    last = at == 1 << c.bits
    return at[~last], w[~last], float(w[last].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], config: FtrlConfig = FtrlConfig(), name: str = "score") -> DataFrame:
    """``docs`` with the score of the whole ``text`` as a last column. The weights are bounded by 2**bits entries."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = config.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        table = np.zeros(1 << bits)
        table[at] = w
        hashes = WordHashes()
        for b in batches:
            texts = as_bytes(b.column("text"))
            out = np.zeros(len(texts))
            for i, j in chunks([len(t) for t in texts]):
                for k in range(i, j):
                    got = buckets(alnum_words(texts[k]), hashes, bits)
                    got = np.unique(got[table[got] != 0])
                    out[k] = table[got].sum()
            out = 1 / (1 + np.exp(-np.clip(out + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, name])

    return lean(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """True for the rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, config: FtrlConfig = FtrlConfig(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels.where(~held_out()), config), config)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
