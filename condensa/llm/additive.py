"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one codeword from each of several codebooks, all of full dimension. Codebooks
start as those of the residuals and are then fitted together by least squares. Codes are found by beam search and
stored with the norm of their sum. A query scores codes by lookup tables of its products with the codewords; the best
of each block are scored again by the exact cosine of the original vectors.

Rows are dealt out to cells, sums of coarse residual codewords, of which there are as many as the rows ask for. A query
goes to its nearest cells only, as many as reach nearly all true neighbours within the fitted sample; so the work grows
with the rows, not with rows times queries. Large cells are divided into blocks of bounded size. Of equal vectors only
the ids that can be among the nearest take part, and equal queries are asked once.

Every row is indexed; only cells and codebooks are fitted on a bounded sample. Defined results: vectors that are null,
zero, or hold null or non-finite components take no part, nor do those of another length than the most common one; rows
of the query's own id are not its neighbours; repeated rows of an id count once, with their nearest vector; a repeated
query id asks with its smallest vector. Null ids take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm.common import cut


@dataclass(frozen=True)
class AqConfig:
    codebooks: int = 8
    codewords: int = 64
    beam: int = 4
    #: Cells and codebooks are fitted on this many vectors at most (those of smallest hash of the id).
    sample: int = 4096
    rounds: int = 4
    #: A cell is to hold so many rows; a level of cells has so many codewords at most.
    cell_rows: int = 2048
    cell_words: int = 256
    #: A query is asked in as many cells as hold this share of the true neighbours within the sample, measured with so many queries.
    aim: float = 0.98
    trials: int = 512
    block: int = 2048
    query_block: int = 256
    #: Of each block, so many rows (and all rows that score like the last of them) are scored exactly.
    rerank: int = 512
    seed: int = 7


class Codebooks:
    def __init__(self, books: np.ndarray):
        self.books = books  # (m, k, d)
        self.square = (books**2).sum(axis=2)

    def encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        """Beam search: after each codebook, the ``beam`` sums nearest to each vector go on."""
        m, k, _ = self.books.shape
        n = len(x)
        rest, cost, codes = x[:, None, :], np.zeros((n, 1)), np.zeros((n, 1, 0), np.uint8)
        for i in range(m):
            gain = self.square[i] - 2 * rest @ self.books[i].T  # of each codeword on each residual
            total = (cost[:, :, None] + gain).reshape(n, -1)
            keep = min(beam if i < m - 1 else 1, total.shape[1])
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < total.shape[1] else np.argsort(total, axis=1)
            cost = np.take_along_axis(total, best, axis=1)
            before, word = best // k, best % k
            codes = np.concatenate([np.take_along_axis(codes, before[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
            rest = np.take_along_axis(rest, before[:, :, None], axis=1) - self.books[i][word]
        return codes[:, 0]

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[i][codes[:, i]] for i in range(len(self.books)))


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means: centres, and the nearest one of each row."""
    near_to = lambda centre: ((centre**2).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        own = (near_to(centre)[:, None] == np.arange(k)).astype(float)
        count, total = own.sum(axis=0), own.T @ x
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre, near_to(centre)


def fit(x: np.ndarray, c: AqConfig) -> Codebooks:
    """Codebooks of the residuals by k-means, then ``rounds`` of beam search and joint least squares."""
    rng = np.random.default_rng(c.seed)
    rest, books = x.copy(), []
    k = min(c.codewords, max(1, len(x)))
    for _ in range(c.codebooks):
        centre, near = _centres(rest, k, rng)
        books.append(centre)
        rest = rest - centre[near]
    found = Codebooks(np.array(books))
    for _ in range(c.rounds):
        codes = found.encode(x, c.beam)
        hot = np.zeros((len(x), c.codebooks * k))
        hot[np.arange(len(x))[:, None], codes + k * np.arange(c.codebooks)] = 1
        gram = hot.T @ hot + 1e-2 * np.eye(hot.shape[1])
        old = found.books.reshape(-1, x.shape[1])
        new = np.linalg.solve(gram, hot.T @ x + 1e-2 * old)
        found = Codebooks(new.reshape(c.codebooks, k, -1))
    return found


class Cells:
    """Sums of one codeword of each level; a row belongs to the nearest one, a query looks into the nearest ``probes``."""

    #: Cells of a query that are put in order at most.
    MOST = 4096

    def __init__(self, x: np.ndarray, rows: int, c: AqConfig):
        want = max(1, rows // c.cell_rows)
        levels = max(1, math.ceil(math.log(want, c.cell_words) - 1e-9)) if want > 1 else 1
        k = min(len(x), math.ceil(want ** (1 / levels)))
        rng = np.random.default_rng(c.seed + 1)
        rest, books = x, []
        for _ in range(levels):
            centre, near = _centres(rest, k, rng)
            books.append(centre)
            rest = rest - centre[near]
        self.books = np.array(books)
        self.count = k**levels
        self.probes = min(self.count, self.MOST)
        if self.count > 1:
            self.probes = self._calibrated(x, c)

    def nearest(self, x: np.ndarray, many: int) -> np.ndarray:
        """The ``many`` nearest cells of each row, nearest first, by beam search over the levels."""
        n, k = len(x), self.books.shape[1]
        beam = max(many, 8)
        rest, cost, cell = x[:, None, :], np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for book in self.books:
            total = (cost[:, :, None] + (book**2).sum(axis=1) - 2 * rest @ book.T).reshape(n, -1)
            best = np.argsort(total, axis=1, kind="stable")[:, :beam]
            cost = np.take_along_axis(total, best, axis=1)
            before, word = best // k, best % k
            cell = np.take_along_axis(cell, before, axis=1) * k + word
            rest = np.take_along_axis(rest, before[:, :, None], axis=1) - book[word]
        return cell[:, :many]

    def _calibrated(self, x: np.ndarray, c: AqConfig) -> int:
        own = np.concatenate([self.nearest(x[i : i + 512], 1)[:, 0] for i in range(0, len(x), 512)])
        asked = np.random.default_rng(c.seed + 2).choice(len(x), min(c.trials, len(x)), replace=False)
        ranks = []
        for i in range(0, len(asked), 64):
            at = asked[i : i + 64]
            order = self.nearest(x[at], self.probes)
            exact = x[at] @ x.T
            exact[np.arange(len(at)), at] = -np.inf
            near = np.argsort(-exact, axis=1)[:, :5]
            place = own[near][:, :, None] == order[:, None, :]
            ranks.append(np.where(place.any(axis=2), place.argmax(axis=2), self.probes - 1).ravel())
        return int(np.quantile(np.concatenate(ranks), c.aim, method="higher")) + 1


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part, as arrays of float or double."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("x")).where("vec_id is not null and x is not null")
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("x", lambda v: v != 0))
    size = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("x") == (size["n"] if size else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    top = np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components are not finite, or zero
    x = x / np.where(top > 0, top, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _in_cells(rows: DataFrame, cells: Broadcast, many: int | None, per_block: int) -> DataFrame:
    """(cell, part, vec_id, x) of each row in its nearest cells; a part is about ``per_block`` rows of a cell."""
    kind = rows.schema["x"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cells.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                own = b.slice(i, 512)
                cell = known.nearest(_unit(_matrix(own.column("x"))), many or known.probes)
                row = pa.array(np.repeat(np.arange(len(cell)), cell.shape[1]))
                yield pa.RecordBatch.from_arrays([own.column("vec_id").take(row), own.column("x").take(row), pa.array(cell.ravel())], ["vec_id", "x", "cell"])

    placed = cut(rows.select("vec_id", "x").mapInArrow(run, f"vec_id long, x {kind}, cell long"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("parts"))
    return placed.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "parts").alias("part"), "vec_id", "x")


def _packed(rows: DataFrame, block: int, books: Broadcast | None, beam: int, prefix: str = "") -> DataFrame:
    """Rows (cell, n, ids, x, codes, norms) of up to ``block`` vectors of one cell; codes only with ``books``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Codebooks(books.value) if books is not None else None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last, size = None, 0

        def out() -> Iterator[pa.RecordBatch]:
            ids, x = (np.concatenate(p) for p in zip(*held, strict=True))
            for s in range(0, len(ids), block):
                own, vectors, codes, norms = ids[s : s + block], x[s : s + block], b"", b""
                if found is not None:
                    unit = _unit(vectors)
                    code = np.concatenate([found.encode(unit[i : i + 512], beam) for i in range(0, len(unit), 512)])
                    codes, norms = code.tobytes(), np.linalg.norm(found.decoded(code), axis=1).tobytes()
                columns = [last[0], len(own), own.tobytes(), vectors.tobytes(), codes, norms]
                types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types, strict=True)], [x.split(" ")[0] for x in schema.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            cell, part = b.column("cell").to_numpy(), b.column("part").to_numpy()
            ids, x = b.column("vec_id").to_numpy(), _matrix(b.column("x"))
            edges = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(cell)]
            for s, e in zip(edges, edges[1:]):
                if held and (last != (cell[s], part[s]) or size >= block):
                    yield from out()
                    held, size = [], 0
                last = (cell[s], part[s])
                held.append((ids[s:e], x[s:e]))
                size += e - s
        if held:
            yield from out()

    schema = "cell long, " + ", ".join(prefix + x for x in ("n int", "ids binary", "x binary", "codes binary", "norms binary"))
    return rows.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(run, schema)


def _meet(books: np.ndarray, candidates: dict, queries: dict, rerank: int, top: int, kind: type = np.float64) -> tuple[np.ndarray, ...]:
    """Best rows of one block for the queries of another: lookup tables first, exact cosines of the best."""
    ids, x = np.frombuffer(candidates["ids"], np.int64), np.frombuffer(candidates["x"], kind).reshape(candidates["n"], -1).astype(float)
    codes = np.frombuffer(candidates["codes"], np.uint8).reshape(len(ids), -1)
    norms = np.maximum(np.frombuffer(candidates["norms"]), 1e-300)
    q_ids, q = np.frombuffer(queries["q_ids"], np.int64), np.frombuffer(queries["q_x"], kind).reshape(queries["q_n"], -1).astype(float)
    if rerank < len(ids):
        tables = np.einsum("qd,mkd->mqk", q, books)
        score = np.zeros((len(q), len(ids)))
        for i in range(len(books)):
            score += tables[i][:, codes[:, i]]
        score /= norms
        least = np.partition(score, -rerank, axis=1)[:, -rerank]
    sizes = np.sqrt((x * x).sum(axis=1))
    out: list[tuple[np.ndarray, ...]] = []
    for i in range(len(q)):
        at = np.flatnonzero(score[i] >= least[i]) if rerank < len(ids) else np.arange(len(ids))
        exact = (x[at] * q[i]).sum(axis=1) / (np.sqrt((q[i] * q[i]).sum()) * sizes[at])
        best = np.lexsort((ids[at], -exact))
        _, once = np.unique(ids[at][best], return_index=True)
        best = best[np.sort(once)][:top]
        out.append((np.full(len(best), q_ids[i]), ids[at][best], exact[best]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, top: int = 5, config: AqConfig = AqConfig()) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest rows of ``vectors`` (vec_id, embedding) of each query.

    ``queries`` are rows of the same columns; if not given, the rows whose id is divisible by 50.
    """
    c, spark = config, vectors.sparkSession
    schema, sc, ids = "query_id long, rank int, vec_id long, score double", spark.sparkContext, vectors.schema["vec_id"].dataType
    rows = _usable(vectors)
    asked = rows.where("vec_id % 50 = 0") if queries is None else _usable(queries)
    asked = asked.groupBy("vec_id").agg(F.min("x").alias("x"))
    # of equal vectors a query can have no more than the first ``top`` ids, and its own, among its nearest
    first = Window.partitionBy("x").orderBy("vec_id")
    kept = cut(rows.dropDuplicates(["vec_id", "x"]).withColumn("r", F.row_number().over(first)).where(F.col("r") <= top + 1).drop("r"))
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(c.sample).select("x").toPandas()
    if sample.empty:
        return spark.createDataFrame([], schema)
    fitted = _unit(np.stack(sample["x"].to_numpy()))
    books = sc.broadcast(fit(fitted, c).books)  # codebooks * codewords * dimensions numbers
    cells = sc.broadcast(Cells(fitted, kept.count(), c))  # levels * cell_words * dimensions numbers
    classes = asked.groupBy("x").agg(F.min("vec_id").alias("vec_id"))  # equal queries are one
    blocks = _packed(_in_cells(kept, cells, 1, c.block), c.block, books, c.beam)
    sent = _packed(_in_cells(classes, cells, None, c.query_block), c.query_block, None, 0, "q_").drop("q_codes", "q_norms")
    kind = np.float32 if kept.schema["x"].dataType.simpleString() == "array<float>" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                got = _meet(books.value, row, row, c.rerank, top + 1, kind)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["class", "vec_id", "score"])

    near = blocks.join(sent, "cell").mapInArrow(run, "class long, vec_id long, score double").groupBy("class", "vec_id").agg(F.max("score").alias("score"))
    order = (F.desc("score"), "vec_id")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(*order))).where(F.col("r") <= top + 1).drop("r")
    each = asked.join(classes.withColumnRenamed("vec_id", "class"), "x").select(F.col("vec_id").alias("query_id"), "class")
    ranked = each.join(cut(near), "class").where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select(F.col("query_id").cast(ids).alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast(ids).alias("vec_id"), "score")
