"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table of segments. A segment holds the words of some documents as postings: by word the
ascending positions in the segment. A phrase is looked up from its rarest word in the segment: the positions of the
other words, less their offset in the phrase, are intersected with what is left, and the work ends when nothing is.
Words are compared themselves, not hashes, so matches are exact. With ``slop`` a phrase also matches if its words
stand in order with so many other words between them.

Defined results: null or empty texts have no words, match nothing and still give a row; items without words or without
an id match nothing; items of the same id are one item; repeated documents each give a row. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.llm.common import alnum_words, as_bytes, chunks, lean, scratch

SEGMENT_BYTES = 4_000_000
#: Test items are broadcast in blocks of about so many windows, whatever the size of the benchmark: some 50 MB of
#: Python objects. Longer items go on in the next block, with a window's overlap.
BLOCK_WINDOWS = 200_000
INDEX = "segment string, doc_ids array<{ids}>, doc_starts binary, terms binary, term_starts binary, positions binary"


class Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _pack(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(np.diff(x, prepend=x.dtype.type(0)).tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, dtype: type) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    got = pa.decompress(raw[8:], n * np.dtype(dtype).itemsize, "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(got, dtype), dtype=dtype)


def segment(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Starts of the texts, terms, starts of the terms' postings, positions."""
    numbers = Numbers()
    counts, codes = [], []
    for t in texts:
        words = alnum_words(t)
        counts.append(len(words))
        codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
    code = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    positions = np.argsort(code, kind="stable").astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(numbers)))]).astype(np.uint32)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32), list(numbers), starts, positions


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the segments of ``docs`` (doc_id, text) to ``path`` and return them."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column("text"))
            for i, j in chunks([len(t) for t in texts], SEGMENT_BYTES):
                docs_at, terms, starts, positions = segment(texts[i:j])
                own = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column("doc_id").slice(i, j - i))
                packed = [_pack(docs_at), pa.compress(b" ".join(terms), "zstd", asbytes=True), _pack(starts), _pack(positions)]
                packed[1] = sum(map(len, terms) , max(0, len(terms) - 1)).to_bytes(8, "little") + packed[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), own, *[pa.array([x], pa.binary()) for x in packed]],
                    ["segment", "doc_ids", "doc_starts", "terms", "term_starts", "positions"],
                )

    lean(docs).select("doc_id", "text").mapInArrow(run, INDEX.format(ids=ids)).write.parquet(path)
    return docs.sparkSession.read.schema(INDEX.format(ids=ids)).parquet(path)


class Phrases:
    """Windows of test items as rows of word numbers, by length; each with the items that hold it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers = Numbers()
        self.items = sorted({i for i, _ in items})
        at = {x: k for k, x in enumerate(self.items)}
        holders: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            code = [self.numbers[w] for w in alnum_words(text)]
            for s in range(max(1, len(code) - window + 1) if code else 0):
                holders.setdefault(tuple(code[s : s + window]), set()).add(at[item])
        self.words = list(self.numbers)
        lengths = sorted({len(k) for k in holders})
        by = {n: [k for k in holders if len(k) == n] for n in lengths}
        self.by_length = [(np.array(by[n], np.int64), [sorted(holders[k]) for k in by[n]]) for n in lengths]


class Segment:
    """Postings of one segment, opened for search."""

    def __init__(self, doc_starts: bytes, terms: bytes, term_starts: bytes, positions: bytes):
        self.docs, self.starts, self.positions = (_unpack(x, np.uint32).astype(np.int64) for x in (doc_starts, term_starts, positions))
        n = int.from_bytes(terms[:8], "little")
        self.terms = {w: i for i, w in enumerate(pa.decompress(terms[8:], n, "zstd", asbytes=True).split(b" "))} if n else {}

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.starts[term] : self.starts[term + 1]]

    def find(self, phrases: Phrases, slop: int = 0) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(items, first positions, last positions) of each phrase that occurs."""
        own = np.fromiter((self.terms.get(w, -1) for w in phrases.words), np.int64, len(phrases.words))
        count = np.diff(self.starts)
        for rows, items in phrases.by_length:
            code = own[rows]
            for r in np.flatnonzero((code >= 0).all(axis=1)):
                row = code[r]
                got = self._exact(row, count) if not slop else self._near(row, count, slop)
                if got is not None:
                    first, last = got
                    one = np.searchsorted(self.docs, first, "right") == np.searchsorted(self.docs, last, "right")
                    if one.any():
                        yield items[r], first[one], last[one]

    def _exact(self, row: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        order = np.argsort(count[row], kind="stable")
        first = self.postings(row[order[0]]) - order[0]
        for k in order[1:]:
            other = self.postings(row[k])
            at = np.searchsorted(other, first + k)
            first = first[other[np.minimum(at, len(other) - 1)] == first + k]
            if not len(first):
                return None
        first = first[first >= 0]
        return (first, first + len(row) - 1) if len(first) else None

    def _near(self, row: np.ndarray, count: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray] | None:
        anchor = int(np.argmin(count[row]))
        first = last = self.postings(row[anchor])
        for k in range(anchor + 1, len(row)):
            other = self.postings(row[k])
            at = np.searchsorted(other, last, "right")
            ok = at < len(other)
            first, last = first[ok], other[at[ok]]
        for k in range(anchor - 1, -1, -1):
            other = self.postings(row[k])
            at = np.searchsorted(other, first, "left") - 1
            ok = at >= 0
            first, last = other[at[ok]], last[ok]
        ok = last - first < len(row) + slop
        return (first[ok], last[ok]) if ok.any() else None


def _blocks(items: DataFrame, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items (item_id as string, words) in blocks of bounded size; one block is on the driver at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        words = alnum_words((r[1] or "").encode())
        for s in range(0, max(1, len(words) - window + 1), BLOCK_WINDOWS):
            piece = words[s : s + BLOCK_WINDOWS + window - 1]
            if block and size + len(piece) > BLOCK_WINDOWS + window - 1:
                yield block
                block, size = [], 0
            block.append((r[0], b" ".join(piece)))
            size += len(piece)
    yield block


def search(index: DataFrame, items: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """(segment, place, doc_id, n_words, item_ids, runs) per document; runs are the covered positions as [start, end) pairs.

    ``items`` has item_id and text. A benchmark of more than one block gives rows per block, which are then united.
    """
    ids = index.schema["doc_ids"].dataType.elementType.simpleString()
    named = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    out = None
    many = 0
    for block in _blocks(named, window):
        part = _search_block(index, Phrases(block, window), slop, ids)
        out = part if out is None else out.unionByName(part)
        many += 1
    if many > 1:
        out = out.groupBy("segment", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.flatten(F.collect_list("runs")).alias("runs"),
        )
    return out


def _search_block(index: DataFrame, phrases: Phrases, slop: int, ids: str) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for k in range(b.num_rows):
                part = Segment(*(b.column(c)[k].as_py() for c in ("doc_starts", "terms", "term_starts", "positions")))
                n = len(part.docs) - 1
                cover = np.zeros(int(part.docs[-1]) + 1, np.int64)
                items: dict[int, set[int]] = {}
                for held, first, last in part.find(known, slop):
                    np.add.at(cover, first, 1)
                    np.add.at(cover, last + 1, -1)
                    for d in np.unique(np.searchsorted(part.docs, first, "right") - 1).tolist():
                        items.setdefault(d, set()).update(held)
                hit = np.cumsum(cover[:-1]) > 0
                runs: list[list[list[int]]] = [[] for _ in range(n)]
                for d in items:
                    own = hit[part.docs[d] : part.docs[d + 1]].astype(np.int8)
                    edge = np.flatnonzero(np.diff(own, prepend=0, append=0))
                    runs[d] = edge.reshape(-1, 2).tolist()
                doc_ids = b.column("doc_ids").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column("segment")[k].as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), doc_ids,
                        pa.array(np.diff(part.docs), pa.int64()),
                        pa.array([[known.items[i] for i in sorted(items.get(d, ()))] for d in range(n)], pa.list_(pa.string())),
                        pa.array(runs, pa.list_(pa.list_(pa.int32()))),
                    ],
                    ["segment", "place", "doc_id", "n_words", "item_ids", "runs"],
                )

    return index.mapInArrow(run, f"segment string, place int, doc_id {ids}, n_words long, item_ids array<string>, runs array<array<int>>")


def covered(runs: str = "runs"):
    """Number of positions in the union of the runs."""
    ordered = F.array_sort(F.col(runs))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, run):
        free = F.greatest(acc["end"], run[0])
        return F.struct(F.greatest(acc["end"], run[1]).alias("end"), (acc["n"] + F.greatest(F.lit(0), run[1] - free)).alias("n"))

    return F.aggregate(ordered, start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    index = build_index(docs, scratch(docs.sparkSession))
    found = search(index, items, window)
    return found.select(
        "doc_id", "n_words", covered().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.size("item_ids") > 0).alias("contaminated"),
    )
