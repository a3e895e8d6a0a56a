"""Substring dedup: words of passages that stand earlier in the corpus are removed, found with suffix automata.

Removal is decided by matching statistics against suffix automata of reference shards. Against a given reference
(``in_reference``) each shard is broadcast, of bounded size, and all documents stream past it. Within a corpus
(``repeated_words``) the reference is the corpus itself, so streaming all documents past all shards would be
quadratic. There, hashes select what can match, and route it to the one shard where it can:

1. Of each window the smallest hash of its inner word groups is selected; groups that occur once in the corpus rule
   out their windows. Equal windows select equal groups, so no repeated window is lost.
2. The windows left are matched by hash with an earlier one; that one's passage is the reference. Each batch of a
   task sends one window of each kind and settles its other copies itself, and what the batches send forms a tree of
   references, so no group of copies meets in one task.
3. Reference passages are put together in shards by their document; a suffix automaton of each shard is built where
   the passages that may match it arrive, and they stream past it. Only what it confirms, word by word, is removed.

Order: by doc_id, then by position; null ids come last. Defined results: null texts have no words and give a row;
rows of equal id are one document to each other (only an earlier start is earlier), so a row that is repeated whole
loses no more than the row alone; texts of fewer words than a window lose nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm.automaton import SuffixAutomaton
from condensa.llm.common import WordHashes, as_bytes, chunks, lean, mix, shuffle_partitions

WINDOW = 20
GROUP = 10
#: A task sends what it has gathered after so many windows or groups.
BATCH = 1_000_000
#: A suffix automaton is built of about so many reference words.
SHARD_WORDS = 100_000
_M = np.uint64(0x9E3779B97F4A7C15)
U8 = np.uint64
#: Fixed values of XXH64.
XXH64_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def _power(n: int) -> np.uint64:
    return U8(pow(int(_M), n, 1 << 64))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n neighbouring word hashes, by doubling."""
    out, have, part, size = None, 0, h, 1
    while n:
        if n & 1:
            out, have = (part, size) if out is None else (_joined(out, have, part), have + size)
        n >>= 1
        if n:
            part, size = _joined(part, size, part), size * 2
    return out


def _joined(a: np.ndarray, n: int, b: np.ndarray) -> np.ndarray:
    k = max(0, min(len(a), len(b) - n))
    return a[:k] + _power(n) * b[n : n + k]


class Cut:
    """Words of some texts, with the windows that lie within one text."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, window: int, group: int):
        self.words = [t.split() for t in texts]
        counts = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.hash = np.concatenate([hashes.of(w) for w in self.words]) if len(texts) else np.zeros(0, U8)
        n = len(self.hash)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        inside = np.repeat(self.starts[1:], counts) - np.arange(n) >= window
        self.at = np.flatnonzero(inside)  # where a window starts
        if len(self.at):
            groups = mix(_rolled(self.hash, group))
            views = np.lib.stride_tricks.sliding_window_view(groups, window - group + 1)
            self.groups = groups
            self.chosen = self.at + views[self.at].argmin(axis=1)
        else:
            self.groups, self.chosen = np.zeros(0, U8), np.zeros(0, np.int64)


def _squeeze(x: np.ndarray) -> bytes:
    """Differences, compressed; for columns in nearly ascending order."""
    raw = np.diff(x, prepend=x.dtype.type(0)).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _open(raw: bytes, dtype: type) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.cumsum(np.frombuffer(pa.decompress(raw[8:], n * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype), dtype=dtype)


def _column(table: pa.Table, name: str, dtype: type | None = None) -> np.ndarray:
    parts = table.column(name).to_pylist()
    got = [np.frombuffer(x, U8) if dtype is None else _open(x, dtype) for x in parts]
    return np.concatenate(got) if got else np.zeros(0, dtype or U8)


def _buckets(o: np.ndarray, n: int) -> np.ndarray:
    """pmod(xxhash64(o), n) as Spark has it: XXH64 of eight bytes with seed 42."""
    p1, p2, p3, p4, p5 = (U8(x) for x in XXH64_PRIMES)
    turned = lambda x, k: (x << U8(k)) | (x >> U8(64 - k))
    x = np.ascontiguousarray(o, np.int64).view(U8)
    x = turned(x * p2, 31) * p1 ^ (U8(42 + 8) + p5)
    x = turned(x, 27) * p1 + p4
    x = (x ^ (x >> U8(33))) * p2
    x = (x ^ (x >> U8(29))) * p3
    return (x ^ (x >> U8(32))).view(np.int64) % n


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("b", F.pmod(F.xxhash64("o"), F.lit(n)).cast("int"))


def _stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, how many) of each run of successive numbers in ascending ``x``."""
    if len(x):
        cuts = np.flatnonzero(np.diff(x) != 1) + 1
        for part in np.split(x, cuts):
            yield int(part[0]), len(part)


def _split(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows by bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def _runs(h: np.ndarray, o: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (hash, document, position), and for each place in it where its hash begins."""
    order = np.lexsort((p, o, h))
    new = np.concatenate([[True], np.diff(h[order]) != 0]) if len(h) else np.zeros(0, bool)
    return order, np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))


ENTRY = "b int, kind int, h binary, o binary, p binary, r binary, q binary"
_NAMES = ["b", "kind", "h", "o", "p", "r", "q"]


def _entries(kind: int, b: int, h: np.ndarray | None, o: np.ndarray, p: np.ndarray, r: np.ndarray, q: np.ndarray) -> list:
    return [
        b, kind, b"" if h is None else h.tobytes(), _squeeze(o.astype(np.int64)), _squeeze(p.astype(np.uint32)),
        _squeeze(r.astype(np.int64)), _squeeze(q.astype(np.uint32)),
    ]


def _table(rows: list[list]) -> pa.Table:
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], _NAMES)


NONE = np.zeros(0, np.int64)
SEARCH, KNOWN, LATER, FIRST = 0, 1, 2, 3


def _send(h: np.ndarray, o: np.ndarray, p: np.ndarray, buckets: int, settle: bool) -> list[list]:
    """Rows for what a task has gathered: one entry of each hash for its bucket; other copies are settled here.

    settle: with the entry that they repeat (LATER, and FIRST for that one); else as KNOWN to be repeated.
    """
    order, head = _runs(h, o, p)
    h, o, p = h[order], o[order], p[order]
    lead = head == np.arange(len(h))
    more = np.zeros(len(h), bool)
    more[head[~lead]] = True
    rows = []
    own = np.flatnonzero(lead)
    for b, at in _split((h[own] % U8(buckets)).astype(np.int64), buckets):
        at = own[at]
        at = at[np.lexsort((p[at], o[at]))]
        rows.append(_entries(SEARCH, b, h[at], o[at], p[at], more[at].astype(np.int64), NONE))
    copies = np.flatnonzero(~lead)
    if settle:
        copies = copies[(o[copies] != o[head[copies]]) | (p[copies] != p[head[copies]])]
        rows += _later(o[copies], p[copies], o[head[copies]], p[head[copies]], buckets)
    else:
        rows += _by_doc(KNOWN, o[copies], p[copies], None, None, buckets)
    return rows


def _by_doc(kind: int, o: np.ndarray, p: np.ndarray, r: np.ndarray | None, q: np.ndarray | None, buckets: int) -> list[list]:
    rows = []
    for b, at in _split(_buckets(o, buckets), buckets):
        at = at[np.lexsort((p[at], o[at]))]
        rows.append(_entries(kind, b, None, o[at], p[at], NONE if r is None else r[at], NONE if q is None or not len(q) else q[at]))
    return rows


def _later(o: np.ndarray, p: np.ndarray, r: np.ndarray, q: np.ndarray, buckets: int) -> list[list]:
    first = np.unique(np.stack([r, q.astype(np.int64)]), axis=1) if len(r) else np.zeros((2, 0), np.int64)
    return _by_doc(LATER, o, p, r, q, buckets) + _by_doc(FIRST, first[0], first[1], None, None, buckets)


#: Of the entries of a hash, so many refer to one earlier entry; those to one before them, and so on to the first.
FAN = 256


def _earlier(head: np.ndarray, o: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each place of entries in order, that of an earlier entry of its hash, or of its first one.

    Any earlier occurrence proves a repeat. So that not all of a hot hash go to one reference, they form a tree.
    """
    fresh = np.ones(len(o), bool)
    fresh[1:] = (head[1:] == np.arange(1, len(o))) | (o[1:] != o[:-1]) | (p[1:] != p[:-1])
    number, place = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    i = number - number[head]
    parent, todo, step = np.zeros(len(o), np.int64), i > 0, FAN
    while todo.any():
        own = todo & (i % step != 0)
        parent[own] = i[own] - i[own] % step
        todo &= ~own
        step *= FAN
    return place[number[head] + parent]


def _reduce(table: pa.Table, buckets: int, settle: bool) -> pa.Table:
    """Of one bucket: entries whose hash another task sent too. What is settled already is passed on."""
    kinds = table.column("kind").to_numpy()
    asked = table.filter(pa.array(kinds == SEARCH))
    h, o, p = _column(asked, "h"), _column(asked, "o", np.int64), _column(asked, "p", np.uint32)
    more = _column(asked, "r", np.int64)
    order, head = _runs(h, o, p)
    o, p = o[order], p[order]
    lead = head == np.arange(len(h))
    if settle:
        of = _earlier(head, o, p)
        at = np.flatnonzero((o != o[of]) | (p != p[of]))
        rows = _later(o[at], p[at], o[of[at]], p[of[at]], buckets)
    else:
        size = np.bincount(head, minlength=len(h))[head] if len(h) else NONE
        at = np.flatnonzero((size > 1) | (more[order] > 0))
        rows = _by_doc(KNOWN, o[at], p[at], None, None, buckets)
    return pa.concat_tables([_table(rows), table.filter(pa.array(kinds != SEARCH)).select(_NAMES)])


class Places:
    """Positions by document, of the rows of one bucket."""

    def __init__(self, table: pa.Table, kind: int, refs: bool = False):
        own = table.filter(pa.array(table.column("kind").to_numpy() == kind))
        self.o, self.p = _column(own, "o", np.int64), _column(own, "p", np.uint32).astype(np.int64)
        order = np.lexsort((self.p, self.o))
        self.o, self.p = self.o[order], self.p[order]
        if refs:
            self.r, self.q = _column(own, "r", np.int64)[order], _column(own, "q", np.uint32).astype(np.int64)
            self.q = self.q[order] if len(self.q) else self.q

    def of(self, o: int) -> slice:
        return slice(int(np.searchsorted(self.o, o, "left")), int(np.searchsorted(self.o, o, "right")))


def _text_rows(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    return table.column("o").to_numpy(), as_bytes(table.column("text").combine_chunks())


class Shard:
    """Suffix automaton of some reference passages, given in ascending order of (document, position)."""

    def __init__(self, passages: list[tuple[int, int, list[bytes]]]):
        self.automaton = SuffixAutomaton()
        self.at = [self.automaton.insert(words) for _, _, words in passages]
        self.of = [(o, p) for o, p, _ in passages]

    def earliest(self, words: list[bytes], window: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """Start of each window that occurs in the references, with the (document, position) of its first occurrence."""
        for i, f in self.automaton.matches(words, window):
            k = bisect_right(self.at, f) - 1
            o, p = self.of[k]
            yield i, (o, p + f - self.at[k])


def shards(passages: list[tuple[int, int, list[bytes]]], window: int) -> Iterator[Shard]:
    """Automata of about SHARD_WORDS words; longer passages go on in the next one, with a window's overlap."""
    part, size = [], 0
    for o, p, words in passages:
        for s in range(0, max(1, len(words) - window + 1), SHARD_WORDS):
            piece = words[s : s + SHARD_WORDS + window - 1]
            if part and size + len(piece) > SHARD_WORDS + window:
                yield Shard(part)
                part, size = [], 0
            part.append((o, p + s, piece))
            size += len(piece)
    if part:
        yield Shard(part)


def text_hash(text: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text), "big", signed=True)


SPAN = "shard int, r long, q int, kind int, o long, p int, t long, words binary"


def repeated_words(docs: DataFrame, window: int = WINDOW, group: int = GROUP, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept (the text that is left) of every document."""
    spark, with_texts = docs.sparkSession, texts
    ids = docs.schema["doc_id"].dataType.simpleString()
    buckets = max(shuffle_partitions(spark), 2 * docs.rdd.getNumPartitions())
    rows = lean(docs).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("o"), "text")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, got, size = WordHashes(), [], 0
        for b in batches:
            ids, texts = b.column("o").to_numpy(), as_bytes(b.column("text"))
            for i, j in chunks([len(t) for t in texts]):
                cut = Cut(texts[i:j], hashes, window, group)
                at = np.unique(cut.chosen)
                doc = cut.doc[at]
                got.append((cut.groups[at], ids[i:j][doc], (at - cut.starts[doc]).astype(np.uint32)))
                size += len(at)
                if size >= BATCH:
                    yield from _table(_send(*map(np.concatenate, zip(*got, strict=True)), buckets, False)).to_batches()
                    got, size = [], 0
        if got:
            yield from _table(_send(*map(np.concatenate, zip(*got, strict=True)), buckets, False)).to_batches()

    def windows(table: pa.Table, marks: pa.Table) -> pa.Table:
        hashes, got, size, out = WordHashes(), [], 0, []
        known = Places(marks, KNOWN)
        ids, texts = _text_rows(table)
        for i, j in chunks([len(t) for t in texts]):
            cut = Cut(texts[i:j], hashes, window, group)
            marked = np.zeros(len(cut.hash), bool)
            for k in range(j - i):
                p = known.p[known.of(int(ids[i + k]))]
                marked[cut.starts[k] + p[p < cut.starts[k + 1] - cut.starts[k]]] = True
            at = cut.at[marked[cut.chosen]]
            if not len(at):
                continue
            doc = cut.doc[at]
            got.append((mix(_rolled(cut.hash, window)[at]), ids[i:j][doc], (at - cut.starts[doc]).astype(np.uint32)))
            size += len(at)
            if size >= BATCH:
                out += _send(*map(np.concatenate, zip(*got, strict=True)), buckets, True)
                got, size = [], 0
        if got:
            out += _send(*map(np.concatenate, zip(*got, strict=True)), buckets, True)
        return _table(out)

    def spans(table: pa.Table, found: pa.Table) -> pa.Table:
        """Passages that repeat, to the shard of what they repeat; and the passages of the shards."""
        later, first = Places(found, LATER, refs=True), Places(found, FIRST)
        ids, texts = _text_rows(table)
        out: list[tuple] = []
        for o, text in zip(ids.tolist(), texts, strict=True):
            own, ref = later.of(o), first.of(o)
            if own.start == own.stop and ref.start == ref.stop:
                continue
            words, t = text.split(), text_hash(text)
            last = len(words) - window
            for p, n in _stretches(np.unique(first.p[ref])):
                if p <= last:
                    n = min(n, last - p + 1)
                    out.append((o, p, 0, o, p, t, b" ".join(words[p : p + n + window - 1])))
            p, r, q = later.p[own], later.r[own], later.q[own]
            order = np.lexsort((p, p - q, r))
            p, r, q = p[order], r[order], q[order]
            cuts = np.flatnonzero((np.diff(r) != 0) | (np.diff(p) > 1) | (np.diff(p - q) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)], strict=True):
                if e > s and p[s] <= last:
                    n = min(int(p[e - 1]), last) - int(p[s]) + 1
                    out.append((int(r[s]), int(q[s]), 1, o, int(p[s]), t, b" ".join(words[p[s] : p[s] + n + window - 1])))
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
        shard = _buckets(np.array(columns[0], np.int64), buckets).astype(np.int32)
        return pa.Table.from_arrays([pa.array(shard), *arrays], ["shard", "r", "q", "kind", "o", "p", "t", "words"])

    def confirm(table: pa.Table) -> pa.Table:
        """Stream the passages of one shard past the suffix automata of its references, some documents at a time."""
        table = table.sort_by([("r", "ascending"), ("kind", "ascending"), ("q", "ascending")])
        r, q, kind, o, p, t = (table.column(c).to_numpy() for c in ("r", "q", "kind", "o", "p", "t"))
        words = table.column("words").to_pylist()
        found: list[tuple[int, int, int]] = []
        start = size = done = 0
        for e in [*(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]:
            size += sum(len(words[k]) for k in range(done, e) if kind[k] == 0) // 6
            done = e
            if size < SHARD_WORDS and e < len(r):
                continue
            own = range(start, e)
            refs = [(int(r[k]), int(q[k]), words[k].split(b" ")) for k in own if kind[k] == 0]
            passages = [(int(o[k]), int(p[k]), int(t[k]), words[k].split(b" ")) for k in own if kind[k] == 1]
            for shard in shards(refs, window):
                for doc, at, text, these in passages:
                    found += [(doc, text, at + i) for i, ref in shard.earliest(these, window) if ref < (doc, at + i)]
            start, size = e, 0
        got = np.array(found, np.int64).reshape(-1, 3)
        return _table(_by_doc(LATER, got[:, 0], got[:, 2], got[:, 1], NONE, buckets))

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        gone = Places(found, LATER, refs=True)
        ids, texts = _text_rows(table)
        n_words, n_removed, sha, kept = [], [], [], []
        for o, text in zip(ids.tolist(), texts, strict=True):
            words = text.split()
            own = gone.of(o)
            starts = gone.p[own]
            if len(starts):
                starts = starts[gone.r[own] == text_hash(text)]
            cover = np.zeros(len(words) + 1, np.int64)
            starts = np.unique(starts[starts <= len(words) - window])
            cover[starts] += 1
            cover[starts + window] -= 1
            covered = np.cumsum(cover[:-1]) > 0
            left = [words[i] for i in np.flatnonzero(~covered)] if len(starts) else words
            rest = b" ".join(left)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest if with_texts else b"")
        return pa.Table.from_arrays(
            [
                table.column("doc_id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )

    dealt = _dealt(rows, buckets)
    marks = rows.select("o", "text").mapInArrow(groups, ENTRY).groupBy("b").applyInArrow(lambda t: _reduce(t, buckets, False), ENTRY)
    sent = dealt.groupBy("b").cogroup(marks.groupBy("b")).applyInArrow(windows, ENTRY)
    found = sent.groupBy("b").applyInArrow(lambda t: _reduce(t, buckets, True), ENTRY)
    passages = dealt.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(spans, SPAN)
    gone = passages.groupBy("shard").applyInArrow(confirm, ENTRY)
    out = f"doc_id {ids}, n_words long, n_removed long, kept_sha256 string, kept string"
    return dealt.groupBy("b").cogroup(gone.groupBy("b")).applyInArrow(remove, out).drop(*[] if with_texts else ["kept"])


def in_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, words): maximal runs of words of ``docs`` that stand in windows which ``reference`` (text) has.

    The reference is cut into shards of bounded size; the driver holds one of them, each is broadcast, and the documents
    stream past each. Runs that two shards give may overlap. Null references and texts have no words.
    """
    ids, sc = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext
    out = docs.sparkSession.createDataFrame([], f"doc_id {ids}, start int, words int")
    part, size = [], 0

    def against(passages: list[tuple[int, int, list[bytes]]]) -> DataFrame:
        shared = sc.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = Shard(shared.value)
            for b in batches:
                rows = []
                for k, text in enumerate(as_bytes(b.column("text"))):
                    at = np.array([i for i, _ in shard.earliest(text.split(), window)], np.int64)
                    cuts = np.flatnonzero(np.diff(at) > window) + 1
                    rows += [(k, int(x[0]), int(x[-1] - x[0]) + window) for x in np.split(at, cuts) if len(x)]
                which, start, n = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(which, pa.int64())), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                    ["doc_id", "start", "words"],
                )

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, start int, words int")

    for k, row in enumerate(reference.select("text").toLocalIterator()):
        words = (row[0] or "").encode().split()
        for s in range(0, max(1, len(words) - window + 1), SHARD_WORDS):
            piece = words[s : s + SHARD_WORDS + window - 1]
            if part and size + len(piece) > SHARD_WORDS + window:
                out = out.unionByName(against(part))
                part, size = [], 0
            part.append((k, s, piece))
            size += len(piece)
    return out.unionByName(against(part)) if part else out


def union_of(spans: DataFrame) -> DataFrame:
    """(doc_id, start, words) of maximal spans, of overlapping and adjacent ``spans`` (doc_id, start, words)."""
    before = Window.partitionBy("doc_id").orderBy("start", "words").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("words")
    new = F.coalesce(F.col("start") > F.max(end).over(before), F.lit(True)).cast("int")
    run = spans.withColumn("new", new).withColumn("run", F.sum("new").over(Window.partitionBy("doc_id").orderBy("start", "words")))
    return run.groupBy("doc_id", "run").agg(F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("words")).drop("run")
