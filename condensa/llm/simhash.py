"""SimHash near-duplicates through an inverted index of positional bytes with count filtering.

Two 64-bit fingerprints at 3 or fewer differing bits share at least 5 of their 8 bytes in place, and so at least 4 of
any 7. A posting list of a single byte would hold a 256th of all fingerprints, so the index has the lists of 4 bytes in
place: an entry for each choice of 4 of the first 7 positions. For each pair that meets in a list the bytes that it
shares in place are tallied over all 8 positions; pairs that reach the guaranteed minimum of 5 go on and are verified
bit by bit. Long lists are divided by the bytes at further positions, of which such a pair must share some, and in the
end by bits; lists that are too long for one task are dealt out anew by 5 bytes, so none holds more than 2**24. A list
gives links that connect its pairs, not all pairs of a group.

``near_duplicates`` links by fingerprints of word shingles alone. ``similar_groups`` finds texts by the similarity of
their five-word shingles, by the same method with longer fingerprints: texts meet in an inverted index of the 48 bytes in
place of a SimHash of 384 bits, pairs that share at least 2 of them and differ in few bits are candidates, and the exact
similarity of the two sets of shingle hashes decides. The candidates of a list that hang together are a bucket. The texts of
a bucket are compared with its first one; then, where that leaves several components in a bucket, with all that are not
in their own component. So all similar pairs that meet are connected.

Defined results: null texts are empty texts; texts without words have fingerprint zero and link like any other;
equal texts, and repeated rows, share a fingerprint and so a component. Null ids are kept as rows; they never are the
smallest id of a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.llm.common import WordHashes, as_bytes, cut, lean, mix, release
from condensa.llm.components import components
from condensa.llm.substring import _rolled

SEED = 42
BYTES = 8
#: A bucket of more fingerprints than this is divided by further bits before pairs are compared.
LEAF = 512


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """Majority of the bits of the XXH64 of every word shingle of the lower-cased text."""
    words = text.lower().split()
    if not words:
        return 0
    k = shingle_words
    if len(words) <= k:
        every = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        flat = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - k + 1].tolist()
        digest = xxhash.xxh64_intdigest
        every = [digest(flat[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    total, n = np.zeros(64, np.int64), len(every)
    for i in range(0, n, 65536):
        part = np.array(every[i : i + 65536], ">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([fingerprint(t, shingle_words) for t in as_bytes(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return lean(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, fp long")


#: The index has lists of so many bytes in place, chosen from the positions that must hold so many shared bytes.
LISTED = 4
#: Of a list of more entries than this a task keeps none, but deals them out anew by all bytes that a pair must share.
HEAVY = 200_000
#: Lists of so many fingerprints are compared pair by pair for all lists of a batch together.
SHORT = 8


def _places(differing: int) -> list[tuple[int, ...]]:
    """Positions of each kind of list: a pair that shares all but ``differing`` bytes shares those of one kind at least."""
    listed = min(LISTED, BYTES - differing)
    return list(combinations(range(differing + listed), listed))


def _mask(places: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in places)


def tally(apart: np.ndarray) -> np.ndarray:
    """Number of bytes that pairs share in place, from their differences."""
    return (np.ascontiguousarray(apart).view(np.uint8).reshape(*apart.shape, BYTES) == 0).sum(axis=-1, dtype=np.int8)


def _near(apart: np.ndarray, differing: int) -> np.ndarray:
    """Count filter, then verification, of the differences of pairs: shared bytes are tallied, then bits counted."""
    kept = tally(apart) >= BYTES - differing
    kept[kept] = np.bitwise_count(apart[kept]) <= differing
    return kept


def _link(fps: np.ndarray, shared: tuple[int, ...], differing: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forest of the pairs at ``differing`` or fewer bits of fingerprints with equal bytes at the positions ``shared``."""
    if len(fps) <= LEAF:
        yield from _forest_of(fps, differing)
        return
    rest = [p for p in range(BYTES) if p not in shared]
    missing = BYTES - differing - len(shared)
    if missing <= 0:
        yield from _by_bits(fps, [8 * p + i for p in rest for i in range(8)], differing)
        return
    for p in rest[: len(rest) - missing + 1]:  # a pair that reaches the minimum shares one of these
        for own in _equal((fps >> np.uint64(8 * p)) & np.uint64(0xFF)):
            yield from _link(fps[own], (*shared, p), differing)


def _equal(key: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each key that two or more have."""
    order = np.argsort(key, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(own) > 1:
            yield own


def _by_bits(fps: np.ndarray, free: list[int], differing: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of fingerprints that may differ in the bits ``free`` only: of so many parts of them, one is equal in a near pair."""
    if len(fps) <= LEAF or len(free) <= differing:
        yield from _forest_of(fps, differing)
        return
    step = -(-len(free) // (differing + 1))
    for i in range(0, len(free), step):
        part = free[i : i + step]
        for own in _equal(fps & np.uint64(sum(1 << x for x in part))):
            yield from _by_bits(fps[own], [x for x in free if x not in part], differing)


def _forest_of(fps: np.ndarray, differing: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    near = _near(fps[:, None] ^ fps[None, :], differing)
    root = near.argmax(axis=1)
    while True:  # smallest reachable row, by neighbours
        new = np.where(near, root[None, :], len(fps)).min(axis=1)
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(fps)))
    if len(at):
        yield fps[at], fps[root[at]]


def links(fps: DataFrame, differing: int = 3) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fps`` (fp) that connect all pairs at ``differing`` bits."""
    kinds, whole = _places(differing), list(combinations(range(BYTES), BYTES - differing))
    met = _met(fps.select("fp", _entries(F.col("fp"), kinds)), kinds, whole if LISTED < BYTES - differing else [], differing)
    met = cut(met, few=True)
    again = _met(met.where("place >= 0").select(F.col("u").alias("fp"), "place", "bytes").distinct(), whole, [], differing)
    return met.where("place < 0").select("u", "v").union(again.select("u", "v")).distinct()


def _entries(fp: Column, kinds: list[tuple[int, ...]]) -> Column:
    return F.posexplode(F.array(*[fp.bitwiseAND(_signed(_mask(k))) for k in kinds])).alias("place", "bytes")


def _met(entries: DataFrame, kinds: list[tuple[int, ...]], deeper: list[tuple[int, ...]], differing: int) -> DataFrame:
    """(u, v, place, bytes): links of the lists of ``entries`` (fp, place, bytes), at place -1; then, of the fingerprints u of
    heavy lists, the entries by the kinds ``deeper``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of the list that the last batch ended in
        heavy = None
        for b in batches:
            if not b.num_rows:
                continue
            place, part, fp = (np.ascontiguousarray(b.column(c).to_numpy()) for c in ("place", "bytes", "fp"))
            if heavy is not None:
                same = (place == heavy[0]) & (part == heavy[1])
                n = len(same) if same.all() else int(same.argmin())
                yield from anew(heavy[0], fp[:n])
                place, part, fp = place[n:], part[n:], fp[n:]
                if not len(fp):
                    continue
                heavy = None
            if held and (held[0][0][0], held[0][1][0]) == (place[0], part[0]) == (place[-1], part[-1]):
                held.append((place, part, fp))
            else:
                place, part, fp = (np.concatenate(x) for x in zip(*held, (place, part, fp), strict=True))
                last = np.flatnonzero((place != place[-1]) | (part != part[-1]))
                end = int(last[-1]) + 1 if len(last) else 0
                held = [(place[end:], part[end:], fp[end:])]
                yield from found(place[:end], part[:end], fp[:end])
            if deeper and sum(len(x[2]) for x in held) > HEAVY:
                heavy = (held[0][0][0], held[0][1][0])
                for x in held:
                    yield from anew(heavy[0], x[2])
                held = []
        if held:
            yield from found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def anew(place: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = kinds[place]
        for k, other in enumerate(deeper):
            if len(fp) and set(own) <= set(other):
                yield batch(fp, np.zeros(len(fp), np.int64), k, fp & np.array([_mask(other)], np.uint64).view(np.int64))

    def batch(u: np.ndarray, v: np.ndarray, place: int, part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), place, np.int32)), pa.array(part)], ["u", "v", "place", "bytes"])

    def found(place: np.ndarray, part: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links within whole lists."""
        if len(fp) < 2:
            return
        fp = fp.view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(part) != 0)]))
        sizes = np.diff(np.append(starts, len(fp)))
        rank, size = np.arange(len(fp)) - np.repeat(starts, sizes), np.repeat(sizes, sizes)
        out = []
        for d in range(1, min(SHORT, int(sizes.max()))):  # pairs so many rows apart
            at = np.flatnonzero((size <= SHORT) & (rank + d < size))
            at = at[_near(fp[at] ^ fp[at + d], differing)]
            out.append((fp[at + d], fp[at]))
        for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
            out += _link(np.unique(fp[s : s + n]), kinds[place[s]], differing)
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        keep = u != v
        if keep.any():
            yield batch(u[keep], v[keep], -1, np.zeros(int(keep.sum()), np.int64))

    dealt = entries.repartition("place", "bytes").sortWithinPartitions("place", "bytes")
    return dealt.mapInArrow(run, "u long, v long, place int, bytes long")


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, differing: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) per row."""
    own = cut(fingerprints(docs, shingle_words))
    # a hot fingerprint is counted before it is dealt out
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reached = components(links(classes.select("fp"), differing))
    rooted = _rooted(classes.select(F.col("fp").alias("node"), "least"), reached)
    # stored, so that the join may split the rows of one root
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), own.count())
    of = rooted.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    return own.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(classes: DataFrame, reached: DataFrame) -> DataFrame:
    """(node, least, root) of each of ``classes`` (node, least): the root that it has ``reached`` (node, root), or itself.

    Both have a row a node at most, so they are put together by an aggregate: no key is hot, whatever the groups are.
    """
    kind = classes.schema["least"].dataType
    every = classes.select("node", "least", F.lit(None).cast("long").alias("root"), F.lit(True).alias("own"))
    every = every.union(reached.select("node", F.lit(None).cast(kind), "root", F.lit(False)))
    return every.groupBy("node").agg(F.max_by("least", "own").alias("least"), F.coalesce(F.max("root"), F.col("node")).alias("root"))


#: Texts are similar from this Jaccard similarity of their shingles on, as a fraction.
LEAST = (4, 5)
#: Bytes of the fingerprint of a set of shingles. At 0.8 a bit differs with a probability of 0.152 at most, so a pair shares
#: ``TALLY`` or more of the bytes in place in all but some 5 of a million cases.
PLACES = 48
TALLY = 2
#: Candidates differ in no more bits than this, of the whole fingerprint and of its first 128 bits (at 0.8: 58 and 19, with
#: deviations of 7 and 4; texts that have nothing in common: 192 and 64).
APART, APART_FIRST = 104, 46
#: The lists of so many places are made at a time, and their shuffles given up before the next.
AT_ONCE = 8
#: In larger parts of lists, rows of the largest group that hangs together are not paired with each other at all.
WIDE = 512
_ODD = mix(np.arange(1, PLACES // 8 + 1, dtype=np.uint64)) | np.uint64(1)


def _print(shingles: np.ndarray) -> bytes:
    """SimHash of a set of shingle hashes: the majority of each bit of so many hashes of them."""
    total = np.zeros(8 * PLACES, np.int64)
    for s in range(0, len(shingles), 255):
        part = mix(shingles[s : s + 255, None] * _ODD)
        total += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(shingles)).tobytes()


def _shingles(h: np.ndarray, shingle_words: int) -> np.ndarray:
    """Distinct hashes, in order, of the shingles of a text whose words have the hashes ``h``."""
    return np.unique(mix(_rolled(h, min(shingle_words, len(h))))) if len(h) else h


def signatures(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """(doc_id, content, node, print): hashes of the text and of its set of shingles, and the set's fingerprint (null: empty)."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            node, prints = [], []
            for text in as_bytes(b.column("text")):
                shingles = _shingles(hashes.of(text.lower().split()), shingle_words)
                node.append(xxhash.xxh3_64_intdigest(shingles.tobytes()))
                prints.append(_print(shingles) if len(shingles) else None)
            columns = [b.column("doc_id"), b.column("content"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "node", "print"])

    rows = lean(docs).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"))
    return rows.mapInArrow(run, f"doc_id {ids}, content long, node long, print binary")


def similar_links(classes: DataFrame) -> DataFrame:
    """(key, u, v): buckets of the ``node``s of ``classes`` (node, print), in which each is a candidate with the first one.

    An entry of the index is a text's byte at a place. Within a list, texts that share a byte at a later place too have
    reached the tally; those of them that differ in few bits hang together, and what does is a bucket.
    """
    every = []
    for s in range(0, PLACES - TALLY + 1, AT_ONCE):
        every.append(cut(_buckets(classes, range(s, min(s + AT_ONCE, PLACES - TALLY + 1))), few=True))
        release(classes.sparkSession)
    return reduce(DataFrame.union, every)


def _buckets(classes: DataFrame, places: range) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of the list that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            prints = np.frombuffer(b"".join(b.column("print").to_pylist()), np.uint8).reshape(-1, PLACES)
            rows = (b.column("place").to_numpy(), prints[np.arange(len(prints)), b.column("place").to_numpy()], b.column("node").to_numpy(), prints)
            if held and all(held[0][c][0] == rows[c][0] == rows[c][-1] for c in (0, 1)):
                held.append(rows)
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held, rows, strict=True))
            ends = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            start = 0
            for end in ends.tolist():
                yield from found(*(x[start:end] for x in rows))
                start = end
            held = [tuple(x[start:] for x in rows)]
        if held:
            yield from found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def found(place: np.ndarray, byte: np.ndarray, node: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = _hanging(prints, int(place[0]))
        own = np.flatnonzero(of != np.arange(len(of)))
        if len(own):
            lead = node[of[own]]
            key = mix(lead.view(np.uint64) + mix(256 * place[own].astype(np.uint64) + byte[own] + np.uint64(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[own]), pa.array(lead)], ["key", "u", "v"])

    where = F.explode(F.array(*map(F.lit, places))).alias("place")
    entries = classes.where("print is not null").select("node", "print", where).withColumn("byte", F.expr("substring(print, place + 1, 1)"))
    dealt = entries.repartition("place", "byte").sortWithinPartitions("place", "byte")
    return dealt.select("place", "node", "print").mapInArrow(run, "key long, u long, v long")


def _hanging(prints: np.ndarray, place: int) -> np.ndarray:
    """For each fingerprint of a list, the first one that it hangs together with by candidates that also share a later place."""
    n, words = len(prints), np.ascontiguousarray(prints).view(np.uint64)
    of = np.arange(n)
    later = PLACES - place - 1
    if n < 2 or not later:
        return of
    value = (prints[:, place + 1 :] + 256 * np.arange(later, dtype=np.uint16)).astype(np.uint16).T.ravel()
    row = np.argsort(value, kind="stable")
    value, row = value[row], row % n
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    sizes = np.diff(np.append(starts, len(row)))
    left = np.where(sizes > WIDE, 0, sizes)
    left = np.repeat(left, sizes) - (np.arange(len(row)) - np.repeat(starts, sizes))  # rows from here to the part's end
    at, d = np.flatnonzero(left > 1), 1
    while len(at):  # pairs so many rows apart
        for s in range(0, len(at), 1 << 18):
            a, b = row[at[s : s + (1 << 18)]], row[at[s : s + (1 << 18)] + d]
            apart = of[a] != of[b]
            a, b = a[apart], b[apart]
            near = _candidates(words, a, b)
            of = _joined(of, a[near], b[near])
        d += 1
        at = at[left[at] > d]
    for s, size in zip(starts[sizes > WIDE].tolist(), sizes[sizes > WIDE].tolist(), strict=True):
        own = row[s : s + size]
        if (of[own] != of[own[0]]).any():
            of = _joined(of, *_grown(words, own, of[own]))
    return of


def _candidates(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows ``a`` and ``b`` share enough bytes in place and differ in few bits."""
    first = np.bitwise_count(words[a, 0] ^ words[b, 0]) + np.bitwise_count(words[a, 1] ^ words[b, 1])
    near = np.flatnonzero(first <= APART_FIRST)
    apart = words[a[near]] ^ words[b[near]]
    kept = tally(apart).sum(axis=1) >= TALLY
    return near[kept & (np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= APART)]


def _grown(words: np.ndarray, own: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that, with the groups ``of`` the rows ``own``, connect all candidates of them.

    The largest group is grown by what hangs together with its rows until fewer rows are left than are to be asked for;
    each of these is compared with all.
    """
    _, kind = np.unique(of, return_inverse=True)
    inside = kind == np.bincount(kind).argmax()
    front, rest, pairs = own[inside].tolist(), own[~inside], []
    while len(rest):
        if not front:  # nothing else hangs together with these
            own, front, rest = rest, [rest[0]], rest[1:]
            continue
        if len(rest) <= len(front):
            break
        x = np.full(len(rest), front.pop())
        near = _candidates(words, x, rest)
        if len(near):
            pairs.append((x[near], rest[near]))
            front += rest[near].tolist()
            rest = np.delete(rest, near)
    for r in rest.tolist():
        x = np.full(len(own), r)
        near = _candidates(words, x, own)
        pairs.append((x[near], own[near]))
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (own[:0], own[:0])


def _joined(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first row of each group, after joining the groups ``of`` the rows ``a`` and ``b``."""
    of = of.copy()
    while True:
        x, y = of[a], of[b]
        apart = x != y
        if not apart.any():
            return of
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
        while (of[of] != of).any():
            of = of[of]


def _sets(docs: DataFrame, of: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles): the set of shingle hashes of each node of ``of`` (node, least), from the text that stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [_shingles(hashes.of(t.lower().split()), shingle_words).tobytes() for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    rows = lean(docs).select(F.col("doc_id").alias("__id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__content"))
    own = rows.join(of, (F.col("__content") == F.col("least.content")) & F.col("__id").eqNullSafe(F.col("least.doc_id")))
    sets = own.select("node", "text").mapInArrow(run, "node long, shingles binary")
    return sets.groupBy("node").agg(F.first("shingles").alias("shingles"))  # repeated rows


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _similar(shared: int | np.ndarray, a: int, b: int | np.ndarray) -> bool | np.ndarray:
    """Whether sets of ``a`` and ``b`` elements, ``shared`` of them common, have the Jaccard similarity that is asked for."""
    return LEAST[1] * shared >= LEAST[0] * (a + b - shared)


def verified(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``links`` (u, v) whose two sets of shingles are similar, by their exact Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = ([np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("a", "b"))
            near = [_similar(_shared(x, y), len(x), len(y)) for x, y in zip(*both, strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    one = links.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = one.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


#: The sets of a bucket are indexed in parts of about so many hashes.
PART = 1_000_000


def _forest(sets: list[np.ndarray], roots: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between texts of different ``roots`` that connect all similar pairs of them.

    Each text is compared with all others, but for those of the largest group: a pair of two groups has one of the rest.
    """
    _, of = np.unique(roots, return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    asking = np.flatnonzero(of != np.bincount(of).argmax())
    part = np.cumsum(sizes) // PART
    for own in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(part)) + 1):
        every, at = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True)
        holders = np.repeat(np.arange(len(own)), sizes[own])[np.argsort(at, kind="stable")]
        count = np.bincount(at, minlength=len(every))
        start = np.cumsum(count) - count
        for i in asking:
            if (of[own] == of[i]).all():
                continue
            k = np.minimum(np.searchsorted(every, sets[i]), len(every) - 1)
            k = k[every[k] == sets[i]]
            places = np.arange(count[k].sum()) + np.repeat(start[k] - (np.cumsum(count[k]) - count[k]), count[k])
            shared = np.bincount(holders[places], minlength=len(own))
            near = own[_similar(shared, sizes[i], sizes[own]) & (of[own] != of[i])]
            for j in near[np.unique(of[near], return_index=True)[1]].tolist():
                yield int(i), j
                of[of == of[j]] = of[i]


def missing_links(met: DataFrame, reached: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) of similar texts that meet in ``met`` (key, u, v) but are not yet ``reached`` (node, root) from each other.

    Every text of a bucket was compared with its first one. So only buckets of three or more texts in several
    components are gone through again; of buckets with the same texts, one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "node", "root", "shingles")), strict=True):
                if row[0] != last:
                    yield from found(held)
                    last, held = row[0], []
                held.append(row[1:])
        yield from found(held)

    def found(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            nodes, roots, sets = zip(*held, strict=True)
            links = [(nodes[i], nodes[j]) for i, j in _forest([np.frombuffer(x, np.uint64) for x in sets], np.array(roots))]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["u", "v"])

    texts = met.select("key", F.col("u").alias("node")).union(met.select("key", F.col("v").alias("node")).distinct())
    # dealt out by its node, of which it has one row each: the stored links of few files would else be read file by file
    texts = cut(texts.join(reached.repartition("node"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    each = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("same"))
    again = each.where("n > 2 and lo <> hi").groupBy("same", "n").agg(F.min("key").alias("key")).select("key")
    dealt = texts.join(again, "key").join(sets, "node").repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "node", "root", "shingles").mapInArrow(run, "u long, v long").distinct()


def _grouped(docs: DataFrame, shingle_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of the rows; (node, root) of each distinct signature; (root, first) of each group."""
    own = cut(signatures(docs, shingle_words))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("least")
    classes = cut(own.groupBy("node").agg(least, F.first("print").alias("print")))
    release(docs.sparkSession)  # here and below: each of these moves as much as all signatures, or sets, are
    found = similar_links(classes)
    met = found.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    release(docs.sparkSession)
    sets = cut(_sets(docs, classes.select("node", "least").join(met, "node"), shingle_words))
    release(docs.sparkSession)
    near = cut(verified(found.select("u", "v").distinct(), sets), few=True)
    reached = components(near)
    release(docs.sparkSession)
    more = cut(missing_links(found, reached, sets), few=True)
    release(docs.sparkSession)
    reached = components(near.union(more))
    rooted = _rooted(classes.select("node", "least"), reached)
    first = rooted.groupBy("root").agg(F.min("least").dropFields("none").alias("first"))
    return own, rooted.select("node", "root"), first


def similar_groups(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """(doc_id, content, first): ``first`` is the (doc_id, content) of the text that stands for the group."""
    own, rooted, first = _grouped(docs, shingle_words)
    # stored, so that the joins may split the rows of one group
    of = cut(rooted.join(cut(first, own.count()), "root").select("node", "first"), own.count())
    return own.select("doc_id", "content", "node").join(of, "node").select("doc_id", "content", "first")


def drop_similar(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """One text, that of smallest id, of each group of ``docs`` that similar pairs connect; repeated rows are kept once."""
    _, _, first = _grouped(docs, shingle_words)  # one row a group, so no group has to meet in one task
    kept = first.select("first.*").select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"))
    rows = docs.withColumn("__own", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = rows.join(kept, rows["__own"].eqNullSafe(kept["__content"]) & rows["doc_id"].eqNullSafe(kept["__id"]))
    return both.dropDuplicates(["__id", "__content"]).drop("__id", "__content", "__own")
