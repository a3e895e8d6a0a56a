"""Byte-level BPE by a depth-first walk over a trie of distinct words.

A prefix is encoded by its last token and the encoding of what stands before it. The last token of a prefix is the
token that ends there and whose pair with the last token before it is stable under the merges. So every node of the
trie needs one token only, and words that share a prefix share its nodes: it is encoded once.

Defined results: null texts are empty and have no tokens; the special token's string in a text is that token. A file
that asks for anything else (a normalizer, another way to cut words, added tokens that take white space with them or
need word ends) is an error, not a different result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.llm.common import chunks, lean

#: How byte-level BPE cuts a text into words: fixed value of the format.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts of ASCII characters, in which these are all letters, digits and white space.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _supported(spec: dict) -> None:
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    flags = [k for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word") if t.get(k)]
    if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or not plain or odd or flags:
        raise ValueError(f"a tokenizer file that is not supported: {cut.get('type')} {odd} {flags}")


class Bpe:
    """Vocabulary, merges and the trie of words seen so far."""

    #: The trie is begun anew beyond so many nodes; the encodings of words, and of pairs, are forgotten beyond so many.
    MOST_NODES, MOST_WORDS, MOST_PAIRS = 100_000, 300_000, 300_000

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        _supported(spec)
        byte = byte_symbols()
        raw = lambda s: bytes(byte[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(self.ids[raw(a)], self.ids[raw(b)]): (i, self.ids[raw(a + b)]) for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_starts = frozenset(t[0] for t in self.special if t)
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.parts = {whole: pair for pair, (_, whole) in self.rank.items()}
        made = {whole: r for r, whole in self.rank.values()}
        #: Merges run in the order of their ranks if each comes after those that make its parts.
        self.in_order = all(max(made.get(a, -1), made.get(b, -1)) < r for (a, b), (r, _) in self.rank.items()) and len(made) == len(self.rank)
        self.made = made
        self.spines: tuple[dict, dict] = ({}, {})
        # a token that its own merges do not give can never end a prefix
        self.own = {k: v for k, v in self.ids.items() if self.merged(k) == [v]}
        lengths: dict[bytes, set[int]] = {}
        for k in self.own:
            if len(k) > 2:
                lengths.setdefault(k[-3:], set()).add(len(k))
        #: By their last three bytes, the lengths of tokens, longest first; shorter tokens are tried with all.
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in lengths.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        #: Ids of words, as the bytes of little-endian numbers.
        self.words: dict[str, bytes] = {}
        self.table = np.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)], object)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node << 8 | byte
        self.last: list[int] = [-1]  # last token by node
        self.before: list[int] = [-1]  # node at which that token starts

    def merged(self, word: bytes) -> list[int]:
        """Merges applied by rank: the definition, used for single tokens and for pairs."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            found = [(self.rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [self.rank[parts[i], parts[i + 1]][1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at the left (0) or right (1) end while ``token`` is merged; each with the rank that ends it."""
        got = self.spines[side].get(token)
        if got is None:
            got, part, end = [], token, len(self.rank)
            while True:
                got.append((part, end))
                if part not in self.parts:
                    break
                part, end = self.parts[part][side], self.made[part]
            self.spines[side][token] = got
        return got

    def apart(self, left: int, right: int) -> bool:
        """No merge joins the end of ``left`` with the start of ``right``.

        Two neighbours join if their rank comes before the merges that end them. At equal ranks the left pair goes first.
        """
        if not self.in_order:
            return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        rank = self.rank
        for a, a_ends in self.spine(left, 1):
            for b, b_ends in self.spine(right, 0):
                r = rank.get((a, b))
                if r is not None and r[0] < a_ends and r[0] <= b_ends:
                    return False
        return True

    def fits(self, left: int, right: int) -> bool:
        got = self.stable.get((left, right))
        if got is None:
            if len(self.stable) >= self.MOST_PAIRS:
                self.stable.clear()
            got = self.stable[left, right] = self.apart(left, right)
        return got

    def learn(self, words: set[str]) -> None:
        """Insert the words; walk them in depth-first order, so that each new node is encoded once.

        The last token of a new node is the longest one that ends there and is stable after the last token before it;
        ``path`` has the nodes of all shorter prefixes.
        """
        if len(self.last) > self.MOST_NODES:
            self.clear()
        child, last, before, known = self.child, self.last, self.before, self.words
        own, stable, lengths, short = self.own, self.stable, self.lengths, (2, 1)
        path: list[int] = [0]
        done = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            size, most, at = len(raw), min(len(done), len(raw)), 0
            while at < most and done[at] == raw[at]:
                at += 1
            del path[at + 1 :]
            node = path[at]
            while at < size:
                key = node << 8 | raw[at]
                at += 1
                node = child.get(key)
                if node is None:
                    node = child[key] = len(last)
                    for n in lengths.get(raw[at - 3 : at], short) if at > 2 else short:
                        if n > at:
                            continue
                        token = own.get(raw[at - n : at])
                        if token is None:
                            continue
                        start = path[at - n]
                        if start:
                            fit = stable.get((last[start], token))
                            if not (self.fits(last[start], token) if fit is None else fit):
                                continue
                        last.append(token)
                        before.append(start)
                        break
                    else:
                        raise ValueError("no token ends here")
                path.append(node)
            done = raw
            out = []
            while node:
                out.append(last[node])
                node = before[node]
            out.reverse()
            known[word] = packed(out)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = []
        for t in texts:
            parts = self.special_cut.split(t) if self.special_cut and any(c in t for c in self.special_starts) else [t]
            cut.append([p if p in self.special else (ASCII_WORDS if p.isascii() else WORDS).findall(p) for p in parts])
        if len(self.words) > self.MOST_WORDS:
            self.words = {}
        new: set[str] = set().union(*(p for parts in cut for p in parts if not isinstance(p, str)))
        self.learn(new.difference(self.words))
        of = self.words.__getitem__
        out = []
        for parts in cut:
            ids = [packed([self.special[p]]) if isinstance(p, str) else b"".join(map(of, p)) for p in parts]
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.table[ids].tolist()).decode("utf-8", "replace")


def read(path: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe(f.read())


#: Of a worker, for all its tasks.
_loaded: dict[str, Bpe] = {}


def _sent(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """Name and bytes (some megabytes) of a tokenizer file, which the driver reads and sends."""
    with open(path, "rb") as f:
        raw = f.read()
    return hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)


def _load(sent: tuple[str, Broadcast]) -> Bpe:
    name, raw = sent
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Bpe(raw.value)
    return _loaded[name]


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", output: str = "ids") -> DataFrame:
    """``key`` with, by ``output``: the ids themselves (``ids``: array of int) or their digest (``digest``).

    ``digest`` returns n_tokens, ids_sha256 and, after decoding those ids again, decoded_sha256. ``tokenizer`` is a
    vocabulary file that the driver can read. Other columns are not read.
    """
    kind, sent = docs.schema[key].dataType.simpleString(), _sent(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(sent)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows: list[tuple] = []
            for i, j in chunks([len(t) for t in texts]):
                for ids in bpe.encode_all(texts[i:j]):
                    if output == "ids":
                        rows.append((ids.astype(np.int32),))
                    else:
                        back = bpe.decode(ids).encode()
                        rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * (1 if output == "ids" else 3)
            types = [pa.list_(pa.int32())] if output == "ids" else [pa.int64(), pa.string(), pa.string()]
            names = ["ids"] if output == "ids" else ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], [key, *names]
            )

    more = "ids array<int>" if output == "ids" else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return lean(docs).select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, {more}")


def decode(tokens: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and text of arrays of ids; null arrays decode to empty texts, invalid UTF-8 to replacement characters."""
    kind, sent = tokens.schema[key].dataType.simpleString(), _sent(tokens.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(sent)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return tokens.select(key, F.col(ids).alias("__ids")).mapInArrow(run, f"`{key}` {kind}, text string")
