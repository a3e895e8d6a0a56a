"""Token counts of a unigram tokenizer: Viterbi that carries the best score and the number of pieces only.

An Aho-Corasick automaton of the vocabulary enumerates the pieces that end at each character; the best score of a
prefix is the largest sum over the last piece, and with it goes the number of its pieces. No path is kept. Of equal
scores the longest last piece wins, as in the tokenizer, which visits starts in ascending order and replaces only for
a larger sum. A character without a piece of its own can be unknown, at the least score less 10; unknown characters
are one piece together, or a piece for each byte if the vocabulary has all bytes.

Words (a text cut before each space mark) are counted on their own, as the tokenizer cuts there too; each distinct
word is counted once per worker, up to a bounded number of words.

Defined results: null and empty texts have no tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.llm.common import chunks, lean

MARK = "▁"
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    MOST_WORDS = 250_000

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                # of equal pieces the last one counts, as in the tokenizer's map
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        pieces, open_unknown = [0] * (n + 1), [False] * (n + 1)
        single = [False] * (n + 1)

        def unknown(at: int) -> None:
            if single[at]:
                return
            score = best[at - 1] + self.unknown
            if best[at] is None or score > best[at]:
                more = len(word[at - 1].encode()) if self.bytes else int(not open_unknown[at - 1])
                best[at], pieces[at], open_unknown[at] = score, pieces[at - 1] + more, True

        done = 0
        for end, (size, piece_score) in self.automaton.iter(word):
            at = end + 1
            while done < end:  # all characters before this one are settled
                done += 1
                unknown(done)
            start = at - size
            if size == 1:
                single[at] = True
            score = best[start] + piece_score
            if best[at] is None or score > best[at]:
                best[at], pieces[at], open_unknown[at] = score, pieces[start] + 1, False
        while done < n:
            done += 1
            unknown(done)
        return pieces[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for word in (text if text[0] in (" ", MARK) else " " + text).replace(" ", MARK).split(MARK)[1:]:
            n = known.get(word)
            if n is None:
                if len(known) >= self.MOST_WORDS:
                    known.clear()
                n = known[word] = self.count_word(MARK + word)
            total += n
        return total


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file; special pieces are left out as matches, bytes are kept."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]


#: Of a worker, for all its tasks.
_loaded: dict[str, UnigramCounter] = {}


def _load(name: str, pieces: Broadcast) -> UnigramCounter:
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = UnigramCounter(pieces.value)
    return _loaded[name]


def count_tokens(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and n_tokens of every whole text. The driver reads ``model_file`` and sends its pieces (a megabyte or so)."""
    kind, pieces = docs.schema[key].dataType.simpleString(), vocabulary(model_file)
    shared, name = docs.sparkSession.sparkContext.broadcast(pieces), hashlib.sha256(repr(pieces).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _load(name, shared)
        for b in batches:
            texts = b.column(1).to_pylist()
            out = []
            for i, j in chunks([len(t or "") for t in texts]):
                out += [counter.count(t or "") for t in texts[i:j]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], [key, "n_tokens"])

    return lean(docs).select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long")
