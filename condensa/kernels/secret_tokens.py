"""Tokens of high entropy, which no lossy result may lose."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
LEAST_ENTROPY = 0.85
_DIGIT, _LETTER, _HEX = re.compile(r"\d"), re.compile(r"[A-Za-z]"), re.compile(r"[0-9a-fA-F]{32,}")


def entropy_share(token: str) -> float:
    """Shannon entropy over that of a uniform choice of its distinct characters."""
    counts = Counter(token)
    if len(counts) < 2:
        return 0.0
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in counts.values()) / math.log2(len(counts))


def _secrets(text: str, source: bool = False) -> Iterator[str]:
    for token in CANDIDATE.findall(text) if len(text) >= 20 else ():
        if not (_DIGIT.search(token) and _LETTER.search(token)):
            continue
        if source and not (_HEX.fullmatch(token) or len(_DIGIT.findall(token)) >= 3):
            continue
        if entropy_share(token) >= LEAST_ENTROPY:
            yield token


def secret_tokens(text: str, source: bool = False) -> Counter[str]:
    """High-entropy tokens with their counts; a digit and a letter are asked for, in source code mixed with both cases or hex."""
    return Counter(_secrets(text, source))


def has_secret(text: str) -> bool:
    return any(True for _ in _secrets(text))


def keeps_secrets(original: str, view: str, source: bool = False) -> bool:
    """Every high-entropy token of the original is in the view as often."""
    left = Counter(CANDIDATE.findall(view))
    return all(left[t] >= n or view.count(t) >= n for t, n in secret_tokens(original, source).items())
