"""Suffix automata over words, and the matching statistics of a text against one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """Suffix automaton of several word sequences, inserted one after the other with a break between them.

    Of each state it holds where its strings end first, so the earliest occurrence of a match is known.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.size, self.last, self.breaks = 0, 0, 0

    def insert(self, words: Iterable) -> int:
        """Add a sequence; returns the position of its first word."""
        start = self.size
        for w in words:
            self._extend(w)
        self.breaks += 1
        self._extend((self.breaks,))  # equals no word
        return start

    def _extend(self, w) -> None:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        self.first.append(self.size)
        link.append(0)
        at = self.last
        while at >= 0 and w not in nxt[at]:
            nxt[at][w] = new
            at = link[at]
        if at >= 0:
            to = nxt[at][w]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(nxt)
                nxt.append(nxt[to].copy())
                length.append(length[at] + 1)
                link.append(link[to])
                self.first.append(self.first[to])
                link[to] = link[new] = copy
                while at >= 0 and nxt[at].get(w) == to:
                    nxt[at][w] = copy
                    at = link[at]
        self.last = new
        self.size += 1

    def matches(self, words: Iterable, least: int) -> Iterator[tuple[int, int]]:
        """(position in the text, first position here) of the start of each window of ``least`` words that occurs.

        The matching statistic is held at ``least``: what is longer adds no window.
        """
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = n = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(w)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= least:
                while length[link[state]] >= least:
                    state = link[state]
                n = least
                yield i - least + 1, first[state] - least + 1
