"""A suffix automaton over sequences of small integers, and matching statistics against it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Words compared at once while a match goes on.
AHEAD = 512


class SuffixAutomaton:
    """All runs of a few sequences of numbers (0 or more).

    A state stands for the runs that end at the same places; ``first`` is the
    earliest of these, as a position in ``text``, the sequences one after the
    other, each followed by -2. Built in time linear in their length.
    """

    def __init__(self, sequences: Sequence[np.ndarray]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.text = np.concatenate([x for s in sequences for x in (s, [-2])]).astype(np.int64)
        self.state_at: list[int] = []  # by position: the state of the sequence so far
        last = 0
        for at, c in enumerate(self.text.tolist()):
            last = self._add(last, c, at) if c >= 0 else 0
            self.state_at.append(last)

    def _state(self, length: int, link: int, first: int, follows: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        self.next.append(follows)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The part of ``q`` that is reached from ``p``, as a state of its own."""
        clone = self._state(self.length[p] + 1, self.link[q], self.first[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, c: int, at: int) -> int:
        follows, link, length = self.next, self.link, self.length
        q = follows[last].get(c)
        if q is not None:  # an earlier sequence has it
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new, p = self._state(length[last] + 1, 0, at, {}), last
        while p >= 0 and c not in follows[p]:
            follows[p][c] = new
            p = link[p]
        if p >= 0:
            q = follows[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def earliest(self, least: int) -> tuple[list[int], np.ndarray]:
        """Where the last ``least`` numbers first end (-1 if there are fewer), of the runs of each state, and
        of the sequence up to each position."""
        out = [-1] * len(self.link)
        for v in np.argsort(np.array(self.length), kind="stable").tolist():
            if self.length[v] >= least:
                up = self.link[v]
                out[v] = out[up] if self.length[up] >= least else self.first[v]
        return out, np.array(out, dtype=np.int64)[np.array(self.state_at, dtype=np.int64)]

    def matches(self, sequence: np.ndarray, least: int, earliest: tuple[list[int], np.ndarray]) -> np.ndarray:
        """By position: where the ``least`` numbers that end there first end in ``text``, -1 if the longest match
        ending there (its matching statistic) is shorter. A long match is followed along ``text``, many at once."""
        follows, link, length, first, text = self.next, self.link, self.length, self.first, self.text
        of_state, of_place = earliest
        out, codes = np.full(len(sequence), -1, dtype=np.int64), sequence.tolist()
        i, v, n, end = 0, 0, 0, len(codes)
        while i < end:
            c = codes[i]
            to = follows[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = follows[v].get(c)
            if to is None:
                n = 0
                i += 1
                continue
            v, n = to, n + 1
            if n >= least:
                out[i] = of_state[v]
                p = first[v] + 1
                m = min(end - i - 1, len(text) - p, AHEAD)
                if m and text[p] == codes[i + 1]:
                    unlike = sequence[i + 1:i + 1 + m] != text[p:p + m]
                    k = int(unlike.argmax()) or m if unlike.any() else m
                    out[i + 1:i + 1 + k] = of_place[p:p + k]
                    i, n, v = i + k, n + k, self.state_at[p + k - 1]
                    while length[link[v]] >= n:
                        v = link[v]
            i += 1
        return out
