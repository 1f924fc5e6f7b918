"""Suffix automaton of token sequences, and matching statistics against it."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def add(self, tokens: Sequence) -> None:
        last = 0
        for token in tokens:
            last = self._extend(last, token)

    def _state(self, size: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _extend(self, last: int, token) -> int:
        moves = self.next
        q = moves[last].get(token)
        if q is not None:  # known from an earlier sequence
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, token, q)
        state = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in moves[p]:
            moves[p][token] = state
            p = self.link[p]
        if p >= 0:
            q = moves[p][token]
            self.link[state] = q if self.size[q] == self.size[p] + 1 else self._clone(p, token, q)
        return state

    def _clone(self, p: int, token, q: int) -> int:
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def matching(self, tokens: Sequence) -> list[int]:
        """For each position the length of the longest known substring that ends there."""
        state, length, out = 0, 0, []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            out.append(length)
        return out
