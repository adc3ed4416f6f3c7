"""A suffix automaton of word sequences, built sequence by sequence, and its form as arrays for broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from wordloom.llm.common import U64, Sorted, mix

_GOLD = U64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """All runs of the sequences added so far. Adding one that is already a run adds no state. If sequences are added
    by document, least first, `first` is the least document in which a state's runs stand."""

    def __init__(self) -> None:
        self.on: list[dict[int, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-(1 << 63)]

    def _state(self, on: dict[int, int], link: int, size: int, first: int) -> int:
        self.on.append(on)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for the shorter runs that reach it through p."""
        copy = self._state(dict(self.on[q]), self.link[q], self.size[p] + 1, self.first[q])
        while p >= 0 and self.on[p].get(word) == q:
            self.on[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: Sequence[int], doc: int = 0) -> None:
        last = 0
        for word in words:
            q = self.on[last].get(word)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
                continue
            now, p = self._state({}, 0, self.size[last] + 1, doc), last
            while p >= 0 and word not in self.on[p]:
                self.on[p][word] = now
                p = self.link[p]
            if p >= 0:
                q = self.on[p][word]
                self.link[now] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
            last = now

    def matches(self, words: Sequence[int]) -> list[int]:
        """Matching statistics: the length of the longest run that ends at each word."""
        state = length = 0
        out = []
        for word in words:
            while state and word not in self.on[state]:
                state = self.link[state]
                length = self.size[state]
            if (to := self.on[state].get(word)) is not None:
                state, length = to, length + 1
            else:
                length = 0
            out.append(length)
        return out


class Compact:
    """An automaton as arrays: transitions in a sorted hash array; links, sizes and first documents by state."""

    def __init__(self, a: SuffixAutomaton):
        state = np.repeat(np.arange(len(a.on)), [len(x) for x in a.on])
        word = np.array([w for x in a.on for w in x], np.int64)
        to = np.array([t for x in a.on for t in x.values()], np.int32)
        self.on = Sorted(self._key(state, word.view(U64)), to)
        self.link, self.size, self.first = np.array(a.link, np.int32), np.array(a.size, np.int32), np.array(a.first, np.int64)

    @staticmethod
    def _key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(word + state.astype(U64) * _GOLD)

    def matches(self, runs: list[np.ndarray], docs: np.ndarray) -> list[np.ndarray]:
        """Matching statistics of each run (words as 64-bit hashes) against documents smaller than its own: the length of
        the longest run of theirs that ends at each word. All runs go on word by word together."""
        sizes = np.array([len(r) for r in runs])
        order = np.argsort(-sizes, kind="stable")
        words = np.zeros((len(runs), sizes.max(initial=0)), U64)
        for k, r in enumerate(order):
            words[k, : sizes[r]] = runs[r]
        out = np.zeros(words.shape, np.int32)
        own, sizes = docs[order], sizes[order]
        state, length = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        for j in range(words.shape[1]):
            left = np.arange(np.searchsorted(-sizes, -j))  # those that have a word here
            while len(left):
                hit, to = self.on.find(self._key(state[left], words[left, j]))
                went, lost = left[hit], left[~hit]
                state[went], length[went] = to[hit], length[went] + 1
                while len(went := went[self.first[state[went]] >= own[went]]):  # only what stands in smaller documents
                    state[went] = self.link[state[went]]
                    length[went] = self.size[state[went]]
                length[lost[state[lost] == 0]] = 0
                left = lost[state[lost] > 0]
                state[left] = self.link[state[left]]
                length[left] = self.size[state[left]]
            out[:, j] = length
        back = np.empty(len(runs), np.int64)
        back[order] = np.arange(len(runs))
        return [out[back[k], : len(r)] for k, r in enumerate(runs)]


def covered(lengths: Sequence[int], least: int) -> list[tuple[int, int]]:
    """Maximal spans of words that matches of at least `least` words cover."""
    out: list[tuple[int, int]] = []
    for end, length in enumerate(lengths, 1):
        if length >= least:
            start = end - length
            while out and out[-1][1] >= start:
                start = min(start, out.pop()[0])
            out.append((start, end))
    return out
