"""Many texts at once, as arrays of code points: a trie that all places of the texts walk together, and counts of substrings.

Code points are kept plus one, and a zero ends each text, so that nothing is found across texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of a code point; a number that hashes well; what a free slot holds.
BITS, ODD, FREE = 21, np.uint64(0x9E3779B97F4A7C15), -1
CODE = (1 << BITS) - 1


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of `most` in all, or of one row that is larger."""
    if not len(sizes):
        return
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])


def lengths_of(texts: pa.Array) -> np.ndarray:
    return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def code_points(texts: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """The texts' code points plus one, a zero behind each text and some at the end. No text is null."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(lengths)
    out = np.zeros(int(lengths.sum()) + n + 4, np.int64)
    if n and data is not None:
        ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1]
        raw = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        out[np.arange(len(codes)) + np.repeat(np.arange(n), lengths)] = codes
        out[: len(codes) + n] += 1
        out[np.cumsum(lengths + 1) - 1] = 0
    return out


class Trie:
    """Strings, none empty: `value` has for each node the first string that ends there, or -1."""

    def __init__(self, strings: list[str]):
        column = pa.array(strings, pa.string())
        lengths = lengths_of(column)
        codes = code_points(column, lengths)
        at = np.cumsum(lengths + 1) - lengths - 1
        node = np.zeros(len(strings), np.int64)
        keys, count = [], 1
        self.depth = int(lengths.max(initial=0))
        for d in range(self.depth):
            live = np.flatnonzero(lengths > d)
            own, place = np.unique(node[live] << BITS | codes[at[live] + d], return_inverse=True)
            node[live] = count + place
            keys.append(own)
            count += len(own)
        self.value = np.full(count, -1, np.int32)
        self.value[node[::-1]] = np.arange(len(strings))[::-1]
        key = np.concatenate([*keys, np.zeros(0, np.int64)])
        self.leaf = np.ones(count, bool)
        self.leaf[key >> BITS] = False
        self.root = np.zeros(int(codes.max(initial=0)) + 2, np.int32)
        first = keys[0] if keys else key
        self.root[first] = np.arange(1, len(first) + 1)
        bits = max(4, (4 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, FREE, np.int64), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(key)), self._slots(key)
        while len(left):
            free = self.keys[slot] == FREE
            self.keys[slot[free]] = key[left[free]]
            won = self.keys[slot] == key[left]
            self.nodes[slot[won]] = left[won] + 1
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * ODD >> self.shift).view(np.int64)

    def _children(self, key: np.ndarray) -> np.ndarray:
        """Nodes by parent and code point; 0 where there is none."""
        slot = self._slots(key)
        held = self.keys[slot]
        found = held == key
        out = np.where(found, self.nodes[slot], 0)
        rest = np.flatnonzero(~found & (held != FREE))
        while len(rest):
            slot[rest] = own = (slot[rest] + 1) & self.mask
            held = self.keys[own]
            found = held == key[rest]
            out[rest[found]] = self.nodes[own[found]]
            rest = rest[~found & (held != FREE)]
        return out

    def walk(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each depth from 1 on: the places, in order, where so many characters lead to a node, and the nodes."""
        node = self.root[np.minimum(codes, len(self.root) - 1)]
        place = np.flatnonzero(node)
        node = node[place]
        for depth in range(1, self.depth + 1):
            if not len(place):
                return
            yield depth, place, node
            inner = np.flatnonzero(~self.leaf[node])
            place = place[inner]
            node = self._children(node[inner].astype(np.int64) << BITS | codes[place + depth])
            found = np.flatnonzero(node)
            place, node = place[found], node[found]


def _spelt(keys: np.ndarray, n: int, names: list[str] | None) -> list[str]:
    codes = np.stack([keys >> BITS * (n - 1 - k) & CODE for k in range(n)], axis=1) - 1
    text = codes.astype(np.uint32).tobytes().decode("utf-32-le")
    tails = [text[k : k + n] for k in range(0, len(text), n)]
    return tails if names is None else [names[i] + t for i, t in zip((keys >> BITS * n).tolist(), tails)]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys and their sums."""
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def substrings(codes: np.ndarray, most: int, weights: np.ndarray | None, trie: Trie | None = None, names: list[str] | None = None) -> Iterator[tuple[list[str], list[int]]]:
    """The substrings of up to `most` characters and their counts, or weights by place; with a trie, whose strings
    (names) are of one length, only longer ones that begin with a string of it. Each substring comes once."""
    if trie is None:
        n, place, name = 0, np.flatnonzero(codes), None
    else:
        n = trie.depth
        place, name = next(((p, trie.value[v].astype(np.int64)) for d, p, v in trie.walk(codes) if d == n), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    while n < most:
        more = codes[place + n] != 0
        place, name = place[more], None if name is None else name[more]
        if not len(place):
            return
        step = min(most - n, 3 if name is None else 2 if len(names) < 1 << BITS else 1)
        key = c = codes[place + n]
        if name is not None:
            key = name << BITS | c
        for k in range(1, step):
            c = np.where(c == 0, 0, codes[np.minimum(place + n + k, len(codes) - 1)])
            key = key << BITS | c
        if weights is None:
            own = np.sort(key)
            first = np.flatnonzero(np.diff(own, prepend=own[:1] - 1))
            own, sums = own[first], np.diff(first, append=len(own))
        else:
            order = np.argsort(key)
            own, sums = _summed(key[order], weights[place[order]])
        for k in range(1, step + 1):
            part = own >> BITS * (step - k)
            whole = part & CODE != 0
            heads, total = _summed(part[whole], sums[whole])
            if len(heads):
                spelt = _spelt(heads, k, names)
                yield spelt, total.tolist()
        n += step
        if n < most and len(heads):
            full = key & CODE != 0
            place, name, names = place[full], np.searchsorted(heads, key[full]), spelt
        elif not len(heads):
            return
