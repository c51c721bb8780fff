"""Literals counted in many texts at once: an automaton as a table, gone through by all stretches of a slice side by side.

The state after a character depends on no more characters than the longest literal has, so joined texts are cut into stretches
that each begin a literal's length earlier. One step of all stretches is one look into the table. Matches become numbers (text,
literal, place), and are sorted once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Entries of the table, at most (4 bytes each), and characters of a literal.
ENTRIES = 1 << 24
LONGEST = 512


def fits(literals: Sequence[str]) -> bool:
    """Whether there are such literals, all different, of printable ASCII characters, and few enough for a table."""
    return bool(literals) and all(literals) and all(x.isascii() and x.isprintable() and len(x) <= LONGEST for x in literals) and len(set(literals)) == len(literals) and (sum(map(len, literals)) + 1) * (len(set("".join(literals))) + 1) <= ENTRIES


class Automaton:
    """Counts literals (``fits``) without overlap from the left, as ``str.count`` does."""

    def __init__(self, literals: Sequence[str]):
        self.length = np.array([len(x) for x in literals], np.int64)
        text = np.frombuffer("".join(literals).encode("ascii"), np.uint8)
        used = np.unique(text)
        self.symbol = np.zeros(128, np.uint8)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        codes, begins = self.symbol[text].astype(np.int64), np.cumsum(self.length) - self.length
        # the nodes of each depth: their parents and symbols
        at, levels, size = np.zeros(len(self.length), np.int64), [], 1
        ends = np.zeros(len(self.length), np.int64)
        for depth in range(int(self.length.max())):
            on = np.flatnonzero(self.length > depth)
            edges, of = np.unique(at[on] * self.width + codes[begins[on] + depth], return_inverse=True)
            at[on] = size + of
            levels.append((np.arange(size, size + len(edges)), edges // self.width, edges % self.width))
            size += len(edges)
            done = on[self.length[on] == depth + 1]
            ends[done] = at[done]
        self.literal = np.full(size, -1, np.int64)
        self.literal[ends] = np.arange(len(ends))
        table, fail, self.shorter = np.zeros((size, self.width), np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64)
        table[0, levels[0][2]] = levels[0][0]
        for depth, (nodes, parents, symbols) in enumerate(levels):
            if depth:
                fail[nodes] = table[fail[parents], symbols]
            back = fail[nodes]
            self.shorter[nodes] = np.where(self.literal[back] >= 0, back, self.shorter[back])
            table[nodes] = table[back]
            if depth + 1 < len(levels):
                further, parents, symbols = levels[depth + 1]
                table[parents, symbols] = further
        self.longest = np.where(self.literal >= 0, np.arange(size), self.shorter)
        self.table = (table * self.width).ravel()

    def _states(self, symbols: np.ndarray) -> np.ndarray:
        """The state after each symbol."""
        before = int(self.length.max()) - 1
        run = max(256, 4 * before, int(len(symbols) ** 0.5))
        lanes = -(-len(symbols) // run)
        padded = np.zeros(before + lanes * run, np.uint8)
        padded[before : before + len(symbols)] = symbols
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (lanes, before + run), (run, 1)).T)
        state, out = np.zeros(lanes, np.int32), np.empty((run, lanes), np.int32)
        for k, step in enumerate(steps):
            state = self.table.take(state + step)
            if k >= before:
                out[k - before] = state
        return out.T.ravel()[: len(symbols)] // self.width

    def counts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, literal, times) as numbers, in order, where a literal occurs. No text has a line break."""
        chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(chars):
            return (np.zeros(0, np.int64),) * 3
        state = self.longest[self._states(self.symbol[np.minimum(chars, 127)])]
        place = np.flatnonzero(state)
        state, many = state[place], len(self.length)
        text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[place] * many
        bits, found = len(chars).bit_length(), []
        while len(place):
            found.append((text + self.literal[state] << bits) | place)
            state = self.shorter[state]
            more = np.flatnonzero(state)
            state, place, text = state[more], place[more], text[more]
        every = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        key, place = every >> bits, every & ((1 << bits) - 1)
        same = key[1:] == key[:-1]
        near = np.flatnonzero(same & (place[1:] - place[:-1] < self.length[key[1:] % many])) + 1
        if len(near):  # a match that begins in the one before: only such runs are gone through one by one
            taken, last, before = np.ones(len(key), bool), 0, -1
            for k, here, previous, length in zip(near.tolist(), place[near].tolist(), place[near - 1].tolist(), self.length[key[near] % many].tolist(), strict=True):
                if before != k - 1:
                    last = previous
                if here - last < length:
                    taken[k] = False
                else:
                    last = here
                before = k
            key = key[taken]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        return key[first] // many, key[first] % many, np.diff(first, append=len(key))
