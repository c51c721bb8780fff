"""Share of matching characters of pairs of texts, exact, for many pairs at a time in numpy.

The measure takes the longest common run of two texts (the first in the one, then in the other), and goes on left and right of it.
All pairs of a batch form one string, whose substrings of 1, 2, 4, ... characters get ranks by prefix doubling, as in the making of
a suffix array: equal ranks are equal substrings, and the common prefix of two places is read from the ranks. Substrings that only
one text of a pair holds get none, so the longer ones of unlike texts cost little. Open stretches of
all pairs are worked off together, from long runs to short ones: at each length all common runs of a stretch are listed, each round
takes the longest of every stretch and cuts what it parts. Where a stretch has too many places to list (long repetitions), its
longest run is found by a suffix automaton, and the listing goes on in the two parts.
"""

from __future__ import annotations

import numpy as np

#: Lengths that are worked off, and pairs of places that are listed at a time.
LENGTHS = (256, 64, 16, 8, 4, 2, 1)
PLACES = 1 << 20
#: Characters of the pairs that are worked off together; a longer pair is alone.
TOGETHER = 1 << 17


def longest_common(a, b) -> tuple[int, int, int]:
    """(begin in a, begin in b, length) of the longest common run, the first in a and then in b; by a suffix automaton of b."""
    nxt: list[dict] = [{}]
    link, length, end = [-1], [0], [0]
    last = 0
    for j, c in enumerate(b, 1):
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(j)
        end.append(j)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            at = nxt[p][c]
            if length[at] != length[p] + 1:
                copy = len(nxt)
                nxt.append(dict(nxt[at]))
                link.append(link[at])
                length.append(length[p] + 1)
                end.append(end[at])
                link[at] = copy
                while p != -1 and nxt[p].get(c) == at:
                    nxt[p][c] = copy
                    p = link[p]
                at = copy
            link[new] = at
        last = new
    best = (0, 0, 0)
    state = n = 0
    for i, c in enumerate(a, 1):
        while state and c not in nxt[state]:
            state = link[state]
            n = length[state]
        state = nxt[state].get(c, 0)
        n = n + 1 if state else 0
        if n > best[2]:
            best = (i - n, end[state] - n, n)
    return best


def _by_code(code: np.ndarray, at: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and places (ascending) in order of the codes, then of the places; as one number where both fit into it."""
    bits = places.bit_length()
    if len(code) and int(code.max()) >= 1 << (63 - bits):
        order = np.argsort(code, kind="stable")
        return code[order], at[order]
    both = np.sort((code << bits) | at)
    return both >> bits, both & ((1 << bits) - 1)


def _starts(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


class _Text:
    """One string of all texts, with the ranks of its substrings.

    From four characters on, only substrings that both texts of a pair hold have a rank, so longer ones are looked for at few
    places; others have -1 in the first text and -2 in the second, which never agree.
    """

    def __init__(self, texts: list[str]):
        parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        lengths = np.array([len(p) for p in parts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(lengths)])
        chars = np.concatenate([*parts, np.zeros(1, "<u4")])
        self.side = np.append(np.repeat(np.arange(len(parts), dtype=np.int8) & 1, lengths), np.int8(0))
        self.pair = np.append(np.repeat(np.arange(len(parts), dtype=np.int32) >> 1, lengths), np.int32(-1))
        room = np.append(np.repeat(self.begins[1:], lengths), len(chars)) - np.arange(len(chars))  # characters up to the end of a text
        seen = np.zeros(int(chars.max()) + 1, bool)
        seen[chars] = True
        ranks = (np.cumsum(seen) - 1)[chars]
        self.ranks = {1: ranks}
        k, top, longest = 1, int(ranks.max()) + 1, int(lengths.max(initial=0))
        while 2 * k <= min(LENGTHS[0], longest):
            if k < 4:  # places near the end of a text run on into the next one; nothing asks for them
                code = ranks * top
                code[:-k] += ranks[k:]
                if k == 1 and top < 1 << 12:  # the codes themselves are small enough
                    ranks, top = code, top * top
                elif k == 1:
                    ranks, top = np.unique(code, return_inverse=True)[1], len(chars)
                else:
                    at = np.flatnonzero(room >= 2 * k)
                    ranks, top = self._shared(code[at], at)
            else:
                at = np.flatnonzero(ranks >= 0)
                at = at[room[at] >= 2 * k]
                at = at[ranks[at + k] >= 0]
                if not len(at):
                    break
                ranks, top = self._shared(ranks[at] * top + ranks[at + k], at)
            k *= 2
            self.ranks[k] = ranks

    def _shared(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
        """Ranks of the substrings with these codes that both texts of a pair hold, and a number above them."""
        code, at = _by_code(code, at, len(self.side))
        new = _starts(code) | _starts(self.pair[at])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        both = self.side[at[first]] != self.side[at[last]]
        ranks = -1 - self.side.astype(np.int64)
        group = np.cumsum(new) - 1
        keep = both[group]
        ranks[at[keep]] = (np.cumsum(both) - 1)[group[keep]]
        return ranks, int(both.sum()) + 1

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, below: int | None) -> np.ndarray:
        """Length of the common run from places i and j on, up to ``most``; ``below``: no run is so long."""
        n = np.zeros(len(i), np.int64)
        lengths = sorted((k for k in self.ranks if below is None or k < below), reverse=True)
        if below is None:
            longest = lengths.pop(0)
            active = np.arange(len(i))
            while len(active):  # by the longest substrings, as often as they agree
                active = active[n[active] + longest <= most[active]]
                active = active[self.ranks[longest][i[active] + n[active]] == self.ranks[longest][j[active] + n[active]]]
                n[active] += longest
        for k in lengths:
            fits = np.flatnonzero(n + k <= most)
            at = n[fits]
            fits = fits[self.ranks[k][i[fits] + at] == self.ranks[k][j[fits] + at]]
            n[fits] += k
        return n


def _runs(text: _Text, open_: np.ndarray, k: int, below: int | None):
    """All common runs of at least k characters in these stretches (rows: a begin, a end, b begin, b end): stretch, i, j, length.

    Gives parts of them, for as many stretches at a time as ``PLACES`` allows, and stretches that hold too many by themselves.
    """
    ranks, chars = text.ranks[k], text.ranks[1]

    def places(low, high):
        n = np.maximum(high - low - k + 1, 0)
        owner = np.repeat(np.arange(len(low)), n)
        at = np.arange(len(owner)) + np.repeat(low - (np.cumsum(n) - n), n)
        if k >= 4:
            shared = ranks[at] >= 0
            owner, at = owner[shared], at[shared]
        return owner, at

    (oa, ia), (ob, jb) = places(open_[:, 0], open_[:, 1]), places(open_[:, 2], open_[:, 3])
    if not len(ia) or not len(jb):
        return
    at, owner = np.concatenate([ia, jb]), np.concatenate([oa, ob])
    own = ranks[at]
    bits = int(own.max()).bit_length()
    code = (owner << bits) | own
    if int(code.max()) >= 1 << (63 - len(chars).bit_length()):
        order = np.lexsort((at, code))
        code, at = code[order], at[order]
    else:
        code, at = _by_code(code, at, len(chars))
    first = np.flatnonzero(_starts(code))
    size = np.diff(first, append=len(code))
    in_b = np.add.reduceat(text.side[at].astype(np.int64), first)
    both = (in_b > 0) & (in_b < size)
    first, in_b = first[both], in_b[both]
    in_a, stretch = size[both] - in_b, code[first] >> bits
    per = np.bincount(stretch, weights=in_a * in_b, minlength=len(open_)).astype(np.int64)
    many = per > PLACES
    if many.any():
        yield np.flatnonzero(many), None
    part = np.cumsum(np.where(many, 0, per)) // PLACES
    for g in np.unique(part[~many & (per > 0)]):
        take = np.flatnonzero((part[stretch] == g) & ~many[stretch])
        na, nb = in_a[take], in_b[take]
        in_first = np.arange(int(na.sum())) + np.repeat(first[take] - (np.cumsum(na) - na), na)  # places in the first texts
        times, to, s = np.repeat(nb, na), np.repeat(first[take] + na, na), np.repeat(stretch[take], na)
        i, s = np.repeat(at[in_first], times), np.repeat(s, times)
        j = at[np.arange(len(i)) + np.repeat(to - (np.cumsum(times) - times), times)]
        box = open_[s]
        inner = np.flatnonzero((i > box[:, 0]) & (j > box[:, 2]))
        inner = inner[chars[i[inner] - 1] == chars[j[inner] - 1]]
        begins = np.ones(len(i), bool)  # where runs begin
        begins[inner] = False
        i, j, s, box = i[begins], j[begins], s[begins], box[begins]
        yield None, (s, i, j, text.common(i, j, np.minimum(box[:, 1] - i, box[:, 3] - j), below))


def _rounds(open_: np.ndarray, owner: np.ndarray, runs, k: int, matched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Take the longest run of every stretch, again and again, until no run of k characters is left; the stretches that remain."""
    s, i, j, n = runs
    done, done_owner = [], []
    while True:
        longest = np.zeros(len(open_), np.int64)
        np.maximum.at(longest, s, n)
        held = longest > 0
        done.append(open_[~held])
        done_owner.append(owner[~held])
        if not len(s):
            return np.concatenate(done), np.concatenate(done_owner)
        best = np.flatnonzero(n == longest[s])  # the longest, then the first in a, then in b: one for each stretch with runs
        for place in (i, j):
            least = np.full(len(open_), np.iinfo(np.int64).max)
            np.minimum.at(least, s[best], place[best])
            best = best[place[best] == least[s[best]]]
        bi, bj, bn, bs = i[best], j[best], n[best], s[best]
        np.add.at(matched, owner[bs], bn)
        left = np.column_stack([open_[bs, 0], bi, open_[bs, 2], bj])
        right = np.column_stack([bi + bn, open_[bs, 1], bj + bn, open_[bs, 3]])
        number = np.zeros(len(open_), np.int64)
        number[bs] = np.arange(len(bs))
        s = number[s]
        di, dj, end = bi[s] - i, bj[s] - j, bn[s]
        short = np.minimum(n, np.minimum(di, dj))  # what lies before the block in both texts
        skip = np.maximum(0, np.maximum(di, dj) + end)  # and behind it
        before, behind = np.flatnonzero(short >= k), np.flatnonzero(n - skip >= k)
        off = skip[behind]
        parts = ((s[before], i[before], j[before], short[before]), (s[behind] + len(bs), i[behind] + off, j[behind] + off, n[behind] - off))
        open_, owner = np.concatenate([left, right]), np.concatenate([owner[bs], owner[bs]])
        s, i, j, n = (np.concatenate(x) for x in zip(*parts, strict=True))


def _singles(open_: np.ndarray, owner: np.ndarray, runs, matched: np.ndarray) -> None:
    """``_rounds`` where no run is longer than one character: nothing is left before the first, so each round goes on behind it."""
    s, i, j, _ = runs
    order = np.lexsort((j, i))  # places of a tell the stretch
    s, i, j = s[order], i[order], j[order]
    while len(s):
        first = np.flatnonzero(_starts(s))
        matched += np.bincount(owner[s[first]], minlength=len(matched))
        times = np.diff(first, append=len(s))
        keep = np.flatnonzero((i > np.repeat(i[first], times)) & (j > np.repeat(j[first], times)))
        s, i, j = s[keep], i[keep], j[keep]


def matched_characters(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Characters in matching blocks of each pair."""
    matched = np.zeros(len(pairs), np.int64)
    text = _Text([t for pair in pairs for t in pair])
    b = text.begins
    open_ = np.column_stack([b[0:-1:2], b[1::2], b[1::2], b[2::2]]).astype(np.int64)
    owner = np.arange(len(pairs))
    below = None
    for k in LENGTHS:
        if k not in text.ranks:
            continue
        todo, todo_owner, later, later_owner = open_, owner, [], []
        while len(todo):
            small = (todo[:, 1] - todo[:, 0] < k) | (todo[:, 3] - todo[:, 2] < k)
            later.append(todo[small])
            later_owner.append(todo_owner[small])
            todo, todo_owner = todo[~small], todo_owner[~small]
            listed, again, again_owner = np.zeros(len(todo), bool), [], []
            for many, runs in _runs(text, todo, k, below) if len(todo) else ():
                if many is not None:
                    listed[many] = True
                    chars = text.ranks[1]
                    for m in many.tolist():
                        a0, a1, b0, b1 = todo[m].tolist()
                        i, j, n = longest_common(chars[a0:a1].tolist(), chars[b0:b1].tolist())
                        matched[todo_owner[m]] += n
                        again += [[a0, a0 + i, b0, b0 + j], [a0 + i + n, a1, b0 + j + n, b1]]
                        again_owner += [todo_owner[m]] * 2
                    continue
                own = np.unique(runs[0])
                listed[own] = True
                number = np.zeros(len(todo), np.int64)
                number[own] = np.arange(len(own))
                if k == 1 and below == 2:
                    _singles(todo, todo_owner, runs, matched)
                    continue
                rest, rest_owner = _rounds(todo[own], todo_owner[own], (number[runs[0]], *runs[1:]), k, matched)
                later.append(rest)
                later_owner.append(rest_owner)
            later.append(todo[~listed])
            later_owner.append(todo_owner[~listed])
            todo, todo_owner = np.array(again, np.int64).reshape(-1, 4), np.array(again_owner, np.int64)
        open_, owner = np.concatenate(later) if later else open_[:0], np.concatenate(later_owner) if later_owner else owner[:0]
        below = k
    return matched


def ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """2 x matching characters / characters of both texts; 1 for two empty texts."""
    out: list[float] = []
    held: list[tuple[str, str]] = []

    def flush() -> None:
        for (a, b), m in zip(held, matched_characters(held).tolist() if held else (), strict=True):
            out.append(2.0 * m / (len(a) + len(b)) if a or b else 1.0)
        held.clear()

    size = 0
    for a, b in pairs:
        if held and size + len(a) + len(b) > TOGETHER:
            flush()
            size = 0
        held.append((a, b))
        size += len(a) + len(b)
    flush()
    return out
