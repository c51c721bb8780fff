"""Token counts by a compiled finite-state transducer.

A piece vocabulary with ranked merges is compiled to a deterministic transducer over characters. After any prefix p of
a marked word, the library's segmentation of p ends in one last token; p without it is segmented as before, and two
neighbouring tokens stand side by side exactly if merging their joined text gives those two. So the last token at each
position follows from the last tokens at earlier positions of the word, of which only those count where a longer piece
may have begun. These (the suffixes of p that are proper prefixes of pieces, with last token and count so far) are the
state. A transition emits the change in the number of tokens, which may be negative when pieces merge. White-space
markers begin a word in one and the same state, since no piece crosses them. States and transitions are made when they
are first met and kept for the worker's life, up to ``MAX_STATES`` (then the machine is emptied and starts again). The
``DENSE`` letters met first have a dense table, all others a dictionary, and texts are worked off in blocks of
``BLOCK_CHARS`` that hand on the state they end in, so memory is bounded whatever the texts.

A block is cut into chunks. Each chunk has a map from states at its begin to those at its end with the counts emitted.
Behind a chunk's first marker the map is constant, so that part runs once. For what lies before, the start states are
those in which the chunk before may end: first the state that it reaches from the root, then the images of these under
the maps, in a few rounds in which all chunks run side by side (the machine forgets its start within a few letters, so
one round mostly does). The maps are then composed by a prefix scan in logarithmically many steps, which gives each
chunk's true start. Where a true start is not among a map's states, it is added and the scan repeated.

Characters outside the vocabulary emit one token for each byte. Null and empty texts have 0 tokens. Only the id and text
columns are read; repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._common import map_slices, model_path, read, texts_of

MARK = "▁"
MAX_STATES = 160_000
CHUNK = 384
BLOCK_CHARS = 1 << 18
#: Letters with a column in the dense table.
DENSE = 80
#: Rounds in which images of start states are followed before the maps are composed.
ROUNDS = 4
#: Marks of characters without a piece, by their number of UTF-8 bytes.
_LOOSE = ["\0 1", "\0 2", "\0 3", "\0 4"]


class Transducer:
    """Counts the tokens of a SentencePiece BPE vocabulary with byte fallback and without rewriting of texts."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.encode("a  b", out_type=str) == sp.encode("a b", out_type=str):
            raise ValueError("the vocabulary rewrites texts before it cuts them")
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in normal}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("this vocabulary has pieces across white-space markers")
        self.prefixes = {p[:n] for p in self.rank for n in range(1, len(p))}
        self.longest = max(map(len, self.rank))
        letters = sorted({c for p in self.rank for c in p} - {MARK})
        self.letters = [MARK, *_LOOSE, *letters]
        self.n = len(self.letters)
        self.code = np.zeros(0x110000, np.int32)
        points = np.arange(0x110000)
        self.code[:] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        self.code[[ord(c) for c in letters]] = np.arange(5, self.n)
        self.code[[ord(" "), ord(MARK)]] = 0
        self.max_states = max_states
        self.clear()

    def clear(self) -> None:
        self.states, self.keys = {}, []
        self.beside, self.merged, self.rare = {}, {}, {}
        #: By state and letter's column: next state * 64 + (change in count + 32); 0 where not yet made. The last column stays empty.
        self.slot = np.full(self.n, DENSE, np.int64)
        self.used = 0
        self.table = np.zeros((4096, DENSE + 1), np.int32)
        self.state(())

    def full(self) -> bool:
        """Whether the machine is to be emptied before it goes on."""
        return len(self.keys) > self.max_states or len(self.rare) > 4 * self.max_states or len(self.beside) > 4 * self.max_states

    def state(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table[: len(self.table) // 2])])
        return found

    def merge(self, text: str) -> list[str]:
        """The library's segmentation of a few characters: the best-ranked pair first, from the left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1))
            if best == np.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, piece: str) -> bool:
        if piece not in self.merged:
            self.merged[piece] = len(self.merge(piece)) == 1
        return self.merged[piece]

    def fits(self, a: str, b: str) -> bool:
        """Whether tokens a and b can stand side by side."""
        if not a or a in _LOOSE:
            return True
        key = (a, b)
        if key not in self.beside:
            self.beside[key] = self.merge(a + b) == [a, b]
        return self.beside[key]

    def step(self, key: tuple, letter: str) -> tuple[tuple, int]:
        """The state after one more character, and the change in the count.

        A state is the tuple of (open prefix, last token before it, tokens since then), longest first; the last entry is
        ("", last token, 0) for the present position.
        """
        if letter in _LOOSE:
            return (("", letter, 0),), int(letter[-1])
        here, last = None, ""
        starts = key or (("", "", 0),)
        for prefix, before, since in starts:
            piece = prefix + letter
            if (piece in self.rank if len(piece) > 1 else True) and self.whole(piece) and self.fits(before, piece):
                here, last = 1 - since, piece
                break
        if here is None:
            raise AssertionError("no token ends here")
        opened = [(p + letter, b, s + here) for p, b, s in starts if p + letter in self.prefixes]
        return (*opened, ("", last, 0)), here

    def fill(self, state: int, letter: int) -> int:
        """Make one transition, or find it among those of letters without a column."""
        if (made := self.rare.get((state, letter))) is not None:
            return made
        if letter == 0 and not self.only_marks(state):
            after, change = self.step((), MARK)
        else:
            after, change = self.step(self.keys[state], self.letters[letter])
        made = self.state(after) * 64 + change + 32
        if self.slot[letter] == DENSE and self.used < DENSE:
            self.slot[letter] = self.used
            self.used += 1
        if self.slot[letter] < DENSE:
            self.table[state, self.slot[letter]] = made
        else:
            self.rare[state, letter] = made
        return made

    def only_marks(self, state: int) -> bool:
        """Whether the word so far has markers only: a further marker then continues it."""
        key = self.keys[state]
        return bool(key) and not key[-1][1].strip(MARK)

    def run(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states and counts of runs codes[begins:ends], side by side, each from its own state."""
        order = np.argsort(begins - ends, kind="stable")
        at, left = begins[order], (ends - begins)[order]
        state, total = states[order].astype(np.int64), np.zeros(len(order), np.int64)
        live = int(np.count_nonzero(left))
        for k in range(int(left[0]) if len(left) else 0):
            while live and left[live - 1] <= k:
                live -= 1
            letters = codes[at[:live] + k]
            made = self.table[state[:live], self.slot[letters]]
            if not made.all():
                for i in np.flatnonzero(made == 0).tolist():
                    s, c = int(state[i]), int(letters[i])
                    made[i] = self.table[s, self.slot[c]] or self.fill(s, c)
            state[:live] = made >> 6
            total[:live] += (made & 63) - 32
        out_state, out_total = np.empty_like(state), np.empty_like(total)
        out_state[order], out_total[order] = state, total
        return out_state, out_total

    def block(self, codes: np.ndarray, fresh: np.ndarray, cuts: np.ndarray, start: int) -> tuple[np.ndarray, int]:
        """Counts of the chunks that begin at ``cuts``, and the state at the end; ``start``: the state before the first chunk."""
        n, ends = len(cuts), np.append(cuts[1:], len(codes))
        places = np.append(np.flatnonzero(fresh), len(codes))
        first = np.minimum(places[np.searchsorted(places, cuts)], ends)  # the chunk's first fresh marker, or its end
        after, rest = self.run(codes, first, ends, np.zeros(n, np.int64))
        constant = first < ends
        # guess: the state at the chunk's end, from the root where its map is not constant
        guess = np.where(constant, after, self.run(codes, cuts, np.where(constant, cuts, first), np.zeros(n, np.int64))[0])
        #: By chunk: start state -> (end state, count) of the part before the first fresh marker.
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in range(n)]
        front = {(0, start)} | {(c, int(guess[c - 1])) for c in range(1, n)}
        while True:
            for _ in range(ROUNDS):
                asked = sorted(front)
                which, states = (np.array([a[k] for a in asked], np.int64) for k in (0, 1))
                got, counts = self.run(codes, cuts[which], first[which], states)
                for (c, s), e, t in zip(asked, got.tolist(), counts.tolist(), strict=True):
                    maps[c][s] = (int(after[c]) if constant[c] else e, t)
                front = {(c + 1, maps[c][s][0]) for c, s in asked if c + 1 < n and maps[c][s][0] not in maps[c + 1]}
                if not front:
                    break
            # scan: places of the start states in each map; the column behind the last stands for a state that a map lacks
            width = max(map(len, maps))
            place = [{s: k for k, s in enumerate(m)} for m in maps]
            to, add = np.full((n, width + 1), width, np.int64), np.zeros((n, width + 1), np.int64)
            for c, m in enumerate(maps):
                for k, (e, t) in enumerate(m.values()):
                    to[c, k] = place[c + 1].get(e, width) if c + 1 < n else 0
                    add[c, k] = t
            reach, d = to.copy(), 1
            while d < n:
                reach[d:] = np.take_along_axis(reach[d:], reach[:-d], 1)
                d *= 2
            begin = place[0][start]
            true = np.concatenate([[begin], reach[:-1, begin]])
            lacking = np.flatnonzero(true == width)
            if not lacking.size:
                last = list(maps[-1].values())[true[-1]][0]
                return rest + add[np.arange(n), true], last
            c = int(lacking[0])
            front = {(c, list(maps[c - 1].values())[true[c - 1]][0])}

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        lengths = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        joined = "".join(MARK + t for t in texts if t)
        if not joined:
            return np.zeros(len(texts), np.int64)
        codes = self.code[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
        mark = codes == 0
        fresh = mark.copy()  # markers behind another character: any state leads from here to the same one
        fresh[1:] &= ~mark[:-1]
        text_ends = np.cumsum(lengths[lengths > 0])
        begins_text = np.concatenate([[0], text_ends[:-1]])
        fresh[begins_text] = True
        # chunks: at most CHUNK characters, and each text begins one
        cuts = np.unique(np.concatenate([begins_text, np.arange(0, len(codes), CHUNK)]))
        totals, key, at = np.zeros(len(cuts), np.int64), (), 0
        while at < len(cuts):
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK_CHARS)))
            end = int(cuts[to]) if to < len(cuts) else len(codes)
            if self.full():
                self.clear()
            here = slice(int(cuts[at]), end)
            totals[at:to], state = self.block(codes[here], fresh[here], cuts[at:to] - cuts[at], self.state(key))
            key, at = self.keys[state], to
        sums = np.concatenate([[0], np.cumsum(totals)])
        out = np.zeros(len(texts), np.int64)
        place = np.append(np.searchsorted(cuts, begins_text), len(cuts))
        out[lengths > 0] = sums[place[1:]] - sums[place[:-1]]
        return out


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """One transducer for a Python worker and vocabulary, kept between tasks."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8) and ``n_tokens`` (without begin and end)."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(part, "text")
        sizes = pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(machine(path).counts(texts))], names=[id_col, "n_bytes", "n_tokens"])

    return map_slices(own, "text", f"`{id_col}` {kind}, n_bytes long, n_tokens long", run, limit=1 << 22)


#: A text with more tokens than this does not fit the training window.
TOKEN_LIMIT = 4096


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = count_tokens(read(spark, sf_dir, "documents"), model_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
