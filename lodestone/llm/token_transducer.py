"""Counts tokens with a deterministic transducer compiled from a BPE vocabulary with word ends.

The transducer reads a normalised text as bytes. Its state is the kind of piece that is open (letters, other
characters, a number, an apostrophe that may become a contraction) and, for the open piece, the longest suffix
that can still grow into a token together with the last token of the piece's encoding up to each place in that
suffix. That is all the future depends on: a token may follow another where merging by rank would leave the two
side by side, and exactly one token can end at each place. A transition is annotated with the change in the
number of tokens if the piece ended after it; over a text these changes add up to the number of its tokens.
States and transitions are compiled when they are first met; the table is emptied when it is full.

A text is cut into chunks, where it can be before a space, which leads from every state to the same one. All
chunks step through the table side by side. A chunk is a map from the states it may begin in (those in which
its predecessor ends) to end states and counts; the maps of a text are composed by a parallel prefix scan.

Defined results: null text counts as empty and has no tokens; special tokens inside a text count as one token
each, as the tokenizers library has it by default. Extra columns pass through; an output name that is taken
already is an error raised before anything runs.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Symbols of a chunk, before its end is moved to the next space.
CHUNK = 1024
#: How far the end is moved at most.
REACH = 128
#: Chunks that step together.
LANES = 8192
#: States that the table holds; beyond, it is emptied of all but the states in use.
MOST_STATES = 400_000

# The split pattern that the transducer is compiled for, and the characters that its \s stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")

#: Symbols that are no bytes of UTF-8: what kind of character follows (letter, number, other), and a special token.
LETTER, NUMBER, OTHER, SPECIAL = 0xF8, 0xF9, 0xFA, 0xFF
#: Kinds of open piece. APOSTROPHE is one that begins a piece; AFTER_R and so on are letters right behind one.
NONE, LETTERS, OTHERS, ONE_NUMBER, APOSTROPHE, AFTER_R, AFTER_V, AFTER_L = range(8)
_SHORT = {ord(c) for c in "stmd"}
_LONG = {ord("r"): AFTER_R, ord("v"): AFTER_V, ord("l"): AFTER_L}
_ENDS = {AFTER_R: ord("e"), AFTER_V: ord("e"), AFTER_L: ord("l")}
#: A transition is the next state and, in the low bits, the change of the count plus this.
BITS, ZERO = 8, 128


class Merges:
    """Tokens and merges of a BPE vocabulary with word ends, and which tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if not suffix or splits != [PATTERN] or normal != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this vocabulary is not of the kind that the transducer is compiled for")
        from lodestone.llm.pretoken import byte_alphabet

        to_byte, vocab = byte_alphabet(), model["vocab"]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in vocab.items():
            ends = token.endswith(suffix)
            (self.final if ends else self.inner)[bytes(to_byte[c] for c in token.removesuffix(suffix))] = i
        self.prefixes = {t[:k] for t in [*self.inner, *self.final] for k in range(len(t))}
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        made = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, c = (vocab[a], vocab[b]), vocab[a + b]
            self.pairs[pair], self.halves[c] = c, pair
            made.append(c)
        if made != sorted(set(made)):
            raise ValueError("the ids of merged tokens must follow the order of merges")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fits: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}

    def whole(self, token: int) -> bool:
        """Whether merging by rank makes this token of its own bytes."""
        if (known := self.sound.get(token)) is None:
            if (halves := self.halves.get(token)) is None:
                known = True
            else:
                known = self.whole(halves[0]) and self.whole(halves[1]) and self.beside(*halves, token)
            self.sound[token] = known
        return known

    def beside(self, left: int, right: int, until: int = 1 << 60) -> bool:
        """Whether no merge before ``until`` joins the two tokens, however far each is merged by then."""
        a, b = left, right
        while True:
            if self.pairs.get((a, b), until) < until:
                return False
            later = max(a if a in self.halves else -1, b if b in self.halves else -1)
            if later < 0:
                return True
            # Undo the later of the two last merges: the sides that face each other then were there before it. Of equal merges the left is made first.
            if later == b and b in self.halves:
                until, b = (b + 1 if a != b else b), self.halves[b][0]
            else:
                until, a = a, self.halves[a][1]

    def compatible(self, left: int, right: int) -> bool:
        if (known := self.fits.get(left << 32 | right)) is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[left << 32 | right] = self.beside(left, right)
        return known


class Table:
    """Whole numbers by key, looked up for many keys at once: open addressing, at most half full."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        slot = self.slots(keys)
        found, out = self.keys[slot], self.values[slot]
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            found = self.keys[slot[left]]
            out[left] = np.where(found == keys[left], self.values[slot[left]], -1)
            left = left[(found != keys[left]) & (found >= 0)]
        return out

    def put(self, key: int, value: int) -> None:
        if 2 * self.used >= 1 << self.bits:
            full = np.flatnonzero(self.keys >= 0)
            old = list(zip(self.keys[full].tolist(), self.values[full].tolist(), strict=True))
            self.__init__(self.bits + 1)
            for k, v in old:
                self.put(k, v)
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        while self.keys[slot] >= 0 and self.keys[slot] != key:
            slot = slot + 1 & (1 << self.bits) - 1
        self.used += self.keys[slot] < 0
        self.keys[slot], self.values[slot] = key, value


class Transducer:
    """The compiled part of the transducer: a table of transitions by state and symbol."""

    #: Of an open piece without bytes: its window, the last token at each place of it, tokens up to there less those of the piece.
    EMPTY = (b"", (-1,), (0,))
    START = 0

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.kinds = None
        self.special = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.table = Table()
        self.state((NONE, *self.EMPTY))

    def state(self, key: tuple) -> int:
        if (i := self.ids.get(key)) is None:
            i = self.ids[key] = len(self.states)
            self.states.append(key)
        return i

    def grow(self, piece: tuple, byte: int) -> tuple[tuple, int]:
        """The piece with one byte more, and the change of its number of tokens if it ended here."""
        window, last, counts = piece
        text = window + bytes((byte,))
        suffixes = [text[at:] for at in range(len(text))]
        _, ends = self.token_at_end(self.merges.final, suffixes, last, counts)
        inner, n = self.token_at_end(self.merges.inner, suffixes, last, counts)
        # A place from which no token can grow any further has no say in the future.
        live = [s in self.merges.prefixes for s in suffixes]
        keep = live.index(True) if True in live else len(text)
        last = tuple(t if ok else -2 for t, ok in zip(last[keep:], live[keep:], strict=True))
        counts = tuple(c - ends if ok else 0 for c, ok in zip(counts[keep:], live[keep:], strict=True))
        return (text[keep:], (*last, inner), (*counts, n - ends)), ends

    def token_at_end(self, tokens: dict[bytes, int], suffixes: list[bytes], last: tuple, counts: tuple) -> tuple[int, int]:
        """The one token that the encoding ends with, and the number of tokens up to there."""
        m = self.merges
        for at, s in enumerate(suffixes):
            if (t := tokens.get(s)) is not None and (m.compatible(last[at], t) if last[at] >= 0 else m.whole(t)):
                return t, counts[at] + 1
        raise ValueError("the vocabulary can't spell this text")

    def spelt(self, text: str) -> int:
        """Tokens of a whole piece."""
        piece, n = self.EMPTY, 0
        for b in text.encode():
            piece, change = self.grow(piece, b)
            n += change
        return n

    def step(self, state: int, symbol: int) -> int:
        """Compiles one transition."""
        kind, *piece = self.states[state]
        kind, piece, change = self.move(kind, tuple(piece), symbol)
        if not 0 <= change + ZERO < 1 << BITS:
            raise ValueError("a transition changes the count too much")
        to = self.state((kind, *piece)) << BITS | change + ZERO
        self.table.put(state << 8 | symbol, to)
        return to

    def move(self, kind: int, piece: tuple, b: int) -> tuple[int, tuple, int]:
        new = self.EMPTY
        if 0x80 <= b < LETTER:  # a byte inside a character whose kind has been told
            piece, change = self.grow(piece, b)
            return kind, piece, change
        if b == SPECIAL:
            return NONE, new, 1
        if b == LETTER:
            return (LETTERS, piece, 0) if kind == LETTERS or kind in _ENDS else (LETTERS, new, 0)
        if b == OTHER:
            return (OTHERS, piece, 0) if kind in (OTHERS, APOSTROPHE) else (OTHERS, new, 0)
        if b == NUMBER:
            return ONE_NUMBER, new, 0
        c = chr(b)
        if c.isalpha():
            if kind == APOSTROPHE and b in _SHORT:
                return NONE, new, self.spelt("'" + c) - self.spelt("'")
            if kind in _ENDS and b == _ENDS[kind]:
                first = "r" if kind == AFTER_R else "v" if kind == AFTER_V else "l"
                return NONE, new, self.spelt("'" + first + c) - self.spelt("'") - self.spelt(first)
            if kind == LETTERS or kind in _ENDS:
                piece, change = self.grow(piece, b)
                return LETTERS, piece, change
            piece, change = self.grow(new, b)
            return _LONG.get(b, LETTERS) if kind == APOSTROPHE else LETTERS, piece, change
        if c.isdigit():
            return NONE, new, self.spelt(c)
        if b == 32 or 9 <= b <= 13:
            return NONE, new, 0
        if kind in (OTHERS, APOSTROPHE):
            piece, change = self.grow(piece, b)
            return OTHERS, piece, change
        piece, change = self.grow(new, b)
        return APOSTROPHE if c == "'" else OTHERS, piece, change

    def shrink(self, held: list[np.ndarray]) -> None:
        """Empties the table but for the states named in ``held``, which get their new numbers."""
        used = np.unique(np.concatenate([h.ravel() for h in held]))
        keys = [self.states[i] for i in used]
        self.clear()
        new = np.array([self.state(k) for k in keys], dtype=np.int64)
        for h in held:
            h[...] = new[np.searchsorted(used, h)]

    def symbols(self, text: str) -> bytes:
        """A text as the transducer reads it."""
        if self.special is not None and any(s in text for s in self.merges.special):
            return bytes((SPECIAL,)).join(self.symbols(p) for p in self.special.split(text)[::2])
        if text.isascii():
            return text.lower().encode()
        text = SPACES.sub(" ", unicodedata.normalize("NFC", text))
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # each character by itself: no final sigma
        if self.kinds is None:
            of = {"L": LETTER, "N": NUMBER}
            self.kinds = np.array([of.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], dtype=np.uint8)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        return np.insert(raw, np.flatnonzero(raw >= 0xC0), self.kinds[points[points > 127]]).tobytes()

    def run(self, chunks: list[bytes], starts: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """End states and counts of chunks read from the given states, all side by side. ``held``: states that must outlive a full table."""
        sizes = np.array([len(c) for c in chunks])
        order = np.argsort(-sizes, kind="stable")
        ends, counts = starts.copy(), np.zeros(len(chunks), dtype=np.int64)
        for begin in range(0, len(order), LANES):
            lanes = order[begin : begin + LANES]
            size = sizes[lanes]
            grid = np.zeros((len(lanes), size[0]), dtype=np.uint8)
            for row, lane in enumerate(lanes):
                grid[row, : size[row]] = np.frombuffer(chunks[lane], dtype=np.uint8)
            grid = np.ascontiguousarray(grid.T)
            state, total = ends[lanes], np.zeros(len(lanes), dtype=np.int64)
            live = np.searchsorted(-size, -np.arange(size[0]), side="left")
            for at in range(size[0]):
                n = live[at]
                key = (state[:n] << 8) + grid[at, :n]
                to = self.table.get(key)
                if to.min(initial=0) < 0:
                    missing = np.flatnonzero(to < 0)
                    for k in np.unique(key[missing]).tolist():
                        self.step(k >> 8, k & 255)
                    to[missing] = self.table.get(key[missing])
                state[:n] = to >> BITS
                total[:n] += to & (1 << BITS) - 1
                if len(self.states) > MOST_STATES:
                    self.shrink([state, ends, *held])
            ends[lanes] = state
            counts[lanes] = total - ZERO * size
        return ends, counts

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        chunks: list[bytes] = []
        owner: list[int] = []
        fixed: list[bool] = []  # begins a text or with a space: one state to begin in is enough
        for i, text in enumerate(texts):
            s, at = self.symbols(text), 0
            while at < len(s):
                end = len(s)
                if end - at > CHUNK + REACH:
                    end = s.find(b" ", at + CHUNK, at + CHUNK + REACH)
                    end = end if end >= 0 else at + CHUNK
                chunks.append(s[at:end])
                owner.append(i)
                fixed.append(at == 0 or s[at] == 32)
                at = end
        out = np.zeros(len(texts), dtype=np.int64)
        if not chunks:
            return out
        text_of, fixed_at = np.array(owner), np.array(fixed)
        # begin, end, counts: a row for each chunk, a column for each state it may begin in (-1: none).
        begin = np.zeros((len(chunks), 1), dtype=np.int64)
        end, count = (a[:, None] for a in self.run(chunks, begin[:, 0].copy(), []))
        while True:  # until every state in which a chunk can end is one that its successor was read from
            comes = np.where(fixed_at[1:, None], -1, end[:-1])
            new = (comes >= 0) & ~(comes[:, :, None] == begin[1:, None, :]).any(axis=2)
            column = np.argmax(new, axis=1)
            row = np.flatnonzero(new.any(axis=1))
            if not len(row):
                break
            starts = comes[row, column[row]]
            ends, counts = self.run([chunks[r + 1] for r in row], starts, [begin_ := np.where(begin < 0, 0, begin), end_ := np.where(end < 0, 0, end), starts_ := starts.copy()])
            begin, end = np.where(begin < 0, -1, begin_), np.where(end < 0, -1, end_)
            more = np.full((3, len(chunks), 1), -1, dtype=np.int64)
            more[0, row + 1, 0], more[1, row + 1, 0], more[2, row + 1, 0] = starts_, ends, counts
            begin, end, count = np.hstack([begin, more[0]]), np.hstack([end, more[1]]), np.hstack([count, more[2]])
        # The end state as the column of the next chunk's map; a fixed one has only the first.
        to = np.zeros_like(end)
        if end.shape[1] > 1:
            to[:-1] = np.where(fixed_at[1:, None], 0, np.argmax(end[:-1, :, None] == begin[1:, None, :], axis=2))
        return scan(to, count, text_of, len(texts))


def scan(to: np.ndarray, count: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Composes the chunks' maps within each text in rounds of doubling length; the counts from the first column to each text's end."""
    n, far = len(owner), 1
    to, count = to.copy(), count.copy()
    while far < n:
        row = np.flatnonzero(owner[far:] == owner[:-far]) + far
        if not len(row):
            break
        middle = to[row - far]  # the left map leads to a column of the right one
        count[row] = count[row - far] + np.take_along_axis(count[row], middle, axis=1)
        to[row] = np.take_along_axis(to[row], middle, axis=1)
        far *= 2
    out = np.zeros(texts, dtype=np.int64)
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    out[owner[last]] = count[last, 0]
    return out


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """One transducer for each vocabulary in this worker."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def count(docs: DataFrame, path: str, text: str = "text", tokens: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each text."""
    if tokens in docs.columns:
        raise ValueError(f"the column {tokens} is there already")

    def work(batches):
        t = compiled(path)
        for b in batches:
            texts = [x or "" for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t.counts(texts))], names=[*b.schema.names, tokens])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(tokens, T.LongType())]))
