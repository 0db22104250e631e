"""BPE encoding by backtracking over longest token matches, and decoding through an offset table.

Encoding a unit: one Aho-Corasick pass finds the longest token at each byte. From the left the longest
token is taken if it is compatible with the token before it, that is, if merging by rank would never
join across their border; else the next shorter token that is its prefix is tried; with none left, the
last token is taken back and its end marked as dead. Each end dies at most once, so the time is linear,
and the ids are exactly those of merging by rank.

Defined results: null text counts as empty; an empty text has no ids and decodes to an empty string;
special tokens inside a text become their ids, as the tokenizers library does by default. Extra columns
pass through; an output name that is taken already is an error raised before anything runs.
"""

from __future__ import annotations

from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.pretoken import Vocabulary, splitter, words

#: Units kept with their ids in a worker; beyond, the memory is emptied and filled anew.
CACHE_UNITS = 450_000
#: Pairs of tokens whose compatibility is kept.
CACHE_PAIRS = 250_000


class _Known(dict):
    """Units seen by this worker with their ids; fills itself, and starts anew when it is full."""

    def __init__(self, bpe: Backtracker):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, w: str) -> bytes:
        ids = array("i", self.bpe.unit(w)).tobytes()
        if len(w) < 64:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[w] = ids
        return ids


class Backtracker:
    """Exact BPE over one vocabulary. Requires merges in ascending order of the ids they make."""

    def __init__(self, path: str):
        v = Vocabulary(path)
        n = max([*v.token_bytes, *v.special.values()]) + 1
        made = [m[2] for m in v.merges]
        if made != sorted(made):
            raise ValueError("the ids of merged tokens must follow the order of merges")
        self.special, self.cut = v.special, splitter(v.special)
        self.token = [v.token_bytes.get(i, b"") for i in range(n)]
        for s, i in v.special.items():
            self.token[i] = s.encode()
        self.length = [len(t) for t in self.token]
        self.pairs = {(a, b): c for a, b, c in v.merges}
        self.halves = [(i, i) for i in range(n)]
        for a, b, c in v.merges:
            self.halves[c] = (a, b)
        self.whole = {t.decode("latin-1"): i for i, t in v.token_bytes.items()}
        self.auto = ahocorasick.Automaton()
        for t, i in self.whole.items():
            self.auto.add_word(t, i)
        self.auto.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.known = _Known(self)
        #: The offset table: all token bytes in a row, and where each begins.
        self.blob = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.offset = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(self.length, out=self.offset[1:])

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if (p := self.shorter.get(token)) is None:
            t, p = self.token[token].decode("latin-1"), -1
            for end in range(len(t) - 1, 0, -1):
                if (p := self.whole.get(t[:end], -1)) >= 0:
                    break
            self.shorter[token] = p
        return p

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two tokens side by side: undoes their merges, last first, looking for an earlier merge across the border."""
        if (kept := self.fits.get(left << 32 | right)) is not None:
            return kept
        a, b, before, fits = left, right, 1 << 60, True
        while True:
            if self.pairs.get((a, b), before) < before:
                fits = False
                break
            a_half, b_half = self.halves[a][1], self.halves[b][0]
            if a > b and a_half != a or b_half == b:
                if a_half == a:
                    break
                before, a = a, a_half
            else:
                before, b = b + 1, b_half
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        self.fits[left << 32 | right] = fits
        return fits

    def unit(self, text: str) -> list[int]:
        """The ids of one unit of merging, uncached."""
        w = text.encode().decode("latin-1")
        if (i := self.whole.get(w)) is not None:
            return [i]
        n, length = len(w), self.length
        longest = [-1] * n
        for end, i in self.auto.iter(w):
            longest[end + 1 - length[i]] = i  # ends ascend, so the longest stays
        alive, ids, at, token = bytearray(b"\x01") * (n + 1), [], 0, longest[0]
        while at < n:
            end = at + length[token]
            if alive[end] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            if (token := self.prefix(token)) < 0:
                if not ids:
                    raise ValueError("the vocabulary can't spell this text")
                alive[at] = 0
                token = ids.pop()
                at -= length[token]
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers in a row."""
        get = self.known.__getitem__
        if len(pieces := self.cut(text)) == 1:
            return b"".join(map(get, words(text)))
        return b"".join(self.native(self.special[p]) if k % 2 else b"".join(map(get, words(p))) for k, p in enumerate(pieces))

    @staticmethod
    def native(*ids: int) -> bytes:
        return array("i", ids).tobytes()

    def decode_all(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids in a row, and where the bytes of each id begin."""
        begin, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(size)
        at = np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.blob[at].tobytes(), np.concatenate([[0], ends])


_LOADED: dict[str, Backtracker] = {}


def loaded(path: str) -> Backtracker:
    if path not in _LOADED:
        _LOADED[path] = Backtracker(path)
    return _LOADED[path]


def _free(df: DataFrame, name: str) -> None:
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the input has a column {name!r} already; give another output name")


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds ``ids array<int>``: the token ids of each whole text. The vocabulary file must be at this path on every executor.

    With ``decoded``, adds under that name the text that the ids decode to as well, in the same pass and the same worker.
    """
    for name in filter(None, (ids, decoded)):
        _free(df, name)
    more = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def run(batches):
        bpe = loaded(tokenizer_path)
        for b in batches:
            for b in _small(b, text):
                each = [bpe.encode(t or "") for t in b.column(text).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in each)])
                flat = np.frombuffer(b"".join(each), dtype=np.int32)
                out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded:
                    out.append(_texts(bpe, flat, ends))
                yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *(f.name for f in more)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more]))


def _texts(bpe: Backtracker, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    data, begins = bpe.decode_all(flat.astype(np.int64))
    marks = begins[ends]
    return pa.array([data[x:y].decode("utf-8", "replace") for x, y in zip(marks[:-1], marks[1:], strict=True)], pa.string())


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the text of each id list. Bytes that are no UTF-8 become U+FFFD; null ids count as none."""
    _free(df, text)

    def run(batches):
        bpe = loaded(tokenizer_path)
        for b in batches:
            for b in _small(b, ids):
                ends, values = _plain(b.column(ids))
                out = _texts(bpe, values.to_numpy(zero_copy_only=False), ends)
                yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def _plain(col: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from zero and values of a list column; null lists are empty."""
    sizes = [n or 0 for n in col.value_lengths().to_pylist()]
    return np.cumsum([0, *sizes]), col.flatten()


def _small(b: pa.RecordBatch, name: str, most: int = 512):
    """Slices of a batch, so that the ids of many long texts don't stand in memory together."""
    for k in range(0, b.num_rows, most):
        yield b.slice(k, most)
