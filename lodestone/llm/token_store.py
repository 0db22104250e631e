"""Token-id files: each document compressed by itself with one zstandard dictionary shared by all.

A file is a block of consecutive documents in ascending ``doc_id`` order, as one value of a Parquet column
(so Spark's commit protocol guards it against lost executors and repeated tasks):

    magic ``LTOK`` and format version (8 bytes) | SHA-256 of the dictionary (32 bytes) | bytes per id (uint32)
    | documents n (uint32) | doc_id (int64 x n) | ids per document (uint32 x n) | offset index (uint64 x n+1) | frames

The offset index finds one document's frame without touching the others. The dictionary lies beside the
blocks and is refused when its hash differs from the block's.

Defined results: null text counts as empty (one end id); a null doc_id sorts first and is kept as null; equal
doc_ids stand by text; an empty table gives no block and no row. Extra columns are not stored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.pretoken import splitter, words
from lodestone.session import table_path

MAGIC = b"LTOK\x00\x01\x00\x00"
_NULL_ID = -(1 << 63)

#: Documents whose ids train the dictionary, and the most characters of one: a bounded sample, by hash order of doc_id.
TRAIN_DOCS, TRAIN_CHARS, DICT_BYTES = 600, 8_000, 64 * 1024
#: A block is closed at so many bytes of frames or documents.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 8_192
#: Units kept with their ids in a worker: some 200 MB. Beyond, only those of the batch at hand stay.
CACHE_UNITS = 1_000_000


class LibraryEncoder:
    """Ids by the tokenizers library, each distinct unit of merging encoded once per worker."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.cut = splitter(self.special)
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        #: Bytes of each token: byte-level vocabularies spell one with as many characters.
        self.size = np.array([len(self.lib.id_to_token(i) or "") for i in range(self.lib.get_vocab_size())])
        self.known: dict[str, bytes] = {}

    def learn(self, units: set[str]) -> None:
        new = [*(units - self.known.keys())]
        if len(self.known) + len(new) > CACHE_UNITS:
            self.known = {w: self.known[w] for w in units & self.known.keys()}
        # Units that begin with one space stay apart when they are joined: one call encodes thousands.
        led = [w for w in new if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        for at in range(0, len(led), 20_000):
            part = led[at : at + 20_000]
            ids = np.array(self.lib.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in part])) + 1
            raw, ends = ids.tobytes(), (ends * self.width).tolist()
            self.known.update(zip(part, (raw[x:y] for x, y in zip([0, *ends], ends, strict=False)), strict=True))
        rest = [*set(new).difference(led)]
        for w, e in zip(rest, self.lib.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, self.kind).tobytes()

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """The serialized ids of each text, with the end id appended."""
        split = [[(k % 2, p if k % 2 else words(p)) for k, p in enumerate(self.cut(t))] for t in texts]
        self.learn(set().union(*(p for parts in split for odd, p in parts if not odd)))
        get, tail, one = self.known.__getitem__, np.array([end], self.kind).tobytes(), lambda i: np.array([i], self.kind).tobytes()
        return [b"".join([one(self.special[p]) if odd else b"".join(map(get, p)) for odd, p in parts]) + tail for parts in split]


_LOADED: dict[str, LibraryEncoder] = {}


def loaded(path: str) -> LibraryEncoder:
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def train(docs: DataFrame, tokenizer_path: str, end: int) -> bytes:
    """A zstandard dictionary from the id arrays of the sample; raw content of those arrays where training finds too little."""
    key = F.xxhash64(F.col("doc_id").cast("string"))
    low = docs.select(key.alias("k")).orderBy("k").limit(TRAIN_DOCS).agg(F.max("k")).first()[0]
    if low is None:
        return b""
    rows = docs.where((key <= F.lit(low)) & (F.length("text") <= TRAIN_CHARS)).select("text").distinct().orderBy("text").limit(TRAIN_DOCS).collect()
    samples = loaded(tokenizer_path).encode([r.text for r in rows], end) if rows else []
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def pack(dictionary: bytes, width: int, ids: list[int | None], counts: list[int], frames: list[bytes]) -> bytes:
    offsets = np.cumsum([0, *map(len, frames)]).astype("<u8")
    keys = np.array([_NULL_ID if i is None else i for i in ids], "<i8")
    return b"".join([MAGIC, hashlib.sha256(dictionary).digest(), struct.pack("<II", width, len(ids)), keys.tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *frames])


class Block:
    """A block read back. ``document(k)`` decodes the k-th document alone."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id block")
        if data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        self.width, n = struct.unpack_from("<II", data, 40)
        self.doc_id = np.frombuffer(data, "<i8", n, 48)
        self.count = np.frombuffer(data, "<u4", n, 48 + 8 * n)
        self.offset = np.frombuffer(data, "<u8", n + 1, 48 + 12 * n)
        self.frames = memoryview(data)[48 + 20 * n + 8 :]
        d = _dictionary(dictionary)
        self.reader = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()

    def document(self, k: int) -> np.ndarray:
        raw = self.reader.decompress(self.frames[int(self.offset[k]) : int(self.offset[k + 1])])
        ids = np.frombuffer(raw, f"<u{self.width}")
        if len(ids) != self.count[k]:
            raise ValueError("a frame doesn't hold the ids its index promises")
        return ids


_BLOCKS = "part long, first_doc long, last_doc long, n_docs long, n_tokens long, part_start long, dict_sha256 string, block binary"


def write(docs: DataFrame, tokenizer_path: str, path: str, end: int = 2) -> str:
    """Writes ``path/blocks`` and ``path/dictionary`` in ascending doc_id order. One shuffle, by range of doc_id; the vocabulary file must be at tokenizer_path on every executor."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    dictionary = train(docs, tokenizer_path, end)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    name = hashlib.sha256(dictionary).hexdigest()

    def run(batches):
        from pyspark import TaskContext

        part, lib, d = TaskContext.get().partitionId(), loaded(tokenizer_path), _dictionary(dictionary)
        zip_ = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=True)
        ids, counts, frames, size, start = [], [], [], 0, 0

        def close():
            block = pack(dictionary, lib.width, ids, counts, frames)
            keys = [i for i in ids if i is not None]
            return pa.RecordBatch.from_pylist([{"part": part, "first_doc": keys[0] if keys else None, "last_doc": keys[-1] if keys else None, "n_docs": len(ids), "n_tokens": sum(counts), "part_start": start, "dict_sha256": name, "block": block}], schema)

        for b in batches:
            for k in range(0, b.num_rows, 512):
                s = b.slice(k, 512)
                for i, raw in zip(s.column("doc_id").to_pylist(), lib.encode([t or "" for t in s.column("text").to_pylist()], end), strict=True):
                    ids.append(i)
                    counts.append(len(raw) // lib.width)
                    frames.append(zip_.compress(raw))
                    size += len(frames[-1])
                    if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                        yield close()
                        start += sum(counts)
                        ids, counts, frames, size = [], [], [], 0
        if ids:
            yield close()

    schema = pa.schema([("part", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("part_start", pa.int64()), ("dict_sha256", pa.string()), ("block", pa.binary())])
    # Rows of one doc_id, or of none, are told apart by how their texts begin, so many of them make more than one part.
    docs.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text").mapInArrow(run, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: doc_id, start (ids before it in the whole store), n_tokens, ids (binary, little-endian uint32)."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    # One row for each task that wrote: few, whatever the input.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("block").to_pylist(), strict=True):
                block, rows = Block(data, dictionary), {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                size = 0
                for k in range(len(block.doc_id)):
                    ids = block.document(k)
                    i = int(block.doc_id[k])
                    for c, v in zip(rows, (None if i == _NULL_ID else i, start, len(ids), ids.astype("<u4").tobytes()), strict=True):
                        rows[c].append(v)
                    start, size = start + len(ids), size + 4 * len(ids)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pydict(rows, out)
                        rows, size = {c: [] for c in rows}, 0
                if rows["doc_id"]:
                    yield pa.RecordBatch.from_pydict(rows, out)

    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    # One short row for each task that wrote, so the blocks needn't be shuffled.
    at = blocks.join(F.broadcast(base), "part").select((F.col("base") + F.col("part_start")).alias("start"), "block")
    return at.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """The ids of a few documents: blocks by their doc_id range, frames by the offset index; nothing else is decompressed."""
    dictionary, found = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary), {}
    hit = F.lit(False)
    for i in doc_ids:
        hit = hit | F.lit(i).between(F.col("first_doc"), F.col("last_doc"))
    for row in spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").where(hit).select("block").toLocalIterator():
        block = Block(bytes(row.block), dictionary)
        for i in doc_ids:
            for k in np.flatnonzero(block.doc_id == i):
                found[i] = block.document(int(k)).tolist()
    return found




def store(docs: DataFrame, tokenizer_path: str, end: int = 2) -> DataFrame:
    """Writes the store in the shared folder and reads every document back."""
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer_path, table_path(spark, "tokens"), end))


