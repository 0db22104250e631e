"""SimHash near-duplicates found by fuzzy hashing with the binary Golay code.

Fingerprint: 64 bits, bit k set if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles.

Candidates: the fingerprint is cut into segments of 22, 21 and 21 bits. The perfect [23, 12, 7] code has one of its 4096
codewords within 3 bits of every word, so two segments that differ in one bit at most share a codeword within 4 bits of both: a
segment is decoded to all codewords that near (one to six), and their indices are its fuzzy keys. With 3 errors or fewer over three segments,
by the pigeonhole principle either a segment has none and another one at most (key: the first segment itself and a
codeword of the second, for each of six ordered pairs), or each segment has exactly one (key: a codeword of each). The latter
is asymmetric, to give fewer keys: the index side takes the codeword nearest to segment 0 and all near ones of 1 and 2, the query side all
of 0 and the nearest of 1 and 2.

Links: distinct fingerprints meet by key; each bucket is searched breadth-first, every distance verified, and gives a spanning forest
of its links, never all its pairs. A bucket over ``BUCKET`` fingerprints is dealt anew by further exact bits (of the bits
that may differ, cut in four, one part is equal), as often as needed, so no task holds an unbounded group and no link is lost.
Components come from min-label propagation over the forest's edges, through tables in the shared folder.

Defined results: null text counts as empty; a text without words has fingerprint zero, linked like any other; rows
of equal or null doc_id are fingerprinted and linked each by its own text; component_id is null only if all rows of the component have a null
doc_id, and components with one smallest doc_id have one component_id; an empty table gives no row. Columns other than doc_id and text are dropped.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.curriculum import unused
from lodestone.session import written

SHINGLE, BITS = 3, 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints searched together; larger buckets are dealt anew.
BUCKET = 20_000
#: With so few bits left to differ a bucket is bounded by itself and is searched, whatever its size.
OPEN = 20
# Fixed value: the generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011


@lru_cache(maxsize=1)
def code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codewords by index; the nearest codeword's index of each 23-bit word; and, by syndrome, the errors of weight 4 or less with that syndrome."""
    words = np.zeros(4096, np.int64)
    for k in range(12):
        words ^= np.where(np.arange(4096) >> k & 1, GENERATOR << k, 0)
    return words, *_tables(words)


def _syndrome(w: np.ndarray) -> np.ndarray:
    w = w.astype(np.int64).copy()
    for k in range(22, 10, -1):
        w ^= np.where(w >> k & 1, GENERATOR << (k - 11), 0)
    return w


def _tables(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    from itertools import combinations

    masks = [np.array([sum(1 << b for b in c) for c in combinations(range(23), k)] or [0], np.int64) for k in range(5)]
    light = np.concatenate(masks)
    by = _syndrome(light)
    near, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for s, e in zip(by.tolist(), light.tolist(), strict=True):  # lightest first: column 0 is the unique error of weight 3 or less
        near[s, count[s]] = e
        count[s] += 1
    index = np.zeros(1 << 23, np.int16)
    index[words] = np.arange(4096)
    return index, near, count


def near_codewords(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For segments: indices (n x 6) of the codewords within 4 bits, nearest first, and how many of them count."""
    _, index, near, count = code()
    s = _syndrome(seg)
    return index[seg[:, None] ^ near[s]].astype(np.int64), count[s]


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = b"\x09\x0a\x0b\x0c\x0d"
_TO_SPACE = bytes(32 if c in _SPACES else _FOLD[c] for c in range(256))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(_TO_SPACE).split(b" ")
    words = [w for w in words if w] if b"" in words else words
    n = len(words)
    if not n:
        return 0
    if n < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, max(1, n - SHINGLE + 1))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tie (MD5 of the text, empty for null), fp (the 64 bits as a signed long)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(fps, pa.int64())], ["doc_id", "tie", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tie(docs).alias("tie"), "text").mapInArrow(run, "doc_id long, tie string, fp long")


def _tie(docs: DataFrame) -> Column:
    return F.coalesce(F.md5(docs["text"]), F.lit(""))


#: By kind of key: the bits that are equal in a bucket. Kind 7 leaves all open.
_EQUAL = np.array([0, *(((1 << SEGMENTS[i][1]) - 1) << SEGMENTS[i][0] for i in range(3) for _ in range(2)), 0], np.uint64).view(np.int64)


def _keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints. Keys of the seven kinds differ in their top bits."""
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    near, count = zip(*(near_codewords(s) for s in seg), strict=True)
    has = [np.arange(6)[None, :] < c[:, None] for c in count]
    rows, keys, kind = [], [], 1

    def add(ok: np.ndarray, key: np.ndarray) -> None:
        r = np.nonzero(ok)[0]
        rows.append(r)
        keys.append(key[ok] | np.int64(kind << 58))

    for i in range(3):
        for j in range(3):
            if i != j:
                add(has[j], seg[i][:, None] << 12 | near[j])
                kind += 1
    a, b, c = near
    index = a[:, 0][:, None, None] << 24 | b[:, :, None] << 12 | c[:, None, :]
    add((has[1][:, :, None] & has[2][:, None, :]), index)
    add(has[0][:, 1:], a[:, 1:] << 24 | (b[:, 0] << 12 | c[:, 0])[:, None])  # the nearest of all three is on the index side already
    return np.concatenate(rows), np.concatenate(keys)


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges (by place) of a spanning forest of the links among these fingerprints. Each is taken from the queue once and compared with those not yet reached."""
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(fp[left] ^ fp[x]) <= bits
            if hit.any():
                got = left[hit]
                out += [(int(x), int(g)) for g in got]
                queue += got.tolist()
                left = left[~hit]
    return out


def _parts(equal: int) -> list[int]:
    """The bits that may differ, as four masks. One of them holds no error, if there are three at most."""
    free = [k for k in range(64) if not equal >> k & 1]
    return [sum(1 << k for k in free[p::4]) for p in range(4)]


_FIELDS = [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("fp", pa.int64()), ("equal", pa.int64())]


def _search(keyed: DataFrame, bits: int, most: int) -> DataFrame:
    """Buckets of one key -> links (kind 0: a, b are nodes) and what overfull buckets hold, dealt anew (kind 1: a is the new key, b the node)."""

    def run(batches):
        key, held, equal, over = None, [], 0, False
        links, dealt = [], []

        def close() -> None:
            nonlocal held
            n = sum(len(x[0]) for x in held)
            if over and n and (equal & (1 << 64) - 1).bit_count() < 64 - OPEN:
                fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
                for p in _parts(equal & (1 << 64) - 1):
                    part = np.array([p], np.uint64).view(np.int64)[0]
                    with np.errstate(over="ignore"):
                        new = (np.int64(key) ^ part) * np.int64(0x2545F4914F6CDD1D) + (fp & part)
                        new = (new ^ new >> np.int64(29)) * np.int64(0x5851F42D4C957F2D)
                    dealt.append((new, node, fp, np.full(n, np.int64(equal) | part)))
            elif n == 2 and len(held) == 1:
                (x, y), (u, v) = held[0][0].tolist(), held[0][1].tolist()
                if 0 < ((x ^ y) & (1 << 64) - 1).bit_count() <= bits:
                    links.append((u, v))
            elif n > 1:
                fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
                fp, one = np.unique(fp.view(np.uint64), return_index=True)
                node = node[one]
                links.extend((int(node[x]), int(node[y])) for x, y in _forest(fp, bits))
            held = []

        def flush():
            nonlocal links, dealt
            if links:
                a, b = np.array([*set(links)], np.int64).T
                zero = np.zeros(len(a), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32)), *map(pa.array, (a, b, zero, zero))], schema=schema)
            for new, node, fp, mask in dealt:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(new), np.int32)), *map(pa.array, (new, node, fp, mask))], schema=schema)
            links, dealt = [], []

        for b in batches:
            ks, fps, nodes, masks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "node", "equal"))
            cuts = np.concatenate([[0], np.flatnonzero(ks[1:] != ks[:-1]) + 1, [len(ks)]])
            sizes = np.diff(cuts)
            # A bucket of one, closed by others in its batch, has no links.
            look = np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1))
            for g in look[sizes[look] > 0].tolist():
                x, y = int(cuts[g]), int(cuts[g + 1])
                if key is None or ks[x] != key:
                    close()
                    key, equal, over = int(ks[x]), int(masks[x]), False
                held.append((fps[x:y], nodes[x:y]))
                if sum(len(h[0]) for h in held) > most and (equal & (1 << 64) - 1).bit_count() < 64 - OPEN:
                    over = True
                    close()
                    yield from flush()
            yield from flush()
        close()
        yield from flush()

    schema = pa.schema(_FIELDS)
    spread = keyed.repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(run, "kind int, a long, b long, fp long, equal long")


def edges(nodes: DataFrame, bits: int = BITS, most: int = BUCKET) -> DataFrame:
    """nodes (node, fp), distinct fingerprints -> links (a, b) between nodes whose components are those of all links within ``bits`` (3 at most)."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys find links of 3 bits at most")

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 4_096):
                fp, node = (b.column(c).slice(k, 4_096).to_numpy(zero_copy_only=False) for c in ("fp", "node"))
                if len(fp):
                    row, key = _keys(fp)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row]), pa.array(fp[row]), pa.array(_EQUAL[key >> 58])], ["key", "node", "fp", "equal"])

    keyed, found = nodes.mapInArrow(run, "key long, node long, fp long, equal long"), None
    while True:
        got = written(_search(keyed, bits, most), "golay")
        links = got.where("kind = 0").select("a", "b")
        found = links if found is None else found.unionByName(links)
        over = got.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "fp", "equal")
        if over.isEmpty():
            return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        keyed = over


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): each linked node with the smallest node it reaches. Alternates large-star and small-star steps, each written to the shared folder, until nothing changes."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.join(low, "a")
        out = out.where("b > a") if large else out
        moved = out.select(F.col("b").alias("x"), F.col("m").alias("y"))
        if not large:
            moved = moved.unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
        return moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    e, sign = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links"), None
    while True:
        e = written(star(star(e, True), False), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == tuple(now):
            break
        sign = tuple(now)
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _rooted(docs: DataFrame, bits: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows' doc_id, tie and fp; and of each distinct fingerprint, which is a node, fp, node (smallest doc_id) and root (smallest fingerprint reachable through links)."""
    fps = written(fingerprints(docs), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    roots = components(edges(nodes.select(F.col("fp").alias("node"), "fp"), bits, most)).select(F.col("node").alias("fp"), "root")
    return fps, nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def dedup(docs: DataFrame, bits: int = BITS, most: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable through links)."""
    fps, nodes = _rooted(docs, bits, most)
    named = nodes.join(nodes.groupBy("root").agg(F.min("node").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The documents that stay: of each component one row, that with the smallest doc_id (null last), then MD5 of the text, then columns as JSON."""
    fps, nodes = _rooted(docs, bits, BUCKET)
    rows = fps.groupBy("fp", "doc_id", "tie").agg(F.count("*").alias("n")).join(nodes.select("fp", "root"), "fp")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "n")).alias("x"))
    own_id, tie, whole = (unused(docs, x) for x in ("first_id", "first_tie", "first_row"))
    first = written(first.select(F.col("x.doc_id").alias(own_id), F.col("x.tie").alias(tie), "x.n"), "first")

    def rows_of(these: DataFrame, how: str) -> DataFrame:
        return docs.join(these, docs["doc_id"].cast("long").eqNullSafe(these[own_id]) & (_tie(docs) == these[tie]), how)

    alone, several = first.where("n = 1"), first.where("n > 1").select(own_id, tie)
    kept = rows_of(alone, "left_semi")
    if several.isEmpty():
        return kept
    row = F.struct(*[docs[c] for c in docs.columns])
    one = rows_of(several, "inner").groupBy(own_id, tie).agg(F.min_by(row, F.to_json(row)).alias(whole))
    return kept.unionByName(one.select(f"{whole}.*"))
