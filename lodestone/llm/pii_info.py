"""Personal data, and terms that reveal it: information-theoretic sanitisation.

Base entities (e-mail, IP, card, phone) come from fixed patterns. Every word of a document that touches no base entity is a term of it, and
a candidate for each entity in the document, wherever the two stand. Over the whole corpus, with N documents, entity e in d(e), term t in d(t) and
both in d(t, e) documents, the
pointwise mutual information log(N d(t,e) / (d(t) d(e))) over the entity's information log(N / d(e)) tells how much of
e the term gives away: 1 if it occurs with e alone. A term seen with e in ``SUPPORT`` documents or more whose ratio is
``DISCLOSE`` or more becomes a span of kind ``term`` wherever it stands in any document, those without e too; its ratio is the highest of all
entities. ``redact`` removes it from ``REMOVE`` on, and generalises it to its class below.

An entity is the same however its digits are grouped or its letters cased. Document counts of all terms are summed inside each task before they are shuffled; entities and terms travel as 64-bit hashes. Pairs are made only
of entities and terms whose own counts leave a ratio of ``DISCLOSE`` possible, which loses none.

Defined results: null text counts as empty and has no span; equal documents have equal spans; a repeated row counts as a
document of its own; an empty table gives no row; offsets count code points. Columns other than those named are dropped by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.curriculum import unused
from lodestone.session import written

SUPPORT, DISCLOSE, REMOVE = 3, 0.9, 0.97
KINDS = ("email", "ip", "card", "phone", "term")
#: Terms counted in a task before their counts are passed on.
HELD_TERMS = 200_000
#: Revealing terms that are sent to every task; with more, texts are joined with their own.
BROADCAST_TERMS = 500_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can't begin inside a run of digits whose first digit begins none, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    """Matches of ``local+@domain(.label)+``. No local character is an @, so each @ has one run before it that could be its local part."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all base entities, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(s: str) -> int:
    h = xxhash.xxh64_intdigest(s)
    return h - (1 << 64) if h >> 63 else h


def _entity(kind: int, span: str) -> int:
    """One number for an entity, however its digits are grouped or its letters cased."""
    return _hash(f"{kind}:{re.sub('[^0-9]', '', span) if kind >= 2 else span.lower()}")


def _free_words(text: str, spans: list[tuple[int, int, int]]):
    """(start, end) of the words that touch no base entity, in order."""
    k, reach = 0, -1
    for m in _WORD.finditer(text):
        x, y = m.span()
        while k < len(spans) and spans[k][0] < y:
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= x:
            yield x, y


def _terms(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    if not spans:
        return {w.lower() for w in set(_WORD.findall(text))}
    return {text[x:y].lower() for x, y in _free_words(text, spans)}


_SCAN = "rid long, entities array<long>, terms array<long>, term long, docs long"


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row for each document with entities (rid set: its distinct entities and terms), rows of term counts (term set: in how many documents of a stretch it is), and rows of document counts (docs alone set)."""
    schema = pa.schema([("rid", pa.int64()), ("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("term", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        rid, held = TaskContext.get().partitionId() << 33, Counter()

        def counted():
            n = len(held)
            nulls = [pa.nulls(n, f.type) for f in (schema.field(k) for k in range(3))]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(map(_hash, held.keys()), pa.int64(), size=n), pa.array(held.values(), pa.int64(), size=n)], schema=schema)

        for b in batches:
            for k in range(0, b.num_rows, 512):
                s = b.slice(k, 512)
                rows = [{"docs": s.num_rows}]
                for t in s.column("text").to_pylist():
                    t = t or ""
                    found = base_spans(t)
                    terms = _terms(t, found)
                    held.update(terms)
                    if found:
                        rows.append({"rid": rid, "entities": list({_entity(q, t[x:y]) for x, q, y in found}), "terms": [_hash(w) for w in terms]})
                    rid += 1
                yield pa.RecordBatch.from_pylist(rows, schema)
                if len(held) > HELD_TERMS:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, _SCAN)


def disclosures(scanned: DataFrame, support: int, disclose: float) -> DataFrame:
    """(term, ratio) of the terms that reveal an entity, with the highest ratio of all entities."""
    n = float(max(scanned.where("rid IS NULL AND term IS NULL").agg(F.sum("docs")).first()[0] or 0, 2))
    docs = scanned.where("rid IS NOT NULL")
    # With d(t, e) <= d(t) and d(e), a ratio of disclose needs d(t) <= d(e) (N / d(e))^(1 - disclose), here with some room for rounding.
    most = F.col("with_entity") * F.pow(F.lit(n) / F.col("with_entity"), F.lit(1 - disclose)) * 1.000001
    entities = docs.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity"))
    entities = written(entities.where((F.col("with_entity") >= support) & (F.col("with_entity") < n)).withColumn("most", most), "entities")
    largest = entities.agg(F.max("most")).first()[0]
    if largest is None:
        return docs.select(F.col("rid").alias("term"), F.lit(0.0).alias("ratio")).where("false")
    terms = scanned.where("term IS NOT NULL").groupBy("term").agg(F.sum("docs").alias("with_term")).where((F.col("with_term") >= support) & (F.col("with_term") <= largest))
    who = docs.select("rid", F.explode("entities").alias("entity")).join(entities, "entity")
    what = docs.select("rid", F.explode("terms").alias("term")).join(terms, "term")
    pairs = who.join(what, "rid").where("with_term <= most")
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("with_entity").alias("with_entity"), F.first("with_term").alias("with_term")).where(F.col("both") >= support)
    gain = F.log(F.lit(n) * F.col("both") / (F.col("with_term") * F.col("with_entity")))
    ratio = (gain / F.log(F.lit(n) / F.col("with_entity"))).alias("ratio")
    return pairs.select("term", ratio).where(F.col("ratio") >= disclose).groupBy("term").agg(F.max("ratio").alias("ratio"))


def _marked(docs: DataFrame, found: DataFrame, schema: T.StructType, made) -> DataFrame:
    """docs mapped to rows of the schema by made(batch, spans, terms), which gets the base spans and the (start, end, ratio) of the revealing terms of each text."""
    spark, names = docs.sparkSession, docs.columns

    def marks(text: str, ratio_of) -> tuple[list, list]:
        spans = base_spans(text)
        hit = {w: r for w in set(_WORD.findall(text)) if (r := ratio_of(w))}
        return spans, [(x, y, hit[text[x:y]]) for x, y in _free_words(text, spans) if text[x:y] in hit] if hit else []

    def mapped(b, ratio_of):
        for k in range(0, b.num_rows, 512):
            s = b.slice(k, 512)
            both = [marks(t or "", ratio_of(k + i)) for i, t in enumerate(s.column("text").to_pylist())]
            yield made(s.select(names), [x for x, _ in both], [y for _, y in both])

    if found.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        shared = spark.sparkContext.broadcast({r.term: r.ratio for r in found.toLocalIterator()})

        def run(batches):
            ratios, known = shared.value, {}

            def ratio_of(word):
                r = known.get(word)
                if r is None:
                    if len(known) > HELD_TERMS:
                        known.clear()
                    r = known[word] = ratios.get(_hash(word.lower()), 0.0)
                return r

            for b in batches:
                yield from mapped(b, lambda i: ratio_of)

        return docs.mapInArrow(run, schema)

    def split(batches):
        for b in batches:
            for key, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                terms = [_hash(w) for w in _terms(t or "", base_spans(t or ""))]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(terms), pa.string()), pa.array(terms, pa.int64())], ["key", "term"])

    key = F.md5(F.coalesce("text", F.lit("")))
    own = docs.select(key.alias("key"), "text").mapInArrow(split, "key string, term long").join(found, "term")
    own_key, revealing = unused(docs, "text_key"), unused(docs, "text_terms")
    own = own.distinct().groupBy("key").agg(F.collect_list(F.struct("term", "ratio")).alias(revealing)).withColumnRenamed("key", own_key)
    joined = docs.withColumn(own_key, key).join(own, own_key, "left")

    def run_joined(batches):
        for b in batches:
            of = [{x["term"]: x["ratio"] for x in r or ()} for r in b.column(revealing).to_pylist()]
            yield from mapped(b, lambda i, of=of: lambda w: of[i].get(_hash(w.lower()), 0.0) if of[i] else 0.0)

    return joined.mapInArrow(run_joined, schema)


_FOUND = "doc_id long, spans array<struct<start:int,kind:int,end:int>>, terms array<struct<start:int,end:int,ratio:double>>"


def find(docs: DataFrame, support: int = SUPPORT, disclose: float = DISCLOSE) -> DataFrame:
    """One row per document: doc_id, spans array<struct<start, kind (place in KINDS), end>> of base entities, terms array<struct<start, end, ratio>> (null if none)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(disclosures(written(scan(docs), "pii"), support, disclose), "terms")
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    term = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())]))

    def made(b, spans, terms):
        s = pa.array([[{"start": x, "kind": k, "end": y} for x, k, y in r] for r in spans], span)
        t = pa.array([[{"start": x, "end": y, "ratio": z} for x, y, z in r] or None for r in terms], term)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), s, t], ["doc_id", "spans", "terms"])

    return _marked(rows, found, T._parse_datatype_string(_FOUND), made)


def redact(docs: DataFrame, support: int = SUPPORT, disclose: float = DISCLOSE) -> DataFrame:
    """The documents with each base entity replaced by its kind and each revealing term removed or generalised. Spans depend on the text alone and each row's are found in its own text, so null and repeated ids do no harm."""
    found = written(disclosures(written(scan(docs), "pii"), support, disclose), "terms")
    names = docs.columns

    def made(b, spans, terms):
        texts = [replace(*x) for x in zip(b.column("text").to_pylist(), spans, terms, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names)

    return _marked(docs, found, docs.schema, made)


def replace(text: str | None, spans: list[tuple[int, int, int]], terms: list[tuple[int, int, float]]) -> str | None:
    if not spans and not terms:
        return text
    cuts = [(a, b, f"<{KINDS[k].upper()}>") for a, k, b in spans]
    for a, b, ratio in terms:
        cuts.append((a, b, "" if ratio >= REMOVE else "<NUMBER>" if text[a:b].isdigit() else "<WORD>"))
    out, at = [], 0
    for a, b, new in sorted(cuts):
        if a >= at:
            out += [text[at:a], new]
            at = b
        elif b > at:  # overlapping entities: what juts out goes too
            at = b
    return "".join(out) + text[at:]
