"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, ASCII other than letters is made a space, and n-grams of 1 to 3 code points are hashed into ``BUCKETS``.
Their counts c weigh log(1 + c) * idf, with unit length over the text. Inverse document frequencies cover every
labelled document. The regression is trained by follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a bounded
sample: ``TRAIN_PER_LANG`` documents of each language, or fewer if the languages are so many that these are more than ``TRAIN_TOTAL``, chosen by
hash of doc_id and text, whatever their length. The sample comes to the driver as n-gram counts, at most two numbers a bucket for a document. A fifth of it
is left out of training and sets the temperature that the scores are divided by, at the least log loss.

Defined results: a text that is null or has no letter (Unicode category L) gets ``und`` with score 0; with no labelled document at all, every
text gets ``und``; more than ``MOST_LANGS`` languages are an error, since the model is a number for each bucket and language; rows with equal doc_id are
judged each by its text, and copies of a row stand in the sample once. Extra columns pass through; a taken output name is an error.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 15
TRAIN_PER_LANG, TRAIN_TOTAL, MOST_LANGS, EPOCHS = 800, 40_000, 1_000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
UNDETERMINED = "und"

_ASCII_LETTER = re.compile("[A-Za-z]")
_PLAIN = np.array([c if 97 <= c <= 122 else 32 for c in range(128)], np.uint64)


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    low = a < 128
    a[low] = _PLAIN[a[low]]
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(a), 1 << 18):  # n-grams that begin in this stretch
        part = a[at : at + (1 << 18) + 2]
        h = np.zeros(len(part), np.uint64)
        for n in range(3):
            m = len(part) - n
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + part[n:] + np.uint64(n + 1)
            starts = h[: min(m, 1 << 18)]
            out += np.bincount((starts * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15), minlength=BUCKETS)
    return out


def has_letter(text: str) -> bool:
    """Any code point of the categories Lu, Ll, Lt, Lm or Lo, which is what ``isalpha`` tells."""
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(c.isalpha() for c in set(text))


class Model:
    """Weights by bucket and language, and the temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        k, x = vector(*_sparse(text), self.idf)
        return x @ self.weights[k] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur, and their counts."""
    c = counts(text)
    k = np.flatnonzero(c)
    return k, c[k]


def vector(k: np.ndarray, c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.log1p(c) * idf[k]
    return k, x / (np.sqrt((x * x).sum()) or 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(samples: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray) -> Model:
    """samples: (buckets, counts, lang)."""
    langs = sorted({lang for *_, lang in samples})
    place = {lang: i for i, lang in enumerate(langs)}
    rows = [(*vector(k, c, idf), place[lang]) for k, c, lang in samples]
    fit, held = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    fit = fit or rows
    n_lang = len(langs)
    z, n, w = np.zeros((BUCKETS + 1, n_lang)), np.zeros((BUCKETS + 1, n_lang)), np.zeros((BUCKETS + 1, n_lang))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            k, x, y = fit[i]
            k, x = np.append(k, BUCKETS), np.append(x, 1.0)
            zk, nk = z[k], n[k]
            wk = np.where(np.abs(zk) <= L1, 0.0, -(zk - np.sign(zk) * L1) / ((BETA + np.sqrt(nk)) / ALPHA + L2))
            p = softmax(x @ wk)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(nk + g * g) - np.sqrt(nk)) / ALPHA
            z[k], n[k] = zk + g - sigma * wk, nk + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    model = Model(langs, idf, w[:-1], w[-1], 1.0)
    scores = [(x @ model.weights[k] + model.bias, y) for k, x, y in held]

    def loss(t: float) -> float:
        return -sum(float(np.log(max(softmax(s / t)[y], 1e-12))) for s, y in scores)

    if scores:
        model.temperature = float(min(np.geomspace(0.05, 10, 60), key=loss))
    return model


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the doc_id as text leaves 2 over 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bucket occurs, and how many texts there are. One row per bucket and task is shuffled."""

    def run(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                total += counts(t or "") > 0
                n += 1
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1), pa.int64()), pa.array(np.append(total[k], n), pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    df, n = np.zeros(BUCKETS, np.int64), 0
    for k, c in rows:
        if k < 0:
            n = c
        else:
            df[k] = c
    return df, n


def fit(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model:
    """Learns from text and lang of the documents that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"{len(sizes)} languages are more than {MOST_LANGS}")
    per_lang = max(1, min(per_lang, TRAIN_TOTAL // len(sizes)))
    # Texts are chosen by ticket, the hash of doc_id and text: of each language those below a bound that leaves about twice as many as are wanted, then exactly the lowest.
    ticket = F.xxhash64(F.col("doc_id").cast("string"), "text")
    tickets = known.select("lang", ticket.alias("ticket")).distinct()
    distinct = {r["lang"]: r["count"] for r in tickets.groupBy("lang").count().collect()}  # one row per language
    bounds = {k: (1 << 63) - 1 if n <= 4 * per_lang else (2 * per_lang << 64) // n - (1 << 63) for k, n in distinct.items()}
    below = lambda of: F.coalesce(*[F.when(F.col("lang") == k, F.lit(t)) for k, t in of.items()])
    few = tickets.where(F.col("ticket") <= below(bounds)).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("ticket"))).where(F.col("place") <= per_lang)
    last = {r["lang"]: r["last"] for r in few.groupBy("lang").agg(F.max("ticket").alias("last")).collect()}
    bound = below(last)
    chosen = known.select("lang", ticket.alias("ticket"), "text").where(F.col("ticket") <= bound).dropDuplicates(["lang", "ticket"])

    def counted(batches):
        for b in batches:
            got = [_sparse(t) for t in b.column("text").to_pylist()]
            bytes_of = lambda i: pa.array([x[i].astype("<i4").tobytes() for x in got], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("ticket"), bytes_of(0), bytes_of(1)], ["lang", "ticket", "k", "c"])

    rows = chosen.mapInArrow(counted, "lang string, ticket long, k binary, c binary").collect()
    rows.sort(key=lambda r: (r.ticket, r.lang))
    return train([(np.frombuffer(r.k, "<i4"), np.frombuffer(r.c, "<i4"), r.lang) for r in rows], idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score (calibrated probability). Reads only the text."""
    for name in ("lang_pred", "score"):
        if name in {c.lower() for c in docs.columns}:
            raise ValueError(f"the input has a column {name!r} already")
    spark = docs.sparkSession
    # Its size is fixed by BUCKETS and the number of languages.
    shared = spark.sparkContext.broadcast((model.langs, model.idf, model.weights, model.bias, model.temperature))

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            got = [m.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
