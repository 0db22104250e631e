"""The part of a transcription that belongs to its target, when blocks before and after it may have leaked in.

A transcription is read as lines; labels and separators split it, and so do lines that are one of the neighbouring blocks. In what is left, the run of lines
that fits the target best is kept. A window of lines is scored by how well its characters align with the target's (1.4), by the target's words that it has (2),
by its words that are the target's (0.2) and by length (0.2). Windows are tried from the first line on, and a later one wins by more than 0.015, or within that
by length or fewer lines. An alignment costs time, so a window is only aligned if bounds on its score leave it a chance: the characters that both have bound the
alignment, and once a window has grown so long that its length alone rules it out, so are all longer ones. What is left out can't have changed the choice.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import fidelity

# What wraps an answer, which lines are labels, separators or introductions, and which marks are presentation.
WRAPPERS = (r"(?is)<think>.*?</think>", r"(?is)</?think>", r"(?is)^\s*```(?:text|plaintext|markdown)?\s*", r"(?is)\s*```\s*$")
SEPARATORS = {"---", "***", "___"}
LABEL = re.compile(r"(?i)^\s*(?:(?:before|after)(?:\s+context)?\s*:?\s*|(?:target(?:\s+transcription)?|answer|transcription)\s*:\s*)$")
INTRODUCTION = re.compile(r"(?i)^\s*(?:here(?:'s| is)\s+(?:the\s+)?(?:target\s+)?transcription|the\s+target\s+(?:text|transcription)\s+is)\s*:?\s*$")
INLINE_LABEL = re.compile(r"(?i)^\s*(?:target(?:\s+transcription)?|answer)\s*:\s*(.+)$")
QUOTES = str.maketrans("", "", "\"'‘’“”")
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9]{2,}")
#: Weights of alignment, recall, precision and length; what counts as a tie of scores and of lengths.
WEIGHTS, SCORE_TIE, LENGTH_TIE = (1.4, 2.0, 0.2, 0.2), 0.015, 0.02
#: Likeness from which a line is a neighbouring block, and the characters from which a part or a likeness says so.
SAME_BLOCK, PART_FROM, LIKE_FROM = 0.92, 8, 12


def evidence(text: str) -> str:
    """Text without differences of presentation: compatibility forms, case, quotation marks, blanks around marks."""
    text = unicodedata.normalize("NFKC", text).casefold().translate(QUOTES)
    return " ".join(re.sub(r"\s*([^\w\s])\s*", r"\1", text).split())


class Line(NamedTuple):
    text: str
    number: int
    key: str
    words: frozenset


def _line(text: str, number: int) -> Line:
    key = evidence(text)
    return Line(text, number, key, frozenset(w.casefold() for w in WORD.findall(key)))


class Fit(NamedTuple):
    score: float
    alignment: float
    recall: float
    precision: float
    length: float


class Target:
    """What windows are measured against."""

    def __init__(self, text: str):
        line = _line(text, 0)
        self.text, self.key, self.words = text, line.key, line.words
        self.letters = Counter(self.key)

    def align(self, key: str) -> float:
        return fidelity.ratio(self.key, key, False) if self.key and key else 0.0

    def shares(self, words: frozenset | set, size: int) -> tuple[float, float, float]:
        common = len(self.words & words)
        longest = max(size, len(self.key))
        return common / len(self.words) if self.words else 0.0, common / len(words) if words else 0.0, min(size, len(self.key)) / longest if longest else 0.0

    def fit(self, text: str) -> Fit:
        line = _line(text, 0)
        shares, alignment = self.shares(line.words, len(line.key)), self.align(line.key)
        return Fit(sum(w * x for w, x in zip(WEIGHTS, (alignment, *shares), strict=True)), alignment, *shares)

    def most_alike(self, key: str) -> float:
        """No less than the alignment: the letters that both have bound it."""
        both = sum(min(n, self.letters[c]) for c, n in Counter(key).items())
        return 2 * both / max(1, len(key) + len(self.key))

    def most(self, text: str) -> float:
        """No less than the score of this window."""
        line = _line(text, 0)
        return sum(w * x for w, x in zip(WEIGHTS, (self.most_alike(line.key), *self.shares(line.words, len(line.key))), strict=True))


def _beats(new: Fit, lines: int, best: Fit, best_lines: int) -> bool:
    if new.score > best.score + SCORE_TIE:
        return True
    if abs(new.score - best.score) > SCORE_TIE:
        return False
    return new.length > best.length + LENGTH_TIE or abs(new.length - best.length) <= LENGTH_TIE and lines < best_lines


def best_window(segments: list[list[Line]], target: Target, prune: bool = True) -> tuple[Fit, list[Line]] | None:
    """The run of lines inside one segment that fits best."""
    best = None
    for segment in segments:
        known = frozenset().union(*(x.words for x in segment))
        recall = target.shares(known, 0)[0]  # of all words of the segment; no window has more
        for i in range(len(segment)):
            size = 0
            for j in range(i, len(segment)):
                # Blanks between lines may vanish beside marks, so the lines alone bound the length from below.
                size += len(segment[j].key)
                if prune and best is not None and size > len(target.key):
                    short = len(target.key) / size
                    if WEIGHTS[0] * 2 * short / (1 + short) + WEIGHTS[1] * recall + WEIGHTS[2] + WEIGHTS[3] * short < best[0].score - SCORE_TIE:
                        break
                window = segment[i : j + 1]
                text = "\n".join(x.text for x in window)
                if prune and best is not None and target.most(text) < best[0].score - SCORE_TIE:
                    continue
                fit = target.fit(text)
                if best is None or _beats(fit, len(window), best[0], len(best[1])):
                    best = fit, window
    return best


def _read(candidate: str) -> tuple[list[Line | None], bool, str]:
    """Lines with None where something splits them, whether anything was no transcription, and the text without wrappers."""
    clean = candidate
    for p in WRAPPERS:
        clean = re.sub(p, "", clean)
    clean = clean.strip()
    foreign, out = clean != candidate.strip(), []
    for number, raw in enumerate(clean.splitlines(), 1):
        line = raw.strip()
        if line in SEPARATORS:
            out.append(None)
        elif line and (LABEL.match(line) or INTRODUCTION.match(line)):
            foreign = True
            out.append(None)
        elif line:
            if m := INLINE_LABEL.match(line):
                foreign, line = True, m[1].strip()
            out.append(_line(line, number) if line else None)
    return out, foreign, clean


def _once(lines: list[Line | None]) -> tuple[list[Line | None], bool]:
    """Without lines that repeat the one before, and without a second half that repeats the first."""
    out: list[Line | None] = []
    for x in lines:
        if x is None or not out or out[-1] is None or not x.key or x.key != out[-1].key:
            out.append(x)
    again = len(out) < len(lines)
    told = [x for x in out if x is not None]
    half = len(told) // 2
    if len(told) >= 2 and len(told) % 2 == 0 and [x.key for x in told[:half]] == [x.key for x in told[half:]]:
        first = {x.number for x in told[:half]}
        return [x for x in out if x is None or x.number in first], True
    return out, again


def _is_block(line: Line, block: str) -> bool:
    a, b = line.key, block
    if not a or not b:
        return False
    if a == b or len(b) >= PART_FROM and (b in a or a in b):
        return True
    # Lengths and common letters bound the likeness, so that few pairs are aligned.
    if min(len(a), len(b)) < LIKE_FROM or 2 * min(len(a), len(b)) / (len(a) + len(b)) < SAME_BLOCK:
        return False
    return 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) >= SAME_BLOCK and fidelity.ratio(a, b, False) >= SAME_BLOCK


def _doubled(text: str) -> set[str]:
    words = [w.casefold() for w in WORD.findall(evidence(text))]
    return {a for a, b in zip(words, words[1:], strict=False) if a == b}


def scope_of(candidate: str | None, original: str | None, before: list[str] | None, after: list[str] | None, cell: bool = False, prune: bool = True) -> dict:
    """The scoped text, its measures, what was cut off, and the reasons against it that the texts alone give."""
    target = Target((original or "").strip())
    blocks = [[evidence(x.strip()) for x in side or () if x and x.strip()] for side in (before, after)]
    lines, foreign, clean = _read(candidate or "")
    out = {"text": "", "reasons": [], "trimmed": foreign, "prefix": "", "suffix": "", "repeated": False, "foreign": foreign, "before_hits": 0, "after_hits": 0, "score": None, "alignment": None, "recall": None, "precision": None, "length": None}
    if not any(x is not None for x in lines):
        return out | {"reasons": ["EMPTY_TRANSCRIPTION"]}
    lines, out["repeated"] = _once(lines)
    segments, hits = [[]], [0, 0]
    for x in lines:
        sides = [x is not None and any(_is_block(x, b) for b in side) for side in blocks]
        hits = [n + s for n, s in zip(hits, sides, strict=True)]
        if x is None or any(sides):
            segments.append([])
        else:
            segments[-1].append(x)
    out["before_hits"], out["after_hits"] = hits
    best = best_window([s for s in segments if s], target, prune)
    if best is None:
        return out | {"reasons": ["ONLY_CONTEXT_OR_ADJACENT_BLOCK_RETURNED"], "trimmed": True}
    fit, window = best
    text = "\n".join(x.text for x in window).strip()
    told = [x for x in lines if x is not None]
    cut = {"prefix": [x.text for x in told if x.number < window[0].number], "suffix": [x.text for x in told if x.number > window[-1].number]}
    cut = {k: "\n".join(v).strip() for k, v in cut.items()}
    key, words = evidence(text), _line(text, 0).words
    failed = {
        "SCOPE_INVERSION_DISCARDED_TARGET": any(_better_cut(v, target, fit) for v in cut.values() if v),
        "NO_TARGET_LEXICAL_OVERLAP": _unrelated(target.words, words, fit.alignment),
        "PARTIAL_TARGET_PREFIX_OR_SUFFIX": len(target.text) >= 80 and key and target.key and len(key) / len(target.key) < 0.90 and (target.key.startswith(key) or target.key.endswith(key)),
        "EXCESSIVE_TARGET_EXPANSION": len(target.text) >= 40 and len(text) > max(2 * len(target.text), len(target.text) + 250),
        "EXCESSIVE_TARGET_CONTRACTION": len(target.text) >= 80 and fit.length < 0.55,
        "REASONING_WRAPPER_REMAINS": re.search("(?i)</?think>", text),
        "NOVEL_TOKEN_DUPLICATION": _doubled(text) - _doubled(target.text),
    }
    reasons = [k for k, v in failed.items() if v]
    trimmed = bool(foreign or out["repeated"] or any(hits) or any(cut.values()) or key != evidence(clean))
    crowded = any(cut.values()) or fit.recall >= 0.70 and fit.precision < 0.65 and fit.length < 0.72 and len(key) > max(len(target.key) + 20, int(len(target.key) * 1.35))
    if cell and crowded:
        reasons.append("TABLE_CELL_CONTEXT_CONTAMINATION")
    return out | {"text": text, "reasons": reasons, "trimmed": trimmed, **cut, **fit._asdict()}


def _better_cut(cut: str, target: Target, kept: Fit) -> bool:
    """Whether what was cut off, all of it, is the target rather than what was kept. It is only aligned if its words and letters leave it a chance."""
    line = _line(cut, 0)
    recall = target.shares(line.words, len(line.key))[0]
    needed = [max(kept.alignment + 0.18, 0.45)] if recall >= kept.recall + 0.18 else []
    if recall >= 0.55 and kept.alignment < 0.40:
        needed.append(0.60)
    return bool(needed) and target.most_alike(line.key) >= min(needed) and target.align(line.key) >= min(needed)


def _unrelated(target: frozenset, words: frozenset, alignment: float) -> bool:
    if len(target) < 4 or not words:
        return False
    common = len(target & words)
    return common < 2 and common / min(len(target), len(words)) < 0.18 and alignment < 0.52


_SCOPE = "struct<text:string,reasons:array<string>,trimmed:boolean,prefix:string,suffix:string,repeated:boolean,foreign:boolean,before_hits:int,after_hits:int,score:double,alignment:double,recall:double,precision:double,length:double>"


def scope(df: DataFrame, candidate: str, original: str, before: str, after: str, cell: bool = False) -> DataFrame:
    """Adds ``scope``: accepted, status, text (empty unless accepted), reasons, and the measures. before and after are arrays of neighbouring blocks.

    Null texts count as empty. A row is worked on by itself; its time grows with its lines and the target's length, not with their square.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("found", T._parse_datatype_string(_SCOPE))])
    kind = pa.struct([("text", pa.string()), ("reasons", pa.list_(pa.string())), ("trimmed", pa.bool_()), ("prefix", pa.string()), ("suffix", pa.string()), ("repeated", pa.bool_()), ("foreign", pa.bool_()), ("before_hits", pa.int32()), ("after_hits", pa.int32()), *[(x, pa.float64()) for x in ("score", "alignment", "recall", "precision", "length")]])

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in (candidate, original, before, after)), strict=True)
            found = [scope_of(*r, cell=cell) for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "found"])

    found = df.mapInArrow(run, schema).withColumn("kept", F.col("found.text"))
    safe = fidelity.transcription_safety(found, original, "kept", cell)
    none = F.col("found.score").isNull()
    reasons = F.when(none, F.col("found.reasons")).otherwise(F.array_distinct(F.concat("found.reasons", "safety.reasons")))
    accepted = F.size(reasons) == 0
    status = F.when(~accepted, "UNRESOLVED").when(F.col("found.trimmed"), "SCOPED").otherwise("UNCHANGED")
    rest = [F.col(f"found.{x}").alias(x) for x in ("trimmed", "prefix", "suffix", "repeated", "foreign", "before_hits", "after_hits")]
    measures = [F.bround(f"found.{x}", 4).alias(x) for x in ("score", "alignment", "recall", "precision", "length")]
    out = F.struct(accepted.alias("accepted"), status.alias("status"), F.when(accepted, F.col("kept")).otherwise("").alias("text"), reasons.alias("reasons"), *rest, *measures)
    return safe.withColumn("scope", out).select(*df.columns, "scope")
