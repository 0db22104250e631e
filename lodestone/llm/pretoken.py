"""The byte-level split of text that comes before merges, and the tables of a byte-level BPE vocabulary."""

from __future__ import annotations

import json
import re

import regex

# The published split pattern of byte-level BPE vocabularies, with its character classes spelt out.
_SPACE = r"\t-\r \x85\xa0  -     　"
_LETTER_LOW = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER_LOW = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SHAPE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"

_LOW = re.compile(_SHAPE.format(L=_LETTER_LOW, N=_NUMBER_LOW, S=r"\t-\r \x85\xa0"))
_ALL = regex.compile(_SHAPE.format(L=r"\p{L}", N=r"\p{N}", S=_SPACE))
_HIGH = re.compile("[ɐ-\U0010ffff]")


def words(text: str) -> list[str]:
    """Text as the vocabulary's units of merging. Characters under U+0250 take the faster of two equal patterns."""
    return (_ALL if _HIGH.search(text) else _LOW).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary: token bytes by id, merges in order, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        model = spec["model"]
        self.token_bytes: dict[int, bytes] = {}
        for token, i in model["vocab"].items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token)
        ids = model["vocab"]
        self.merges: list[tuple[int, int, int]] = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.append((ids[a], ids[b], ids[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


def splitter(special: dict[str, int]):
    """A function that cuts text at special tokens: pieces at even places, special tokens at odd ones."""
    if not special:
        return lambda text: [text]
    pattern = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
    first = list(special)

    def cut(text: str) -> list[str]:
        return pattern.split(text) if any(s in text for s in first) else [text]

    return cut
