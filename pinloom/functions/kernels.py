"""Romanization of single texts and token lists by dictionary, for batches in Arrow functions.

A kernel holds a dictionary in the form its function needs. It is broadcast once a session and stays in the
workers, so a dictionary of any size a language has costs nothing a query, and plans carry no entries.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

#: Unicode White_Space (fixed values).
WHITE_SPACE_CODES = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WHITE = "".join(map(chr, WHITE_SPACE_CODES))
_WORDS = {c: chr(c) for c in map(ord, "0123456789abcdefghijklmnopqrstuvwxyz")} | {c: chr(c + 32) for c in range(65, 91)}
_TOKEN = re.compile(r"[0-9a-z]+|[^ ]")
_RAW_TOKEN = re.compile(r"(?s)[0-9A-Za-z]+|.")
_ASCII_WORD = re.compile("[0-9A-Za-z]+").fullmatch
_HAN_PHRASE = re.compile(f"[^0-9A-Za-z{re.escape(_WHITE)}]+").fullmatch
_SPACES = re.compile(" +")
#: Stands for a reading that is empty; it never occurs in what is kept of a text.
_EMPTY = "\0"


def first_reading(pinyin: str) -> str:
    """The first non-empty reading between pipes, ASCII lower-cased."""
    part = next((p for p in pinyin.split("|") if p), pinyin)
    return ascii_lower(part)


def first_readings(pinyin: str) -> str:
    """first_reading() of each blank-separated part, joined by one space."""
    return " ".join(map(first_reading, pinyin.split()))


def ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


class _Table(dict):
    """For str.translate(): characters without an entry become blanks."""

    def __missing__(self, code: int) -> str:
        self[code] = " "
        return " "


def _single(key: str) -> bool:
    """One character that is neither white space nor an ASCII letter or digit."""
    return len(key) == 1 and key not in _WHITE and not (key.isascii() and key.isalnum())


class Characters:
    """First readings of mapped characters and lower-cased ASCII runs; all else only separates."""

    def __init__(self, mapping: Mapping[str, str]):
        readings = {ord(k): first_readings(v) for k, v in mapping.items() if _single(k)}
        self.empty = "" in readings.values()
        self.table = _Table(_WORDS | {c: f" {r or _EMPTY} " for c, r in readings.items()})

    def __call__(self, text: str) -> str:
        out = " ".join(text.translate(self.table).split())
        return out.replace(_EMPTY, "") if self.empty else out


class Words:
    """Greedy longest words over tokens: a token's own entry, else the longest span of single characters, else its characters."""

    def __init__(self, mapping: Mapping[str, str], words: Mapping[str, str]):
        self.first = {k: first_readings(v) for k, v in mapping.items()}
        self.words = {k: first_readings(v) for k, v in words.items()}
        self.table = _Table(_WORDS | {ord(k): k for k in mapping if _single(k)})
        lengths: dict[str, set[int]] = {}
        for k in words:
            if len(k) > 1 and all(map(_single, k)):
                lengths.setdefault(k[0], set()).add(len(k))
        self.lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}

    def __call__(self, text: str) -> str:
        return self.greedy(_TOKEN.findall(text.translate(self.table)))

    def tokens(self, tokens: list[str | None]) -> str:
        """As for a text, where unmapped characters stay. A null token is an error."""
        if None in tokens:
            raise ValueError("a token is null")
        trimmed = [t for t in (t.strip(_WHITE) for t in tokens) if t]
        return self.greedy([t.lower() if _ASCII_WORD(t) else t for t in trimmed])

    def greedy(self, tokens: list[str]) -> str:
        out, i, n = [], 0, len(tokens)
        words, lengths = self.words.get, self.lengths.get
        while i < n:
            t = tokens[i]
            found, size = words(t), 1
            if found is None:
                for k in lengths(t, ()):
                    part = "".join(tokens[i : i + k])
                    # a span's entry holds single characters, so each of the k tokens is one
                    if i + k <= n and len(part) == k and (found := words(part)) is not None:
                        size = k
                        break
                else:
                    found = self.alone(t)
            out.append(found)
            i += size
        return " ".join(out)

    def alone(self, t: str) -> str:
        if len(t) == 1 or _ASCII_WORD(t):
            return t if _ASCII_WORD(t) else self.first.get(t, t)
        return " ".join(self.first.get(c, c) for c in t) if _HAN_PHRASE(t) else t


class Readings:
    """All readings, piped as in the dictionary."""

    def __init__(self, mapping: Mapping[str, str], words: Mapping[str, str]):
        self.mapping, self.words = dict(mapping), dict(words)
        keep = {c: chr(c) for c in map(ord, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")}
        self.table = _Table(keep | {ord(k): k for k in mapping if len(k) == 1})

    def text(self, text: str) -> str:
        """ASCII runs and mapped characters; each stretch of anything else becomes one space."""
        return _SPACES.sub(" ", text.translate(self.table))

    def array(self, text: str) -> list[str]:
        return _RAW_TOKEN.findall(self.text(text)) or [""]

    def __call__(self, text: str) -> str:
        """The whole text's word entry, else each token's; unmapped tokens in pipes."""
        found = self.words.get(text)
        return " ".join(self.mapping.get(t, f"|{t}|") for t in self.array(text)) if found is None else found

    def tokens(self, tokens: list[str | None]) -> str | None:
        """A token's word entry, else each character's or the character; None without tokens."""
        some = [t for t in tokens if t is not None]
        return " ".join(self.words[t] if t in self.words else " ".join(self.mapping.get(c, c) for c in t) for t in some) if some else None
