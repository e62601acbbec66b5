"""Personal data: regular expressions propose spans, checksums confirm them, context words score them.

Base kinds (email, ip, card, phone) are proposed leftmost and non-overlapping per kind and
confirmed by their validators; they are always reported. The method's own kinds follow: iban
(mod-97), ssn (number rules), phone numbers in other forms, and secrets (letters and digits mixed as in random keys). Each
starts from a prior; a context word within CONTEXT characters before or after raises the score, and what
stays below THRESHOLD is dropped.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, small_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "phone_local", "secret")
#: Characters on either side in which a context word counts.
CONTEXT = 40
THRESHOLD = 0.5
#: Score of a confirmed span without context, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "phone_local": 0.2, "secret": 0.3}
BOOST = 0.4
WORDS = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "secret": ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "access_key", "credential", "bearer", "auth"),
}
#: Bits a character that random keys have at least; words and plain numbers have fewer, or lack letters or digits.
SECRET_BITS = 3.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its start fails from its middle too, so starts inside are skipped.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looked ahead, so that a start within another's characters is proposed too.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))")
#: Characters of an IBAN by country.
IBAN_LENGTH = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,512}(?![A-Za-z0-9+/_=-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _iban_end(proposed: str) -> int:
    """End of the IBAN that ``proposed`` starts with, 0 if none.

    Words that follow can look like its groups. A word end at the country's length comes first, then the
    whole; for countries of unknown length every word end counts, the longest first.
    """
    ends = [i for i in range(len(proposed), 0, -1) if proposed[i : i + 1] in ("", " ")]
    known = IBAN_LENGTH.get(proposed[:2])
    if known:
        ends = [i for i in ends if i - proposed.count(" ", 0, i) == known] + ends[:1]
    return next((i for i in ends if mod97(proposed[:i])), 0)


def _ibans(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _IBAN.finditer(text):
        if m.start() >= end and (n := _iban_end(m[1])):
            end = m.start() + n
            out.append((m.start(), end))
    return out


def _emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ outward: the run of local characters before it, not before the last match's end."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = at
        if found:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = found.end()
                out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = lambda m: _NOT_DIGIT.sub("", m[0])
    return {
        "email": _emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(_small, m.groups()))],
        "card": [m.span() for m in _CARD.finditer(text) if 13 <= m.end() - m.start() and 13 <= len(d := digits(m)) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits(m)) <= 15] if "+" in text else [],
    }


def looks_random(key: str) -> bool:
    """Letters and digits, of at least SECRET_BITS bits a character."""
    if not (any(c.isdigit() for c in key) and any(c.isalpha() for c in key)):
        return False
    return -sum(n / len(key) * math.log2(n / len(key)) for n in Counter(key).values()) >= SECRET_BITS


def _proposed(text: str) -> dict[str, list[tuple[int, int]]]:
    """The method's own kinds; all of them hold digits."""
    if _DIGIT.search(text) is None:
        return {}
    return {
        "iban": _ibans(text),
        "ssn": [m.span() for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"],
        "phone_local": [m.span() for m in _PHONE_LOCAL.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 12],
        "secret": [m.span() for m in _SECRET.finditer(text) if looks_random(m[0])],
    }


_NEAR = {k: re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, v)) + r")s?\b") for k, v in WORDS.items()}


def score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT]
    return PRIOR[kind] + (BOOST if _NEAR[kind].search(near) else 0.0)


class Taken:
    """Places that spans cover, as disjoint ones in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return (i == 0 or self.ends[i - 1] <= a) and (i == len(self.starts) or b <= self.starts[i])

    def add(self, a: int, b: int) -> None:
        i, j = bisect_left(self.ends, a), bisect_right(self.starts, b)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start. Spans of the method don't overlap other spans."""
    out, taken = [], Taken()
    for kind, found in base_spans(text).items():
        out += [(kind, a, b, min(1.0, score(kind, text, a, b))) for a, b in found]
        for s in found:
            taken.add(*s)
    for kind, found in _proposed(text).items():
        for a, b in found:
            if taken.free(a, b) and (p := score(kind, text, a, b)) >= THRESHOLD:
                out.append((kind, a, b, min(1.0, p)))
                taken.add(a, b)
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and spans, an array of (kind, start, end, score) in code points.

    Null counts as empty and has no spans. Repeated rows are scanned each by itself, empty tables
    give no rows. Every pattern takes time in proportion to the text, however long it is.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "score": p} for k, a, b, p in spans_of(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans and has_pii (whether there are any) of each of ``documents``.

    Nulls, empty texts, repeated rows and empty tables as in find_pii().
    """
    found = find_pii(table(spark, sf_dir, "documents"))
    one = "concat_ws(':', s.kind, s.start, s.end)"
    return found.selectExpr(
        "doc_id",
        *(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) AS n_{k}" for k in BASE),
        f"sha2(array_join(transform(filter(spans, s -> s.kind in {BASE}), s -> {one}), ','), 256) AS base_sha256",
        f"array_join(transform(spans, s -> {one}), ',') AS spans",
        "cast(size(spans) as long) AS n_spans",
        "size(spans) > 0 AS has_pii",
    )
