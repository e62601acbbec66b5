"""Dictionary tables, their versions and overlays.

A registry holds immutable DataFrame snapshots of the three base tables and of suffix overlays.
Every edit makes a new snapshot and raises the version, so plans built later see it. Romanizers
take a ``Dictionary``: the merged entries, cached by version. Overlay edits show after
their cache is cleared or the base version moves on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .functions.kernels import first_reading, first_readings
from .operators.tables import insert_if_absent, overlay_merge, upsert

__all__ = ["Dictionary", "Registry", "canonical_suffix", "first_reading", "first_readings", "standard_token_table", "standard_tokens"]

MAPPING_SCHEMA = "character string, pinyin string"
TOKEN_SCHEMA = "character string, category smallint"
WORDS_SCHEMA = "word string, pinyin string"
SCHEMAS = {"mapping": MAPPING_SCHEMA, "token": TOKEN_SCHEMA, "words": WORDS_SCHEMA}
SPACE = (" ", " ")
#: Entries of a table that may come to the driver to be broadcast. Dictionaries are bounded by the language.
MAX_ENTRIES = 2_000_000

# The initials, the vowels that are tokens, and the finals that each initial takes.
INITIALS = ("zh", "ch", "sh", "b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "q", "r", "s", "t", "v", "w", "x", "y", "z")
VOWELS = ("a", "e", "o")
FINALS = {
    "": "ai an ang ao ei en eng er ou",
    "b": "a ai an ang ao ei en eng i ian iang iao ie in ing o ong u",
    "c": "a ai an ang ao e ei en eng i ong ou u uan ui un uo",
    "ch": "a ai an ang ao e en eng i ong ou u ua uai uan uang ui un uo",
    "d": "a ai an ang ao e ei en eng i ia ian iao ie in ing iu ong ou u uan ui un uo",
    "f": "a an ang ei en eng iao o ou u",
    "g": "a ai an ang ao e ei en eng ong ou u ua uai uan uang ui un uo",
    "h": "a ai an ang ao e ei en eng m ng ong ou u ua uai uan uang ui un uo",
    "j": "i ia ian iang iao ie in ing iong iu u uan ue un",
    "k": "a ai an ang ao e ei en eng ong ou u ua uai uan uang ui un uo",
    "l": "a ai an ang ao e ei en eng i ia ian iang iao ie in ing iu o ong ou u uan ue un uo",
    "m": "a ai an ang ao e ei en eng i ian iao ie in ing iu o ou u",
    "n": "a ai an ang ao e ei en eng g i ia ian iang iao ie in ing iu ong ou u uan ue un uo",
    "p": "a ai an ang ao ei en eng i ian iao ie in ing o ou u",
    "q": "i ia ian iang iao ie in ing iong iu u uan ue un",
    "r": "an ang ao e en eng i ong ou u ua uan ui un uo",
    "s": "a ai an ang ao e en eng i ong ou u uan ui un uo",
    "sh": "a ai an ang ao e ei en eng i ou u ua uai uan uang ui un uo",
    "t": "a ai an ang ao e ei eng i ian iao ie ing ong ou u uan ui un uo",
    "w": "a ai an ang ei en eng o ong u",
    "x": "i ia ian iang iao ie in ing iong iu u uan ue un",
    "y": "a an ang ao e i in ing o ong ou u uan ue un",
    "z": "a ai an ang ao e ei en eng i ong ou u uan ui un uo",
    "zh": "a ai an ang ao e ei en eng i ong ou u ua uai uan uang ui un uo",
}


def standard_tokens() -> dict[str, int]:
    """Token categories: 1 syllables (initial and final), 2 initials, 3 vowels."""
    syllables = {i + f: 1 for i, finals in FINALS.items() for f in finals.split()}
    return syllables | dict.fromkeys(INITIALS, 2) | dict.fromkeys(VOWELS, 3)


def standard_token_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(standard_tokens().items()), TOKEN_SCHEMA)


def canonical_suffix(suffix: str | None) -> str | None:
    """None for the base dictionary, else the overlay's name with one leading underscore."""
    name = (suffix or "").strip()
    if not name:
        return None
    name = name.lstrip("_")
    if not re.fullmatch("[A-Za-z0-9_]+", name):
        raise ValueError(f"not a dictionary suffix: {suffix!r}")
    return f"_{name.lower()}"


@dataclass(frozen=True)
class Dictionary:
    """Merged entries as plain tables; ``shared`` keeps what a session has broadcast of them."""

    mapping: dict[str, str]
    tokens: dict[str, int]
    words: dict[str, str]
    shared: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def syllables(self) -> list[str]:
        return [t for t, k in self.tokens.items() if k == 1]


class Registry:
    """The dictionary store of one session."""

    def __init__(self, spark: SparkSession, mapping: DataFrame, tokens: DataFrame, words: DataFrame | None = None):
        self.spark, self.version = spark, 1
        words = spark.createDataFrame([], WORDS_SCHEMA) if words is None else words
        self.tables = {"mapping": mapping, "token": self._checked(tokens), "words": words}
        self.overlays: dict[tuple[str, str], DataFrame] = {}
        self._base: tuple[int, Dictionary] | None = None
        self._merged: dict[str, tuple[int, Dictionary]] = {}
        self._with_space()

    @classmethod
    def of(cls, spark: SparkSession, mapping: dict[str, str], tokens: dict[str, int], words: dict[str, str] | None = None) -> Registry:
        make = lambda rows, kind: spark.createDataFrame(list(rows.items()), SCHEMAS[kind])
        return cls(spark, make(mapping, "mapping"), make(tokens, "token"), make(words or {}, "words"))

    @staticmethod
    def _checked(tokens: DataFrame) -> DataFrame:
        if tokens.where("category is null or category not in (1, 2, 3)").limit(1).count():
            raise ValueError("token categories are 1, 2 and 3")
        return tokens

    def _with_space(self) -> None:
        self.tables["mapping"] = insert_if_absent(self.tables["mapping"], self.spark.createDataFrame([SPACE], MAPPING_SCHEMA), "character")

    def _set(self, kind: str, df: DataFrame) -> None:
        self.tables[kind] = self._checked(df) if kind == "token" else df
        self.version += 1

    def upsert(self, kind: str, rows: DataFrame) -> None:
        self._set(kind, upsert(self.tables[kind], rows, self.tables[kind].columns[0]))

    def insert_if_absent(self, kind: str, rows: DataFrame) -> None:
        self._set(kind, insert_if_absent(self.tables[kind], rows, self.tables[kind].columns[0]))

    def delete(self, kind: str, condition: str) -> None:
        self._set(kind, self.tables[kind].where(f"not coalesce({condition}, false)"))

    def truncate(self, kind: str) -> None:
        self._set(kind, self.tables[kind].limit(0))

    def seed(self, mapping: DataFrame, tokens: DataFrame, words: DataFrame) -> bool:
        """Replaces all three tables; the space entry is always there."""
        for kind, df in (("mapping", mapping), ("token", tokens), ("words", words)):
            self._set(kind, df)
        self._with_space()
        return True

    def save(self, path: str) -> None:
        """Writes all tables, overlays and the version as Parquet under ``path``."""
        for kind, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{kind}")
        for (name, kind), df in self.overlays.items():
            df.write.mode("overwrite").parquet(f"{path}/overlay_{kind}/name={name}")
        meta = self.spark.createDataFrame([(True, self.version, [f"{n} {k}" for n, k in self.overlays])], "singleton boolean, version long, overlays array<string>")
        meta.write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        """What save() wrote, with its version."""
        read = lambda at, kind: spark.read.schema(SCHEMAS[kind]).parquet(f"{path}/{at}")
        out = cls(spark, read("mapping", "mapping"), read("token", "token"), read("words", "words"))
        meta = spark.read.parquet(f"{path}/meta").first()
        for name, kind in map(str.split, meta["overlays"]):
            out.set_overlay(name, kind, read(f"overlay_{kind}/name={name}", kind))
        out.version = meta["version"]
        return out

    def set_overlay(self, suffix: str, kind: str, df: DataFrame) -> None:
        """An overlay of mapping or words. Cached merges stay as they are until cleared."""
        self.overlays[canonical_suffix(suffix), kind] = df

    def _entries(self, kind: str, suffix: str | None = None) -> dict:
        df = self.tables[kind]
        if suffix and (over := self.overlays.get((suffix, kind))) is not None:
            df = overlay_merge(df, over, df.columns[0])
        rows = df.limit(MAX_ENTRIES + 1).collect()
        if len(rows) > MAX_ENTRIES:
            raise ValueError(f"{kind} has more than {MAX_ENTRIES} entries")
        return {r[0]: r[1] for r in rows}

    def dictionary(self, suffix: str | None = None) -> Dictionary:
        name = canonical_suffix(suffix)
        if self._base is None or self._base[0] != self.version:
            self._base = self.version, Dictionary(*(self._entries(k) for k in ("mapping", "token", "words")))
        if name is None or not any(s == name for s, _ in self.overlays):
            return self._base[1]
        if name not in self._merged or self._merged[name][0] != self.version:
            self._merged[name] = self.version, Dictionary(self._entries("mapping", name), self._base[1].tokens, self._entries("words", name))
        return self._merged[name][1]

    def refresh(self) -> None:
        """Forgets everything cached, as after a restart: the version moves on and merges are dropped."""
        self.version += 1
        self._merged.clear()

    def clear_suffix_cache(self, suffix: str | None = ...) -> int | bool:
        """Without a suffix: forgets all merges and returns their number. With one: whether it was there."""
        if suffix is ...:
            n = len(self._merged)
            self._merged.clear()
            return n
        name = canonical_suffix(suffix)
        return name is not None and self._merged.pop(name, None) is not None
