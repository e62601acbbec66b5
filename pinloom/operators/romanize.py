"""Romanization of text and token columns, row by row without shuffles or joins.

Each function runs a kernel over Arrow batches (Spark's Arrow functions); distinct texts of a batch are romanized
once. The dictionary is broadcast once a session, whatever its size, so plans stay small.

``first reading`` functions give lower-case romanization without pipes; ``all readings`` functions
keep the dictionary's piped values. Null input gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..dictionary import Dictionary
from ..functions import kernels
from ..shipping import ship_package


def _shared(d: Dictionary, name: str, make: Callable[[], object]):
    """The broadcast kernel of a dictionary, kept with it for the session."""
    spark = SparkSession.getActiveSession()
    key = (spark.sparkContext.applicationId, name)
    if key not in d.shared:
        ship_package(spark)
        d.shared[key] = spark.sparkContext.broadcast(make())
    return d.shared[key]


def _of_texts(kernel, method: str, kind: str):
    """An Arrow function of a text column."""
    out = pa.list_(pa.string()) if kind.startswith("array") else pa.string()

    def run(texts: pa.Array) -> pa.Array:
        f = getattr(kernel.value, method)
        once = texts.dictionary_encode()
        return pa.array([f(t) for t in once.dictionary.to_pylist()], out).take(once.indices)

    return F.arrow_udf(run, kind)


def _of_tokens(kernel, method: str):
    """An Arrow function of a column of token arrays."""

    def run(tokens: pa.Array) -> pa.Array:
        f = getattr(kernel.value, method)
        return pa.array([None if t is None else f(t) for t in tokens.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def _characters(d: Dictionary):
    return _shared(d, "characters", lambda: kernels.Characters(d.mapping))


def _words(d: Dictionary):
    return _shared(d, "words", lambda: kernels.Words(d.mapping, d.words))


def _readings(d: Dictionary):
    return _shared(d, "readings", lambda: kernels.Readings(d.mapping, d.words))


#: The functions by name: what each makes of a dictionary is an Arrow function of one column.
FUNCTIONS: dict[str, Callable[[Dictionary], Callable[[Column], Column]]] = {
    "char_romanize": lambda d: _of_texts(_characters(d), "__call__", "string"),
    "word_romanize": lambda d: _of_texts(_words(d), "__call__", "string"),
    "word_romanize_tokens": lambda d: _of_tokens(_words(d), "tokens"),
    "romanize2text": lambda d: _of_texts(_readings(d), "text", "string"),
    "romanize2array": lambda d: _of_texts(_readings(d), "array", "array<string>"),
    "characters2romanize": lambda d: _of_texts(_readings(d), "__call__", "string"),
    "romanize_tokens_all": lambda d: _of_tokens(_readings(d), "tokens"),
}


def char_romanize(c: Column, d: Dictionary) -> Column:
    """First readings of mapped characters and lower-cased ASCII runs, joined by spaces."""
    return FUNCTIONS["char_romanize"](d)(c)


def word_romanize(c: Column, d: Dictionary) -> Column:
    """Greedy longest words, then characters. Separators between characters don't break words."""
    return FUNCTIONS["word_romanize"](d)(c)


def word_romanize_tokens(tokens: Column, d: Dictionary) -> Column:
    """As word_romanize for an array of tokens, where unmapped characters stay. A null token is an error."""
    return FUNCTIONS["word_romanize_tokens"](d)(tokens)


def romanize2text(c: Column, d: Dictionary) -> Column:
    """Keeps ASCII runs and mapped characters; each stretch of anything else becomes one space."""
    return FUNCTIONS["romanize2text"](d)(c)


def romanize2array(c: Column, d: Dictionary) -> Column:
    return FUNCTIONS["romanize2array"](d)(c)


def characters2romanize(c: Column, d: Dictionary) -> Column:
    """All readings, piped: the whole text's word entry, else each token's; unmapped tokens in pipes."""
    return FUNCTIONS["characters2romanize"](d)(c)


def romanize_tokens_all(tokens: Column, d: Dictionary) -> Column:
    """All readings of tokens: a token's word entry, else each character's or the character; null for no tokens."""
    return FUNCTIONS["romanize_tokens_all"](d)(tokens)
