"""Matching romanized columns with patterns and phrase queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _term(p: Column) -> Column:
    """A term pattern that can't leave its term."""
    return F.regexp_replace(p, r"\.\*", "[^ ]*")


def phrase_regex(query: Column) -> Column:
    """One regular expression for a regex or regex_phrase query without gaps."""
    return F.concat(F.lit("(?:^| )"), F.array_join(F.transform(query["patterns"], _term), " "), F.lit("(?:$| )"))


def _with_gaps(terms: Column, query: Column) -> Column:
    """Ordered terms with at most slope terms skipped in all. State: (end, cost) of partial matches, cheapest per end."""
    place = F.sequence(F.lit(0), F.greatest(F.size(terms) - 1, F.lit(0)))
    hit = lambda i, p: F.call_function("rlike", F.get(terms, i), F.concat(F.lit("^(?:"), _term(p), F.lit(")$")))
    slope = F.coalesce(query["slope"], F.lit(0))

    def step(states: Column, p: Column) -> Column:
        ends = F.filter(place, lambda i: hit(i, p))
        first = F.size(states) == 0
        from_all = F.flatten(F.transform(ends, lambda i: F.transform(F.filter(states, lambda s: s["end"] < i), lambda s: F.struct(i.alias("end"), (s["cost"] + i - s["end"] - 1).alias("cost")))))
        started = F.transform(ends, lambda i: F.struct(i.alias("end"), F.lit(0).alias("cost")))
        dead = F.array(F.struct(F.lit(1 << 30).alias("end"), F.lit(1 << 30).alias("cost")))
        out = F.array_distinct(F.filter(F.when(first, started).otherwise(from_all), lambda s: s["cost"] <= slope))
        return F.when(F.size(out) > 0, out).otherwise(dead)

    none = F.array().cast("array<struct<end:int,cost:int>>")
    last = F.aggregate(query["patterns"], none, step)
    return F.exists(last, lambda s: s["cost"] <= slope) & (F.size(terms) > 0)


def matches(text: Column, query: Column, gaps: bool = True) -> Column:
    """Whether a column of space-separated terms matches; false for the empty query, null for null.

    With ``gaps`` a positive slope lets that many terms be skipped in order, in all. max_expansions has
    no effect here, where no terms are expanded; search_postings() checks it.
    """
    plain = F.when(query["kind"] == "empty", F.lit(False)).otherwise(F.call_function("rlike", text, phrase_regex(query)))
    if not gaps:
        return plain
    terms = F.filter(F.split(text, " "), lambda t: t != "")
    return F.when((query["kind"] == "regex_phrase") & (F.coalesce(query["slope"], F.lit(0)) > 0), _with_gaps(terms, query)).otherwise(plain)


def piped_matches(piped: Column, pattern: Column) -> Column:
    """The regular-expression search over all readings."""
    return F.call_function("rlike", piped, pattern)


#: Letters of a pattern's start that joins compare; longer starts are compared in full afterwards.
START = 8
#: Queries of other forms that one pass over the texts tries, as a broadcast.
BLOCK = 10_000
_PREFIX = r"^([0-9a-z]+)\.\*$"


def _starts(term: Column) -> Column:
    """The first 1 to START characters of a term."""
    return F.transform(F.sequence(F.lit(1), F.least(F.length(term), F.lit(START))), lambda n: F.substring(term, F.lit(1), n))


def _prefixes(patterns: Column) -> Column:
    """The starts that patterns of the form ``start.*`` ask for; null if any has another form."""
    found = F.transform(patterns, lambda p: F.nullif(F.regexp_extract(p, _PREFIX, 1), F.lit("")))
    return F.when(~F.exists(found, lambda p: p.isNull()) & (F.size(found) > 0), found)


def _phrase_at(terms: Column, starts: Column) -> Column:
    """Whether neighbouring terms begin with ``starts``, in order."""
    last = F.size(terms) - F.size(starts)
    at = lambda i: F.forall(F.zip_with(F.slice(terms, i + 1, F.size(starts)), starts, lambda t, p: F.startswith(t, p)), lambda x: x)
    return F.when(last >= 0, F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(False)


def _in_blocks(left: DataFrame, queries: DataFrame, condition: Column) -> DataFrame:
    """Joins by a condition that holds no equality: ``queries``, once each, are broadcast BLOCK by BLOCK."""
    n = -(-queries.count() // BLOCK)
    blocks = [left.join(F.broadcast(queries.where(F.pmod(F.xxhash64(*queries.columns[:1]), F.lit(n)) == i)), condition) for i in range(n)]
    return reduce(DataFrame.unionByName, blocks) if blocks else left.join(queries, F.lit(False))


def search_counts(docs: DataFrame, queries: DataFrame, text: str = "pinyin", query: str = "query", id_: str = "id") -> DataFrame:
    """(id, hits) for each row of ``queries``: each distinct query runs once over the distinct texts.

    Texts are counted first, map-side, so repeated ones are matched once. A query of starts of terms joins
    the texts that have a term with its longest start, an equi-join; the phrase is then verified, and counts
    combine map-side. Queries with other patterns are few and tried on each text, in blocks.
    """
    texts = docs.groupBy(F.col(text).alias("__text")).agg(F.count(F.lit(1)).alias("__n"))
    every = queries.select(F.to_json(query).alias("__key"), F.col(query).alias("__q")).dropDuplicates(["__key"])
    once = every.where("__q.kind <> 'empty'").select("__key", "__q", _prefixes(F.col("__q.patterns")).alias("__p"))
    longest = F.array_max(F.transform("__p", lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    asked = once.where("__p is not null").select("__key", "__p", F.substring(longest, 1, START).alias("__start"))
    split = texts.where(F.col("__text").isNotNull()).select("__n", F.split("__text", " ").alias("__t"))
    starts = F.flatten(F.transform(F.filter("__t", lambda t: t != ""), _starts))
    begun = split.select("__t", "__n", F.explode(F.array_distinct(starts)).alias("__start"))
    hits = begun.join(asked, "__start").where(_phrase_at(F.col("__t"), F.col("__p"))).groupBy("__key").agg(F.sum("__n").alias("hits"))
    other = once.where("__p is null").select("__key", "__q")
    if not other.isEmpty():
        tried = _in_blocks(texts, other, matches(F.col("__text"), F.col("__q"), gaps=False))
        hits = hits.unionByName(tried.groupBy("__key").agg(F.sum("__n").alias("hits")))
    keyed = queries.select(id_, F.to_json(query).alias("__key"))
    return keyed.join(hits, "__key", "left").select(id_, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def postings(docs: DataFrame, text: str = "pinyin", id_: str = "id") -> DataFrame:
    """(term, id, pos): an inverted index of space-separated terms, to be stored bucketed by term."""
    return docs.select(F.col(id_), F.posexplode(F.filter(F.split(text, " "), lambda t: t != "")).alias("pos", "term")).select("term", id_, "pos")


def search_postings(index: DataFrame, queries: DataFrame, query: str = "query", id_: str = "id", query_id: str = "query_id") -> DataFrame:
    """(query_id, id) of phrase matches by equi-joins: patterns are expanded over the vocabulary by their starts, then terms join postings.

    A query whose patterns expand to more terms than its max_expansions is an error: none are dropped.
    """
    parts = queries.select(query_id, F.size(f"{query}.patterns").alias("n"), F.posexplode(f"{query}.patterns").alias("i", "p"))
    words = index.select("term").distinct()
    asked = parts.select("p").distinct().withColumn("start", F.get(_prefixes(F.array("p")), F.lit(0)))
    begun = words.select("term", F.explode(_starts(F.col("term"))).alias("__start"))
    wanted = (
        begun.join(asked.where("start is not null").withColumn("__start", F.substring("start", 1, START)), "__start")
        .where(F.startswith("term", "start")).select("term", "p")
    )
    other = asked.where("start is null").select("p")
    if not other.isEmpty():
        wanted = wanted.unionByName(_in_blocks(words, other, F.call_function("rlike", F.col("term"), F.concat(F.lit("^(?:"), _term(F.col("p")), F.lit(")$")))).select("term", "p"))
    capped = queries.where(F.col(f"{query}.max_expansions").isNotNull()).select(query_id, F.col(f"{query}.max_expansions").alias("most")).distinct()
    if not capped.isEmpty():
        found = parts.join(wanted.groupBy("p").agg(F.count("term").alias("k")), "p").groupBy(query_id).agg(F.sum("k").alias("k")).join(capped, query_id)
        over = F.raise_error(F.concat(F.lit("a query expands to "), F.col("k").cast("string"), F.lit(" terms, more than "), F.col("most").cast("string")))
        found = found.select(query_id, F.when(F.col("k") > F.col("most"), over.cast("boolean")).otherwise(True).alias("fine"))
        parts = parts.join(found, query_id, "left").where(F.coalesce("fine", F.lit(True))).drop("fine")
    hits = parts.join(wanted, "p").join(index, "term").select(query_id, id_, "n", "i", (F.col("pos") - F.col("i")).alias("start"))
    full = hits.groupBy(query_id, id_, "start", "n").agg(F.count_distinct("i").alias("k")).where("k = n")
    return full.select(query_id, id_).distinct()


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters, with two blanks before and one after, as trigram indexes have them."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_index(docs: DataFrame, text: str = "pinyin", id_: str = "id") -> DataFrame:
    """(gram, id), to be stored bucketed by gram."""
    return docs.select(F.explode(trigrams(F.col(text))).alias("gram"), id_)


def search_substring(docs: DataFrame, index: DataFrame, part: str, text: str = "pinyin", id_: str = "id") -> DataFrame:
    """Rows whose text contains ``part``: those that have all its inner trigrams, then verified. Short parts scan."""
    grams = sorted({part.lower()[i : i + 3] for i in range(len(part) - 2)})
    verified = F.contains(F.col(text), F.lit(part))
    if not grams:
        return docs.where(verified)
    ids = index.where(F.col("gram").isin(grams)).groupBy(id_).agg(F.count_distinct("gram").alias("k")).where(F.col("k") == len(grams))
    return docs.join(ids.select(id_), id_, "left_semi").where(verified)
