"""The registered queries of the romanization and search operators, with their SQL.

Names derive from customer keys and typed queries from order keys; Latin-side operators also run
over documents and parts. The SQL inlines the fixture dictionaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dictionary import MAPPING_SCHEMA, Dictionary, Registry, first_readings, standard_tokens
from ..functions import patterns as pt
from ..functions import text as tx
from ..operators import match, tables
from ..operators import romanize as rm
from ..sources import files, prep
from . import workload as wl

STANDARD = standard_tokens()
SYLLABLES = [t for t, k in STANDARD.items() if k == 1]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), wl.name_of(F.col("c_custkey")).alias("name"))


def _typed(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), wl.query_of(F.col("o_orderkey")).alias("query"))


def _parts(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


_built: dict[tuple[str, str | None], Dictionary] = {}


def _dictionary(spark: SparkSession, suffix: str | None = None) -> Dictionary:
    key = (spark.sparkContext.applicationId, suffix)
    if key not in _built:
        _built[key] = wl.bench_registry(spark).dictionary(suffix)
    return _built[key]


# --- SQL pieces -----------------------------------------------------------------------------

def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _map(entries: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in entries.items()) + "}"


_BENCH = wl.bench_mapping()
_OVER = _BENCH | wl.OVERLAY_MAPPING
_OVER_WORDS = wl.WORDS | wl.OVERLAY_WORDS
_FIRST = {k: first_readings(v) for k, v in _BENCH.items()}
_OVER_FIRST = {k: first_readings(v) for k, v in _OVER.items()}
_NAMES = (
    f"names AS (SELECT c_custkey AS id, {_list(wl.SURNAMES)}[1 + c_custkey % 10] || {_list(wl.GIVEN)}[1 + (c_custkey // 3) % 10] || "
    "CASE WHEN c_custkey % 5 = 0 THEN 'ABC' WHEN c_custkey % 7 = 0 THEN '123' ELSE '' END AS name FROM customer)"
)
_TYPED = f"typed AS (SELECT o_orderkey AS id, {_list(wl.QUERIES)}[1 + o_orderkey % 9] AS query FROM orders)"
_PARTS = "parts AS (SELECT p_partkey AS id, p_name AS name FROM part)"
_SPLIT = "regexp_extract_all({}, '(?s)([0-9A-Za-z]+|.)')"
_ASCII = "regexp_full_match(t, '[0-9A-Za-z]+')"
_WS = tx.WHITE_SPACE


def _syllables(c: str, zhchsh: bool, tokens=SYLLABLES) -> str:
    return f"regexp_extract_all(lower({c}), {_quoted(tx.syllable_pattern(tokens, zhchsh))})"


def _join(items: str, sep: str = " ") -> str:
    return f"array_to_string({items}, {_quoted(sep)})"


def _char(c: str, first: dict[str, str]) -> str:
    """Char romanization of c; each token's map entry, or itself in lower case where ASCII."""
    each = f"list_transform(regexp_extract_all({c}, '([0-9A-Za-z]+|[^0-9A-Za-z{_WS}])'), lambda t: CASE WHEN {_ASCII} THEN lower(t) ELSE {_map({k: v for k, v in first.items() if k.strip()})}[t] END)"
    return f"coalesce({_join(f'list_filter({each}, lambda t: t IS NOT NULL)')}, '')"


def _word(c: str, first: dict[str, str], words: dict[str, str]) -> str:
    """Word romanization by one alternation, longest words first; exact as no word has one character and names no separators."""
    longest = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    entries = first | {k: first_readings(v) for k, v in words.items()}
    return _join(f"list_transform(regexp_extract_all({c}, '({longest}|[0-9A-Za-z]+|.)'), lambda t: CASE WHEN {_ASCII} THEN lower(t) ELSE {_map(entries)}[t] END)")


def _romanize2text(c: str) -> str:
    kept = f"list_transform({_SPLIT.format(c)}, lambda t: CASE WHEN {_ASCII} OR {_map(_BENCH)}[t] IS NOT NULL THEN t ELSE ' ' END)"
    return f"regexp_replace({_join(kept, '')}, ' +', ' ', 'g')"


def _characters(c: str) -> str:
    """All readings; the whole text's word entry first."""
    t2 = f"CASE WHEN {_romanize2text(c)} = '' THEN [''] ELSE {_SPLIT.format(_romanize2text(c))} END"
    return f"coalesce({_map(wl.WORDS)}[{c}], {_join(f'''list_transform({t2}, lambda t: coalesce({_map(_BENCH)}[t], '|' || t || '|'))''')})"


def _patterns(c: str, generated: bool = False) -> str:
    head = r".*\|" if generated else ""
    return f"CASE WHEN regexp_full_match({c}, '[A-Za-z \\t\\n\\x0B\\f\\r]+') THEN list_transform({_syllables(c, True)}, lambda t: '{head}' || t || '.*') ELSE [] END"


def _rendered(c: str, slope: int | None = None, most: int | None = None) -> str:
    ps = _patterns(c)
    quoted = f"array_to_string(list_transform({ps}, lambda t: '''' || t || ''''), ', ')"
    tail = (f", {slope or 0}, {most}" if most is not None else f", {slope}") if (slope is not None or most is not None) else ""
    return f"CASE len({ps}) WHEN 0 THEN 'empty()' WHEN 1 THEN 'regex(' || {quoted} || ')' ELSE 'regex_phrase(ARRAY[' || {quoted} || ']{tail})' END"


def _isearch(c: str, zhchsh: bool, prefix: bool) -> str:
    initials = _list(t for t, k in sorted(STANDARD.items()) if k == 2)
    items = f"list_transform({_syllables(c, zhchsh)}, lambda t: '\\S*\\|' || t || CASE WHEN list_contains({initials}, t) THEN '[^\\|]*' ELSE '' END || '\\|\\S*')"
    return f"CASE WHEN len({_syllables(c, zhchsh)}) > 0 THEN {_quoted('^' if prefix else '')} || {_join(items)} END"


def _search(c: str, full: bool, prefix: bool) -> str:
    tail = "" if full else r"[^\\|]*"
    return f"{_quoted('^' if prefix else '')} || regexp_replace({c}, '([\\p{{L}}\\p{{N}}_]+)', '\\\\S*\\\\|\\1{tail}\\\\|\\\\S*', 'g')"


def _phrase_regex(c: str) -> str:
    return f"'(?:^| )' || array_to_string(list_transform({_patterns(c)}, lambda t: regexp_replace(t, '\\.\\*', '[^ ]*')), ' ') || '(?:$| )'"


# --- registration ---------------------------------------------------------------------------

def _column_query(name: str, source, in_sql: str, table: str, column: str, make: Callable[[Column, SparkSession], Column], sql: str) -> None:
    """A query that maps one column; result columns id and out."""
    QUERIES[name] = lambda spark, sf_dir: source(spark, sf_dir).select("id", make(F.col(column), spark).alias("out"))
    SQL[name] = f"WITH {in_sql} SELECT id, {sql} AS out FROM {table}"


def _on_names(name, make, sql):
    _column_query(name, _names, _NAMES, "names", "name", make, sql)


def _on_parts(name, make, sql):
    _column_query(name, _parts, _PARTS, "parts", "name", make, sql)


def _on_typed(name, make, sql):
    _column_query(name, _typed, _TYPED, "typed", "query", make, sql)


_bar = lambda c: F.array_join(c, "/")

_on_names("romanize2text", lambda c, s: rm.romanize2text(c, _dictionary(s)), _romanize2text("name"))
_on_names("romanize2array", lambda c, s: _bar(rm.romanize2array(c, _dictionary(s))), _join(_SPLIT.format(_romanize2text("name")), "/"))
_on_names("characters2romanize", lambda c, s: rm.characters2romanize(c, _dictionary(s)), _characters("name"))
_on_names("char_romanize", lambda c, s: rm.char_romanize(c, _dictionary(s)), _char("name", _FIRST))
_on_names("char_romanize_overlay", lambda c, s: rm.char_romanize(c, _dictionary(s, "_bench")), _char("name", _OVER_FIRST))
_on_names("word_romanize", lambda c, s: rm.word_romanize(c, _dictionary(s)), _word("name", _FIRST, wl.WORDS))
_on_names("word_romanize_overlay", lambda c, s: rm.word_romanize(c, _dictionary(s, "_bench")), _word("name", _OVER_FIRST, _OVER_WORDS))

_tokens = lambda c: F.array(F.substring(c, 1, 1), F.expr("substring(name, 2)"))
_PAIR = "list_transform([name[1:1], name[2:]], lambda t: {})"
_one_char = lambda ch, m: f"coalesce({_map(m)}[{ch}], {ch})"


def _token_first(first, words) -> str:
    w = {k: first_readings(v) for k, v in words.items()}
    chars = f"array_to_string(list_transform(regexp_extract_all(t, '.'), lambda u: {_one_char('u', first)}), ' ')"
    return _join(_PAIR.format(f"coalesce({_map(w)}[t], CASE WHEN {_ASCII} THEN lower(t) WHEN len(t) > 1 AND regexp_matches(t, '[0-9A-Za-z]') THEN t ELSE {chars} END)"))


def _tokens_sql(first, words) -> str:
    """Two tokens: the surname and the rest. A surname and a one-character rest can form a word of two characters; the fixtures have none."""
    return _token_first(first, words)


_on_names("word_romanize_tokens", lambda c, s: rm.word_romanize_tokens(_tokens(c), _dictionary(s)), _tokens_sql(_FIRST, wl.WORDS))
_on_names("word_romanize_tokens_overlay", lambda c, s: rm.word_romanize_tokens(_tokens(c), _dictionary(s, "_bench")), _tokens_sql(_OVER_FIRST, _OVER_WORDS))
_on_names(
    "token_romanize_all_readings", lambda c, s: rm.romanize_tokens_all(_tokens(c), _dictionary(s)),
    _join(_PAIR.format(f"coalesce({_map(wl.WORDS)}[t], array_to_string(list_transform(regexp_extract_all(t, '.'), lambda u: {_one_char('u', _BENCH)}), ' '))")),
)

_on_parts("tokenize", lambda c, s: _bar(tx.pinyin_tokenize(c, SYLLABLES)), _join(_syllables("name", False), "/"))
_on_parts("tokenize_zhchsh", lambda c, s: _bar(tx.pinyin_tokenize(c, SYLLABLES, True)), _join(_syllables("name", True), "/"))
for _full in (False, True):
    for _prefix in (False, True):
        _name = "search_pattern_" + ("full" if _full else "open") + ("_prefix" if _prefix else "")
        _on_parts(_name, lambda c, s, f=_full, p=_prefix: pt.pinyin_search(c, f, p), _search("name", _full, _prefix))

_on_typed("isearch_pattern", lambda c, s: pt.pinyin_isearch(c, STANDARD), _isearch("query", False, False))
_on_typed("isearch_pattern_zhchsh", lambda c, s: pt.pinyin_isearch(c, STANDARD, False, True), _isearch("query", True, False))
_on_typed("isearch_prefix", lambda c, s: pt.pinyin_isearch(c, STANDARD, True), _isearch("query", False, True))
_on_typed("regex_phrase_patterns", lambda c, s: F.array_join(pt.regex_phrase_patterns(c, SYLLABLES), " "), f"coalesce({_join(_patterns('query'))}, '')")
_on_typed("regex_phrase_patterns_generated", lambda c, s: F.array_join(pt.regex_phrase_patterns(c, SYLLABLES, True), " "), f"coalesce({_join(_patterns('query', True))}, '')")
_on_typed("regex_phrase_query", lambda c, s: pt.render_query(pt.regex_phrase(c, SYLLABLES)), _rendered("query"))
_on_typed("regex_phrase_query_slope", lambda c, s: pt.render_query(pt.regex_phrase(c, SYLLABLES, 2, 4096)), _rendered("query", 2, 4096))
_on_typed("phrase_token_count", lambda c, s: F.coalesce(pt.phrase_token_count(c, SYLLABLES), F.lit(-1)).cast("long"), f"coalesce(nullif(len({_patterns('query')}), 0), -1)")


def _query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return register


@_query("split_tokens", f"SELECT doc_id AS id, unnest(toks) AS token, generate_subscripts(toks, 1)::BIGINT AS ord FROM (SELECT doc_id, {_SPLIT.format('text')} AS toks FROM documents)")
def split_tokens(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.posexplode(tx.split_tokens(F.col("text"))).alias("pos", "token")).select("id", "token", (F.col("pos") + 1).cast("long").alias("ord"))


@_query("char_romanize_documents", f"SELECT doc_id AS id, {_char('text', _FIRST)} AS out FROM documents")
def char_romanize_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), rm.char_romanize(F.col("text"), _dictionary(spark)).alias("out"))


@_query(
    "piped_regex_search",
    f"WITH {_NAMES}, q AS (SELECT unnest({_list(wl.QUERIES)}) AS query) SELECT query, count(*) AS hits FROM names, q WHERE regexp_matches({_characters('name')}, {_isearch('query', True, False)}) GROUP BY query",
)
def piped_regex_search(spark, sf_dir):
    d = _dictionary(spark)
    piped = _names(spark, sf_dir).select(rm.characters2romanize(F.col("name"), d).alias("piped")).groupBy("piped").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([(q,) for q in wl.QUERIES], "query string").withColumn("pattern", pt.pinyin_isearch(F.col("query"), STANDARD, False, True))
    return piped.join(F.broadcast(asked), match.piped_matches(F.col("piped"), F.col("pattern"))).groupBy("query").agg(F.sum("n").cast("long").alias("hits"))


def _romanized(spark, sf_dir) -> DataFrame:
    return _names(spark, sf_dir).select("id", "name", rm.word_romanize(F.col("name"), _dictionary(spark)).alias("pinyin"))


_ROMANIZED = f"docs AS (SELECT id, name, {_word('name', _FIRST, wl.WORDS)} AS pinyin FROM names)"
_HITS = f"asked AS (SELECT query, len({_patterns('query')}) > 0 AS asks, {_phrase_regex('query')} AS re FROM (SELECT unnest({_list(wl.QUERIES)}) AS query))"


@_query("phrase_search", f"WITH {_NAMES}, {_ROMANIZED}, {_HITS} SELECT query, id, pinyin FROM docs, asked WHERE asks AND regexp_matches(pinyin, re)")
def phrase_search(spark, sf_dir):
    asked = spark.createDataFrame([(q,) for q in wl.QUERIES], "query string").withColumn("q", pt.regex_phrase(F.col("query"), SYLLABLES))
    return _romanized(spark, sf_dir).join(F.broadcast(asked), match.matches(F.col("pinyin"), F.col("q"))).select("query", "id", "pinyin")


_GAPS = "SELECT id, pinyin FROM docs WHERE regexp_matches(pinyin, '(?:^| )w[^ ]* (?:[^ ]+ )?y[^ ]*(?:$| )')"


@_query("phrase_search_slope", f"WITH {_NAMES}, {_ROMANIZED} {_GAPS}")
def phrase_search_slope(spark, sf_dir):
    query = pt.regex_phrase(F.lit("w y"), SYLLABLES, 1)
    return _romanized(spark, sf_dir).where(match.matches(F.col("pinyin"), query)).select("id", "pinyin")


@_query("postings_search", f"WITH {_NAMES}, {_ROMANIZED}, {_HITS} SELECT query, id FROM docs, asked WHERE asks AND regexp_matches(pinyin, re)")
def postings_search(spark, sf_dir):
    index = match.postings(_romanized(spark, sf_dir))
    asked = spark.createDataFrame([(q,) for q in wl.QUERIES], "query_id string").withColumn("query", pt.regex_phrase(F.col("query_id"), SYLLABLES))
    return match.search_postings(index, asked).withColumnRenamed("query_id", "query")


@_query("substring_search", f"WITH {_NAMES}, {_ROMANIZED} SELECT id, pinyin FROM docs WHERE contains(pinyin, 'ang x')")
def substring_search(spark, sf_dir):
    docs = _romanized(spark, sf_dir).select("id", "pinyin")
    return match.search_substring(docs, match.trigram_index(docs), "ang x")


_COUNTS = f"counts AS (SELECT query, count(*) AS hits FROM docs, asked WHERE asks AND regexp_matches(pinyin, re) GROUP BY query)"


@_query("search_count_per_query", f"WITH {_NAMES}, {_ROMANIZED}, {_HITS}, {_COUNTS}, {_TYPED} SELECT id, coalesce(hits, 0) AS hits FROM typed LEFT JOIN counts USING (query)")
def search_count_per_query(spark, sf_dir):
    asked = _typed(spark, sf_dir).select("id", pt.regex_phrase(F.col("query"), SYLLABLES).alias("query"))
    return match.search_counts(_romanized(spark, sf_dir), asked)


@_query("search_checksum", f"WITH {_NAMES}, {_ROMANIZED}, {_HITS}, {_COUNTS}, {_TYPED} SELECT sum(coalesce(hits, 0))::BIGINT AS checksum FROM typed LEFT JOIN counts USING (query)")
def search_checksum(spark, sf_dir):
    return search_count_per_query(spark, sf_dir).agg(F.sum("hits").cast("long").alias("checksum"))


@_query("token_checksum", f"WITH {_TYPED} SELECT sum(len({_patterns('query')}) + length(coalesce(array_to_string({_patterns('query')}, ''), '')))::BIGINT AS checksum FROM typed")
def token_checksum(spark, sf_dir):
    return _typed(spark, sf_dir).agg(wl.token_checksum(pt.regex_phrase_patterns(F.col("query"), SYLLABLES)).alias("checksum"))


# Dictionary tables of the data's size: keys and readings derive from customers, edits from suppliers and parts.
_BASE_SQL = "base AS (SELECT 'k' || c_custkey AS character, '|a' || c_custkey % 7 || '|' AS pinyin FROM customer)"
_EDITS_SQL = "edits AS (SELECT 'k' || s_suppkey * 13 AS character, '|b' || s_suppkey % 5 || '|' AS pinyin FROM supplier)"


def _base(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), k).alias("character"), F.concat(F.lit("|a"), k % 7, F.lit("|")).alias("pinyin"))


def _edits(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), k * 13).alias("character"), F.concat(F.lit("|b"), k % 5, F.lit("|")).alias("pinyin"))


_ABSENT = "SELECT x.character, x.pinyin FROM {0} x WHERE NOT EXISTS (SELECT 1 FROM {1} y WHERE y.character = x.character)"


@_query("overlay_merge", f"WITH {_BASE_SQL}, {_EDITS_SQL} SELECT coalesce(o.character, b.character) AS character, coalesce(o.pinyin, b.pinyin) AS pinyin FROM base b FULL JOIN edits o ON b.character = o.character")
def overlay_merge(spark, sf_dir):
    return tables.overlay_merge(_base(spark, sf_dir), _edits(spark, sf_dir), "character")


@_query("dictionary_upsert", f"WITH {_BASE_SQL}, {_EDITS_SQL} SELECT * FROM edits UNION ALL {_ABSENT.format('base', 'edits')}")
def dictionary_upsert(spark, sf_dir):
    return tables.upsert(_base(spark, sf_dir), _edits(spark, sf_dir), "character")


@_query("insert_if_absent", f"WITH {_BASE_SQL}, {_EDITS_SQL} SELECT * FROM base UNION ALL {_ABSENT.format('edits', 'base')}")
def insert_if_absent(spark, sf_dir):
    return tables.insert_if_absent(_base(spark, sf_dir), _edits(spark, sf_dir), "character")


@_query(
    "dictionary_edits",
    f"""WITH {_BASE_SQL}, {_EDITS_SQL}, u AS (SELECT * FROM edits UNION ALL {_ABSENT.format('base', 'edits')}),
d AS (SELECT * FROM u WHERE pinyin <> '|a3|')
SELECT character, pinyin, 4 AS version FROM d UNION ALL SELECT ' ', ' ', 4 UNION ALL SELECT 'kx', '|new|', 4""",
)
def dictionary_edits(spark, sf_dir):
    """A registry's mapping and version after an upsert, a delete and an insert of a new and an old key."""
    registry = Registry(spark, _base(spark, sf_dir), spark.createDataFrame([], "character string, category int"))
    registry.upsert("mapping", _edits(spark, sf_dir))
    registry.delete("mapping", "pinyin = '|a3|'")
    registry.insert_if_absent("mapping", spark.createDataFrame([("kx", "|new|"), (" ", "|never|")], MAPPING_SCHEMA))
    return registry.tables["mapping"].withColumn("version", F.lit(registry.version))


@_query(
    "dictionary_files",
    f"WITH {_BASE_SQL}, {_EDITS_SQL}, rows AS (SELECT *, 0 AS place FROM base UNION ALL SELECT character, pinyin || '\"' || ',x', 1 FROM edits) SELECT character, arg_max(pinyin, place) AS pinyin FROM rows GROUP BY character",
)
def dictionary_files(spark, sf_dir):
    """A table written as CSV in two files and read again: of a repeated key the later file's row stays."""
    at = f"{(spark.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints').rstrip('/')}/pinloom-files-{uuid.uuid4().hex}"
    edits = _edits(spark, sf_dir).withColumn("pinyin", F.concat("pinyin", F.lit('",x')))
    files.write_table(_base(spark, sf_dir).coalesce(1), f"{at}/a")
    files.write_table(edits.coalesce(1), f"{at}/b")
    return files.read_table(spark, f"{at}/*/*.csv", "mapping")


_STALE = {"郑": "|zhengy|"}


@_query(
    "overlay_cache",
    f"""WITH {_NAMES} SELECT id, {_char('name', _OVER_FIRST)} AS merged, {_char('name', _OVER_FIRST)} AS stale, {_char('name', {k: first_readings(v) for k, v in (_BENCH | _STALE).items()})} AS cleared,
{_char('name', _FIRST)} AS unknown FROM names""",
)
def overlay_cache(spark, sf_dir):
    """Names by an overlay, by the merge that stays after the overlay's edit, after its cache is cleared, and by an unknown overlay."""
    registry = wl.bench_registry(spark)
    before = registry.dictionary("bench")
    registry.set_overlay("__Bench", "mapping", spark.createDataFrame(list(_STALE.items()), MAPPING_SCHEMA))
    stale = registry.dictionary("_bench")
    registry.clear_suffix_cache("bench")
    by = {"merged": before, "stale": stale, "cleared": registry.dictionary("_bench"), "unknown": registry.dictionary("_nosuch")}
    return _names(spark, sf_dir).select("id", *(rm.char_romanize(F.col("name"), d).alias(k) for k, d in by.items()))


_CATEGORIES = f"MAP {{{', '.join(f'{_quoted(t)}: {k}' for t, k in STANDARD.items())}}}"


@_query("token_category_counts", f"WITH {_PARTS}, t AS (SELECT unnest({_syllables('name', True)}) AS token FROM parts) SELECT {_CATEGORIES}[token] AS category, count(*) AS tokens FROM t GROUP BY ALL")
def token_category_counts(spark, sf_dir):
    """Tokens of part names by their category in the standard dictionary, null for single letters that it lacks."""
    known = spark.createDataFrame(list(STANDARD.items()), "token string, category int")
    found = _parts(spark, sf_dir).select(F.explode(tx.pinyin_tokenize(F.col("name"), SYLLABLES, True)).alias("token"))
    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(known), "token", "left").groupBy("category").agg(F.sum("n").cast("long").alias("tokens"))


# Source lines of the preparation: a code point, two readings with tone marks from a part's name, and lines of other forms.
_MARKS = ("aeou", "āéǒǜ")
_LINES_SQL = f"""l AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 50 = 0 THEN '# ' || p_name WHEN p_partkey % 50 = 1 THEN 'U+4E00: 1,2 # none'
ELSE 'U+' || printf('%X', 19968 + p_partkey % 1500) || ': ' || translate(replace(p_name, ' ', ','), {_quoted(_MARKS[0])}, {_quoted(_MARKS[1])}) || ',' || split_part(p_name, ' ', 1) || '  # note' END AS line FROM part),
p AS (SELECT ord, chr(('0x' || regexp_extract(line, '^U\\+([0-9A-Fa-f]+):', 1))::INTEGER) AS character, string_split(regexp_extract(line, '^U\\+[0-9A-Fa-f]+:\\s*([^#]*)', 1), ',') AS prons FROM l WHERE regexp_matches(line, '^U\\+[0-9A-Fa-f]+:')),
x AS (SELECT ord, character, list_transform(prons, lambda t: regexp_replace(strip_accents(lower(trim(t))), '[^a-z]', '', 'g')) AS r FROM p),
z AS (SELECT ord, character, list_filter(r, lambda t, i: t <> '' AND list_position(r, t) = i) AS r FROM x),
y AS (SELECT character, r, row_number() OVER (PARTITION BY character ORDER BY ord DESC) AS k FROM z WHERE len(r) > 0)"""


def _lines(spark, sf_dir) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    marked = F.translate(F.replace(name, F.lit(" "), F.lit(",")), *_MARKS)
    line = F.concat(F.lit("U+"), F.hex(k % 1500 + 19968), F.lit(": "), marked, F.lit(","), F.split_part(name, F.lit(" "), F.lit(1)), F.lit("  # note"))
    value = F.when(k % 50 == 0, F.concat(F.lit("# "), name)).when(k % 50 == 1, "U+4E00: 1,2 # none").otherwise(line)
    return _table(spark, sf_dir, "part").select(k.cast("long").alias("ord"), value.alias("value"))


@_query("prep_char_map", f"WITH {_LINES_SQL} SELECT character, '|' || array_to_string(r, '|') || '|' AS pinyin FROM y WHERE k = 1")
def prep_char_map(spark, sf_dir):
    return prep.mapping_table(prep.char_map(_lines(spark, sf_dir)))


_INITIALS = [t for t, k in STANDARD.items() if k == 2]


@_query(
    "prep_tokens",
    f"""WITH {_LINES_SQL}, t AS (SELECT DISTINCT unnest(r) AS character FROM y WHERE k = 1)
SELECT character, CASE WHEN character IN ('a', 'e', 'o', 'i', 'u') THEN 3 ELSE 1 END AS category FROM t WHERE NOT list_contains({_list(_INITIALS)}, character)
UNION ALL SELECT unnest({_list(_INITIALS)}), 2""",
)
def prep_tokens(spark, sf_dir):
    return prep.token_rows(prep.char_map(_lines(spark, sf_dir))).select("character", "category")


_PREP_SYLLABLES = [*SYLLABLES, "a", "e", "o"]
_BY_LENGTH = "|".join(sorted(set(_PREP_SYLLABLES), key=lambda t: (-len(t), t)))


@_query(
    "prep_words",
    f"""WITH w AS (SELECT p_partkey AS ord, ' ' || split_part(p_name, ' ', 1) || p_partkey % 40 || ' ' AS word, CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '')) WHEN 1 THEN replace(p_name, ' ', '''') WHEN 2 THEN replace(p_name, ' ', '’') || 'u:' ELSE p_name || '12ab' END AS joined FROM part),
p AS (SELECT ord, trim(word) AS word, regexp_extract_all(replace(replace(replace(lower(trim(joined)), 'u:', 'v'), 'ü', 'v'), '’', ''''), '({_BY_LENGTH}|[^''{_WS}]\\p{{L}}*)') AS parts FROM w),
f AS (SELECT word, parts, row_number() OVER (PARTITION BY word ORDER BY ord) AS k FROM p WHERE len(parts) > 0)
SELECT word, array_to_string(parts, ' ') AS pinyin, len(list_filter(parts, lambda t: NOT list_contains({_list(_PREP_SYLLABLES)}, t))) > 0 AS fallback FROM f WHERE k = 1""",
)
def prep_words(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    swap = lambda s: F.replace(name, F.lit(" "), F.lit(s))
    joined = F.when(k % 4 == 0, F.upper(swap(""))).when(k % 4 == 1, swap("'")).when(k % 4 == 2, F.concat(swap("’"), F.lit("u:"))).otherwise(F.concat(name, F.lit("12ab")))
    word = F.concat(F.lit(" "), F.split_part(name, F.lit(" "), F.lit(1)), (k % 40).cast("string"), F.lit(" "))
    return prep.word_rows(_table(spark, sf_dir, "part").select(k.cast("long").alias("ord"), word.alias("word"), joined.alias("joined")), _PREP_SYLLABLES)
