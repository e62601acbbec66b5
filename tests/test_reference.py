"""Golden cases, cache contract, checksums, plans and properties of the romanization operators."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pinloom.dictionary import Registry, canonical_suffix, first_readings, standard_tokens
from pinloom.functions import patterns as pt
from pinloom.functions import sql
from pinloom.functions import text as tx
from pinloom.operators import match
from pinloom.operators import romanize as rm
from pinloom.plans import workload as wl
from pinloom.sources import files, prep
from pinloom.streaming.romanize import romanize_stream, with_pinyin

MAPPING = {"我": "|wo|", "们": "|men|", "重": "|tong|zhong|chong|", "起": "|qi|", "郑": "|zheng|", "爽": "|shuang|"}
TOKENS = dict.fromkeys(("wang", "chong", "yang", "xi", "an"), 1) | dict.fromkeys(("zh", "ch", "sh", "w", "c", "h", "y"), 2)
WORDS = {"郑爽": "|zheng| |shuang|"}


@pytest.fixture
def registry(spark):
    return Registry.of(spark, MAPPING, TOKENS, WORDS)


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()[0]


GOLDEN = [
    (rm.romanize2text, "我们", "我们"), (rm.romanize2text, "我ABC们123", "我ABC们123"), (rm.romanize2text, "我!!!们", "我 们"), (rm.romanize2text, "!我", " 我"),
    (rm.romanize2text, "", ""), (rm.romanize2array, "我ABC们123", ["我", "ABC", "们", "123"]), (rm.romanize2array, "", [""]),
    (rm.characters2romanize, "我ABC们123", "|wo| |ABC| |men| |123|"), (rm.characters2romanize, "重起", "|tong|zhong|chong| |qi|"),
    (rm.characters2romanize, "郑爽", "|zheng| |shuang|"), (rm.characters2romanize, "", "||"), (rm.characters2romanize, "我 们", "|wo|   |men|"),
    (rm.char_romanize, "我ABC们123", "wo abc men 123"), (rm.char_romanize, "重起", "tong qi"), (rm.char_romanize, "!我!", "wo"), (rm.char_romanize, "", ""),
    (rm.char_romanize, "!!!", ""), (rm.char_romanize, "Étion", "tion"), (rm.char_romanize, "a-b　我", "a b wo"),
    (rm.word_romanize, "郑爽ABC", "zheng shuang abc"), (rm.word_romanize, "郑-爽", "zheng shuang"), (rm.word_romanize, "", ""), (rm.word_romanize, "!!!", ""),
]


@pytest.mark.parametrize(("f", "text", "want"), GOLDEN)
def test_golden(spark, registry, f, text, want):
    assert one(spark, lambda c: f(c, registry.dictionary()), text) == want
    assert one(spark, lambda c: f(c, registry.dictionary()), None) is None


def test_tokens(spark, registry):
    d = registry.dictionary()
    words = lambda v: one(spark, lambda c: rm.word_romanize_tokens(c, d), v, "array<string>")
    assert words(["郑爽", "ABC"]) == "zheng shuang abc"
    assert words(["!!!", "a-B"]) == "! ! ! a-B"
    assert words([" 郑", "", "爽 "]) == "zheng shuang"
    assert words([]) == ""
    assert words(None) is None
    with pytest.raises(Exception, match="a token is null"):
        words(["a", None])
    every = lambda v: one(spark, lambda c: rm.romanize_tokens_all(c, d), v, "array<string>")
    assert every(["ABC"]) == "A B C"
    assert every(["郑爽", "重!"]) == "|zheng| |shuang| |tong|zhong|chong| !"
    assert every([]) is None


def test_one_character_word_shadows(spark):
    d = Registry.of(spark, MAPPING, TOKENS, {"郑": "|a|", "郑爽": "|b| |c|"}).dictionary()
    assert one(spark, lambda c: rm.word_romanize(c, d), "郑爽") == "a shuang"


def test_search_patterns(spark, registry):
    tokens = registry.dictionary().tokens
    run = lambda f, v: one(spark, f, v)
    assert run(lambda c: pt.pinyin_search(c), "zh sh") == r"\S*\|zh[^\|]*\|\S* \S*\|sh[^\|]*\|\S*"
    assert run(lambda c: pt.pinyin_search(c, True, True), "zhang sheng") == r"^\S*\|zhang\|\S* \S*\|sheng\|\S*"
    assert run(lambda c: tx.pinyin_tokenize(c, registry.dictionary().syllables), "wangchongyang") == ["wang", "chong", "yang"]
    opened = lambda ts: " ".join(rf"\S*\|{t}[^\|]*\|\S*" for t in ts)
    assert run(lambda c: pt.pinyin_isearch(c, tokens), "wchy") == opened("wchy")
    assert run(lambda c: pt.pinyin_isearch(c, tokens, False, True), "wchy") == opened(["w", "ch", "y"])
    assert run(lambda c: pt.pinyin_isearch(c, tokens), "123") is None
    assert run(lambda c: pt.pinyin_isearch(c, standard_tokens()), "u") == r"\S*\|u\|\S*"
    assert one(spark, lambda c: match.piped_matches(c, F.lit(opened(["zh", "s"]))), "|zhang| |shi| |yun|")


def test_phrases(spark):
    syllables = [t for t, k in standard_tokens().items() if k == 1]
    assert len(syllables) == 418
    assert len({*syllables, "zh", "ch", "sh"}) == 421
    run = lambda v, **k: one(spark, lambda c: pt.regex_phrase_patterns(c, syllables, **k), v)
    assert run("lun") == ["lun.*"]
    assert run("lunlun") == ["lun.*", "lun.*"]
    assert run("zhengshuang") == ["zheng.*", "shuang.*"]
    assert run("whh") == ["w.*", "h.*", "h.*"]
    assert run("lun", generated_pinyin=True) == [r".*\|lun.*"]
    assert [run(x) for x in ("中文", "", "   ")] == [[], [], []]
    assert run(None) is None
    assert run("a\x0bb") == ["a.*", "b.*"]
    assert run("a\x0bb", strict=True) == []
    assert run("lun", strict=True, generated_pinyin=None) is None
    rendered = lambda v, *a: one(spark, lambda c: pt.render_query(pt.regex_phrase(c, syllables, *a)), v)
    assert rendered("") == "empty()"
    assert rendered("lun", 2, 9) == "regex('lun.*')"
    assert rendered("lunlun") == "regex_phrase(ARRAY['lun.*', 'lun.*'])"
    assert rendered("lunlun", 2) == "regex_phrase(ARRAY['lun.*', 'lun.*'], 2)"
    assert rendered("lunlun", None, 9) == "regex_phrase(ARRAY['lun.*', 'lun.*'], 0, 9)"
    assert rendered(None) is None


def test_matching(spark):
    syllables = [t for t, k in standard_tokens().items() if k == 1]
    hit = lambda text, q, slope=None: one(spark, lambda c: match.matches(c, pt.regex_phrase(F.lit(q), syllables, slope)), text)
    assert hit("zheng shuang", "zhengshuang") and hit("a zhengx shuangx b", "zheng shuang")
    assert not hit("zheng x shuang", "zheng shuang") and not hit("azheng shuang", "zheng shuang")
    assert hit("zheng shuang", "") is False and hit(None, "zheng shuang") is None
    assert hit("wang a b yang", "wy", 2) and not hit("wang a b yang", "wy", 1)
    assert hit("w w a y", "wy", 1) and not hit("y w", "wy", 5) and not hit("", "wy", 1)
    assert hit("wang a chong b yang", "wchy", 2) and not hit("wang a chong b yang", "wchy", 1)


def test_suffixes():
    assert canonical_suffix("") is None and canonical_suffix(" ") is None
    assert canonical_suffix("_SUFFIX1") == canonical_suffix("suffix1") == canonical_suffix("__suffix1") == "_suffix1"
    for bad in ("___", "a-b"):
        with pytest.raises(ValueError):
            canonical_suffix(bad)


def test_overlays_and_cache(spark, registry):
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} string, pinyin string")
    registry.set_overlay("_suffix1", "mapping", table([("郑", "|zhengx|")], "character"))
    registry.set_overlay("_suffix1", "words", table([("郑爽", "|zhengx| |shuangx|")], "word"))
    char = lambda s: one(spark, lambda c: rm.char_romanize(c, registry.dictionary(s)), "郑爽ABC")
    word = lambda s: one(spark, lambda c: rm.word_romanize(c, registry.dictionary(s)), "郑爽ABC")
    assert char("_suffix1") == "zhengx shuang abc" and word("_suffix1") == "zhengx shuangx abc"
    assert char(None) == char("_nosuch") == "zheng shuang abc" and word("_nosuch") == word(None)
    registry.set_overlay("suffix1", "mapping", table([("郑", "|zhengy|")], "character"))
    assert char("_suffix1") == "zhengx shuang abc"
    assert registry.clear_suffix_cache("_suffix1") is True and registry.clear_suffix_cache("_suffix1") is False
    assert registry.clear_suffix_cache("") is False
    assert char("_suffix1") == "zhengy shuang abc"
    assert registry.clear_suffix_cache() == 1
    char("_suffix1")
    registry.set_overlay("suffix1", "mapping", table([("郑", "|zhengz|")], "character"))
    version = registry.version
    registry.upsert("mapping", table([("我", "|wo2|")], "character"))
    assert registry.version == version + 1 and char("_suffix1") == "zhengz shuang abc"
    assert one(spark, lambda c: rm.char_romanize(c, registry.dictionary()), "我") == "wo2"
    registry.insert_if_absent("mapping", table([("我", "|wo3|"), ("新", "|xin|")], "character"))
    assert registry.dictionary().mapping["我"] == "|wo2|" and registry.dictionary().mapping["新"] == "|xin|"
    registry.delete("mapping", "character = '新'")
    assert "新" not in registry.dictionary().mapping and registry.dictionary().mapping[" "] == " "
    registry.truncate("words")
    assert registry.dictionary().words == {} and word(None) == "zheng shuang abc"
    with pytest.raises(ValueError):
        registry.upsert("token", spark.createDataFrame([("x", 9)], "character string, category int"))


@pytest.mark.parametrize(("n", "want"), [(2000, 1337644), (20000, 13336444)])
def test_search_checksums(spark, n, want):
    d = wl.bench_registry(spark).dictionary()
    docs = wl.names(spark, n).select("id", rm.word_romanize(F.col("name"), d).alias("pinyin"))
    asked = wl.typed_queries(spark, 20000).select("id", pt.regex_phrase(F.col("query"), d.syllables).alias("query"))
    assert match.search_counts(docs, asked).agg(F.sum("hits")).first()[0] == want


def test_token_checksum(spark):
    syllables = [t for t, k in standard_tokens().items() if k == 1]
    rows = spark.range(20000).select(pt.regex_phrase_patterns(wl.query_of(F.col("id")), syllables).alias("p"))
    assert rows.agg(wl.token_checksum(F.col("p"))).first()[0] == 219996


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, registry):
    """Romanizers add no shuffle, no join and no dictionary to a plan; searches join by equality."""
    d = registry.dictionary()
    rows = spark.range(10).select(F.col("id").cast("string").alias("v"))
    plan = plan_of(rows.select(rm.word_romanize(F.col("v"), d), rm.char_romanize(F.col("v"), d)))
    assert not any(x in plan for x in ("Exchange", "Join", "郑")) and "ArrowEvalPython" in plan
    docs = rows.select(F.col("v").alias("id"), F.lit("zheng shuang").alias("pinyin"))
    asked = rows.select(F.col("v").alias("id"), F.col("v").alias("query_id"), pt.regex_phrase(F.col("v"), d.syllables).alias("query"))
    for found in (match.search_counts(docs, asked), match.search_postings(match.postings(docs), asked)):
        plan = plan_of(found)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_searches_against_all_pairs(spark):
    """Counts and postings of starts, of other patterns and of empty queries, against each text by itself."""
    import re

    rng = random.Random(4)
    terms = ["zheng", "zhong", "shuang", "wang", "w", "a.b", "zhengshuangwang", "zhengshuangx", "xian"]
    texts = [" ".join(rng.choice(terms) for _ in range(rng.randrange(0, 5))) for _ in range(60)] + [None, "", " ", "zheng  shuang"]
    patterns = [[], ["zheng.*"], ["zh.*", "sh.*"], ["w.*", "w.*"], ["zhengshuangw.*"], ["zhengshuang.*", "x.*"], [".*n.*"], ["z.*", ".*g"], ["none.*"]]
    kind = lambda p: "empty" if not p else "regex" if len(p) == 1 else "regex_phrase"
    docs = spark.createDataFrame(enumerate(texts), "id long, pinyin string")
    asked = spark.createDataFrame([(i % 20, (kind(p), p, None, None)) for i, p in enumerate(patterns * 2)], f"id long, query {pt.QUERY_TYPE}").withColumn("query_id", F.col("id"))

    def hits(p, t):
        parts = [x for x in (t or "").split(" ") if x]
        at = lambda i: len(parts) >= i + len(p) and all(re.fullmatch(x.replace(".*", "[^ ]*"), y) for x, y in zip(p, parts[i:]))
        return bool(p) and any(map(at, range(len(parts))))

    got = match.search_counts(docs.where("id < 60"), asked).collect()
    assert sorted((r.id, r.hits) for r in got) == sorted((i, sum(hits(p, t) for t in texts[:60])) for i, p in enumerate(patterns * 2))
    found = match.search_postings(match.postings(docs), asked).collect()
    assert {(r.query_id, r.id) for r in found} == {(i, k) for i, p in enumerate(patterns * 2) for k, t in enumerate(texts) if hits(p, t)}


def test_syllable_tree():
    import re

    syllables = [t for t, k in standard_tokens().items() if k == 1]
    rng = random.Random(1)
    for tokens in (syllables, ["a"], ["ab", "a", "abcd"], TOKENS):
        for z in (False, True):
            plain, tree = (re.compile(f(tokens, z)) for f in (tx.syllable_pattern, tx.syllable_tree))
            for _ in range(300):
                text = "".join(rng.choice("zhcsangioueyw x") for _ in range(rng.randrange(0, 20)))
                assert tree.findall(text) == plain.findall(text)


def model(text, mapping, words, longest=None):
    """Word romanization in plain Python."""
    import re

    toks = [t.lower() if t[0].isascii() and t[0].isalnum() else t for t in re.findall(r"[0-9A-Za-z]+|[^0-9A-Za-z\s]", text) if (t[0].isascii() and t[0].isalnum()) or t in mapping]
    longest, out, i = max(map(len, words), default=0) if longest is None else longest, [], 0
    han = lambda t: len(t) == 1 and not (t.isascii() and t.isalnum())
    while i < len(toks):
        best = None
        if toks[i] in words:
            best = 1, words[toks[i]]
        else:
            for n in range(2, longest + 1):
                part = toks[i : i + n]
                if len(part) == n and all(map(han, part)) and "".join(part) in words:
                    best = n, words["".join(part)]
        n, value = best or (1, mapping.get(toks[i], toks[i]))
        out.append(first_readings(value))
        i += n
    return " ".join(out)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("我们重起郑爽张aB1 -!　", max_size=14), min_size=1, max_size=30), st.integers(0, 10**6))
def test_word_romanize_against_model(spark, texts, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("我们重起郑爽") for _ in range(rng.randrange(1, 4))): f"|x{i}| |y|" for i in range(4)} | {"ab": "|zz|"}
    mapping = MAPPING | {" ": " "}
    d = Registry.of(spark, mapping, TOKENS, words).dictionary()
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "v string").coalesce(1).select(rm.word_romanize(F.col("v"), d)).collect()]
    assert got == [model(t, mapping, words) for t in texts]


def test_dictionary_of_real_size(spark):
    """20,902 characters and 100,000 words, by columns and by SQL, against the model."""
    mapping, words = wl.large_dictionary()
    registry = Registry.of(spark, mapping, TOKENS, words)
    d = registry.dictionary()
    assert len(d.mapping) == 20_903 and len(d.words) > 90_000
    rows = wl.large_names(spark, 2000).select("name", rm.word_romanize(F.col("name"), d).alias("word"), rm.char_romanize(F.col("name"), d).alias("char")).collect()
    longest = max(map(len, words))
    for r in rows:
        assert r.word == model(r["name"], mapping, words, longest)
        assert r["char"] == model(r["name"], mapping, {}, 0)
    assert sum(r.word != r["char"] for r in rows) > 1000
    names = sql.register(spark, registry, prefix="large_")
    assert "large_pinyin_word_romanize" in names
    wl.large_names(spark, 100).createOrReplaceTempView("large_names")
    assert [r[0] for r in spark.sql("SELECT large_pinyin_word_romanize(name) FROM large_names ORDER BY id").collect()] == [r.word for r in rows[:100]]


def test_sql_functions(spark, registry):
    names = sql.register(spark, registry)
    assert len(names) == len(set(names)) == 13
    rows = spark.createDataFrame([("郑-爽ABC!",), ("我重 x",), (None,), ("",)], "v string")
    rows.createOrReplaceTempView("sql_rows")
    d = registry.dictionary()
    for name, f in (("pinyin_char_romanize", rm.char_romanize), ("pinyin_word_romanize", rm.word_romanize), ("romanize2text", rm.romanize2text), ("romanize2array", rm.romanize2array), ("characters2romanize", rm.characters2romanize)):
        assert spark.sql(f"SELECT {name}(v) FROM sql_rows").collect() == rows.select(f(F.col("v"), d)).collect(), name
    get = lambda e: spark.sql(f"SELECT {e}").first()[0]
    assert get("pinyin_word_romanize_tokens(array('郑爽', 'ABC'))") == "zheng shuang abc"
    assert get("icu_romanize_tokens(array('郑爽', 'AB'))") == "|zheng| |shuang| A B"
    assert get("pinyin_tokenize('wchy', true)") == ["w", "ch", "y"]
    assert get("pinyin_search('zh sh')") == r"\S*\|zh[^\|]*\|\S* \S*\|sh[^\|]*\|\S*"
    assert get("pinyin_search('zhang', true, true)") == r"^\S*\|zhang\|\S*"
    assert get("pinyin_isearch('w', anchored => true)") == r"^\S*\|w[^\|]*\|\S*"
    assert get("pinyin_regex_phrase_patterns('xi an')") == ["xi.*", "an.*"]
    assert [tuple(r) for r in spark.sql("SELECT t.* FROM sql_rows, LATERAL pinyin_tokens_of(v) t WHERE v = '我重 x' ORDER BY ord").collect()] == [("我", 1), ("重", 2), (" ", 3), ("x", 4)]


def test_files_round_trip(spark, registry, tmp_path):
    for kind in ("mapping", "token", "words"):
        files.write_table(registry.tables[kind].coalesce(1), str(tmp_path / kind))
    again = files.load_registry(spark, *(str(tmp_path / k) for k in ("mapping", "token", "words"))).dictionary()
    assert (again.mapping, again.tokens, again.words) == (registry.dictionary().mapping, registry.dictionary().tokens, registry.dictionary().words)
    (tmp_path / "twice.csv").write_text('字,|a|\n字,|b|\n"x,y",|c|\n')
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "twice.csv"), "mapping").collect())) == [("x,y", "|c|"), ("字", "|b|")]
    assert files.load_registry(spark, str(tmp_path / "mapping"), str(tmp_path / "token")).dictionary().words == {}


def test_seed_from_files(spark, registry, tmp_path):
    """CSV files, else all as plain lines with a warning."""
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    good, words = write("good.csv", '字,|zi|\n"a,b",|c|\n字,|zi2|\n'), write("words.csv", "字字,|zi| |zi|\n")
    assert files.seed(registry, good, words) is True
    d = registry.dictionary()
    assert d.mapping == {"字": "|zi2|", "a,b": "|c|", " ": " "} and d.words == {"字字": "|zi| |zi|"} and d.tokens == standard_tokens()
    plain, tokens = write("plain.csv", '字,|zi|,x\r\n\n"q,|c|\n字,|last|\n'), write("tokens.csv", "zi,1\nz,2\n")
    with pytest.warns(UserWarning, match="plain lines"):
        files.seed(registry, plain, words, tokens)
    d = registry.dictionary()
    assert d.mapping == {"字": "|last|", '"q': "|c|", " ": " "} and d.tokens == {"zi": 1, "z": 2}
    with pytest.raises(Exception, match="no second column"):
        files.read_plain_table(spark, write("bad.csv", "no comma\n"), "mapping").collect()


def test_registry_persists(spark, registry, tmp_path):
    registry.upsert("mapping", spark.createDataFrame([("新", "|xin|")], "character string, pinyin string"))
    registry.set_overlay("x", "mapping", spark.createDataFrame([("新", "|sin|")], "character string, pinyin string"))
    registry.save(str(tmp_path / "store"))
    again = Registry.load(spark, str(tmp_path / "store"))
    assert again.version == registry.version == 2
    for suffix in (None, "_x"):
        assert again.dictionary(suffix) == registry.dictionary(suffix)


def test_max_expansions(spark):
    docs = spark.createDataFrame([(1, "zhong zheng"), (2, "zhang")], "id long, pinyin string")
    ask = lambda most: spark.createDataFrame([("q", ("regex", ["zh.*"], None, most))], f"query_id string, query {pt.QUERY_TYPE}")
    assert match.search_postings(match.postings(docs), ask(3)).count() == match.search_postings(match.postings(docs), ask(None)).count() == 2
    with pytest.raises(Exception, match="a query expands to 3 terms"):
        match.search_postings(match.postings(docs), ask(2)).collect()
    assert pt.token_count([t for t, k in standard_tokens().items() if k == 1]) == 421


def test_preparation(spark, tmp_path):
    (tmp_path / "chars.txt").write_text("# x\nU+4E2D: zhōng,zhòng # 中\nU+6587: wén\nU+20000: hē\n\nU+554A: ā,á\n")
    tables = prep.prepare(files.lines_of(spark, str(tmp_path / "chars.txt")), spark.createDataFrame([(0, "中文", "zhongwen"), (1, "中文", "x"), (2, "啊", "q'a")], "ord long, word string, joined string"))
    assert [tuple(r) for r in tables["mapping"].collect()] == [("中", "|zhong|"), ("啊", "|a|"), ("文", "|wen|"), ("\U00020000", "|he|")]
    assert [tuple(r) for r in tables["token"].collect()][:4] == [("zhong", 1), ("wen", 1), ("he", 1), ("a", 3)]
    assert sorted(map(tuple, tables["words"].collect())) == [("中文", "zhong wen", False), ("啊", "q a", True)]
    assert one(spark, prep.normalize_tone, " Lǜ ") == "lu" and one(spark, lambda c: prep.normalize_tone(c, {"ǜ": "ü"}), "Lǜ") == "lv"
    assert one(spark, prep.normalize_tone, "nu:e’r5") == "nve'r"
    with pytest.raises(ValueError):
        prep.prepare(spark.createDataFrame([], "ord long, value string"), None)


def test_preparation_by_command(spark, tmp_path):
    from pinloom.sources.__main__ import main

    (tmp_path / "chars.txt").write_text("U+4E2D: zhōng\nU+7EFF: lǜ\n")
    (tmp_path / "words.csv").write_text('中绿,"zhonglv"\n中,q1\n')
    assert main([str(tmp_path / "chars.txt"), str(tmp_path / "out"), "--words", str(tmp_path / "words.csv")]) == {"mapping": 2, "token": 26, "words": 2, "fallback": 2}
    d = files.load_registry(spark, *(str(tmp_path / "out" / k) for k in ("mapping", "token", "words"))).dictionary()
    assert d.mapping["绿"] == "|lu|" and d.words == {"中绿": "zhong lv", "中": "q 1"}


def test_icu_words(spark, registry):
    from pinloom.functions.icu import icu_romanize, icu_tokens, icu_word_romanize

    assert "".join(icu_tokens(spark, "我们 ABC\U0001f600")) == "我们ABC\U0001f600" and icu_tokens(spark, None) is None
    get = lambda c: spark.range(1).select(c.alias("r")).first()[0]
    assert get(icu_romanize(spark, "我们", registry.dictionary())) == "|wo| |men|"
    assert get(icu_word_romanize(spark, "我 AB", registry.dictionary())) == "wo ab"
    assert get(icu_romanize(spark, None, registry.dictionary())) is None


def test_refresh(registry):
    version = registry.version
    registry.refresh()
    assert registry.version == version + 1 and registry.clear_suffix_cache() == 0


def test_stream(spark, registry, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "郑爽"), (2, None)], "id long, v string").write.parquet(str(source))
    seen = []
    stream = spark.readStream.schema("id long, v string").parquet(str(source))
    query = romanize_stream(stream, registry, "v", lambda df, n: seen.extend(map(tuple, df.select("id", "pinyin").collect())), str(tmp_path / "check"))
    query.processAllAvailable()
    registry.upsert("words", spark.createDataFrame([("郑爽", "|new|")], "word string, pinyin string"))
    spark.createDataFrame([(3, "郑爽")], "id long, v string").write.mode("append").parquet(str(source))
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [(1, "zheng shuang"), (2, None), (3, "new")]
    assert with_pinyin(stream, registry, "v", mode="char").isStreaming
