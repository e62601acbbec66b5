"""Generated workloads: Chinese names and typed queries, and the fixture dictionaries they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dictionary import Registry, standard_tokens

# The parts of the generated names, the query mix, and readings of the names' characters.
SURNAMES = ("张", "王", "李", "赵", "郑", "重", "楼", "上", "小", "龙")
GIVEN = ("爽", "世昀", "仕英", "重阳", "先生", "小姐", "小明", "起飞", "测试", "编号")
QUERIES = ("lun", "lunlun", "zhengshuang", "wangchongyang", "xian", "wchy", "zh sh", "   ", "abc")
READINGS = (
    "张 zhang 王 wang 李 li 赵 zhao 郑 zheng 重 zhong|chong 楼 lou 上 shang 小 xiao 龙 long 爽 shuang 世 shi 昀 yun 仕 shi "
    "英 ying 阳 yang 先 xian 生 sheng 姐 jie 明 ming 起 qi 飞 fei 测 ce 试 shi 编 bian 号 hao"
)
WORDS = {"重阳": "chong yang", "先生": "xian sheng", "小姐": "xiao jie"}
#: Overlay entries used by the overlay queries.
OVERLAY_MAPPING = {"郑": "|zhengx|", "小": "|xiaox|"}
OVERLAY_WORDS = {"先生": "xianx shengx", "小明": "xiaox mingx"}


def bench_mapping() -> dict[str, str]:
    parts = READINGS.split()
    return {" ": " "} | {c: f"|{r}|" for c, r in zip(parts[::2], parts[1::2])}


def bench_registry(spark: SparkSession) -> Registry:
    make = lambda rows, schema: spark.createDataFrame(list(rows.items()), schema)
    registry = Registry.of(spark, bench_mapping(), standard_tokens(), WORDS)
    registry.set_overlay("_bench", "mapping", make(OVERLAY_MAPPING, "character string, pinyin string"))
    registry.set_overlay("_bench", "words", make(OVERLAY_WORDS, "word string, pinyin string"))
    return registry


def large_dictionary(characters: int = 20_902, words: int = 100_000) -> tuple[dict[str, str], dict[str, str]]:
    """A mapping and words of the size that real ones have, by rule: readings go round the syllables."""
    syllables = [t for t, k in standard_tokens().items() if k == 1]
    of = lambda i: chr(0x4E00 + i % characters)
    reading = lambda i: syllables[i % characters % len(syllables)]
    mapping = {" ": " "} | {of(i): f"|{reading(i)}|{reading(i + 7)}|" if i % 5 == 0 else f"|{reading(i)}|" for i in range(characters)}
    parts = [[i * 31 + 1 + k * (k + 17 + i % 97) for k in range(2 + i % 3)] for i in range(words)]
    return mapping, {"".join(map(of, p)): " ".join(f"|{reading(x + 3)}|" for x in p) for p in parts}


def large_names(spark: SparkSession, n: int) -> DataFrame:
    """Names of the large dictionary's characters: each a word of it, a character, another word and sometimes an ASCII tail."""
    i = F.col("id")
    code = lambda x: F.decode(F.unhex(F.lpad(F.hex(x % 20_902 + 0x4E00), 8, "0")), "utf-32")
    word = lambda w: F.concat(*(F.when(k < 2 + w % 3, code(w * 31 + 1 + k * (k + 17 + w % 97))).otherwise("") for k in map(F.lit, range(4))))
    tail = F.when(i % 5 == 0, "ABC").otherwise("")
    return spark.range(1, n + 1).select("id", F.concat(word(i * 7 % 100_000), code(i * 13), word(i * 11 % 100_000), tail).alias("name"))


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def name_of(g: Column) -> Column:
    """The g-th name: surname, given name and sometimes an ASCII tail."""
    tail = F.when(g % 5 == 0, "ABC").when(g % 7 == 0, "123").otherwise("")
    return F.concat(_pick(SURNAMES, g % len(SURNAMES)), _pick(GIVEN, F.floor(g / 3) % len(GIVEN)), tail)


def query_of(g: Column) -> Column:
    return _pick(QUERIES, g % len(QUERIES))


def names(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select("id", name_of(F.col("id")).alias("name"))


def typed_queries(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select("id", query_of(F.col("id")).alias("query"))


def token_checksum(patterns: Column) -> Column:
    """Sum over rows of the number of patterns and their lengths."""
    return F.sum(F.size(patterns) + F.aggregate(patterns, F.lit(0), lambda n, p: n + F.length(p))).cast("long")
