"""URL filters: prefix rules, and trust and distrust propagated over the host link graph.

Rules decide the urls they fit. For the rest, personalised PageRank starts at hosts under allow
rules and follows links, while distrust starts at hosts under block rules and follows links
backwards (who links to bad hosts is suspect). A rank is divided among all who link to a host, so how
far distrust carries is measured beside it undivided: one link to a blocked host carries the same
however many others link there. A host is blocked when either reaches a threshold and its distrust
exceeds its trust. Only DataFrame operations run here; ranks, hosts and edges stay distributed, and
every few rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
#: Rounds at most; they end earlier when no rank has moved by more than TOLERANCE since the last that was written.
ROUNDS = 8
TOLERANCE = 1e-9
#: Distrust, divided or as one link carries it, from which a host can be blocked. Seeds are shares of
#: a host's pages, from 0 to 1, so the threshold depends neither on the number of hosts nor on degrees.
THRESHOLD = 0.01
#: Links that name a host: the value of href or src up to a quote, blank or bracket. Relative links
#: stay on their host and carry nothing between hosts.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) hosts of links between different hosts."""
    links = pages.select(
        host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1))).alias("link")
    )
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return links.select("src", host_of(full).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(scratch: Scratch, seeds: DataFrame, edges: DataFrame, name: str, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank: (host, rank) of ``seeds`` (host, seed) over ``edges`` (src, dst).

    Each source divides its rank evenly among its distinct targets. Sums are combined map-side, so a
    host that many link to is no hot key; a host that links to many is one on one side of an inner join, which adaptive
    execution splits. Every second round is written out and compared with the one before.
    """
    if edges.isEmpty():
        return seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank")) if rounds else seeds.select("host", F.col("seed").alias("rank"))
    out_degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    weighted = scratch.save(edges.join(out_degree, "src").select("src", "dst", (F.lit(1.0) / F.col("deg")).alias("w")), f"{name}-edges")
    ranks, saved = seeds.select("host", F.col("seed").alias("rank")), None
    for i in range(1, rounds + 1):
        moved = weighted.join(ranks, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("rank") * F.col("w") * damping).alias("rank"))
        base = seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"))
        ranks = moved.unionByName(base).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % 2 == 0 or i == rounds:
            ranks = scratch.save(ranks, f"{name}-{i}")
            if saved is not None and not _moved(saved, ranks):
                return ranks
            scratch.drop(f"{name}-{i - 2}")
            saved = ranks
    return ranks


def _moved(old: DataFrame, new: DataFrame) -> bool:
    """Whether any rank differs by more than TOLERANCE."""
    both = old.select("host", F.col("rank").alias("was")).join(new, "host", "full")
    return not both.where(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))) > TOLERANCE).isEmpty()


def carried(scratch: Scratch, scores: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(host, carried) of the hosts in ``scores`` (host, trust, distrust) with more distrust than trust.

    That is the host's distrust or, where larger, what a link carries of a blocked host it names:
    damping times that host's own, undivided. Trusted hosts carry nothing.
    """
    doubted = scores.where(F.col("distrust") > F.col("trust")).select("host", F.col("distrust").alias("carried"))
    side = lambda c: doubted.select(F.col("host").alias(c))
    links = scratch.save(edges.join(side("src"), "src", "left_semi").join(side("dst"), "dst", "left_semi").select("src", "dst"), "doubted-edges")
    if links.isEmpty():
        return doubted
    found = doubted
    for i in range(1, rounds + 1):
        moved = links.join(found.where(F.col("carried") >= threshold), F.col("dst") == F.col("host")).select(F.col("src").alias("host"), (F.col("carried") * damping).alias("carried"))
        found = moved.unionByName(doubted).groupBy("host").agg(F.max("carried").alias("carried"))
        if i % 2 == 0 or i == rounds:
            found = scratch.save(found, f"carried-{i}")
            scratch.drop(f"carried-{i - 2}")
    return found


def judge_urls(pages: DataFrame, scratch: Scratch, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A null url counts as empty, without host, path and rule. Hosts that neither trust nor distrust
    reaches are allowed. Repeated rows are judged each by itself; an empty table gives no rows.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn(
        "best", best_rule(F.col("host"), F.col("path"), rules)
    )
    hosts = scratch.save(
        urls.where("host <> ''").groupBy("host").agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if(F.col("best.verdict") == "allow").alias("good"),
            F.count_if(F.col("best.verdict") == "block").alias("bad"),
        ),
        "hosts",
    )
    edges = scratch.save(host_edges(pages), "edges")

    def seeds(kind: str) -> DataFrame:
        return hosts.where(f"{kind} > 0").select("host", (F.col(kind) / F.col("pages")).alias("seed"))

    trust = propagate(scratch, seeds("good"), edges, "trust", damping, rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = propagate(scratch, seeds("bad"), back, "distrust", damping, rounds)
    scores = scratch.save(
        hosts.select("host")
        .join(trust.withColumnRenamed("rank", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
        .na.fill(0.0, ["trust", "distrust"]),
        "scores",
    )
    scores = scores.join(carried(scratch, scores, edges, damping, rounds, threshold), "host", "left")
    blocked = F.col("carried") >= threshold
    return urls.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of each of ``pages``; null urls, repeated rows and empty tables as in judge_urls()."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages, Scratch(spark, "urls")).drop("trust", "distrust")


def _sql() -> str:
    """The judgement by ranks alone, with the rounds written out one by one: it lacks what links carry undivided."""
    rules = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in rules]
    case = lambda i: "CASE " + " ".join(f"WHEN {f} THEN '{(r[1] + r[2]) if i else r[0]}'" for f, r in zip(fits, rules)) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: lower.format(f"regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)")
    link = LINK.replace("'", "''")
    parts = [
        f"u AS (SELECT page_id, {host("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages)",
        f"j AS (SELECT page_id, host, path, html, {case(1)} AS rule, {case(0)} AS ruled FROM u)",
        "hosts AS (SELECT host, count(*) AS pages, count_if(ruled = 'allow') AS good, count_if(ruled = 'block') AS bad FROM j WHERE host <> '' GROUP BY host)",
        f"links AS (SELECT DISTINCT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM j)",
        f"e AS (SELECT DISTINCT src, dst FROM (SELECT src, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links) WHERE src <> '' AND dst <> '' AND src <> dst)",
    ]
    for kind, seed, a, b in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        parts.append(f"{kind}e AS (SELECT {a} AS src, {b} AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY {a}) AS w FROM e)")
        parts.append(f"{kind}0 AS (SELECT host, {seed}::DOUBLE / pages AS rank FROM hosts WHERE {seed} > 0)")
        for i in range(1, ROUNDS + 1):
            parts.append(
                f"{kind}{i} AS (SELECT host, sum(rank) AS rank FROM (SELECT dst AS host, rank * w * {DAMPING}::DOUBLE AS rank FROM {kind}e JOIN {kind}{i - 1} ON src = host "
                f"UNION ALL SELECT host, rank * (1 - {DAMPING}::DOUBLE) FROM {kind}0) GROUP BY host)"
            )
    return f"""WITH {", ".join(parts)}
SELECT page_id, j.host, path, rule,
       coalesce(ruled, CASE WHEN coalesce(d.rank, 0) >= {THRESHOLD}::DOUBLE AND coalesce(d.rank, 0) > coalesce(t.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN t{ROUNDS} t ON j.host = t.host LEFT JOIN d{ROUNDS} d ON j.host = d.host"""


OP9_SQL = _sql()
