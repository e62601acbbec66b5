"""Exact duplicates, personal data, decontamination, url rules and the quality classifier, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pinloom.llm import decontaminate, exact, pii, quality, urls
from pinloom.llm.common import Scratch
from tests.llm.conftest import docs_frame

# --- exact duplicates


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("options", [{}, {"max_heavy": 1, "counters": 2}])
def test_exact(spark, options):
    texts = ["Same", "same", "SAME", "ÄB", "äb", "ÄB", None, "", "x", "same"] * 3
    df = docs_frame(spark, texts)
    rows = df.collect()
    df = spark.createDataFrame([*rows, *rows[:4], (None, *rows[0][1:])], df.schema).repartition(3)
    got = exact.exact_duplicates(df, Scratch(spark, "test"), **options).collect()
    groups = defaultdict(list)
    for r in df.collect():
        groups[lowered(r.text)].append(r.doc_id)
    seen = defaultdict(list)
    for r in got:
        seen[r.text_sha256].append(r)
    assert len(seen) == len(groups)
    for text, ids in groups.items():
        rows = seen[hashlib.sha256(text.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rows)
        assert all(r.keep_id == best and r.group_size == len(ids) for r in rows)
        assert [r.doc_id for r in rows if r.kept] == [best]
    kept = exact.drop_exact_duplicates(df, Scratch(spark, "test"))
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, lowered(r.text))) for r in kept.collect()) == sorted(str((max((i for i in ids if i is not None), default=None), t)) for t, ids in groups.items())


def test_exact_empty(spark):
    df = docs_frame(spark).limit(0)
    assert exact.exact_duplicates(df, Scratch(spark, "test")).count() == 0
    assert exact.drop_exact_duplicates(df, Scratch(spark, "test")).count() == 0


def test_exact_is_native(spark):
    plan = exact.exact_duplicates(docs_frame(spark), Scratch(spark, "test"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    """The contract's patterns as they stand."""
    out = {k: [] for k in BASE}
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1]))
                ok = 13 <= len(digits) <= 19 and total % 10 == 0
            if kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out[kind].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("ab1209.@+- ()_%é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == base(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "256.1.1.1.9", "a@b.c", "_d@e.f-", "+1 (386) 555-3733", "+123", "x", " ", "0", ".", "@"]), max_size=12))
def test_base_spans_of_parts(parts):
    assert pii.base_spans("".join(parts)) == base("".join(parts))


def test_pii_of_the_method():
    kinds = lambda t: [(k, t[a:b]) for k, a, b, _ in pii.spans_of(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert kinds("ssn 123-45-6789") == [("ssn", "123-45-6789")] and kinds("part 123-45-6789") == []
    assert kinds("call (030) 123 456 78") == [("phone_local", "(030) 123 456 78")] and kinds("sum 030 123 456 78") == []


def test_secrets():
    kinds = lambda t: [(k, t[a:b]) for k, a, b, _ in pii.spans_of(t)]
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert kinds(f'token = "{key}" x') == kinds(f"api_key:{key}") == [("secret", key)]
    assert kinds(f"digest {key}") == [] and kinds("token aaaaaaaaaaaaaaaaaaaa1111111111") == [] and kinds("token internationalisationally") == []
    assert kinds("token 4111111111111111")[0][0] == "card"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)), max_size=20), st.integers(0, 50), st.integers(1, 15))
def test_taken_places(parts, a, n):
    taken, places = pii.Taken(), set()
    for start, size in parts:
        taken.add(start, start + size)
        places |= {*range(start, start + size)}
    assert taken.free(a, a + n) == (not places & {*range(a, a + n)})


def test_pii_query(spark, tmp_path):
    """The query's columns against the contract's patterns."""
    texts = ["a@b.co and 1.2.3.4", "x" * 5000 + " +1 (386) 555-3733 4111111111111111", None, "", "mail a@b.c, a@b.c", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "é 1.2.3.4 \U0001f600 5.6.7.8", "plain"]
    docs = docs_frame(spark, texts)
    docs.unionByName(docs.limit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = pii.op1_pii(spark, str(tmp_path)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 2 and all(r == by_id[r.doc_id] for r in rows)
    for i, t in enumerate(texts):
        want = base(t or "")
        r = by_id[i]
        assert [r[f"n_{k}"] for k in BASE] == [len(want[k]) for k in BASE]
        joined = [f"{k}:{a}:{b}" for k in BASE for a, b in want[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert r.spans.split(",")[: len(joined)] == joined or not joined
        assert r.n_spans == len([x for x in r.spans.split(",") if x]) and r.has_pii == (r.n_spans > 0)
    assert by_id[5].spans == "secret:9:49" and by_id[5].n_spans == 1 and by_id[7].spans == ""


def test_iban_before_other_words():
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NO9386011117947"
    found = lambda t: [t[a:b] for k, a, b, _ in pii.spans_of(t) if k == "iban"]
    for iban in (de, de.replace(" ", ""), gb, no):
        for after in ("", " BIC COBADEFF", " EUR 500", " 500", " A B C D E F G H I J", " OK then", ", EUR", f" {'X' * 40}"):
            assert found(iban + after) == [iban]
            assert found(f"REF AB12 {iban}{after}") == [iban]
    assert found(f"{de} {gb} {no}") == [de, gb, no]
    # a start whose own checksum fails hides none that begin within its characters
    assert found(f"DE88 3704 0044 0532 0130 00 {gb}") == [gb]
    # a country of unknown length: any word end
    unknown = next(t for i in range(100) if pii.mod97(t := f"ZZ{i:02} 1234 5678 9012 34"))
    assert found(unknown) == [unknown] and found(f"{unknown} EUR")[0].startswith(unknown)
    assert found("DE89370400440532013000EUR") == [] and found("XDE89370400440532013000") == []
    for part in ("AB12 ", "DE89 ", "DE89370400440532013000 ", "AB12"):
        pii.spans_of(part * 12_000)


def test_pii_long_texts_are_quick():
    for part in ("a", "1", "1.", "+1", "a@", "1 ", "@a.", "(1"):
        pii.spans_of(part * 60_000)


def test_pii_table(spark):
    df = docs_frame(spark)
    rows = {str(r.doc_id): r for r in pii.find_pii(df).collect()}
    assert len(pii.find_pii(df).collect()) == df.count() and rows["2"].spans == []
    assert pii.find_pii(df.limit(0)).count() == 0


# --- decontamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))


def brute_hits(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(window, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [10**6, 12])
def test_decontaminate(spark, limit):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["a", "B", "c2", "é", "dd-e"]) for _ in range(n))
    items = [(i, some(rng.randrange(0, 9))) for i in range(12)] + [(20, None), (21, "!!"), (3, "a B a B")]
    texts = [some(rng.randrange(0, 40)) for _ in range(40)] + ["zz " * 90 + "x a B a B y", None, "", "a"]
    df = docs_frame(spark, texts)
    again = df.unionByName(df)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(df, bench, 4, 20, limit).collect()}
    for d, t in enumerate(texts):
        n, k, found = brute_hits(t, items, 4)
        r = got[d]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, k, found, k > 0 and 20 * k >= n)
    kept = decontaminate.drop_contaminated(df, bench, 4, 20, limit)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d in range(len(texts)) if not got[d].contaminated]
    assert sorted(map(str, decontaminate.drop_contaminated(again, bench, 4, 20, limit).collect())) == sorted([*map(str, kept.collect())] * 2)
    for r in decontaminate.remove_spans(df, bench, 4, limit).collect():
        left = [w for i, w in enumerate(words(texts[r.doc_id])) if not any(s["first"] <= i < s["end"] for s in got[r.doc_id].spans)]
        assert words(r.text) == left and (r.text == texts[r.doc_id] or got[r.doc_id].n_hit)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(df, bench.limit(0)).collect())


# --- urls


def test_url_rules(spark):
    cases = [
        ("http://Sub.Example.ORG/es/x?q", "sub.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://a.org/x", "a.org", "/x", "org/", "allow"),
        ("https://xorg/x", "xorg", "/x", None, "allow"),
        ("https://a.org", "a.org", "", None, "allow"),
        ("ftp://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        ("x://a.com/de/?b", "a.com", "/de/", "com/de/", "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://h?p/q", "h", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, None, "x") for i, (u, *_) in enumerate(cases)], "page_id long, url string, html string, host string").drop("host")
    got = {r.page_id: r for r in urls.judge_urls(df, Scratch(spark, "test")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert urls.judge_urls(df.limit(0), Scratch(spark, "test")).count() == 0


def test_link_graph(spark):
    """Ranks against dense iteration; hosts that link to blocked ones are blocked, those that trusted ones link to aren't."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [
        (1, "http://good.org/a", link("fine.net", "mid.net")), (2, "http://bad.com/de/a", ""), (3, "http://spam.net/a", link("bad.com", "bad.com", "spam.net")),
        (4, "http://fine.net/a", '<img src=//mid.net/i>'), (5, "http://mid.net/a", ""), (6, "http://lone.net/a", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge_urls(df, Scratch(spark, "test")).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["allow", "block", "block", "allow", "allow", "allow"]
    edges = {("good.org", "fine.net"), ("good.org", "mid.net"), ("spam.net", "bad.com"), ("fine.net", "mid.net")}

    def rank(seed, edges):
        out = dict(seed)
        for _ in range(urls.ROUNDS):
            new = {h: s * (1 - urls.DAMPING) for h, s in seed.items()}
            for a, b in edges:
                new[b] = new.get(b, 0) + urls.DAMPING * out.get(a, 0) / sum(x == a for x, _ in edges)
            out = new
        return out

    trust, distrust = rank({"good.org": 1.0}, edges), rank({"bad.com": 1.0}, {(b, a) for a, b in edges})
    for r in got.values():
        assert r.trust == pytest.approx(trust.get(r.host, 0)) and r.distrust == pytest.approx(distrust.get(r.host, 0))


def test_urls_of_odd_rows(spark):
    """Repeated rows, null page_id and columns with names used inside; only DataFrame operations."""
    rows = [(1, "http://bad.com/de/a", "", "h", 1.0), (1, "http://bad.com/de/a", "", "h", 1.0), (None, "http://x.org/", "<a href=http://bad.com/>", "h", 2.0), (2, "http://bad.com/fr/", None, None, None), (2, None, "", "", 0.0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rank double")
    found = urls.judge_urls(df, Scratch(spark, "test"))
    assert sorted(str((r.page_id, r.host, r.rule, r.verdict)) for r in found.collect()) == sorted(
        map(str, [(1, "bad.com", "com/de/", "block")] * 2 + [(None, "x.org", "org/", "allow"), (2, "bad.com", "com/fr/", "allow"), (2, "", None, "allow")])
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_ranks_end_early(spark):
    """Where links make no ring, ranks stand still before the last round, and further rounds change nothing."""
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    get = lambda n: {r["host"]: r["rank"] for r in urls.propagate(Scratch(spark, "test"), seeds, edges, "t", rounds=n).collect()}
    assert get(8) == pytest.approx({"a": 0.15, "b": 0.15 * 0.85, "c": 0.15 * 0.85**2}) and get(20) == pytest.approx(get(8))


@pytest.mark.parametrize("n", [1, 12, 13, 300])
def test_link_graph_popular_blocked_host(spark, n):
    """However many link to a blocked host, each is blocked, and who links to them; trusted hosts aren't and carry nothing."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [(0, "http://bad.com/de/a", "", "block")]
    pages += [(i, f"http://spam{i}.net/a", link("bad.com"), "block") for i in range(1, n + 1)]
    pages += [
        (1001, "http://farm.net/a", link("bad.com", *(f"other{i}.net" for i in range(40))), "block"), (1002, "http://hub.net/a", link("spam1.net"), "block"),
        (1003, "http://top.net/a", link("hub.net"), "block"), (1004, "http://good.org/a", link("fine.net"), "allow"), (1005, "http://other1.net/a", "", "allow"),
        (1006, "http://good.org/b", link("bad.com"), "allow"),
    ]
    if n >= 12:
        pages += [(1007, "http://fine.net/a", link("bad.com"), "allow"), (1008, "http://far.net/a", link("fine.net"), "allow")]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(df, Scratch(spark, "test")).collect()}
    assert got == {p[0]: p[3] for p in pages}


# --- quality


def test_quality_separates_held_out(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(60))
    texts, bad = [], set()
    for i in range(600):
        t = good().split()
        if i % 6 == 0:
            bad.add(i)
            for _ in range(6):
                t[rng.randrange(60)] = rng.choice(["idiotword", "junk***"])
        texts.append(" ".join(t))
    df = docs_frame(spark, [*texts, None, "", "  "])
    labels = spark.createDataFrame([(i, int(i % 12 != 0), int(i % 12 == 6), "x") for i in range(0, 600, 2)], "doc_id long, quality long, toxic long, text string")
    rows = quality.resample(df, labels, Scratch(spark, "test"), buckets=1 << 14).collect()
    kept = {r.doc_id for r in rows if r.kept}
    held = [i for i in range(600) if i % 2]
    assert sum(i in kept for i in held) >= 0.95 * len(held)
    assert sum(i in kept for i in bad) <= 0.1 * len(bad)
    assert {600, 601, 602} <= kept
    left = quality.drop_rejected(df, labels, Scratch(spark, "test"), buckets=1 << 14)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == kept
    assert all(r.kept for r in quality.resample(df, labels.limit(0), Scratch(spark, "test"), buckets=1 << 14).collect())
    assert quality.resample(df.limit(0), labels, Scratch(spark, "test"), buckets=1 << 14).count() == 0


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), 1.5, -1e9]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 100, 250, 400, 499):
        assert quality.kth_largest(df, k, bins=7, few=20) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, 0) == float("inf") and quality.kth_largest(df, 500) == float("-inf")
