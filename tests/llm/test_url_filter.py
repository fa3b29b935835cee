"""URL filters against every rule run on every URL."""

import random
import re
from collections import Counter

import pytest

from brackwater.llm import queries, url_filter

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    tail = rest[len(host) :]
    return host.translate(A_TO_Z), re.split("[?#]", tail, maxsplit=1)[0], tail


def fits(pattern, host, tail):
    """A pattern, character by character: no regular expressions and no index."""
    address = host + tail
    if pattern.startswith("||"):
        starts, body = [k for k in range(len(host) + 1) if k == 0 or host[k - 1] == "."], pattern[2:]
    elif pattern.startswith("|"):
        starts, body = [0], pattern[1:]
    else:
        starts, body = range(len(address) + 1), pattern
    ended = body.endswith("|")
    body = body[:-1] if ended else body

    def match(i, j):
        if i == len(body):
            return not ended or j == len(address)
        if body[i] == "*":
            return any(match(i + 1, x) for x in range(j, len(address) + 1))
        if body[i] == "^":
            return j == len(address) and match(i + 1, j) or j < len(address) and not re.match("[A-Za-z0-9_.%-]", address[j]) and match(i + 1, j + 1)
        return j < len(address) and address[j] == body[i] and match(i + 1, j + 1)

    return any(match(0, s) for s in starts)


def plain(url, sites, patterns):
    host, path, tail = parts(url)
    found = []
    for rule, action in sites:
        of, slash, start = rule.partition("/")
        if (host == of.lower() or host.endswith("." + of.lower())) and path.startswith(slash + start):
            found.append((len(rule), rule, action))
    if found:
        return host, path, *max(found)[1:]
    hits = {a for p, a in patterns if host + tail and (re.search(p[1:-1], host + tail) if p.startswith("/^") else fits(p, host, tail))}
    return host, path, None, "allow" if "allow" in hits or not hits else "block"


URLS = [None, "", "no scheme.net/en/", "http://", "http:///en/", "http://net/", "http://a.NET/", "http://.net/", "http://anet/", "http://a.net", "http://a.net?x=/", "http://a.net#/", "http://a.net:80/", "HTTP://EXAMPLE.NET/EN/", "http://Example.Net/en/a", "http://example.net/en", "x://y.example.com/de/?a=b", "http://a.org/fr/?u=http://b.net/"]
URLS += ["http://u@free-bets.com/", "http://m.free-bets.com/", "http://free-betsy.com/", "http://x.com/setup.exe", "http://x.com/setup.exe?", "http://10.2.3.4/", "http://10.2.3.4:80?x", "http://10.2.3.4.5/", "http://x.com/ads/a/b/banner", "http://x.com/ads/banner-top", "http://ads.x.com/about", "http://ads.x.com/aboutus", "http://x.com/?sessionid=3", "http://x.com/wp-login.php\nnext", "http://x.com/\u212aads.", "http://x.com/ads/\u0130/banner\u212a", "a://b://c.net/", "http://x.com/" + "long/" * 3000]


def test_urls_of_all_kinds(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(1, URLS[6]), (None, URLS[7])]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).select("page_id", "filter.*").collect()
    assert Counter(map(tuple, got)) == Counter((i, *plain(u, url_filter.SITES, url_filter.PATTERNS)) for i, u in rows)


@pytest.mark.parametrize("block", [1, 7, 50_000])
def test_many_rules_in_blocks(spark, block):
    rng = random.Random(block)
    name = lambda: rng.choice(["a", "b", "ab", "ads", "x-y", "net", "com", "b-a", "7"])
    sites = sorted({(f"{name()}.{name()}" + rng.choice(["", "/", f"/{name()}", f"/{name()}/"]), rng.choice(["allow", "block"])) for _ in range(25)})
    patterns = sorted({(rng.choice(["", "|", "||"]) + rng.choice([f"/{name()}", f"{name()}.", f".{name()}^", f"{name()}*{name()}", "*", f"^{name()}^", f"{name()}/"]) + rng.choice(["", "", "|", "^", "*"]), rng.choice(["allow", "block", "block"])) for _ in range(40)})
    rows = [(k, "http://" + ".".join(name() for _ in range(rng.randrange(1, 4))) + rng.choice(["", "/", "?", "/" + name(), f"/{name()}/{name()}", f"/{name()}#{name()}"])) for k in range(300)]
    rules = url_filter.rules_table(spark, sites, [*patterns, (None, "block"), ("", "block")])
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(3), rules, block=block).select("page_id", "filter.*").collect()
    assert Counter(map(tuple, got)) == Counter((i, *plain(u, sites, patterns)) for i, u in rows)


def test_rarest_tokens_index_the_rules(spark):
    scratch = url_filter.Scratch(spark, "test")
    addresses = spark.createDataFrame([("ads.com/free",)] * 3 + [("ads.net/",)], "address string")
    rules = url_filter.rules_table(spark, [("ads.com/free/", "block")], [("||ads.*/free^", "block"), ("ads", "block"), ("/x[0-9]/", "block")])
    got = {r["rule"]: r["token"] for r in url_filter.indexed(addresses, rules, scratch).collect()}
    assert got == {"ads.com/free/": "free", "||ads.*/free^": "free", "ads": None, "/x[0-9]/": None}


def test_hot_url_empty_tables_and_clashing_names(spark):
    rows = [(k, "http://m.casino-win.example.net/fr/1") for k in range(400)] + [(k, f"http://h{k}.com/") for k in range(400, 500)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).select("filter.verdict").collect()
    assert Counter(r[0] for r in got) == {"block": 400, "allow": 100}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
    names = ("filter", "address", "told0", "told", "host", "rule", "token", "n")
    df = spark.createDataFrame([(1, "http://a.net/", *names), (2, "http://b.com/", *names)], "page_id long, url string, " + ", ".join(f"{c} string" for c in names))
    assert {(r["page_id"], r["filter"]["verdict"], r["host"], r["told0"]) for r in url_filter.judge(df).collect()} == {(1, "block", "host", "told0"), (2, "allow", "host", "told0")}
    kept = url_filter.keep_allowed(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, "http://b.com/", *names)]
    nothing = url_filter.rules_table(spark, [], [("|", "block")]).filter("false")
    assert [r["filter"]["verdict"] for r in url_filter.judge(df, nothing).collect()] == ["allow"] * 2


def test_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert Counter(map(tuple, queries.op12_url_filter(spark, sf_dir).collect())) == Counter((r["page_id"], *plain(r["url"], url_filter.SITES, url_filter.PATTERNS)) for r in pages)
