"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch candidates, and only those run regular expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast, shipped, small_batches, unused

#: Rules of site and path: they go before all patterns, and the longest that fits wins.
SITES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Patterns of the filter lists' usual syntax, for URLs that no site rule fits; one that allows goes before any that blocks.
PATTERNS = (
    ("||ads.", "block"),
    ("||ads-track.", "block"),
    ("||tracker.", "block"),
    ("||adult-", "block"),
    ("||casino-", "block"),
    ("||cheap-pills.", "block"),
    ("||free-bets.", "block"),
    ("||spam-farm.", "block"),
    ("/wp-login.", "block"),
    ("/ads/*/banner^", "block"),
    ("?sessionid=", "block"),
    ("&sessionid=", "block"),
    (".exe|", "block"),
    ("||ads.*/about^", "allow"),
    ("/^[0-9]+(?:[.][0-9]+){3}(?::[0-9]+)?[/?#]/", "block"),
)
TOKEN = r"[A-Za-z0-9]+"
#: Rules whose index and expressions are sent to workers at once; more are sent in as many blocks, one after the other.
BLOCK = 50_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """What rules are matched against: the host in lower case and all that follows it."""
    return F.concat(host_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(.*)$", 1))


def site_expression(site: str) -> tuple[str, list[str]]:
    """A site rule as regular expression on an address, and its literal tokens: the host itself or a subdomain, and a path that starts so."""
    host, slash, path = site.partition("/")
    host = host.lower()
    whole = re.findall(TOKEN, host) + _inside(slash + path, open_end=True)
    return rf"(?:[^/?#]*\.)?{re.escape(host)}" + (re.escape(slash + path) if slash else r"(?=[/?#]|\Z)"), whole


def _inside(literal: str, open_start: bool = False, open_end: bool = False) -> list[str]:
    """Tokens of a literal that are whole in every match: one at an open end may go on in the URL."""
    return [m.group().lower() for m in re.finditer(TOKEN, literal) if not (open_start and m.start() == 0) and not (open_end and m.end() == len(literal))]


def pattern_expression(pattern: str) -> tuple[str, list[str]]:
    """A pattern as regular expression on an address, and the literal tokens that every match has whole.

    || is the start of the host or of one of its labels, | the address's start or end, * anything, ^ a character other than letters,
    digits and _ - . %, or the end; /.../ with one of \\ [ ( $ + { inside is a regular expression itself, whose tokens are not looked for.
    """
    if len(pattern) > 1 and pattern.startswith("/") and pattern.endswith("/") and re.search(r"[\\\[($+{]", pattern):
        return f"(?s:.*?)(?:{pattern[1:-1]})", []
    label, start = pattern.startswith("||"), pattern.startswith("|")
    body = pattern.lstrip("|") if start else pattern
    end = body.endswith("|")
    body = body[:-1] if end else body
    out = [r"(?:[^/?#]*\.)?" if label else "" if start else "(?s:.*?)"]
    tokens = []
    parts = re.split(r"([*^])", body)
    for k in range(0, len(parts), 2):
        before, after = parts[k - 1] if k else "", parts[k + 1] if k + 1 < len(parts) else ""
        out.append(re.escape(parts[k]) + {"*": "(?s:.*?)", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)", "": ""}[after])
        tokens += _inside(parts[k], open_start=before == "*" or (not before and not start), open_end=after == "*" or (not after and not end))
    return "".join(out) + (r"\Z" if end else ""), tokens


def _read(rules: pa.Array, sites: pa.Array) -> pa.Array:
    rows = [site_expression(r) if s else pattern_expression(r) for r, s in zip(rules.to_pylist(), sites.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([e for e, _ in rows], pa.string()), pa.array([sorted(set(t)) for _, t in rows], pa.list_(pa.string()))], ["expression", "tokens"])


def rules_table(spark: SparkSession, sites=SITES, patterns=PATTERNS) -> DataFrame:
    """rule, action, site of two lists."""
    return spark.createDataFrame([(r, a, True) for r, a in sites] + [(r, a, False) for r, a in patterns], "rule string, action string, site boolean")


def indexed(addresses: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """rule, action, site, expression, token: each rule under that of its literal tokens which the fewest of all addresses have; null if it has none.

    Only the rules' tokens are counted, once for an address; ties go to the longer token, then the smaller. A token that no address has is rarest.
    """
    read = F.arrow_udf(_read, "struct<expression:string,tokens:array<string>>")
    rules = rules.filter("rule is not null and rule <> ''").select("rule", "action", F.coalesce("site", F.lit(False)).alias("site")).dropDuplicates()
    rules = scratch.save(rules.withColumn("e", read("rule", "site")).select("rule", "action", "site", "e.expression", "e.tokens"), "rules")
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = addresses.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("address", F.lit(TOKEN), F.lit(0)), F.lower))).alias("token"))
    counts = scratch.save(seen.join(bounded_broadcast(wanted, wanted.count()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")), "counts")
    each = rules.select("rule", "action", "site", "expression", F.explode_outer("tokens").alias("token"))
    each = each.join(counts, "token", "left")
    best = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token"))
    return each.groupBy("rule", "action", "site", "expression").agg(best.alias("token"))


class Rules:
    """A block of indexed rules on a worker. Expressions are compiled when a URL first fetches them."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.compiled, self.by_token = rows, {}, {}
        for k, row in enumerate(rows):
            self.by_token.setdefault(row[4], []).append(k)

    def fits(self, k: int, address: str) -> bool:
        if k not in self.compiled:
            self.compiled[k] = re.compile(self.rows[k][3])
        return self.compiled[k].match(address) is not None

    def judge(self, address: str, path_ends: int) -> tuple:
        """The longest fitting site rule with its action, and whether a pattern allows or blocks."""
        site, pattern = None, None
        tokens = {None, *(t.lower() for t in re.findall(TOKEN, address))}
        for k in (k for t in tokens for k in self.by_token.get(t, ())):
            rule, action, is_site = self.rows[k][:3]
            if self.fits(k, address[:path_ends] if is_site else address):
                if is_site:
                    site = max(site or (-1,), (len(rule), rule, action))
                else:
                    pattern = "allow" if "allow" in (pattern, action) else action
        return site, pattern


def _judging(sent: Broadcast):
    """The function that judges a batch by a block of rules, which a worker reads once."""
    known: dict[str, Rules] = {}

    def run(addresses: pa.Array, ends: pa.Array) -> pa.Array:
        if not known:
            known["rules"] = Rules(sent.value)
        told = [known["rules"].judge(a, n) if a else (None, None) for a, n in zip(addresses.to_pylist(), ends.to_pylist())]
        sites = pa.array([s and {"long": s[0], "rule": s[1], "action": s[2]} for s, _ in told], pa.struct([("long", pa.int32()), ("rule", pa.string()), ("action", pa.string())]))
        return pa.StructArray.from_arrays([sites, pa.array([{"allow": 2, "block": 1}.get(p, 0) for _, p in told], pa.int32())], ["site", "pattern"])

    return run


def _blocks(rules: DataFrame, size: int):
    """The indexed rules, read piece by piece in the order of their texts."""
    rows = []
    for r in rules.orderBy("site", "rule", "action").toLocalIterator():
        rows.append(tuple(r[c] for c in ("rule", "action", "site", "expression", "token")))
        if len(rows) == size:
            yield rows
            rows = []
    yield rows


def judge(pages: DataFrame, rules: DataFrame | None = None, *, column: str = "filter", url_column: str = "url", block: int = BLOCK, default: str = "allow") -> DataFrame:
    """pages with `column`, struct(host, path, rule, verdict).

    A site rule fits its host and all subdomains if the path starts with its path (its host alone: any path); the longest that fits gives
    rule and verdict (of equal ones the later text; if both actions are listed for one rule, block). Where none fits, rule is null
    and patterns decide: allow if one that allows fits, block if one that blocks does, `default` otherwise. Every URL is judged by all rules;
    an expression runs only where the URL holds the rule's rarest token, or where the rule has none.

    Null URLs and those without :// have an empty host and path, which no rule fits. Repeated rows get the same verdict. Other columns pass
    through, whatever their names; one named like `column` is replaced. Rules with a null or empty text are left out; without rules every
    verdict is the default. An empty table gives no rows.
    """
    shipped(__name__)
    spark = pages.sparkSession
    small_batches(spark, rows=10_000, size=16 << 20)
    scratch = Scratch(spark, "url-rules")
    url = F.col(url_column)
    address = address_of(url)
    found = scratch.save(indexed(pages.select(address.alias("address")), rules_table(spark) if rules is None else rules, scratch), "index")
    best = F.lit(None).cast("struct<long:int,rule:string,action:string>")
    pattern = F.lit(0)
    out, own = pages, []
    for rows in _blocks(found, block):
        sent = spark.sparkContext.broadcast(rows)
        name = unused(out, f"told{len(own)}")
        kind = "struct<site:struct<long:int,rule:string,action:string>,pattern:int>"
        out = out.withColumn(name, F.arrow_udf(_judging(sent), kind)(address, F.length(F.concat(host_of(url), path_of(url)))))
        own.append(name)
    sites, patterns = [F.col(f"{c}.site") for c in own], [F.col(f"{c}.pattern") for c in own]
    best = F.greatest(best, best, *sites)
    pattern = F.greatest(pattern, pattern, *patterns)
    verdict = F.coalesce(best["action"], F.when(pattern == 2, "allow").when(pattern == 1, "block").otherwise(default))
    kept = [c for c in pages.columns if c.lower() != column.lower()]
    return out.select(*kept, F.struct(host_of(url).alias("host"), path_of(url).alias("path"), best["rule"].alias("rule"), verdict.alias("verdict")).alias(column))


def keep_allowed(pages: DataFrame, rules: DataFrame | None = None, **options) -> DataFrame:
    """The pages whose verdict is allow, with pages' columns."""
    own = unused(pages, "filter")
    return judge(pages, rules, column=own, **options).filter(F.col(f"{own}.verdict") == "allow").drop(own)
