"""Verdicts on URLs: rules by host and path, then pattern rules found by their rarest literal token.

A pattern is literal text with ``*`` for anything. Its tokens are the runs of letters and digits that stand
between other literal characters, so a URL that fits holds them as whole tokens. Each rule is filed under the
one of its tokens that the fewest URLs hold; a URL's tokens fetch the rules filed under them, and only those
run their regular expression. The rules are a hash table in one literal: the checksum of a token is the place of its
bucket, so a look-up costs the same for ten rules and for ten thousand. All is one projection: no join, no shuffle but
the count of the rules' tokens, DataFrame functions only.
"""

from __future__ import annotations

import json
import re
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path): the rule holds for the host and its subdomains where the path starts with its path.
HOST_RULES = (
    (ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/"),
)
#: (verdict, pattern) for URLs that no host rule fits.
PATTERNS = (
    (BLOCK, "/ads/"), (BLOCK, "/ad-click/"), (BLOCK, "/cgi-bin/"), (BLOCK, "/login?"), (BLOCK, "/signup?"), (BLOCK, "/wp-admin/"),
    (BLOCK, "/cart/"), (BLOCK, "/track/*pixel."), (BLOCK, "?sessionid="), (BLOCK, "&sessionid="), (BLOCK, "://spam."), (BLOCK, "/casino-"),
    (BLOCK, "/search?q="), (BLOCK, "?replytocom="), (ALLOW, "/ads/about-our-ads."), (ALLOW, "/search?q=site-map&"),
)
_TOKEN = re.compile(r"[a-z0-9]+")


def tokens_of(pattern: str) -> list[str]:
    """Tokens of a pattern that stand between other literal characters."""
    low = pattern.lower()
    return [m[0] for m in _TOKEN.finditer(low) if 0 < m.start() and low[m.start() - 1] != "*" and m.end() < len(low) and low[m.end()] != "*"]


def regex_of(pattern: str) -> str:
    """The pattern as a regular expression over URLs in lower case."""
    return ".*".join(re.sub(r"([^a-z0-9])", r"\\\1", part) for part in pattern.lower().split("*"))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = _rest(url)
    return _lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _found(keys: Column, rules: dict[str, list[dict]], fields: str) -> Column:
    """The rules filed under any of the ``keys``, as an array of ``struct<key, ...fields>``."""
    size = 1 << max(0, len(rules) - 1).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for key, rows in rules.items():
        buckets[crc32(key.encode()) % size] += [{"key": key, **row} for row in rows]
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<key: string, {fields}>>>")
    bucket = lambda k: F.element_at(table, (F.crc32(k.cast("binary")) % size + 1).cast("int"))
    return F.flatten(F.transform(keys, lambda k: F.filter(bucket(k), lambda r: r["key"] == k)))


def _host_rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as (length, rule, verdict), else null."""
    by_host: dict[str, list[dict]] = {}
    for v, h, p in rules:
        by_host.setdefault(h, []).append({"length": len(h + p), "rule": h + p, "verdict": v, "path": p})
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = _found(ends, by_host, "length: int, rule: string, verdict: string, path: string")
    fitting = F.filter(near, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def filed_under(urls: DataFrame, patterns) -> dict[str, list[tuple[str, str]]]:
    """Rules by the token that the fewest URLs hold; rules without a token under the empty one.

    Counted are the rules' own tokens only, combined in the tasks: what reaches the driver has a row a token of the rules.
    """
    known = sorted({t for _, p in patterns for t in tokens_of(p)})
    counts = {}
    if known:
        held = _found(F.array_distinct(_url_tokens(F.col("url"))), {t: [{}] for t in known}, "same: boolean")
        counts = {r["t"]: r["count"] for r in urls.select(F.explode(F.transform(held, lambda r: r["key"])).alias("t")).groupBy("t").count().collect()}
    out: dict[str, list[tuple[str, str]]] = {}
    for verdict, pattern in patterns:
        tokens = tokens_of(pattern)
        out.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else "", []).append((verdict, pattern))
    return out


def _url_tokens(url: Column) -> Column:
    return F.split(F.regexp_replace(_lower(url), "[^a-z0-9]+", " "), " ")


def _pattern_verdict(url: Column, filed: dict[str, list[tuple[str, str]]]) -> Column:
    rows = {token: [{"allows": v == ALLOW, "pattern": p, "regex": regex_of(p)} for v, p in rules] for token, rules in filed.items()}
    tokens = F.array_union(F.array_distinct(_url_tokens(url)), F.array(F.lit("")))
    candidates = _found(tokens, rows, "allows: boolean, pattern: string, regex: string")
    fits = F.filter(candidates, lambda r: F.rlike(_lower(url), r["regex"]))
    # An allowing pattern wins over blocking ones; among equals the last by name, for a stable answer.
    return F.array_max(F.transform(fits, lambda r: F.struct(r["allows"].alias("allows"), r["pattern"].alias("pattern"))))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """Rows: page_id, host, path, rule, verdict, pattern.

    The longest host rule decides; else a fitting pattern; else the URL is allowed. ``rule`` and ``pattern`` tell
    which did, null if none. A url that is null or has no ``://`` has empty host and path, and patterns see what there is
    of it. Repeated rows are judged each, other columns are not read, an empty table gives no rows.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    filed = filed_under(urls.where("url is not null"), patterns)
    host, path = host_and_path(F.col("url"))
    out = urls.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    out = out.withColumn("by_host", _host_rule(F.col("host"), F.col("path"), host_rules))
    out = out.withColumn("by_pattern", F.when(F.col("by_host").isNull(), _pattern_verdict(F.coalesce("url", F.lit("")), filed)))
    verdict = F.coalesce(F.col("by_host.verdict"), F.when(F.col("by_pattern.allows") == F.lit(False), F.lit(BLOCK)), F.lit(ALLOW))
    return out.select("page_id", "host", "path", F.col("by_host.rule").alias("rule"), verdict.alias("verdict"), F.col("by_pattern.pattern").alias("pattern"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    """The same verdicts in SQL, every pattern tried on every URL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    hosts = ", ".join(f"({len(h + p)}, {quoted(h + p)}, {quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in HOST_RULES)
    patterns = ", ".join(f"({'true' if v == ALLOW else 'false'}, {quoted(p)}, {quoted(regex_of(p))})" for v, p in PATTERNS)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH host_rules(len, rule, verdict, host, path) AS (VALUES {hosts}),
patterns(allows, pattern, regex) AS (VALUES {patterns}),
split AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT n, page_id, {lower.format('url')} AS low, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
),
by_host AS (
  SELECT n, arg_max(r.rule, r.len) AS rule, arg_max(r.verdict, r.len) AS verdict FROM parts u JOIN host_rules r
  ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY n
),
by_pattern AS (
  SELECT n, max({{'allows': allows, 'pattern': pattern}}) AS best FROM parts u JOIN patterns p ON regexp_matches(u.low, p.regex) GROUP BY n
)
SELECT page_id, host, path, h.rule AS rule,
       coalesce(h.verdict, CASE WHEN p.best.allows = false THEN 'block' END, 'allow') AS verdict,
       CASE WHEN h.rule IS NULL THEN p.best.pattern END AS pattern
FROM parts LEFT JOIN by_host h USING (n) LEFT JOIN by_pattern p USING (n)
"""


SQL = _sql()
