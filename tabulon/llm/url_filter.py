"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

A listed entry is (host, path, verdict): it fits its host and every subdomain of it, and every path that
starts with its path. A URL probes the filter with one key for each *shape* (number of host labels, length
of path) that occurs in the list, so the number of probes depends on the list and not on the URL's length.
Everything is built-in column code; only the filter is broadcast, and only if it is within
common.BROADCAST_BYTES - else it is joined by block number like any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, maybe_broadcast, table

WORDS, BITS_PER_KEY = 4, 16


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z
    lower-cased; path goes on up to `?`, `#` or the end. Null, or no `://`: both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n_blocks))


def _mask(key: Column, word: int) -> Column:
    """Two bits of one 64-bit word of the key's block."""
    h = F.xxhash64(F.lit("bits"), key)
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return one(12 * word).bitwiseOR(one(12 * word + 6))


def build_filter(listed: DataFrame, n_listed: int) -> tuple[DataFrame, int]:
    """The filter as rows (block, w0..w3), and its number of blocks. Each block has 256 bits, of which a key sets up to 8."""
    n_blocks = max(1, -(-n_listed * BITS_PER_KEY // (64 * WORDS)))
    key = F.concat("rule_host", "rule_path")
    masks = [_mask(key, w).alias(f"m{w}") for w in range(WORDS)]
    rows = listed.select(_block(key, n_blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)])
    return rows, n_blocks


def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict of each URL.

    listed: rows (host, path, verdict); of one (host, path) listed twice the greatest verdict holds; rows with a
    null host or path take no part. The longest fitting rule wins, by length of host plus path, then by text; with
    none, rule is null and verdict is `default`. A null or empty URL, or one without `://`, has empty host and path
    and fits nothing. Repeated rows stay, each with the same verdict. Columns of `pages` named like the new ones
    are replaced.
    """
    new = ["host", "path", "rule", "verdict"]
    host, path = url_parts(F.col(url))
    kept = [c for c in pages.columns if c not in new]
    # all columns of its own have names that begin with __url_
    u = pages.withColumns({"__url_host": host, "__url_path": path}).select(*[F.col(f"`{c}`") for c in kept], "__url_host", "__url_path")
    named = [F.col(f"`{c}`") for c in kept]
    h, p, key = F.col("__url_host"), F.col("__url_path"), F.concat("rule_host", "rule_path")
    rules = listed.where("host is not null and path is not null").groupBy(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
    # a driver-side list of the shapes: at most 255 host labels times the distinct path lengths
    shapes = rules.select(F.size(F.split("rule_host", "\\.")).alias("nl"), F.length("rule_path").alias("pl")).distinct().collect()
    n_rules, n_bytes = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("rule_host") + F.length("rule_path") + 64), F.lit(0))).first()
    if not shapes:
        return u.select(*named, h.alias("host"), p.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    bloom, n_blocks = build_filter(rules, n_rules)
    # one literal for all shapes, of which a URL takes those that it is long enough for
    every = F.array(*[F.struct(F.lit(s.nl).alias("nl"), F.lit(s.pl).alias("pl")) for s in sorted(shapes)])
    fitting = F.filter(every, lambda s: (s.nl <= F.size(F.split(h, "\\."))) & (s.pl <= F.length(p)))
    probes = F.transform(fitting, lambda s: F.struct(F.call_function("substring_index", h, F.lit("."), -s.nl).alias("rule_host"), F.substr(p, F.lit(1), s.pl).alias("rule_path")))
    urls = u.select(h, p).where(h != "").select(h, p, F.explode(probes).alias("c")).select(h, p, "c.*")
    possible = urls.withColumn("block", _block(key, n_blocks)).join(maybe_broadcast(bloom, n_blocks * 64), "block")
    for w in range(WORDS):
        possible = possible.where(F.col(f"w{w}").bitwiseAND(_mask(key, w)) == _mask(key, w))
    exact = possible.select(h, p, "rule_host", "rule_path").distinct().join(rules if n_bytes > BROADCAST_BYTES else F.broadcast(rules), ["rule_host", "rule_path"])
    best = exact.groupBy(h, p).agg(F.max(F.struct(F.length(key).alias("n"), key.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("__url_best"))
    out = u.join(best, ["__url_host", "__url_path"], "left")
    return out.select(*named, h.alias("host"), p.alias("path"), F.col("__url_best.rule").alias("rule"), F.coalesce("__url_best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP10_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*', 0) AS h0 FROM rest),
u AS (SELECT page_id, translate(h0, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(r, length(h0) + 1), '^[^?#]*', 0) AS path FROM h),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
d AS (SELECT DISTINCT host, path FROM u),
best AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
         FROM d JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT u.page_id, u.host, u.path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""
