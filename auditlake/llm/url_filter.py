"""URL filters: a blocked Bloom filter in front of an exact hash join.

The list holds canonical URLs and host rules (a host with its subdomains, and a path prefix). Every listed key
sets one bit in each word of one block of a Bloom filter, which has a block for every eight keys. A page asks for its
canonical URL and for its possible rules; what the filter passes is hash-joined exactly with the list, which removes
false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, read, spread

#: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Query parameters that do not change a page.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Hosts of junk: gambling, advertising, spam, pills and adult pages, by a whole word of a label (words end at `.`, `-` or the port; of spam the beginning is enough).
JUNK_HOST = r"(^|[.-])(casino|casinos|bet|bets|betting|ad|ads|spam[^.:-]*|pill|pills|adult|adults)([.:-]|$)"
#: Blocks of a filter that is sent whole to every executor, 40 bytes each; a larger one is dealt by block.
MAX_BLOCKS, WORDS = 65_536, 4


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without closing slashes, and the sorted query without tracking; no scheme, port 80 or 443, or fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)))
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    return F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def rule_keys(url: Column, rules: list) -> Column:
    """The rules that could fit: for every shape (labels of the host, length of the path) among the rules, one key."""
    shapes = sorted({(host.count(".") + 1, len(path)) for host, path, _ in rules})
    host, path = host_of(url), path_of(url)
    keys = [F.when(F.length(path) >= n, F.concat(F.lit("rule:"), F.substring_index(host, ".", -k), F.substring(path, 1, n))) for k, n in shapes]
    return F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bit_of(key: Column, word: int) -> Column:
    bit = F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit("bits"), key), 6 * word), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter's non-empty blocks: block and WORDS words of 64 bits; at most `blocks` rows."""
    return listed.groupBy(block_of(F.col("key"), blocks).alias("block")).agg(*[F.bit_or(bit_of(F.col("key"), i)).alias(f"w{i}") for i in range(WORDS)])


def url_verdicts(pages: DataFrame, listed_urls: DataFrame, rules: list = RULES, id_col: str = "page_id", url_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    `listed_urls` has a column `url`. The longest rule that fits decides; without one a page is blocked when its
    canonical URL is listed (also in another spelling) and allowed otherwise. A null url, or one without `://`, has
    an empty host and path, fits no rule and is not listed. `rules` is a list written by the caller. Repeated rows are judged once and returned as often as
    they came. Extra columns are not read.
    """
    rows = spread(cut(pages.groupBy(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).agg(F.count("*").alias("times"))))
    as_rules = pages.sparkSession.createDataFrame([(f"rule:{h}{p}", h + p, v) for h, p, v in rules], "key string, rule string, verdict string")
    as_urls = listed_urls.filter(F.col("url").contains("://")).select(F.concat(F.lit("url:"), canonical(F.col("url"))).alias("key")).distinct().select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    listed = cut(as_rules.unionByName(as_urls))
    blocks = max(16, listed.count() // 8)
    asked = F.concat(rule_keys(F.col("url"), rules), F.when(F.col("url").contains("://"), F.array(F.concat(F.lit("url:"), canonical(F.col("url"))))).otherwise(F.array().cast("array<string>")))
    keys = rows.select("page_id", "url", F.explode(asked).alias("key"))
    filter_ = bloom(listed, blocks)
    set_ = reduce(Column.__and__, [F.col(f"w{i}").bitwiseAND(bit_of(F.col("key"), i)) != 0 for i in range(WORDS)])
    # A filter of few blocks goes to every executor; of a longer list, keys and blocks meet by block.
    sent = F.broadcast(filter_) if blocks <= max_blocks else filter_.hint("shuffle_hash")
    passed = cut(keys.withColumn("block", block_of(F.col("key"), blocks)).join(sent, "block").filter(set_).select("page_id", "url", "key"))
    # Many pages ask for one rule, of which there are as many as the caller wrote down.
    is_rule = F.col("key").startswith("rule:")
    exact = passed.filter(is_rule).join(F.broadcast(as_rules), "key").unionByName(passed.filter(~is_rule).join(listed.filter(~is_rule).hint("shuffle_hash"), "key"))
    no_fit = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    fit = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("length"), "rule", "verdict"))
    found = rows.select("page_id", "url", "times", no_fit.alias("fit"), F.lit(False).alias("listed")).unionByName(exact.select("page_id", "url", F.lit(0).cast("long").alias("times"), fit.alias("fit"), F.col("rule").isNull().alias("listed")))
    best = found.groupBy("page_id", "url").agg(F.max("times").alias("times"), F.max("fit").alias("fit"), F.max("listed").alias("listed"))
    verdict = F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return best.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "listed", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_n")).drop("_n")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists the canonical URLs of all pages on hosts with a label that begins with `spam`."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, pages.filter(host_of(F.col("url")).rlike(r"(^|\.)spam")).select("url"))


def op3_url_filter_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists the canonical URLs of all pages on junk hosts (JUNK_HOST)."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, pages.filter(host_of(F.col("url")).rlike(JUNK_HOST)).select("url"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS query, coalesce(contains(url, '://'), false) AS whole FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept FROM p),
c AS (SELECT *, regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canon FROM q),
l AS (SELECT DISTINCT canon FROM c WHERE whole AND regexp_matches(host, '(^|\.)spam')),
r(h, pre, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT c.page_id, c.url, c.host, c.path, c.whole AND canon IN (SELECT canon FROM l) AS listed,
  (SELECT max({'n': length(h || pre), 'rule': h || pre, 'v': v}) FROM r WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, pre)) AS fit FROM c)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM f
"""
OP3_JUNK_SQL = OP3_SQL.replace(r"(^|\.)spam", JUNK_HOST)
