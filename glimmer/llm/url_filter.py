"""URL filtering by host and path rules, in DataFrame functions only.

Every URL is expanded into expressions ``host suffix + path prefix``; the short prefix of
each expression's SHA-256 is equi-joined with the rules' prefixes, survivors are confirmed
by the full digest, and the longest confirmed rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Rules of the registered query: action, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Rule tables up to this many rows are broadcast (about 100 bytes each); larger ones are shuffled.
BROADCAST_RULES = 20_000
#: Hex digits of the digest that are joined on.
PREFIX_DIGITS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    tail = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1), F.lit(""))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_suffixes(host: Column) -> Column:
    """The host and every suffix of it that starts after a dot."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to ``pages``.

    ``rules`` has action, host and path; a rule fits its host and all subdomains where the
    URL's path starts with the rule's path. The longest rule (host plus path, then the longer
    host, then block before allow) wins; without one, rule is null and verdict is ``default``.

    Null and malformed URLs get empty host and path, fit no rule and keep their row. Repeated
    rows are kept, each judged alike. Long paths cost no more than short ones: a prefix is
    built only for each length that a rule's path has. Columns of the input named like an
    output column are replaced. Each distinct URL is judged once and joined back.
    """
    sizes = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths")).first()
    listed = rules.select(
        F.col("action").alias("_action"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("_host_length"),
    ).where("rule is not null").withColumn("_digest", F.sha2(F.concat(F.lit("u:"), "rule"), 256))
    listed = listed.withColumn("_key", F.substring("_digest", 1, PREFIX_DIGITS))
    if sizes["n"] <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col(url))
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), host.alias("host"), path.alias("path"))
    lengths = sorted(int(n) for n in sizes["lengths"] if n is not None)
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    expressions = F.flatten(F.transform(
        host_suffixes(F.col("host")),
        lambda h: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(h, p)),
    ))
    found = (
        base.select("host", "path").distinct()
        .select("host", "path", F.explode(expressions).alias("_expression"))
        .withColumn("_full", F.sha2(F.concat(F.lit("u:"), "_expression"), 256))
        .withColumn("_key", F.substring("_full", 1, PREFIX_DIGITS))
        .join(listed, "_key")
        .where(F.col("_full") == F.col("_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            F.length("rule").alias("n"), "_host_length", (F.col("_action") == "block").alias("b"), "rule", "_action",
        )).alias("_best"))
        .select("host", "path", F.col("_best.rule").alias("rule"), F.col("_best._action").alias("_action"))
    )
    return base.join(found, ["host", "path"], "left").select(
        *[F.col("_row").getField(c).alias(c) for c in kept], "host", "path", "rule", F.coalesce("_action", F.lit(default)).alias("verdict")
    )


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(tail, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages)
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), judged AS (
  SELECT p.page_id, p.host, p.path,
         (SELECT max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, action := action))
          FROM rules WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS best
  FROM parts p
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM judged
"""

QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {"op8_url_filter": SQL}
