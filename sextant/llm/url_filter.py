"""URL filters: rules on host suffixes and path prefixes, found by hash.

A URL expands into (host suffix, path prefix) expressions; these meet the
rules in an equi-join on a short hash prefix, the full digest confirms the
expression, and the longest confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, small_or_shuffled, stage, unused

#: Hex digits of the short hash (32 bits).
SHORT = 8

RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def _folder(path: Column) -> Column:
    """The path up to its last slash, included."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains
    if the URL's path starts with the rule's path. The longest rule string
    (host and path) wins; equally long ones go to the longer host, then to
    ``block``. No rule: ``rule`` is null, ``verdict`` is ``default``. Null
    URLs and those without ``://`` have empty host and path and meet no rule
    but one of empty host. URLs of any length are read whole. Null rule parts
    are dropped; repeated rules count once; without rules all get ``default``.
    Columns of ``pages`` called like the added ones are replaced; rows, repeated
    ones too, are neither lost nor multiplied; an empty table gives an empty one.
    Rules may be many: they are broadcast only if measured small, else both
    sides are shuffled by the short hash. URLs meet them once per distinct
    (host, path), so repeated hosts cost little. The decided ones are staged:
    the last join is between plain shuffles, whose hot keys AQE splits, and
    rows without a host pass it by unless a rule has an empty host.
    """
    rules = rules.dropna().dropDuplicates()
    shape = rules.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.max(F.regexp_count("path", F.lit("/"))).alias("slashes"),
        F.coalesce(F.bool_or(F.col("host") == ""), F.lit(False)).alias("hostless"),
    ).first()
    pages = pages.drop(*(c for c in ("host", "path", "rule", "verdict") if c in pages.columns and c != url_col))
    located = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if not shape["n"]:
        return located.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    # Host suffixes of 1 .. n labels and path prefixes up to the 0th .. nth slash;
    # no rule reaches beyond these many, so no expression does.
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"]))),
        lambda k: F.array_join(F.slice(labels, -k, k), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.regexp_count("path", F.lit("/")), F.lit(shape["slashes"]))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"), F.lit("/"))),
    )
    met = F.lit(True) if shape["hostless"] else F.col("host") != ""
    spots = located.where(met).select("host", "path").distinct()
    expressions = (
        spots.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("digest", 1, SHORT))
        .select("host", "path", "digest", "short")
    )
    indexed = rules.select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"),
        _digest(F.col("host"), _folder(F.col("path"))).alias("r_digest"),
    ).withColumn("short", F.substring("r_digest", 1, SHORT))
    indexed, _ = stage(indexed, "url-rules")
    decided = (
        expressions.join(small_or_shuffled(indexed), "short")
        .where((F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"),
                    (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
                )
            ).alias("won")
        )
    )
    d_host, d_path = unused("d_host", located.columns), unused("d_path", located.columns)
    decided, _ = stage(decided.select(F.col("host").alias(d_host), F.col("path").alias(d_path), F.col("won.rule").alias("rule"), F.col("won.verdict").alias("verdict")), "url-decided")
    judged = located.where(met).join(decided, (F.col("host") == F.col(d_host)) & (F.col("path") == F.col(d_path)), "left").drop(d_host, d_path)
    rest = located.where(~met).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    return judged.unionByName(rest).withColumn("verdict", F.coalesce("verdict", F.lit(default)))


#: The rules of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every ``pages`` url, under five rules. Null urls and
    such without a scheme have an empty host and path and get the default; see ``filter_urls``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH p AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT p.host, p.path, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
  FROM (SELECT DISTINCT host, path FROM p) p
  JOIN r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)
  GROUP BY p.host, p.path)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
