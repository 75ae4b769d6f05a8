"""URL filter: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

Every URL is expanded into ``host suffix + path prefix`` expressions. Only as many host labels and only those
path lengths are expanded that some rule has, so the number of expressions of a URL is bounded by the rules. Expressions meet
the rules in an equi-join on the first four bytes of a SHA-256; the whole digest then confirms, and the longest rule wins.

The work is done once for each distinct URL. A null URL, or one without ``://``, has an empty host and path and meets no rule;
empty tables give empty results; repeated rows each get their verdict; columns other than the key and URL are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, small

#: The rules that the query applies: (verdict, host, path).
QUERY_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def match_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``(url, rule, verdict)`` of each distinct URL that some rule fits.

    ``rules`` has verdict, host and path; a rule fits its host and all subdomains if the URL's path starts with the rule's. The
    longest rule wins; of equally long ones (the same host and path twice) the smaller verdict, ``allow`` before ``block``.
    """
    rules = rules.select(
        ascii_lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where("r_host is not null and r_path is not null")
    shape = rules.agg(
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")
    ).first()
    labels, lengths = shape["labels"] or 0, sorted(shape["lengths"])
    keyed = rules.withColumns({"rule": F.concat("r_host", "r_path")}).withColumns(
        {"digest": F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)}
    )
    keyed = keyed.groupBy("digest", "rule").agg(F.min("r_verdict").alias("verdict"), F.max(F.length("rule")).alias("size"))
    keyed = keyed.select(F.substring("digest", 1, PREFIX_HEX).alias("prefix"), "digest", "rule", "verdict", "size")

    url = F.col(url_col)
    distinct = urls.where(url.isNotNull()).select(url.alias("url")).distinct()
    parts = distinct.select("url", F.split(url_host(F.col("url")), r"\.").alias("names"), url_path(F.col("url")).alias("path"))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size("names"), F.lit(max(labels, 1)))),
        lambda n: F.array_join(F.slice("names", F.size("names") - n + 1, n), "."),
    )
    starts = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(starts, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", s, p), 256))))
    probes = parts.select("url", F.explode(expressions).alias("probe")).select(
        "url", "probe", F.substring("probe", 1, PREFIX_HEX).alias("probe_prefix")
    )
    hits = probes.join(small(keyed), F.col("probe_prefix") == F.col("prefix")).where("probe = digest")
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct("size", "digest")).alias("best"))
    return best.select("url", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(key, host, path, rule, verdict)`` of every row; ``default`` is the verdict where no rule fits."""
    rows = pages.select(F.col(key).alias("row_key"), F.col(url_col).alias("row_url"))
    matched = match_urls(pages, rules, url_col)
    joined = rows.join(matched, F.col("row_url") == F.col("url"), "left")
    return joined.select(
        F.col("row_key").alias(key),
        url_host(F.col("row_url")).alias("host"),
        url_path(F.col("row_url")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, rules_frame(spark, QUERY_RULES))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE
      translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE
      regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (
  SELECT p.page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

QUERIES = {"op8_url_rules": op8_url_rules}
SQL = {"op8_url_rules": OP8_SQL}
