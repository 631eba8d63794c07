"""URL allow/block rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the registered query: (action, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Rule tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    whole = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    slash = F.locate("/", whole)
    return F.when(slash > 0, whole.substr(slash, F.length(whole))).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # A NUL parts host and path; neither side can shift characters across it.
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keys: tuple[str, ...] = ("page_id",),
    default: str = "allow",
    prefix_hex: int = 8,
) -> DataFrame:
    """``keys``, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has action (allow or block), host and path. A rule fits its host and all subdomains when
    the url's path starts with the rule's path. The longest host wins, then the longest path, then
    block before allow. Each url is expanded into (host suffix, path prefix) expressions; those join the
    rules on the first ``prefix_hex`` hex digits of a SHA-256 digest, and full digests confirm.

    Null urls and urls without ``://`` have an empty host and path, and so the default verdict unless a
    rule names the empty host. Rules with a null field are left out; repeated rules count once. Repeated rows of ``pages`` give
    repeated rows. Other columns of either table don't matter. Empty tables give empty results, or the
    default verdict throughout. The distinct path lengths of the rules are gathered on the driver: they
    are as many as the longest rule path has characters, at most.
    """
    rules = rules.select("action", "host", "path").dropna().dropDuplicates()
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    # Before the join, one row a rule expression: block stands before allow.
    table = (
        rules.groupBy("host", "path")
        .agg(F.max("action").alias("action"))
        .select(
            _digest(F.col("host"), F.col("path")).alias("digest"),
            F.concat("host", "path").alias("rule"),
            "action",
            F.length("host").alias("host_len"),
            F.length("path").alias("path_len"),
        )
        .withColumn("short", F.substring("digest", 1, prefix_hex))
    )
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        table = F.broadcast(table)
    wanted = [F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]
    # Each distinct url is judged once, however often it occurs.
    urls = pages.select(F.col(url).alias("url")).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    parts = (
        urls.select("url", "path", fitting.alias("cuts"), F.explode(suffixes).alias("suffix"))
        .select("url", "suffix", "path", F.explode("cuts").alias("cut"))
        .select("url", _digest(F.col("suffix"), F.col("path").substr(F.lit(1), F.col("cut"))).alias("full"))
        .withColumn("short", F.substring("full", 1, prefix_hex))
    )
    best = (
        parts.join(table, "short")
        .filter(F.col("full") == F.col("digest"))
        .groupBy("url")
        .agg(F.max(F.struct("host_len", "path_len", "action", "rule")).alias("best"))
    )
    rows = pages.select(*wanted, F.col(url).alias("url"))
    host, path = F.coalesce(host_of(F.col("url")), F.lit("")), F.coalesce(path_of(F.col("url")), F.lit(""))
    return (
        rows.join(best, "url", "left")
        .select(
            *[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)],
            host.alias("host"),
            path.alias("path"),
            F.col("best.rule").alias("rule"),
            F.coalesce("best.action", F.lit(default)).alias("verdict"),
        )
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


_VALUES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
ORACLE = f"""
WITH rules(action, rhost, rpath) AS (VALUES {_VALUES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hits AS (SELECT k, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY k ORDER BY length(rhost) DESC, length(rpath) DESC, action DESC) AS n
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM hits WHERE n = 1) h USING (k)
"""
