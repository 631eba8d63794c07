"""Tilesets and features derived from the test tables, the same in Spark and in SQL.

Orders become tiles: a tile's key follows from the order's numbers, and its data are a text of few
distinct values, so that layouts with shared data have something to share. Events become points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every SQL text of the queries may begin with these.
SQL_TILES = """
WITH base AS (
  SELECT CAST(2 + o_orderkey % 9 AS INTEGER) AS z, o_custkey * 31 % (1 << (2 + o_orderkey % 9)) AS x,
    (o_orderkey * 7 + o_custkey) % (1 << (2 + o_orderkey % 9)) AS y, o_orderpriority || '/' || o_orderstatus AS d
  FROM orders),
v1 AS (SELECT z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, max(d) AS d FROM base GROUP BY z, x, y),
v2 AS (SELECT z, x, y, CASE WHEN (x * 3 + y) % 7 = 0 THEN d || '/v2' ELSE d END AS d FROM v1 WHERE (x + y) % 11 <> 0
  UNION ALL SELECT CAST(z + 10 AS INTEGER), x, y, d FROM v1 WHERE (x + y) % 13 = 0)
"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version: z, x, y, tile_data."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    z = (F.col("o_orderkey") % 9 + 2).cast("int")
    side = F.call_function("shiftleft", F.lit(1).cast("long"), z)
    key = orders.select(
        z.alias("z"),
        (F.col("o_custkey") * 31 % side).alias("x"),
        ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % side).alias("y"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("d"),
    )
    return key.groupBy("z", "x", "y").agg(F.max("d").cast("binary").alias("tile_data"))


def tiles_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version: some tiles gone, some changed, some new."""
    v1 = tiles(spark, sf_dir)
    changed = F.when((F.col("x") * 3 + F.col("y")) % 7 == 0, F.concat("tile_data", F.lit(b"/v2"))).otherwise(F.col("tile_data"))
    kept = v1.filter((F.col("x") + F.col("y")) % 11 != 0).withColumn("tile_data", changed)
    new = v1.filter((F.col("x") + F.col("y")) % 13 == 0).withColumn("z", (F.col("z") + 10).cast("int"))
    return kept.unionByName(new)


#: Longitude and latitude of an event, in thousandths of a degree.
SQL_POINTS = "SELECT event_id AS id, (event_id * 7919 % 360000 - 180000) / 1000.0 AS lng, (user_id * 104729 % 170000 - 85000) / 1000.0 AS lat, event_type, value, ts FROM events"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        ((F.col("event_id") * 7919 % 360000 - 180000) / 1000.0).alias("lng"),
        ((F.col("user_id") * 104729 % 170000 - 85000) / 1000.0).alias("lat"),
        "event_type",
        "value",
        "ts",
    )


def metadata(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    """Nations as names and values; the second version lacks some, changes some and adds regions."""
    n = read(spark, sf_dir, "nation")
    if version == 1:
        return n.select(F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("value"))
    value = F.concat(F.lit("r"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")).cast("string"))
    kept = n.filter(F.col("n_nationkey") % 5 != 0).select(F.col("n_name").alias("name"), value.alias("value"))
    return kept.unionByName(read(spark, sf_dir, "region").select(F.concat(F.lit("region "), "r_name").alias("name"), F.lit("new").alias("value")))


SQL_METADATA = """
WITH m1 AS (SELECT n_name AS name, 'r' || n_regionkey AS value FROM nation),
m2 AS (SELECT n_name AS name, 'r' || CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS value FROM nation WHERE n_nationkey % 5 <> 0
  UNION ALL SELECT 'region ' || r_name, 'new' FROM region)
"""
