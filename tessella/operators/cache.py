"""Tile caches with expiry: upsert, revalidate, purge and evict, as new versions of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tileset import KEY

COLUMNS = [*KEY, "fetched", "expires", "etag", "tile_data"]


def lookup(cache: DataFrame, coords: DataFrame, now: Column | int) -> DataFrame:
    """Entries at ``coords`` with ``fresh``; empty data is a known absence, not a miss."""
    now = F.lit(now) if isinstance(now, int) else now
    return cache.join(coords.select(*KEY).distinct(), KEY).withColumn("fresh", F.col("expires").isNull() | (F.col("expires") >= now))


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    return cache.join(new.select(*KEY), KEY, "left_anti").select(*COLUMNS).unionByName(new.select(*COLUMNS))


def touch(cache: DataFrame, stamps: DataFrame) -> DataFrame:
    """Entries of ``stamps`` (key, fetched, expires, etag) get its values; their data stay."""
    new = stamps.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in ("fetched", "expires", "etag")], F.lit(True).alias("hit"))
    pick = lambda c: F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return cache.join(new, KEY, "left").select(*KEY, pick("fetched"), pick("expires"), pick("etag"), "tile_data")


def zoom_bounds(own_min: Column, own_max: Column, other_min: Column, other_max: Column, disabled: Column) -> Column:
    """Struct (minzoom, maxzoom) of what is cached: a source's own bounds, each filled in from the other's; disabled is the empty range."""
    pick = lambda own, other, none: F.when(disabled, F.lit(none)).otherwise(F.coalesce(own, other)).cast("int")
    return F.struct(pick(own_min, other_min, 255).alias("minzoom"), pick(own_max, other_max, 0).alias("maxzoom"))


def within(z: Column, bounds: Column) -> Column:
    """Whether tiles of zoom ``z`` are cached; a bound that is null is none."""
    return F.coalesce(z >= bounds["minzoom"], F.lit(True)) & F.coalesce(z <= bounds["maxzoom"], F.lit(True))


def expired(cache: DataFrame, now: Column | int) -> DataFrame:
    now = F.lit(now) if isinstance(now, int) else now
    return cache.filter(F.col("expires").isNotNull() & (F.col("expires") < now))


def purge(cache: DataFrame, now: Column | int) -> DataFrame:
    now = F.lit(now) if isinstance(now, int) else now
    return cache.filter(F.col("expires").isNull() | (F.col("expires") >= now))


def evict(cache: DataFrame, most_bytes: int) -> DataFrame:
    """What is left when the entries that expire first go until ``most_bytes`` of data remain; entries without expiry go last.

    Bytes are summed a second of expiry first; which second the budget ends in follows from those sums.
    Its entries, maybe all that have no expiry, are summed by zoom and then by column in the same way, so
    only one column's entries are ordered one by one.
    """
    size = F.octet_length("tile_data").cast("long")
    rows = cache.select(*COLUMNS, F.coalesce("expires", F.lit((1 << 63) - 1)).alias("second"), size.alias("size"), F.lit(0).cast("long").alias("beyond"))
    out = []
    for by in ("second", "z", "x"):
        later = _suffix_sums(rows.groupBy(F.col(by).cast("long").alias("at")).agg(F.sum("size").alias("bytes")))
        placed = rows.join(later.withColumnRenamed("at", by), by).withColumn("beyond", F.col("beyond") + F.col("after"))
        out.append(placed.filter(F.col("beyond") + F.col("bytes") <= most_bytes).select(*COLUMNS))
        rows = placed.filter((F.col("beyond") < most_bytes) & (F.col("beyond") + F.col("bytes") > most_bytes)).drop("bytes", "after")
    w = Window.partitionBy("second", "z", "x").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, 0)
    out.append(rows.withColumn("held", F.sum("size").over(w) + F.col("beyond")).filter(F.col("held") <= most_bytes).select(*COLUMNS))
    return reduce(DataFrame.unionByName, out)


def _suffix_sums(sums: DataFrame, width: int = 1 << 12) -> DataFrame:
    """at, bytes and ``after``: the bytes of all higher ``at``, by blocks of these, then blocks of blocks."""
    low = sums.withColumn("b1", F.expr(f"at div {width}")).withColumn("b2", F.expr(f"at div {width * width}"))

    def after(df: DataFrame, part: list[str], by: str, value: str, name: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))

    one = after(low, ["b1"], "at", "bytes", "a1")
    mid = after(low.groupBy("b2", "b1").agg(F.sum("bytes").alias("s1")), ["b2"], "b1", "s1", "a2").select("b1", "a2")
    top = low.groupBy("b2").agg(F.sum("bytes").alias("s2"))
    # Blocks of 2^24 seconds or columns: a few dozen, and one for no expiry.
    top = after(top.withColumn("all", F.lit(1)), ["all"], "b2", "s2", "a3").select("b2", "a3")
    joined = one.join(mid, "b1").join(F.broadcast(top), "b2")
    return joined.select("at", "bytes", (F.col("a1") + F.col("a2") + F.col("a3")).alias("after"))
