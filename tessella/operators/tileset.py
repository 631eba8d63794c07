"""Tilesets as DataFrames: archive layouts, copies with filters, lookups and merges.

The logical table has z, x, y (stored south-up), tile_data, which may be null, and tile_hash, the
upper-case MD5 of the data. Layouts are ways to lay it out in tables; every operator works on the
logical table, and a layout is put on at the end, so Catalyst sees one plan from scan to sink.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import tile_math as tm

KEY = ["z", "x", "y"]
LAYOUTS = ("flat", "flat_with_hash", "normalized", "dedup_id", "cache")
#: Metadata names that describe content and don't travel with copies of it.
AGG_HASH, BEFORE, AFTER = "agg_tiles_hash", "agg_tiles_hash_before_apply", "agg_tiles_hash_after_apply"


def md5_hex(data: Column | str) -> Column:
    return F.upper(F.md5(data))


@dataclass
class Tileset:
    """``tables`` by name as the layout has them, and ``metadata`` (name, value)."""

    layout: str
    tables: dict[str, DataFrame]
    metadata: DataFrame | None = field(default=None)
    #: The keys by themselves, where the source can read them without the data.
    keys: DataFrame | None = field(default=None)

    def tiles(self, how: str = "inner") -> DataFrame:
        """The logical table. ``how`` "left" keeps map rows without an image, as patches need."""
        t = self.tables
        if self.layout == "flat":
            return t["tiles"].select(*KEY, "tile_data")
        if self.layout == "flat_with_hash":
            return t["tiles_with_hash"].select(*KEY, "tile_data", "tile_hash")
        if self.layout == "normalized":
            return t["map"].join(t["images"], "tile_id", how).select(*KEY, "tile_data", F.col("tile_id").alias("tile_hash"))
        if self.layout == "dedup_id":
            return t["tiles_shallow"].join(t["tiles_data"], "tile_data_id", how).select(*KEY, "tile_data")
        if self.layout == "cache":
            return t["tile_cache"].select(*KEY, "tile_data")
        raise ValueError(f"unknown layout {self.layout}")

    def hashed(self, how: str = "inner") -> DataFrame:
        """``tiles`` with tile_hash, computed where the layout holds none."""
        rows = self.tiles(how)
        return rows if "tile_hash" in rows.columns else rows.withColumn("tile_hash", md5_hex("tile_data"))

    def coords(self) -> DataFrame:
        """Keys only; columnar tables and sources with ``keys`` read no data for them."""
        if self.keys is not None:
            return self.keys
        name = {"flat": "tiles", "flat_with_hash": "tiles_with_hash", "normalized": "map", "dedup_id": "tiles_shallow", "cache": "tile_cache"}[self.layout]
        return self.tables[name].select(*KEY)

    def get_tiles(self, coords: DataFrame, with_hash: bool = False) -> DataFrame:
        """The tiles at ``coords`` (z, x, y north-up); null data counts as no tile."""
        stored = coords.select("z", "x", tm.invert_y("z", "y").alias("y")).distinct()
        rows = (self.hashed() if with_hash else self.tiles().select(*KEY, "tile_data")).join(stored, KEY).filter("tile_data is not null")
        return rows.withColumn("y", tm.invert_y("z", "y"))

    def contains(self, coords: DataFrame) -> DataFrame:
        """Those of ``coords`` (north-up) that the key table holds."""
        stored = self.coords().select("z", "x", tm.invert_y("z", "y").alias("y"))
        return coords.join(stored, KEY, "left_semi")


def detect_layout(schemas: dict[str, list[str]]) -> str:
    """The layout of an archive by its tables' columns; further tables and columns don't matter."""
    key = {"zoom_level", "tile_column", "tile_row"}
    tests = [
        ("normalized", {"map": key | {"tile_id"}, "images": {"tile_id", "tile_data"}}),
        ("dedup_id", {"tiles_shallow": key | {"tile_data_id"}, "tiles_data": {"tile_data_id", "tile_data"}}),
        ("flat_with_hash", {"tiles_with_hash": key | {"tile_data", "tile_hash"}}),
        ("flat", {"tiles": key | {"tile_data"}}),
        ("cache", {"tile_cache": key | {"fetched", "expires", "etag", "tile_data"}}),
    ]
    for layout, needed in tests:
        if all(columns <= set(schemas.get(table, ())) for table, columns in needed.items()):
            return layout
    raise ValueError("the tables are of no known layout")


def to_layout(rows: DataFrame, layout: str, metadata: DataFrame | None = None) -> Tileset:
    """A tileset of ``layout`` from a logical table."""
    if layout == "flat":
        return Tileset(layout, {"tiles": rows.select(*KEY, "tile_data")}, metadata)
    if layout == "flat_with_hash":
        digest = F.col("tile_hash") if "tile_hash" in rows.columns else md5_hex("tile_data")
        return Tileset(layout, {"tiles_with_hash": rows.select(*KEY, "tile_data", digest.alias("tile_hash"))}, metadata)
    if layout == "dedup_id":
        ids = dedup_ids(rows)
        shallow = rows.withColumn("__hash", md5_hex("tile_data")).join(ids.select(F.col("tile_hash").alias("__hash"), "tile_data_id"), "__hash", "left")
        return Tileset(layout, {"tiles_shallow": shallow.select(*KEY, "tile_data_id"), "tiles_data": ids.select("tile_data_id", "tile_data")}, metadata)
    if layout == "normalized":
        digest = F.col("tile_hash") if "tile_hash" in rows.columns else md5_hex("tile_data")
        with_id = rows.withColumn("tile_id", digest)
        images = with_id.filter("tile_data is not null").select("tile_id", "tile_data").dropDuplicates(["tile_id"])
        return Tileset("normalized", {"map": with_id.select(*KEY, "tile_id"), "images": images}, metadata)
    if layout == "cache":
        stamps = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("fetched", "long"), ("expires", "long"), ("etag", "string"))]
        return Tileset(layout, {"tile_cache": rows.filter("tile_data is not null").select(*KEY, *stamps, "tile_data")}, metadata)
    raise ValueError(f"unknown layout {layout}")


def dedup_ids(rows: DataFrame) -> DataFrame:
    """(tile_hash, tile_data, tile_data_id): each distinct blob with a number from 1, in the order of the hashes.

    Hashes are counted by their first three digits, so a number follows from the counts of 4096 ranges and a place
    within one; no task orders all.
    """
    blobs = rows.filter("tile_data is not null").withColumn("tile_hash", md5_hex("tile_data")).dropDuplicates(["tile_hash"]).select("tile_hash", "tile_data")
    blobs = blobs.withColumn("range", F.substring("tile_hash", 1, 3))
    counts = blobs.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # 4096 rows at most
    place = F.row_number().over(Window.partitionBy("range").orderBy("tile_hash"))
    return blobs.withColumn("place", place).join(F.broadcast(before), "range").select("tile_hash", "tile_data", (F.col("before") + F.col("place")).cast("long").alias("tile_data_id"))


def numbered(rows: DataFrame, order: str, name: str, ranges: int = 256) -> DataFrame:
    """``rows`` with their number from 1 by ``order``: borders of ranges from a sample, counts of the ranges, a place within each.

    The borders decide only how rows are dealt, not their numbers; equal values of ``order`` are numbered in any way.
    Dealt anew, rows have other borders, as the sample is another; so dealt rows are kept in the session's cache, and
    counts and places are those of the same ranges.
    """
    spread = rows.repartitionByRange(ranges, order).withColumn("__range", F.spark_partition_id()).persist()
    bounds = spread.groupBy("__range").agg(F.min(order).alias("__low"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = bounds.select("__range", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return spread.withColumn("__place", place).join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")


def remap_ids(map_: DataFrame, ids: DataFrame) -> DataFrame:
    """``map_`` with its ids replaced by new ones: ``ids`` has tile_id and new_id."""
    return map_.join(ids.select(F.col("tile_id").cast("string").alias("old_id"), "new_id"), F.col("tile_id").cast("string") == F.col("old_id")).select(*KEY, F.col("new_id").alias("tile_id"))


def where(
    zooms: list[int] | None = None, min_zoom: int | None = None, max_zoom: int | None = None, boxes: list[tuple[float, float, float, float]] | None = None
) -> Column:
    """The rows a copy takes: a list of zooms goes before bounds; of several boxes any may hold the tile."""
    z = F.col("z")
    keep = F.lit(True)
    if zooms:
        keep = z.isin(list(zooms))
    else:
        keep = keep & (z >= min_zoom) if min_zoom is not None else keep
        keep = keep & (z <= max_zoom) if max_zoom is not None else keep
    if boxes:
        inside = F.lit(False)
        for box in boxes:
            inside = inside | tm.in_bbox("z", "x", "y", box)
        keep = keep & inside
    return keep


def copy(src: Tileset, layout: str | None = None, what: str = "all", **filters) -> Tileset:
    """A copy in ``layout`` (or the source's), of all, only "tiles" or only "metadata".

    Filters on z, x and y reach the scan of the key table, before any join with the data.
    """
    keep = where(**filters)
    narrowed = {k: t.filter(keep) if set(KEY) <= set(t.columns) else t for k, t in src.tables.items()}
    inner = Tileset(src.layout, narrowed, src.metadata)
    target = layout or src.layout
    keep_hash = "tile_hash" in inner.tiles().columns
    rows = inner.tiles() if keep_hash or target in ("flat", "cache") else inner.hashed()
    if what == "metadata":
        rows = rows.limit(0)
    meta = src.metadata.filter(~F.col("name").isin(AGG_HASH, BEFORE, AFTER)) if src.metadata is not None and what != "tiles" else None
    return to_layout(rows, target, meta)


def clustered(rows: DataFrame, partitions: int, *first: str) -> DataFrame:
    """``rows`` dealt by ranges and sorted along the Z-order curve of each zoom, so that near tiles share files and row groups."""
    place = tm.morton("x", "y")
    return rows.repartitionByRange(partitions, *first, "z", place).sortWithinPartitions(*first, "z", place)


def merge(dst: DataFrame, src: DataFrame, on_duplicate: str = "override") -> DataFrame:
    """``dst`` and ``src`` as one table: "override" lets src win, "ignore" dst, "abort" raises on any key that both have.

    Without a policy ("default") an empty ``dst`` is overridden, and any other raises.
    """
    if on_duplicate == "default":
        if not dst.isEmpty():
            raise ValueError("the target holds tiles; say what becomes of those that both have")
        on_duplicate = "override"
    if on_duplicate == "override":
        return dst.join(src.select(*KEY), KEY, "left_anti").unionByName(src)
    if on_duplicate == "ignore":
        return dst.unionByName(src.join(dst.select(*KEY), KEY, "left_anti"))
    if on_duplicate == "abort":
        clash = src.join(dst.select(*KEY), KEY, "left_semi").select(*KEY).limit(1).collect()
        if clash:
            raise ValueError(f"tile {tuple(clash[0])} is there already")
        return dst.unionByName(src)
    raise ValueError(f"unknown policy {on_duplicate}")


def conflicts(dst: DataFrame, src: DataFrame) -> DataFrame:
    """Keys that both have with different data."""
    other = dst.select(*KEY, F.col("tile_data").alias("held"))
    return src.join(other, KEY).filter(~F.col("tile_data").eqNullSafe(F.col("held"))).select(*KEY)


def upsert_metadata(metadata: DataFrame, rows: dict[str, str | None]) -> DataFrame:
    """``metadata`` with the names of ``rows`` set, or gone where the value is None."""
    spark = metadata.sparkSession
    kept = metadata.filter(~F.col("name").isin(list(rows)))
    new = [(k, v) for k, v in rows.items() if v is not None]
    return kept.unionByName(spark.createDataFrame(new, "name string, value string")) if new else kept
