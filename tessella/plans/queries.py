"""The engine's registered queries over the test tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import codecs
from tessella.functions import geometry as geo
from tessella.functions import tile_math as tm
from tessella.operators import cache, catalog, checks, composite, patch, ranges, tileset, transcode, vector
from tessella.operators import metadata as meta
from tessella.operators.tileset import KEY

from . import tables
from .tables import SQL_METADATA, SQL_POINTS, SQL_TILES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _text(c: str = "tile_data"):
    return F.col(c).cast("string").alias(c)


# --- summaries and hashes ---


@query(SQL_TILES + """SELECT z, count(*) AS tile_count, min(strlen(d)) AS min_size, max(strlen(d)) AS max_size, round(avg(strlen(d)), 6) AS avg_size,
min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v1 GROUP BY z""")  # fmt: skip
def summary_by_zoom(spark: SparkSession, sf: str) -> DataFrame:
    return checks.summary(tables.tiles(spark, sf)).withColumn("avg_size", F.round("avg_size", 6))


_LAT = "degrees(atan(sinh({0} / 6378137.0)))"


@query(SQL_TILES + f""", q AS (SELECT z, count(*) AS n, min(strlen(d)) AS a, max(strlen(d)) AS b, avg(strlen(d)) AS m, min(x) AS x0, max(x) AS x1,
(1 << z) - 1 - max(y) AS y0, (1 << z) - 1 - min(y) AS y1, {tm.EARTH} / (1 << z) AS s FROM v1 GROUP BY z)
SELECT CAST(sum(n) AS BIGINT) AS tile_count, min(a) AS min_size, max(b) AS max_size, round(sum(m * n) / sum(n), 6) AS avg_size, min(z) AS min_zoom, max(z) AS max_zoom,
round(min(degrees((x0 * s - {tm.EARTH} / 2) / {tm.RADIUS!r})), 6) AS min_lng, round(min(degrees(atan(sinh(({tm.EARTH} / 2 - (y1 + 1) * s) / {tm.RADIUS!r})))), 6) AS min_lat,
round(max(degrees(((x1 + 1) * s - {tm.EARTH} / 2) / {tm.RADIUS!r})), 6) AS max_lng, round(max(degrees(atan(sinh(({tm.EARTH} / 2 - y0 * s) / {tm.RADIUS!r})))), 6) AS max_lat FROM q""")  # fmt: skip
def summary_total(spark: SparkSession, sf: str) -> DataFrame:
    out = checks.summary_all(tables.tiles(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_size", "min_lng", "min_lat", "max_lng", "max_lat")})


@query(SQL_TILES + "SELECT upper(md5(string_agg(z || '' || x || '' || y || d, '' ORDER BY z, x, y))) AS agg_tiles_hash FROM v1")
def agg_tiles_hash(spark: SparkSession, sf: str) -> DataFrame:
    return checks.agg_tiles_hash(tables.tiles(spark, sf))


@query(SQL_TILES + """, b AS (SELECT z, x >> 8 AS kx, y >> 8 AS ky, md5(string_agg(x || ':' || y || ':' || md5(d), ',' ORDER BY x, y)) AS h FROM v1 GROUP BY ALL)
SELECT z, count(*) AS n_blocks, upper(md5(md5(md5(string_agg(h, ',' ORDER BY kx, ky))))) AS hash FROM b GROUP BY z""")  # fmt: skip
def tree_hash(spark: SparkSession, sf: str) -> DataFrame:
    return checks.tree_hash(tables.tiles(spark, sf))


# --- copies, layouts, lookups ---


@query(SQL_TILES + "SELECT z, x, y, d AS tile_data FROM v1 WHERE z IN (3, 5, 8)")
def copy_zoom_list(spark: SparkSession, sf: str) -> DataFrame:
    src = tileset.to_layout(tables.tiles(spark, sf), "flat")
    return tileset.copy(src, zooms=[3, 5, 8], min_zoom=9).tiles().select(*KEY, _text())


@query(SQL_TILES + "SELECT z, x, y, upper(md5(d)) AS tile_hash, d AS tile_data FROM v1 WHERE z BETWEEN 4 AND 7")
def copy_zoom_range_hashed(spark: SparkSession, sf: str) -> DataFrame:
    src = tileset.to_layout(tables.tiles(spark, sf), "flat")
    return tileset.copy(src, "flat_with_hash", min_zoom=4, max_zoom=7).tiles().select(*KEY, _text(), "tile_hash")


_BOXES = [(-120.0, -10.0, 30.0, 60.0), (100.0, -45.0, 160.0, -5.0)]
_BOX_SQL = " OR ".join(
    f"(x * (1 << (30 - z)) BETWEEN {a} AND {c} AND y * (1 << (30 - z)) BETWEEN {(1 << 30) - 1 - d} AND {(1 << 30) - 1 - b})" for a, b, c, d in (ranges.bbox_to_range(*box, 30) for box in _BOXES)
)


@query(SQL_TILES + f"SELECT z, x, y, d AS tile_data FROM v1 WHERE {_BOX_SQL}")
def copy_bbox(spark: SparkSession, sf: str) -> DataFrame:
    src = tileset.to_layout(tables.tiles(spark, sf), "flat")
    return tileset.copy(src, boxes=_BOXES).tiles().select(*KEY, _text())


@query(SQL_TILES + "SELECT DISTINCT upper(md5(d)) AS tile_id, d AS tile_data FROM v1")
def normalized_images(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.to_layout(tables.tiles(spark, sf), "normalized").tables["images"].select("tile_id", _text())


@query(SQL_TILES + "SELECT z, x, y, d AS tile_data, upper(md5(d)) AS tile_hash FROM v1")
def normalized_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.to_layout(tables.tiles(spark, sf), "normalized").tiles().select(*KEY, _text(), "tile_hash")


@query(SQL_TILES + """ SELECT z, x, y, d AS tile_data FROM v1""")
def dedup_id_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.tiles(spark, sf)
    ids = rows.withColumn("tile_data_id", F.xxhash64("tile_data"))
    src = tileset.Tileset("dedup_id", {"tiles_shallow": ids.select(*KEY, "tile_data_id"), "tiles_data": ids.select("tile_data_id", "tile_data").dropDuplicates(["tile_data_id"])})
    return src.tiles().select(*KEY, _text())


_COORDS_SQL = "coords AS (SELECT DISTINCT CAST(2 + c_custkey % 9 AS INTEGER) AS z, c_custkey * 31 % (1 << (2 + c_custkey % 9)) AS x, c_custkey * 17 % (1 << (2 + c_custkey % 9)) AS y FROM customer)"


def _coords(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.read(spark, sf, "customer").select("c_custkey")
    z = (F.col("c_custkey") % 9 + 2).cast("int")
    return c.select(z.alias("z"), (F.col("c_custkey") * 31 % tm.side(z)).alias("x"), (F.col("c_custkey") * 17 % tm.side(z)).alias("y")).distinct()


@query(SQL_TILES + f", {_COORDS_SQL} SELECT c.z, c.x, c.y, d AS tile_data, upper(md5(d)) AS tile_hash FROM coords c JOIN v1 ON v1.z = c.z AND v1.x = c.x AND v1.y = (1 << c.z) - 1 - c.y")
def get_tiles(spark: SparkSession, sf: str) -> DataFrame:
    src = tileset.to_layout(tables.tiles(spark, sf), "flat")
    return src.get_tiles(_coords(spark, sf), with_hash=True).select(*KEY, _text(), "tile_hash")


@query(SQL_TILES + f", {_COORDS_SQL} SELECT z, x, y FROM coords c WHERE EXISTS (SELECT 1 FROM v1 WHERE v1.z = c.z AND v1.x = c.x AND v1.y = (1 << c.z) - 1 - c.y)")
def contains_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.to_layout(tables.tiles(spark, sf), "normalized").contains(_coords(spark, sf))


@query(SQL_TILES + "SELECT z, x, y, d AS tile_data FROM v2 UNION ALL SELECT z, x, y, d FROM v1 WHERE NOT EXISTS (SELECT 1 FROM v2 WHERE v2.z = v1.z AND v2.x = v1.x AND v2.y = v1.y)")
def merge_override(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.merge(tables.tiles(spark, sf), tables.tiles_v2(spark, sf), "override").select(*KEY, _text())


@query(SQL_TILES + "SELECT z, x, y, d AS tile_data FROM v1 UNION ALL SELECT z, x, y, d FROM v2 WHERE NOT EXISTS (SELECT 1 FROM v1 WHERE v2.z = v1.z AND v2.x = v1.x AND v2.y = v1.y)")
def merge_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.merge(tables.tiles(spark, sf), tables.tiles_v2(spark, sf), "ignore").select(*KEY, _text())


@query(SQL_TILES + "SELECT v2.z, v2.x, v2.y FROM v1 JOIN v2 USING (z, x, y) WHERE v1.d <> v2.d")
def merge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.conflicts(tables.tiles(spark, sf), tables.tiles_v2(spark, sf))


# --- patches ---


@query(SQL_TILES + """SELECT coalesce(v1.z, v2.z) AS z, coalesce(v1.x, v2.x) AS x, coalesce(v1.y, v2.y) AS y, v2.d AS tile_data, upper(md5(v2.d)) AS tile_hash
FROM v1 FULL JOIN v2 ON v1.z = v2.z AND v1.x = v2.x AND v1.y = v2.y WHERE v1.d IS NULL OR v2.d IS NULL OR v1.d <> v2.d""")  # fmt: skip
def diff_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return patch.diff(tables.tiles(spark, sf), tables.tiles_v2(spark, sf)).select(*KEY, _text(), "tile_hash")


@query(SQL_TILES + "SELECT z, x, y, d AS tile_data, upper(md5(d)) AS tile_hash FROM v2")
def apply_patch(spark: SparkSession, sf: str) -> DataFrame:
    v1 = tables.tiles(spark, sf)
    return patch.apply(v1, patch.diff(v1, tables.tiles_v2(spark, sf))).select(*KEY, _text(), "tile_hash")


@query(SQL_TILES + "(SELECT z, x, y, d AS tile_data, 'gone' AS side FROM (FROM v1 EXCEPT ALL FROM v2)) UNION ALL (SELECT z, x, y, d, 'come' FROM (FROM v2 EXCEPT ALL FROM v1))")
def patched_except(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the first version has over the patched tileset, and the other way round."""
    v1, v2 = tables.tiles(spark, sf), tables.tiles_v2(spark, sf)
    done = patch.apply(v1, patch.diff(v1, v2)).select(*KEY, "tile_data")
    gone, come = v1.select(*KEY, "tile_data").exceptAll(done), done.exceptAll(v1.select(*KEY, "tile_data"))
    return gone.withColumn("side", F.lit("gone")).union(come.withColumn("side", F.lit("come"))).select(*KEY, _text(), "side")


@query(SQL_METADATA + """SELECT coalesce(m1.name, m2.name) AS name, m2.value AS value FROM m1 FULL JOIN m2 ON m1.name = m2.name
WHERE m1.value IS NULL OR m2.value IS NULL OR m1.value <> m2.value""")  # fmt: skip
def diff_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return patch.diff_metadata(tables.metadata(spark, sf), tables.metadata(spark, sf, 2))


@query(SQL_METADATA + "SELECT name, value FROM m2")
def apply_metadata(spark: SparkSession, sf: str) -> DataFrame:
    m1 = tables.metadata(spark, sf)
    return patch.apply_metadata(m1, patch.diff_metadata(m1, tables.metadata(spark, sf, 2)))


@query(SQL_TILES + "SELECT DISTINCT upper(md5(d)) AS tile_id FROM v1 WHERE upper(md5(d)) IN (SELECT upper(md5(d)) FROM v2)")
def orphans_dropped(spark: SparkSession, sf: str) -> DataFrame:
    images = tileset.to_layout(tables.tiles(spark, sf), "normalized").tables["images"]
    map_ = tileset.to_layout(tables.tiles_v2(spark, sf), "normalized").tables["map"]
    return patch.drop_orphans(images, map_).select("tile_id")


@query(SQL_TILES + "SELECT count(*) AS tiles FROM v1 JOIN v2 USING (z, x, y) WHERE v1.d <> v2.d")
def binary_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Binary patches made and applied: as many tiles as differ come out as the second version has them."""
    v1, v2 = tables.tiles(spark, sf), tables.tiles_v2(spark, sf)
    done = transcode.binary_apply(v1, transcode.binary_diff(v1, v2))
    return done.join(v2.withColumnRenamed("tile_data", "want"), KEY).filter("tile_data = want").agg(F.count("*").alias("tiles"))


# --- validation ---


@query(SQL_TILES + """, bad AS (SELECT z, CASE WHEN x % 17 = 0 THEN x + (1 << z) ELSE x END AS x, y, d, CASE WHEN y % 19 = 0 THEN 'X' ELSE upper(md5(d)) END AS h FROM v1
  UNION ALL SELECT z, CASE WHEN x % 17 = 0 THEN x + (1 << z) ELSE x END, y, d, CASE WHEN y % 19 = 0 THEN 'X' ELSE upper(md5(d)) END FROM v1 WHERE (x + y) % 23 = 0)
SELECT 'duplicate key' AS "check", count(*) AS n FROM (SELECT z, x, y FROM bad GROUP BY z, x, y HAVING count(*) > 1)
UNION ALL SELECT 'tile out of range', count(*) FROM bad WHERE x >= (1 << z) OR y >= (1 << z)
UNION ALL SELECT 'wrong hash', count(*) FROM bad WHERE h <> upper(md5(d))""")  # fmt: skip
def validate_tiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.tiles(spark, sf)
    x = F.when(F.col("x") % 17 == 0, F.col("x") + tm.side("z")).otherwise(F.col("x"))
    digest = F.when(F.col("y") % 19 == 0, "X").otherwise(tileset.md5_hex("tile_data"))
    rows = rows.union(rows.filter((F.col("x") + F.col("y")) % 23 == 0)).select("z", x.alias("x"), "y", "tile_data", digest.alias("tile_hash"))
    return checks.violations(rows)


@query(SQL_TILES + """SELECT v2.z, v2.x, v2.y FROM v2 WHERE upper(md5(d)) NOT IN (SELECT upper(md5(d)) FROM v1)""")
def missing_images(spark: SparkSession, sf: str) -> DataFrame:
    map_ = tileset.to_layout(tables.tiles_v2(spark, sf), "normalized").tables["map"]
    return checks.missing_images(map_, tileset.to_layout(tables.tiles(spark, sf), "normalized").tables["images"]).select(*KEY)


@query(SQL_TILES + "SELECT z, CASE WHEN z % 2 = 0 THEN 'json' ELSE 'mvt' END AS format, CASE WHEN z % 3 = 0 THEN 'gzip' ELSE 'uncompressed' END AS encoding FROM v1 GROUP BY z")
def zoom_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Formats found in the bytes of a sample tile a zoom."""
    rows = tables.tiles(spark, sf)
    as_json = F.concat(F.lit(b'{"a":"'), "tile_data", F.lit(b'"}'))
    plain = F.when(F.col("z") % 2 == 0, as_json).otherwise(F.concat(F.lit(b"\x1a\x05"), "tile_data"))
    packed = codecs.recode(plain, "uncompressed", "gzip")
    made = rows.select(*KEY, F.when(F.col("z") % 3 == 0, packed).otherwise(plain).alias("tile_data"))
    return checks.zoom_formats(made, codecs.detect_format).select("z", "format.format", "format.encoding")


# --- tile math ---

_X = f"least(CAST(floor(abs(radians(lng) * {tm.RADIUS!r} + {tm.EARTH / 2!r}) / ({tm.EARTH!r} / (1 << {{z}}))) AS BIGINT), (1 << {{z}}) - 1)"
_Y = f"least(CAST(floor(abs({tm.EARTH / 2!r} - {tm.RADIUS / 2!r} * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat))))) / ({tm.EARTH!r} / (1 << {{z}}))) AS BIGINT), (1 << {{z}}) - 1)"


@query(f"WITH p AS ({SQL_POINTS}) SELECT id, {_X.format(z=4)} AS x4, {_Y.format(z=4)} AS y4, {_X.format(z=14)} AS x14, {_Y.format(z=14)} AS y14, (1 << 14) - 1 - {_Y.format(z=14)} AS row14 FROM p")
def tile_indexes(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.points(spark, sf)
    return p.select("id", tm.tile_x("lng", 4).alias("x4"), tm.tile_y("lat", 4).alias("y4"), tm.tile_x("lng", 14).alias("x14"), tm.tile_y("lat", 14).alias("y14"), tm.invert_y(14, tm.tile_y("lat", 14)).alias("row14"))


@query(f"""WITH p AS ({SQL_POINTS}) SELECT id, round(radians(lng) * {tm.RADIUS!r}, 3) AS mx, round({tm.RADIUS / 2!r} * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))), 3) AS my, round(lng, 6) AS lng, round(lat, 6) AS lat FROM p""")
def reprojected(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees to metres and back."""
    p = tables.points(spark, sf).select("id", tm.mercator_x("lng").alias("mx"), tm.mercator_y("lat").alias("my"))
    return p.select("id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), F.round(tm.longitude("mx"), 6).alias("lng"), F.round(tm.latitude("my"), 6).alias("lat"))


@query(SQL_TILES + f""", t AS (SELECT z, x, y, {tm.EARTH!r} / (1 << z) AS s FROM v1)
SELECT z, x, y, round(x * s - {tm.EARTH / 2!r}, 2) AS minx, round({tm.EARTH / 2!r} - (y + 1) * s, 2) AS miny, round(degrees(((x + 1) * s - {tm.EARTH / 2!r}) / {tm.RADIUS!r}), 6) AS max_lng,
round(degrees(atan(sinh(({tm.EARTH / 2!r} - y * s) / {tm.RADIUS!r}))), 6) AS max_lat FROM t""")  # fmt: skip
def tile_boxes(spark: SparkSession, sf: str) -> DataFrame:
    metres, degrees = tm.tile_box("z", "x", "y"), tm.range_box("z", "x", "y", "x", "y")
    return tables.tiles(spark, sf).select(*KEY, F.round(metres["minx"], 2).alias("minx"), F.round(metres["miny"], 2).alias("miny"), F.round(degrees["max_lng"], 6).alias("max_lng"), F.round(degrees["max_lat"], 6).alias("max_lat"))


def _box_of_supplier(spark: SparkSession, sf: str) -> DataFrame:
    s = tables.read(spark, sf, "supplier").select("s_suppkey")
    lng, lat = (F.col("s_suppkey") * 37 % 300 - 150).cast("double"), (F.col("s_suppkey") * 23 % 120 - 60).cast("double")
    wide = (F.col("s_suppkey") % 7 + 1).cast("double")
    return s.select(F.col("s_suppkey").alias("id"), (lng + 0.5).alias("l"), (lat + 0.5).alias("b"), (lng + 0.5 + wide).alias("r"), (lat + 0.5 + wide).alias("t"))


_SUPPLIERS = "s AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 300 - 150 AS DOUBLE) + 0.5 AS l, CAST(s_suppkey * 23 % 120 - 60 AS DOUBLE) + 0.5 AS b, s_suppkey % 7 + 1 AS w FROM supplier)"
_SX = f"CAST(floor((radians({{0}}) * {tm.RADIUS!r} + {tm.EARTH / 2!r}) / ({tm.EARTH!r} / (1 << z))) AS BIGINT)"
_SY = f"CAST(floor(({tm.EARTH / 2!r} - {tm.RADIUS / 2!r} * ln((1 + sin(radians({{0}}))) / (1 - sin(radians({{0}}))))) / ({tm.EARTH!r} / (1 << z))) AS BIGINT)"


@query(f"""WITH {_SUPPLIERS}, r AS (SELECT id, z, {_SX.format("l")} AS x0, {_SX.format("l + w")} AS x1, {_SY.format("b + w")} AS y0, {_SY.format("b")} AS y1 FROM s, (SELECT unnest([3, 6, 8]) AS z))
SELECT z, CAST(sum((x1 - x0 + 1) * (y1 - y0 + 1)) AS BIGINT) AS n_tiles FROM r GROUP BY z""")  # fmt: skip
def tile_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles over the suppliers' boxes, counted without listing them."""
    boxes = _box_of_supplier(spark, sf).withColumn("z", F.explode(F.array(*[F.lit(z) for z in (3, 6, 8)])))
    r = boxes.select("z", tm.tile_range("l", "b", "r", "t", "z").alias("q")).select("z", "q.*")
    return r.groupBy("z").agg(F.sum((F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1)).cast("long").alias("n_tiles"))


@query(f"""WITH {_SUPPLIERS}, r AS (SELECT id, z, {_SX.format("l")} AS x0, {_SX.format("l + w")} AS x1, {_SY.format("b + w")} AS y0, {_SY.format("b")} AS y1 FROM s, (SELECT unnest([3, 6]) AS z)),
c AS (SELECT id, z, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM r) SELECT DISTINCT CAST(z AS INTEGER) AS z, x, y FROM (SELECT z, x, unnest(range(y0, y1 + 1)) AS y FROM c)""")  # fmt: skip
def tiles_enumerated(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _box_of_supplier(spark, sf).withColumn("z", F.explode(F.array(F.lit(3), F.lit(6))))
    r = boxes.select("z", tm.tile_range("l", "b", "r", "t", "z").alias("q")).select(F.col("z").alias("zoom"), "q.*")
    return ranges.tiles_of(r).distinct()


# --- vector tiling ---


@query(f"WITH p AS ({SQL_POINTS}) SELECT CAST(6 AS INTEGER) AS z, {_X.format(z=6)} AS x, {_Y.format(z=6)} AS y, count(*) AS n, round(avg(value), 6) AS avg_value FROM p GROUP BY 1, 2, 3")
def points_by_tile(spark: SparkSession, sf: str) -> DataFrame:
    """Points of no buffer meet exactly one tile each."""
    p = vector.point_features(tables.points(spark, sf), F.col("lng"), F.col("lat"))
    return vector.cover(p, [6], buffer=0).groupBy(*KEY).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


_M = f"SELECT id, event_type, radians(lng) * {tm.RADIUS!r} AS mx, {tm.RADIUS / 2!r} * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) AS my FROM p"
_S5, _H = tm.EARTH / 32, tm.EARTH / 2
_B5 = _S5 * 64 / 4096


@query(f"""WITH p AS ({SQL_POINTS}), m AS ({_M}), g AS (SELECT unnest(range(0, 32)) AS x), k AS (SELECT a.x AS x, b.x AS y FROM g a, g b)
SELECT CAST(5 AS INTEGER) AS z, k.x, k.y, count(*) AS n FROM m JOIN k ON mx BETWEEN k.x * {_S5!r} - {_H!r} - {_B5!r} AND (k.x + 1) * {_S5!r} - {_H!r} + {_B5!r}
AND my BETWEEN {_H!r} - (k.y + 1) * {_S5!r} - {_B5!r} AND {_H!r} - k.y * {_S5!r} + {_B5!r} GROUP BY k.x, k.y""")  # fmt: skip
def points_on_buffered_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The spatial join with each tile's buffer, as an equi-join; SQL has it as an inequality join."""
    p = vector.point_features(tables.points(spark, sf), F.col("lng"), F.col("lat"))
    return vector.cover(p, [5]).groupBy(*KEY).agg(F.count("*").alias("n"))


@query(f"""WITH p AS ({SQL_POINTS}), t AS (SELECT id, event_type, {_X.format(z=3)} AS x, {_Y.format(z=3)} AS y FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY id) AS n FROM t) SELECT CAST(3 AS INTEGER) AS z, x, y, id FROM r WHERE n <= 5""")  # fmt: skip
def features_limited(spark: SparkSession, sf: str) -> DataFrame:
    p = vector.point_features(tables.points(spark, sf), F.col("lng"), F.col("lat"))
    return vector.limit_features(vector.cover(p, [3], buffer=0), 5).select(*KEY, "id")


@F.pandas_udf(T.BinaryType())
def _point_wkb(x, y):
    return x.combine(y, geo.point_wkb)


@query(f"WITH p AS ({SQL_POINTS}), t AS (SELECT {_X.format(z=4)} AS x, {_Y.format(z=4)} AS y FROM p) SELECT CAST(4 AS INTEGER) AS z, x, y, count(*) AS n_features FROM t GROUP BY x, y")
def vector_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Points encoded as vector tiles; the number of features a tile is checked, the bytes are by tests."""
    p = vector.point_features(tables.points(spark, sf), F.col("lng"), F.col("lat")).withColumn("geom", _point_wkb("minx", "miny"))
    done = vector.encode_tiles(vector.cover(p, [4], buffer=0), "events", props=["event_type", "value"], buffer=0)
    return done.filter(F.octet_length("tile_data") > 0).select(*KEY, "n_features")


@query(f"WITH p AS ({SQL_POINTS}), m AS ({_M}) SELECT round(min(mx), 2) AS minx, round(min(my), 2) AS miny, round(max(mx), 2) AS maxx, round(max(my), 2) AS maxy, count(*) AS n FROM m")
def features_extent(spark: SparkSession, sf: str) -> DataFrame:
    p = vector.point_features(tables.points(spark, sf), F.col("lng"), F.col("lat"))
    return vector.extent_of(p).select(*[F.round(c, 2).alias(c) for c in ("minx", "miny", "maxx", "maxy")], "n")


@query("""WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events WHERE props IS NOT NULL),
t AS (SELECT event_id, key, json_type(props, '$."' || key || '"') AS t FROM k), f AS (SELECT key, arg_min(t, event_id) AS t FROM t WHERE t <> 'NULL' GROUP BY key)
SELECT key, CASE WHEN t = 'BOOLEAN' THEN 'Boolean' WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'Number' ELSE 'String' END AS type FROM f""")  # fmt: skip
def property_types(spark: SparkSession, sf: str) -> DataFrame:
    return vector.property_types(tables.read(spark, sf, "events").select(F.col("event_id").alias("id"), "props"))


# --- composite sources, descriptions, transcoding ---


@query(SQL_TILES + """, u AS (SELECT 0 AS o, * FROM v1 UNION ALL SELECT 1, * FROM v2 UNION ALL SELECT 2, z, x, y, '' FROM v1)
SELECT z, x, y, string_agg(d, '' ORDER BY o) AS tile_data, CAST(count(*) AS INTEGER) AS n_sources FROM u WHERE d <> '' GROUP BY z, x, y""")  # fmt: skip
def composite_tiles(spark: SparkSession, sf: str) -> DataFrame:
    v1 = tables.tiles(spark, sf)
    sources = [("a", v1), ("b", tables.tiles_v2(spark, sf)), ("none", v1.withColumn("tile_data", F.lit(b"")))]
    return composite.merge_tiles(composite.union_sources(sources)).select(*KEY, _text(), "n_sources")


@query(SQL_TILES + "SELECT z, x, y, d AS tile_data, upper(md5(d)) AS tile_hash FROM v1 WHERE d NOT LIKE '%/F'")
def transcoded(spark: SparkSession, sf: str) -> DataFrame:
    """Data packed and unpacked again; blobs that can't be changed are left out."""

    def again(data: bytes) -> bytes:
        if data.endswith(b"/F"):
            raise ValueError("not this one")
        return codecs.decode(codecs.encode(data, "zlib"), "zlib")

    rows = tables.tiles(spark, sf).withColumn("tile_hash", tileset.md5_hex("tile_data"))
    return transcode.transcode(rows, again).select(*KEY, _text(), "tile_hash")


@query(SQL_TILES + "SELECT count(*) AS tiles_written, count(DISTINCT d) AS cache_encoded, count(*) - count(DISTINCT d) AS cache_hits FROM v1")
def transcode_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.tiles(spark, sf).withColumn("tile_hash", tileset.md5_hex("tile_data"))
    return transcode.transcode_stats(rows, transcode.transcode(rows, lambda d: d[::-1]))


@query("""SELECT (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region) AS name, 'public' AS attribution, min(n_nationkey) AS minzoom, max(n_nationkey) AS maxzoom FROM nation""")
def merged_description(spark: SparkSession, sf: str) -> DataFrame:
    n, r = tables.read(spark, sf, "nation"), tables.read(spark, sf, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        (F.col("r_regionkey") * 1000 + F.col("n_nationkey")).alias("ord"), F.col("r_name").alias("name"), F.lit("public").alias("attribution"), F.lit(None).cast("string").alias("description"),
        F.col("n_nationkey").alias("minzoom"), F.col("n_nationkey").alias("maxzoom"), F.array(*[F.lit(float(v)) for v in (-10, -10, 10, 10)]).alias("bounds"), F.array(F.lit(0.0)).alias("center"), F.array("n_name").alias("layers"),
    )
    return meta.merge_descriptions(rows).select("name", "attribution", "minzoom", "maxzoom")


@query("""SELECT n_name AS name, n_regionkey || ',' || n_nationkey || ',' || CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE '1' END AS value, n_nationkey % 2 = 1 AS valid FROM nation""")
def metadata_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Centers parse or don't, and say so."""
    n = tables.read(spark, sf, "nation")
    value = F.concat_ws(",", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise("1"))
    rows = n.select(F.col("n_name").alias("real"), F.lit("center").alias("name"), value.alias("value"))
    both = meta.parse(rows.select("name", "value").distinct()).select("value", "valid")
    return rows.select(F.col("real").alias("name"), "value").join(both, "value").select("name", "value", "valid")


# --- caches ---

_NOW = 1_700_000_000
_CACHE = SQL_TILES + f", c AS (SELECT z, x, y, CAST({_NOW} - x AS BIGINT) AS fetched, CASE WHEN (x + y) % 5 = 0 THEN NULL ELSE CAST({_NOW} + (x * 37 + y * 11) % 2000 - 1000 AS BIGINT) END AS expires, d FROM v1)"


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    expires = F.when((F.col("x") + F.col("y")) % 5 != 0, F.lit(_NOW) + (F.col("x") * 37 + F.col("y") * 11) % 2000 - 1000).cast("long")
    return tables.tiles(spark, sf).select(*KEY, (F.lit(_NOW) - F.col("x")).cast("long").alias("fetched"), expires.alias("expires"), F.lit("e").alias("etag"), "tile_data")


@query(_CACHE + f"SELECT z, x, y, expires FROM c WHERE expires IS NULL OR expires >= {_NOW}")
def cache_purged(spark: SparkSession, sf: str) -> DataFrame:
    return cache.purge(_cache(spark, sf), _NOW).select(*KEY, "expires")


@query(_CACHE + f"SELECT c.z, c.x, c.y, CASE WHEN t.z IS NULL THEN fetched ELSE {_NOW} END AS fetched, CASE WHEN t.z IS NULL THEN expires ELSE {_NOW} + 60 END AS expires FROM c LEFT JOIN (SELECT z, x, y FROM v2) t ON t.z = c.z AND t.x = c.x AND t.y = c.y")
def cache_touched(spark: SparkSession, sf: str) -> DataFrame:
    stamps = tables.tiles_v2(spark, sf).select(*KEY, F.lit(_NOW).cast("long").alias("fetched"), F.lit(_NOW + 60).cast("long").alias("expires"), F.lit("n").alias("etag"))
    return cache.touch(_cache(spark, sf), stamps).select(*KEY, "fetched", "expires")


@query(_CACHE + """, k AS (SELECT *, sum(strlen(d)) OVER (ORDER BY coalesce(expires, 9223372036854775807) DESC, z DESC, x DESC, y DESC ROWS UNBOUNDED PRECEDING) AS held FROM c)
SELECT z, x, y, expires FROM k WHERE held <= 20000""")  # fmt: skip
def cache_evicted(spark: SparkSession, sf: str) -> DataFrame:
    return cache.evict(_cache(spark, sf), 20_000).select(*KEY, "expires")


# --- catalogs, reload, functions ---


@query("""WITH a AS (SELECT c_custkey AS id, c_mktsegment AS v FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'add' WHEN b.id IS NULL THEN 'remove' ELSE 'update' END AS action FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.v <> b.v""")  # fmt: skip
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("version"))
    changed = F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("version"))
    return catalog.snapshot_diff(c.filter("id % 7 <> 0"), c.filter("id % 11 <> 0").withColumn("version", changed))


@query(SQL_TILES + f", {_COORDS_SQL} SELECT c.z, c.x, c.y, 'z' || c.z || CASE WHEN c.x % 2 = 0 THEN '' ELSE '!' END AS tile_data FROM coords c WHERE c.y % 3 > 0 UNION ALL SELECT z, x, y, '' FROM coords WHERE y % 3 = 0")
def function_source(spark: SparkSession, sf: str) -> DataFrame:
    """A registered function makes tiles for coordinates; where it gives no row, the tile is empty."""
    registry = catalog.Registry()
    registry.register("mark", lambda coords, params: coords.filter("y % 3 > 0").withColumn("tile_data", F.concat(F.lit("z"), F.col("z").cast("string"), F.when(F.col("x") % 2 == 0, "").otherwise(params["mark"])).cast("binary")))
    return registry.tiles("mark", _coords(spark, sf), {"mark": "!"}).select(*KEY, _text())


# --- aggregates by place and hour ---


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")
def events_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.read(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("""SELECT n_nationkey AS zone, count(o_orderkey) AS trips, round(coalesce(avg(o_totalprice), 0), 2) AS avg_price FROM nation LEFT JOIN (SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) o
ON c_nationkey = n_nationkey AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND (n_regionkey = 1 OR o_orderpriority LIKE '1%') GROUP BY n_nationkey""")  # fmt: skip
def zones_joined(spark: SparkSession, sf: str) -> DataFrame:
    """A left join on a key, with a range and an alternative besides."""
    n = tables.read(spark, sf, "nation")
    o = tables.read(spark, sf, "orders").join(tables.read(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    span = (F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    either = (F.col("n_regionkey") == 1) | F.col("o_orderpriority").startswith("1")
    joined = n.join(o, (F.col("c_nationkey") == F.col("n_nationkey")) & span & either, "left")
    return joined.groupBy(F.col("n_nationkey").alias("zone")).agg(F.count("o_orderkey").alias("trips"), F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)), 2).alias("avg_price"))


@query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, count(DISTINCT n_nationkey % 3) AS kinds, bool_or(n_nationkey % 5 = 0) AS any_fifth FROM nation GROUP BY n_regionkey")
def ordered_names(spark: SparkSession, sf: str) -> DataFrame:
    """An ordered list, a distinct count and an alternative over each region."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: r["n_name"])
    return tables.read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(listed, ",").alias("names"), F.countDistinct(F.col("n_nationkey") % 3).alias("kinds"), F.bool_or(F.col("n_nationkey") % 5 == 0).alias("any_fifth"))


_RES = 2 * math.pi * tm.RADIUS / 256


@query(f"SELECT p_partkey AS id, CASE WHEN p_size % 31 < 20 THEN CAST(p_size % 31 AS INTEGER) END AS zoom FROM part WHERE p_size % 31 < 20")
def resolution_zooms(spark: SparkSession, sf: str) -> DataFrame:
    """Raster levels by resolution: metres a pixel find their zoom."""
    p = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 31).alias("level")).filter("level < 20")
    return p.select("id", tm.zoom_of_resolution(F.lit(tm.EARTH / 256) / F.pow(F.lit(2.0), F.col("level")), absolute=1.0).alias("zoom"))


# --- checks that verify, patches with hashes ---


@query(SQL_TILES + "SELECT 'agg_tiles_hash' AS name, upper(md5(string_agg(z || '' || x || '' || y || d, '' ORDER BY z, x, y))) AS value FROM v1 UNION ALL SELECT 'n_name', max(n_name) FROM nation")
def hash_updated(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata with the content hash set, and then verified against the tiles."""
    rows = tables.tiles(spark, sf)
    named = tables.read(spark, sf, "nation").agg(F.max("n_name").alias("value")).select(F.lit("n_name").alias("name"), "value")
    done = checks.validate(rows, named, "update")
    return checks.validate(rows, done, "verify")


@query(SQL_TILES + "SELECT z, x, y, d AS tile_data FROM v2")
def patch_with_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """A patch that names the hashes before and after, applied where both fit."""
    v1, v2 = tables.tiles(spark, sf), tables.tiles_v2(spark, sf)
    metas = [checks.validate(v, tables.metadata(spark, sf, k), "update") for k, v in ((1, v1), (2, v2))]
    made, meta_ = patch.diff_tilesets(v1, metas[0], v2, metas[1])
    return patch.apply_tileset(v1, metas[0], made, meta_)[0].select(*KEY, _text())


@query(SQL_TILES + "SELECT z, x, y, d AS tile_data FROM v2")
def patch_of_both_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Changed tiles as binary patches, the others of the patch as they are."""
    v1, v2 = tables.tiles(spark, sf), tables.tiles_v2(spark, sf)
    return transcode.patched(v1, patch.diff(v1, v2).select(*KEY, "tile_data"), transcode.binary_diff(v1, v2)).select(*KEY, _text())


@query(SQL_TILES + """, p AS (SELECT coalesce(a.z, b.z) AS z, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, b.d AS d FROM v1 a FULL JOIN v2 b ON a.z = b.z AND a.x = b.x AND a.y = b.y
WHERE a.d IS NULL OR b.d IS NULL OR a.d <> b.d) SELECT z, x, y, d AS tile_data FROM p WHERE NOT EXISTS (SELECT 1 FROM v1 a WHERE a.z = p.z AND a.x = p.x AND a.y = p.y AND p.d IS NOT NULL)""")  # fmt: skip
def plain_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of a patch that no binary patch makes."""
    v1, v2 = tables.tiles(spark, sf), tables.tiles_v2(spark, sf)
    return transcode.without_patched(patch.diff(v1, v2).select(*KEY, "tile_data"), transcode.binary_diff(v1, v2)).select(*KEY, _text())


@query(SQL_TILES + """, g AS (SELECT upper(md5(d)) AS h FROM v1 GROUP BY d), n AS (SELECT h, row_number() OVER (ORDER BY h) AS id FROM g)
SELECT z, x, y, id AS tile_data_id FROM v1 JOIN n ON n.h = upper(md5(v1.d))""")  # fmt: skip
def dedup_ids_written(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.to_layout(tables.tiles(spark, sf), "dedup_id").tables["tiles_shallow"]


@query(SQL_TILES + ", g AS (SELECT upper(md5(d)) AS h FROM v1 GROUP BY d), n AS (SELECT h, row_number() OVER (ORDER BY h) AS id FROM g) SELECT z, x, y, id AS tile_id FROM v1 JOIN n ON n.h = upper(md5(v1.d))")
def ids_remapped(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.tiles(spark, sf)
    ids = tileset.dedup_ids(rows).select(F.col("tile_hash").alias("tile_id"), F.col("tile_data_id").alias("new_id"))
    return tileset.remap_ids(tileset.to_layout(rows, "normalized").tables["map"], ids)


@query(SQL_TILES + "SELECT count(*) FILTER (d NOT LIKE '%/F') AS tiles_written, count(DISTINCT d) FILTER (d NOT LIKE '%/F') AS cache_encoded, count(*) FILTER (d NOT LIKE '%/F') - count(DISTINCT d) FILTER (d NOT LIKE '%/F') AS cache_hits FROM v1")
def transcode_failures_counted(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics where some blobs can't be changed."""

    def fail(data: bytes) -> bytes:
        if data.endswith(b"/F"):
            raise ValueError("not this one")
        return data + b"!"

    rows = tables.tiles(spark, sf).withColumn("tile_hash", tileset.md5_hex("tile_data"))
    return transcode.transcode_stats(rows, transcode.transcode(rows, fail))


@query(SQL_TILES + "SELECT z, max(CASE WHEN z % 3 = 0 THEN 'gzip' WHEN z % 3 = 1 THEN 'zlib' END) AS compression FROM v1 GROUP BY z")
def compressions(spark: SparkSession, sf: str) -> DataFrame:
    """What metadata would call the compression of each zoom's tiles, by their bytes."""
    rows = tables.tiles(spark, sf).withColumn("tile_data", F.concat(F.lit(b"\x1a\x05"), "tile_data"))
    packed = F.when(F.col("z") % 3 == 0, codecs.recode("tile_data", "uncompressed", "gzip")).when(F.col("z") % 3 == 1, codecs.recode("tile_data", "uncompressed", "zlib")).otherwise(F.col("tile_data"))
    named = rows.select("z", codecs.compression_name(codecs.detect_format(packed)["encoding"]).alias("compression"))
    return named.groupBy("z").agg(F.max("compression").alias("compression"))


# --- tile math: precision, cameras, resolutions ---


@query("SELECT o_orderkey % 31 AS zoom, CASE WHEN o_orderkey % 31 < 11 THEN 0 WHEN o_orderkey % 31 < 14 THEN 1 WHEN o_orderkey % 31 < 17 THEN 2 WHEN o_orderkey % 31 < 21 THEN 3 WHEN o_orderkey % 31 < 24 THEN 4 WHEN o_orderkey % 31 < 27 THEN 5 ELSE 6 END AS digits, count(*) AS n FROM orders GROUP BY ALL")
def zoom_precisions(spark: SparkSession, sf: str) -> DataFrame:
    zoom = (F.col("o_orderkey") % 31).cast("int")
    return tables.read(spark, sf, "orders").groupBy((F.col("o_orderkey") % 31).alias("zoom"), tm.zoom_precision(zoom).alias("digits")).agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT c_custkey AS id, {tm.EARTH!r} / 256 / pow(2, c_custkey % 20) * (1 + (c_custkey % 41 - 20) * 1e-4) AS m FROM customer)
SELECT id, (SELECT min(z) FROM range(0, 31) t(z) WHERE abs(m - {tm.EARTH!r} / 256 / pow(2, z)) < least(3.0, {tm.EARTH!r} / 256 / pow(2, z) * 1e-3)) AS zoom FROM r""")
def zooms_of_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    """Resolutions near those of zooms, within the tolerance and beyond it."""
    key = F.col("c_custkey")
    metres = F.lit(tm.EARTH / 256) / F.pow(F.lit(2.0), key % 20) * (1 + (key % 41 - 20) * F.lit(1e-4))
    return tables.read(spark, sf, "customer").select(key.alias("id"), tm.zoom_of_resolution(metres).cast("long").alias("zoom"))


_BOX_OF = "(c_custkey * 37 % 3000 - 1500) / 10.0 AS w, (c_custkey * 53 % 1400 - 700) / 10.0 AS s, (c_custkey % 5) * 3.5 AS dx, (c_custkey % 3) * 2.5 AS dy"


@query(f"""WITH b AS (SELECT c_custkey AS id, {_BOX_OF} FROM customer)
SELECT id, round((w + w + dx) / 2, 6) AS lng, round((s + s + dy) / 2, 6) AS lat, round(CASE WHEN dx = 0 AND dy = 0 THEN 14.0 ELSE greatest(0.0, least(20.0,
CASE WHEN dx > 0 THEN log2(360.0 * 800 / (256 * dx)) ELSE 20.0 END, CASE WHEN dy > 0 THEN log2(180.0 * 600 / (256 * dy)) ELSE 20.0 END)) END, 6) AS zoom FROM b""")  # fmt: skip
def cameras(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.read(spark, sf, "customer").selectExpr("c_custkey AS id", *[x.strip() for x in _BOX_OF.split(", ")])
    num = lambda name: F.col(name).cast("double")
    seen = c.select("id", tm.camera(num("w"), num("s"), num("w") + num("dx"), num("s") + num("dy"), F.lit(800.0), F.lit(600.0)).alias("c"))
    return seen.select("id", *[F.round(f"c.{k}", 6).alias(k) for k in ("lng", "lat", "zoom")])


# --- catalog helpers ---


@query("""SELECT p_partkey AS id, regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9_.-]', '-', 'g') AS clean, '"' || replace(p_type || '"x', '"', '""') || '"' AS quoted,
'/' || p_partkey || '/' || p_size || '/{y}' AS url, '"' || array_to_string(string_split(p_brand || '.t', '.'), '"."') || '"' AS relation FROM part""")
def names_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.read(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"), catalog.clean_id(F.concat_ws(" ", "p_name", "p_brand")).alias("clean"), catalog.quote_identifier(F.concat("p_type", F.lit('"x'))).alias("quoted"),
        catalog.fill_template("/{z}/{x}/{y}", z=F.col("p_partkey"), x=F.col("p_size")).alias("url"), catalog.quote_relation(F.concat("p_brand", F.lit(".t"))).alias("relation"),
    )


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN upper(md5(s_name)) END AS digits FROM supplier")
def hex_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of 32 hexadecimal digits as 16 bytes, others as null."""
    text = F.when(F.col("s_suppkey") % 2 == 0, F.md5("s_name")).otherwise(F.col("s_name"))
    return tables.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.hex(catalog.hex_128(text)).alias("digits"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 <> c_custkey % 3 THEN NULL
ELSE coalesce(nullif(c_custkey % 4, 0), nullif(c_custkey % 3, 0), CASE WHEN c_custkey % 5 = 0 THEN 9 END) END AS srid FROM customer""")
def srids_resolved(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda k: (F.col("c_custkey") % k).cast("int")
    srid = catalog.resolve_srid(n(4), F.nullif(n(3), F.lit(0)), F.when(n(5) == 0, 9))
    return tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), srid.cast("long").alias("srid"))


@query("""WITH c AS (SELECT s_suppkey AS t, k, CASE k WHEN 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'GID' ELSE 'name' END WHEN 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'feat_id' ELSE 'other' END ELSE 'size' END AS n FROM supplier, range(0, 3) r(k))
SELECT t AS "table", CASE WHEN max(n = 'GID') THEN 'GID' ELSE 'feat_id' END AS id_column FROM c GROUP BY t HAVING max(n = 'GID') OR max(n = 'feat_id')""")  # fmt: skip
def id_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The column that serves as id: the first of "gid", "feat_id" that a table has."""
    s = tables.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("table"), F.lit("public").alias("schema"))
    names = F.array(F.when(F.col("table") % 3 == 0, "GID").otherwise("name"), F.when(F.col("table") % 2 == 0, "feat_id").otherwise("other"), F.lit("size"))
    columns = s.select("schema", "table", F.explode(names).alias("column"), F.lit("int4").alias("type"))
    return catalog.id_column(columns, ["gid", "feat_id"]).select("table", "id_column")


@query("""WITH g AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), f AS (SELECT p_brand, p_size, n FROM g WHERE p_size % 5 <> 0)
SELECT p_brand AS "schema", p_size AS "table", n > 1 AS indexed, p_size % 2 = 0 AS has_props FROM f""")  # fmt: skip
def geometry_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Geometry tables of a catalog whose columns are derived from parts."""
    g = tables.read(spark, sf, "part").groupBy(F.col("p_brand").alias("schema"), F.col("p_size").alias("table")).agg(F.count("*").alias("n"))
    kinds = F.array(
        F.struct(F.lit("geom").alias("column"), F.when(F.col("table") % 5 != 0, "geometry").otherwise("text").alias("type")),
        F.when(F.col("table") % 2 == 0, F.struct(F.lit("size").alias("column"), F.lit("_int4").alias("type"))),
    )
    columns = g.select("schema", "table", F.inline(F.filter(kinds, lambda k: k.isNotNull())))
    indexes = g.select("schema", "table", F.lit("geom").alias("column"), (F.col("n") > 1).alias("is_spatial"))
    found = catalog.geometry_tables(columns, indexes)
    return found.select("schema", "table", "indexed", (F.size("properties") > 0).alias("has_props"))


@query("SELECT o_orderkey AS function, o_orderkey % 4 = 0 AS takes_query FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1")
def tile_function_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Functions by their signatures: some return text, some take a fourth argument that is no JSON."""
    key = F.col("o_orderkey")
    args = lambda *types: F.array(*[F.struct(F.lit(k).alias("position"), F.lit(n).alias("name"), t.alias("type")) for k, (n, t) in enumerate(zip("zxyq", types))])
    whole = F.lit("integer")
    signature = F.when(key % 4 < 2, args(whole, whole, whole, F.when(key % 4 == 0, "json").otherwise("text"))).otherwise(F.slice(args(whole, whole, whole, whole), 1, 3))
    rows = tables.read(spark, sf, "orders").select(key.alias("function"), F.when(key % 3 == 0, "text").otherwise("bytea").alias("returns"), F.inline(signature))
    return catalog.tile_functions(rows)
