"""Further queries over the test tables: rendering, exact geometry, catalogs, metadata rules and caches, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import codecs
from tessella.functions import geometry as geo
from tessella.functions import tile_math as tm
from tessella.operators import cache, catalog, metadata, patch, ranges, render, tileset, vector
from tessella.operators.tileset import KEY

from . import tables
from .queries import _CACHE, _NOW, _cache, _text, query
from .tables import SQL_METADATA, SQL_POINTS, SQL_TILES

# --- bulk rendering, rectangles, clustering ---


def _hollow(spark: SparkSession, sf: str):
    """A source over the first version in which some tiles are empty."""
    rows = tables.tiles(spark, sf).withColumn("tile_data", F.when(F.col("tile_data").endswith(F.lit(b"/F")), F.lit(b"")).otherwise(F.col("tile_data")))
    return tileset.to_layout(rows, "flat").get_tiles


@query(SQL_TILES + "SELECT z, x, y, d AS tile_data FROM v1 WHERE z BETWEEN 2 AND 7 AND d NOT LIKE '%/F'")
def rendered_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """All tiles of six zooms asked of a source; the empty ones make no row."""
    return render.render_boxes(spark, _hollow(spark, sf), [7, 2, 3, 4, 5, 6, 2]).select(*KEY, _text())


@query(SQL_TILES + """, r AS (SELECT z, x, y, d FROM v1 WHERE z IN (5, 6) AND d NOT LIKE '%/F' AND x >= (1 << z) // 2 AND y >= (1 << z) // 2), t AS (SELECT z, x, y, d FROM v2 WHERE z < 7)
SELECT z, x, y, d AS tile_data FROM t UNION ALL SELECT z, x, y, d FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.z = r.z AND t.x = r.x AND t.y = r.y)""")  # fmt: skip
def rendered_into(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of the north-east, put into an archive whose own tiles stay."""
    there = tables.tiles_v2(spark, sf).filter("z < 7")
    return render.render_boxes(spark, _hollow(spark, sf), [5, 6], [(0.001, 0.001, 180.0, 85.0511)], there, "ignore").select(*KEY, _text())


@query("""WITH b AS (SELECT r_regionkey AS k, r_regionkey * 20.0 - 60.5 AS w, r_regionkey * 10.0 - 30.5 AS s FROM region)
SELECT z AS zoom, count(*) AS n FROM (SELECT DISTINCT r.z, x.x, y.y FROM b, (SELECT unnest([3, 6, 8]) AS z) r,
LATERAL (SELECT unnest(range(CAST(floor((w + 180) / 360 * (1 << z)) AS BIGINT), CAST(floor((w + 30 + 180) / 360 * (1 << z)) AS BIGINT) + 1)) AS x) x,
LATERAL (SELECT unnest(range(CAST(floor((0.5 - ln((1 + sin(radians(s + 15))) / (1 - sin(radians(s + 15)))) / (4 * pi())) * (1 << z)) AS BIGINT),
CAST(floor((0.5 - ln((1 + sin(radians(s))) / (1 - sin(radians(s)))) / (4 * pi())) * (1 << z)) AS BIGINT) + 1)) AS y) y) GROUP BY z""")  # fmt: skip
def ranges_united(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping boxes, a region each, as rectangles that don't overlap: every tile counts once."""
    keys = [r[0] for r in tables.read(spark, sf, "region").select("r_regionkey").collect()]  # five regions
    boxes = [(k * 20.0 - 60.5, k * 10.0 - 30.5, k * 20.0 - 30.5, k * 10.0 - 15.5) for k in keys]
    tiles = ranges.tiles_of(ranges.rects_frame(spark, ranges.ranges_of(boxes, [3, 6, 8])))
    return tiles.groupBy(F.col("z").alias("zoom")).agg(F.count("*").alias("n"))


@query(SQL_TILES + "SELECT z, x, y, CAST((SELECT sum((((x >> k) & 1) << (2 * k)) + (((y >> k) & 1) << (2 * k + 1))) FROM range(0, 30) b(k)) AS BIGINT) AS place FROM v1")
def clustered_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles in ranges of the Z-order curve, with their place on it."""
    return tileset.clustered(tables.tiles(spark, sf), 8).select(*KEY, tm.morton("x", "y").alias("place"))


# --- geometry ---


@F.pandas_udf(T.BinaryType())
def _diagonal(a, b, n):
    return (a.astype(str) + " " + b.astype(str) + " " + n.astype(str)).map(lambda t: geo.line_wkb([(float(t.split()[0]) + k, float(t.split()[1]) + k) for k in range(int(t.split()[2]) + 1)]))


def _diagonals(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    c = tables.read(spark, sf, "customer").select(key.alias("id"), (key * 37 % 200).alias("a"), (key * 53 % 200).alias("b"), (key % 50 + 1).alias("n"))
    return c.select("id", "n", _diagonal("a", "b", "n").alias("geom"))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey * 37 % 200 AS a, c_custkey * 53 % 200 AS b, c_custkey % 50 + 1 AS n FROM customer)
SELECT id FROM c WHERE greatest(0, 40.5 - a, 60.25 - b) <= least(n, 120.5 - a, 130.25 - b)""")  # fmt: skip
def lines_in_box(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that run through a box; some have a box that meets it and don't meet it themselves."""
    return _diagonals(spark, sf).filter(vector.meets_box("geom", F.lit(40.5), F.lit(60.25), F.lit(120.5), F.lit(130.25))).select("id")


@F.pandas_udf(T.LongType())
def _points_left(geoms):
    return geoms.map(lambda g: sum(len(part) for s in geo.read_wkb(bytes(g)) for part in geo.simplify(s)[1]))


@query("SELECT c_custkey AS id, c_custkey % 50 + 2 AS points, 2 AS kept FROM customer")
def lines_simplified(spark: SparkSession, sf: str) -> DataFrame:
    """Straight lines of many points keep their ends."""
    return _diagonals(spark, sf).select("id", (F.col("n") + 1).alias("points"), _points_left("geom").cast("int").alias("kept"))


@query(SQL_TILES + f""", t AS (SELECT z, x, y, {tm.EARTH!r} / (1 << z) AS s, 360.0 / (1 << z) AS w FROM v1)
SELECT z, x, y, round(x * s - {tm.EARTH / 2!r} - s / 64, 2) AS m_minx, round({tm.EARTH / 2!r} - y * s + s / 64, 2) AS m_maxy,
round(radians(x * w - 180 - w / 64), 8) AS d_minx, round(atan(sinh(({tm.EARTH / 2!r} - y * s) / {tm.RADIUS!r})) + radians(w / 64), 8) AS d_maxy FROM t""")  # fmt: skip
def search_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Where a tile's features are looked for, in metres and in degrees (here as radians, whose digits end nowhere)."""
    metres, degrees = (vector.search_box("z", "x", "y", srid) for srid in (3857, 4326))
    boxed = tables.tiles(spark, sf).select(*KEY, metres.alias("m"), degrees.alias("d"))
    return boxed.select(*KEY, F.round("m.minx", 2).alias("m_minx"), F.round("m.maxy", 2).alias("m_maxy"), F.round(F.radians("d.minx"), 8).alias("d_minx"), F.round(F.radians("d.maxy"), 8).alias("d_maxy"))


@query(f"""WITH p AS ({SQL_POINTS}), m AS (SELECT id, radians(lng) * {tm.RADIUS!r} AS mx, {tm.RADIUS / 2!r} * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) AS my, {tm.EARTH / 64!r} AS s FROM p),
t AS (SELECT *, CAST(floor((mx + {tm.EARTH / 2!r}) / s) AS BIGINT) AS x, CAST(floor(({tm.EARTH / 2!r} - my) / s) AS BIGINT) AS y FROM m)
SELECT id, x, y, CAST(floor((mx - (x * s - {tm.EARTH / 2!r})) * (4096 / s)) AS BIGINT) // 16 AS px, (4096 - CAST(floor((my - ({tm.EARTH / 2!r} - y * s - s)) * (4096 / s)) AS BIGINT)) // 16 AS py FROM t WHERE x < 64""")  # fmt: skip
def tile_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Places of points on their tile's grid, in steps of sixteen; what rounding puts a hair before the edge is in the first step."""
    p = vector.point_features(tables.points(spark, sf), F.col("lng"), F.col("lat")).select("id", F.col("minx").alias("mx"), F.col("miny").alias("my"), tm.tile_x("lng", 6).alias("x"), tm.tile_y("lat", 6).alias("y"))
    px, py = tm.tile_pixel("mx", "my", F.lit(6), "x", "y", corner=tm.exact_corner(6, "x", "y"))
    return p.select("id", "x", "y", (px / 16).cast("long").alias("px"), (py / 16).cast("long").alias("py"))


# --- catalogs ---


def _by_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("table"))


@query("""WITH t AS (SELECT s_suppkey AS k, s_suppkey % 4 AS f, s_suppkey % 5 AS g FROM supplier)
SELECT k AS "table", CASE WHEN g = 0 THEN CASE WHEN f = 2 THEN 'shape' END WHEN g = 1 THEN CASE WHEN f IN (1, 2) THEN 'geom' END WHEN f = 1 THEN 'geom' END AS geometry,
CASE WHEN g = 0 THEN CASE WHEN f <> 2 THEN 'no such column' END WHEN g = 1 THEN CASE WHEN f NOT IN (1, 2) THEN 'not a geometry' END WHEN f = 2 THEN 'several geometries' WHEN f <> 1 THEN 'no geometry' END AS fault FROM t""")  # fmt: skip
def geometry_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with no, one or two geometries, of which some are asked for by name."""
    t = F.col("table")
    column = lambda name, kind: F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type"))
    one = F.array(column("geom", "geometry"), column("size", "int4"))
    listed = F.when(t % 4 == 1, one).when(t % 4 == 2, F.array(column("geom", "geometry"), column("shape", "geography"))).otherwise(F.array(column("geom", "text"), column("size", "int4")))
    columns = _by_supplier(spark, sf).select("table", F.inline(listed))
    wanted = _by_supplier(spark, sf).filter(t % 5 < 2).select("table", F.when(t % 5 == 1, "geom").otherwise("shape").alias("column"))
    return catalog.geometry_column(columns, wanted)


@query("SELECT p_partkey AS id, p_name AS title, p_size AS \"order\" FROM part")
def columns_aliased(spark: SparkSession, sf: str) -> DataFrame:
    """Columns under other names, found whatever their case."""
    return catalog.aliased(tables.read(spark, sf, "part"), {"id": "P_PartKey", "title": "p_name", "order": "P_SIZE"})


@query("WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT c_nationkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 1) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)")
def only_one_side(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that one of two sets has and the other hasn't."""
    part = lambda k: tables.read(spark, sf, "customer").filter(F.col("c_custkey") % 3 == k).select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return catalog.symmetric_difference(part(0), part(1))


@query("SELECT o_custkey AS k, min(o_orderkey) AS place FROM orders GROUP BY o_custkey")
def ids_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    o = tables.read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("place"))
    return catalog.first_seen(o, "k", "place")


@query("""SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE prev IS DISTINCT FROM event_type""")
def adjacent_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user but for those of the kind of the one before."""
    return catalog.drop_adjacent(tables.read(spark, sf, "events"), ["user_id"], "event_id", ["event_type"]).select("event_id", "event_type")


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'add' ELSE 'update' END AS action FROM customer)
SELECT id, action, row_number() OVER (ORDER BY CASE action WHEN 'update' THEN 0 WHEN 'add' THEN 1 ELSE 2 END, name) AS place FROM a""")  # fmt: skip
def publish_order(spark: SparkSession, sf: str) -> DataFrame:
    """Changes in the order in which they are published. Places follow from counts of ranges; no task orders all."""
    c = tables.read(spark, sf, "customer")
    key = F.col("c_custkey")
    snapshot = c.select(key.alias("id"), F.col("c_name").alias("name"))
    actions = c.select(key.alias("id"), F.when(key % 3 == 0, "remove").when(key % 3 == 1, "add").otherwise("update").alias("action"))
    return tileset.numbered(catalog.published(snapshot, actions), "place", "number").select("id", "action", F.col("number").alias("place"))


@query("""SELECT s_suppkey AS id, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}') AS version FROM supplier""")
def versions_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A digest over a source's fields, bounds left out."""
    s = tables.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", "s_name", F.lit("0,0,1,1").alias("bounds"))
    return catalog.fingerprint(s, "bounds")


@query(SQL_TILES + "SELECT count(*) AS n, true AS same, true AS within, 7 AS mirrors FROM v1")
def mirrors_chosen(spark: SparkSession, sf: str) -> DataFrame:
    """A tile always has the same mirror, whatever its version, and all mirrors serve."""
    which = catalog.mirror(F.col("z"), F.col("x"), F.col("y"), 7)
    a, b = tables.tiles(spark, sf).select(*KEY, which.alias("m")), tables.tiles_v2(spark, sf).select(*KEY, which.alias("other"))
    both = a.join(b, KEY, "left")
    return both.agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("m") == F.col("other"), F.lit(True))).alias("same"), F.bool_and(F.col("m").between(0, 6)).alias("within"), F.countDistinct("m").cast("int").alias("mirrors"))


@query("SELECT o_orderkey AS id, CAST(json_array_length(CAST('[' || rtrim(repeat('1,', CAST(o_orderkey % 4 AS BIGINT)), ',') || ']' AS JSON)) AS INTEGER) AS n FROM orders")
def argument_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many arguments a signature in JSON lists."""
    ones = F.array_repeat(F.lit("1"), (F.col("o_orderkey") % 4).cast("int"))
    return tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.json_array_length(F.concat(F.lit("["), F.array_join(ones, ","), F.lit("]"))).alias("n"))


# --- metadata rules ---


@query(SQL_METADATA + "SELECT name, value FROM m2 WHERE value <> 'r2' UNION ALL SELECT 'agg_tiles_hash', max(value) FROM m1")
def metadata_after_patch(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata once a patch is applied: the hash promised for after is the hash, the others go, and so do names without a value."""
    m1, m2 = (tables.metadata(spark, sf, k) for k in (1, 2))
    after = m1.agg(F.lit(tileset.AFTER).alias("name"), F.max("value").alias("value"))
    before = m1.agg(F.lit(tileset.BEFORE).alias("name"), F.min("value").alias("value"))
    old = m1.agg(F.lit(tileset.AGG_HASH).alias("name"), F.min("value").alias("value"))
    nulled = m2.select("name", F.when(F.col("value") != "r2", F.col("value")).alias("value"))
    return patch.patched_metadata(nulled.unionByName(after).unionByName(before).unionByName(old))


@query(SQL_TILES + """, k AS (SELECT min(z) AS a, max(z) AS b FROM v1) SELECT 'reset' AS mode, CAST(a AS VARCHAR) AS minzoom, CAST(b AS VARCHAR) AS maxzoom FROM k
UNION ALL SELECT 'grow', CAST(least(a, 4) AS VARCHAR), CAST(greatest(b, 14) AS VARCHAR) FROM k UNION ALL SELECT 'skip', '4', '14'""")  # fmt: skip
def zooms_updated(spark: SparkSession, sf: str) -> DataFrame:
    """The zooms in metadata after tiles changed, by the three policies."""
    rows = tables.tiles(spark, sf)
    start = tileset.upsert_metadata(tables.metadata(spark, sf), {"minzoom": "4", "maxzoom": "14"})
    out = None
    for mode in ("reset", "grow", "skip"):
        value = lambda name: F.max(F.when(F.col("name") == name, F.col("value"))).alias(name)
        row = metadata.update_zooms(start, rows, mode).agg(F.lit(mode).alias("mode"), value("minzoom"), value("maxzoom"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""WITH a AS (SELECT n_regionkey AS source, min(n_nationkey) AS a0, max(n_nationkey) AS a1 FROM nation GROUP BY 1)
SELECT n_regionkey AS source, n_name AS layer, greatest(n_nationkey - 5, a0) AS minzoom, least(n_nationkey + 5, a1) AS maxzoom FROM nation JOIN a ON source = n_regionkey""")  # fmt: skip
def zooms_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """Zooms that layers declare, held within those of their source's tiles."""
    n = tables.read(spark, sf, "nation")
    declared = n.select(F.col("n_regionkey").alias("source"), F.col("n_name").alias("layer"), (F.col("n_nationkey") - 5).alias("minzoom"), (F.col("n_nationkey") + 5).alias("maxzoom"))
    actual = n.groupBy(F.col("n_regionkey").alias("source")).agg(F.min("n_nationkey").alias("min_zoom"), F.max("n_nationkey").alias("max_zoom"))
    return metadata.clamp_zooms(declared, actual)


@query("SELECT p_brand AS image, min(p_size) AS minzoom, max(p_size) AS maxzoom, count(DISTINCT p_partkey % 7 = 0) = 1 AS one_size FROM part GROUP BY p_brand")
def pyramids(spark: SparkSession, sf: str) -> DataFrame:
    """Zooms of images by their levels, and whether a level's tiles differ in size."""
    size = F.when(F.col("p_partkey") % 7 == 0, 512).otherwise(256)
    return metadata.pyramid_zooms(tables.read(spark, sf, "part").select(F.col("p_brand").alias("image"), F.col("p_size").alias("zoom"), size.alias("tile_size")))


@query("""SELECT (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region) AS name, string_agg(n_name, '|' ORDER BY n_regionkey, n_nationkey) AS layers,
'-' || CAST(10 + max(n_nationkey) AS VARCHAR) || ',-10,' || CAST(10 + max(n_nationkey) AS VARCHAR) || ',10' AS bounds, CAST(min_by(n_nationkey, n_regionkey * 1000 + n_nationkey) AS DOUBLE) AS center FROM nation""")  # fmt: skip
def merged_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Layers, bounds and center of descriptions put together in order."""
    n, r = tables.read(spark, sf, "nation"), tables.read(spark, sf, "region")
    wide, text = F.col("n_nationkey").cast("double") + 10, F.lit(None).cast("string")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        (F.col("r_regionkey") * 1000 + F.col("n_nationkey")).alias("ord"), F.col("r_name").alias("name"), text.alias("attribution"), text.alias("description"), F.lit(0).alias("minzoom"), F.lit(9).alias("maxzoom"),
        F.array(-wide, F.lit(-10.0), wide, F.lit(10.0)).alias("bounds"), F.array(F.col("n_nationkey").cast("double")).alias("center"), F.array("n_name").alias("layers"),
    )
    done = metadata.merge_descriptions(rows)
    bounds = F.array_join(F.transform("bounds", lambda b: b.cast("int").cast("string")), ",")
    return done.select("name", F.array_join("layers", "|").alias("layers"), bounds.alias("bounds"), F.get("center", F.lit(0)).alias("center"))


# --- caches, scans, formats ---


@query(_CACHE + f"SELECT z, x, y, fetched, d AS tile_data FROM c WHERE NOT EXISTS (SELECT 1 FROM v2 WHERE v2.z = c.z AND v2.x = c.x AND v2.y = c.y) UNION ALL SELECT z, x, y, {_NOW}, d FROM v2")
def cache_upserted(spark: SparkSession, sf: str) -> DataFrame:
    new = tables.tiles_v2(spark, sf).select(*KEY, F.lit(_NOW).cast("long").alias("fetched"), F.lit(_NOW + 60).cast("long").alias("expires"), F.lit("n").alias("etag"), "tile_data")
    return cache.upsert(_cache(spark, sf), new).select(*KEY, "fetched", _text())


@query(SQL_TILES + "SELECT z, x, y FROM v1 WHERE CASE WHEN x % 3 = 0 THEN false WHEN x % 3 = 1 THEN z BETWEEN 4 AND 8 ELSE z BETWEEN 5 AND 8 END")
def cached_zooms(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles that are cached: some sources have no caching, some no bound of their own, and take the general one."""
    kind = F.col("x") % 3
    bounds = cache.zoom_bounds(F.when(kind == 2, 5), F.lit(None).cast("int"), F.lit(4), F.lit(8), kind == 0)
    return tables.tiles(spark, sf).filter(cache.within(F.col("z"), bounds)).select(*KEY)


@query(SQL_TILES + "SELECT z, x, y, CASE WHEN d NOT LIKE '%/F' THEN d END AS tile_data FROM v1")
def normalized_left(spark: SparkSession, sf: str) -> DataFrame:
    """Keys whose image is gone stay, without data."""
    made = tileset.to_layout(tables.tiles(spark, sf), "normalized")
    made.tables["images"] = made.tables["images"].filter(~F.col("tile_data").endswith(F.lit(b"/F")))
    return made.tiles("left").select(*KEY, _text())


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 AND p_partkey % 5 <> 0 THEN 'mlt' WHEN p_size % 3 = 1 AND p_partkey % 2 = 1 AND p_partkey % 7 <> 0 THEN 'mvt' END AS target FROM part""")
def conversions(spark: SparkSession, sf: str) -> DataFrame:
    """What a tile is turned into, by its format, what the client takes and what is disabled."""
    key, size = F.col("p_partkey"), F.col("p_size")
    fmt = F.when(size % 3 == 0, "mvt").when(size % 3 == 1, "mlt").otherwise("png")
    accepted = F.when(key % 2 == 0, "mlt").otherwise("mvt")
    target = codecs.conversion(fmt, accepted, F.when(key % 5 == 0, "disabled"), F.when(key % 7 == 0, "disabled").otherwise("explicit"))
    return tables.read(spark, sf, "part").select(key.alias("id"), target.alias("target"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/x-protobuf' WHEN 2 THEN 'image/jpeg' END AS content_type FROM part")
def content_types(spark: SparkSession, sf: str) -> DataFrame:
    """Content types by format names, in any case; unknown names have none."""
    size = F.col("p_size") % 4
    name = F.when(size == 0, "PNG").when(size == 1, "pbf").when(size == 2, "jpg").otherwise("tiff")
    return tables.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), codecs.content_type(name).alias("content_type"))
