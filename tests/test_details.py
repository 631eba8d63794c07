import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as geo
from tessella.functions import tile_math as tm
from tessella.operators import cache, catalog, ranges, render, tileset, vector
from tessella.plans import detail_queries, queries


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_shapes_meet_boxes_by_themselves():
    line = (2, [[(0.0, 0.0), (10.0, 10.0)]])
    assert geo.meets(line, (4, 4, 6, 6)) and not geo.meets(line, (6, 1, 9, 4))
    square = (3, [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]])
    assert geo.meets(square, (4, 4, 6, 6)) and not geo.meets(square, (11, 11, 12, 12))


def test_straight_points_go():
    assert geo.simplify((2, [[(0, 0), (1, 1), (2, 2), (3, 3), (4, 0)]])) == (2, [[(0, 0), (3, 3), (4, 0)]])
    back = [(0, 0), (4, 0), (2, 0)]  # a turn back is no straight
    assert geo.simplify((2, [back])) == (2, [back])
    ring = [(5, 0), (10, 0), (10, 5), (10, 10), (0, 10), (0, 0), (5, 0)]
    assert geo.simplify((3, [ring])) == (3, [[(10, 0), (10, 10), (0, 10), (0, 0), (10, 0)]])
    assert geo.simplify((1, [[(0, 0), (1, 1), (2, 2)]])) == (1, [[(0, 0), (1, 1), (2, 2)]])


def test_wkb_lines(spark):
    assert geo.read_wkb(geo.line_wkb([(0, 0), (1, 2)])) == [(2, [[(0.0, 0.0), (1.0, 2.0)]])]
    df = spark.createDataFrame([(1, geo.line_wkb([(0, 0), (9, 9)])), (2, None)], "id int, geom binary")
    hit = vector.meets_box("geom", F.lit(4.0), F.lit(4.0), F.lit(5.0), F.lit(5.0))
    assert rows_of(df.select("id", hit)) == [(1, True), (2, False)]


def test_morton_against_bits(spark):
    points = [(0, 0), (1, 0), (0, 1), (5, 9), ((1 << 30) - 1, (1 << 30) - 1), (1 << 29, 3)]
    got = {(r[0], r[1]): r[2] for r in spark.createDataFrame(points, "x bigint, y bigint").select("x", "y", tm.morton("x", "y")).collect()}
    assert got == {(x, y): sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(30)) for x, y in points}


def test_numbers_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    got = rows_of(tileset.numbered(df, "v", "n", 16).select("v", "n"))
    assert [n for _, n in got] == list(range(1, 1001))
    assert rows_of(tileset.numbered(df.limit(0), "v", "n")) == []


def test_numbers_hold_beyond_the_sample(spark):
    # More rows than the borders are drawn from, and a column that only the places need.
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("v"), F.col("id").cast("string").alias("w"))
    assert [n for _, n, _ in rows_of(tileset.numbered(df, "v", "n", 16).select("v", "n", "w"))] == list(range(1, 100_001))


@pytest.fixture(scope="module")
def edge_events(spark, tmp_path_factory):
    """Events whose points lie on the edges between tiles, which rounding puts to either side."""
    folder = str(tmp_path_factory.mktemp("edges"))
    rows = spark.range(0, 360_000, 625).select(F.col("id").alias("event_id"), (F.col("id") % 97).alias("user_id"))
    rows = rows.select("*", F.timestamp_seconds("event_id").alias("ts"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"))
    rows.write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["tile_pixels", "vector_tiles"])
def test_points_on_edges_are_as_in_sql(spark, edge_events, name):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{edge_events}/events.parquet/*.parquet'")
        want = con.execute(queries.ORACLES[name]).fetchall()
    assert rows_of(queries.QUERIES[name](spark, edge_events)) == sorted(want)


def test_equal_names_are_published_by_id(spark):
    ids = [k * 7919 % 600 for k in range(600)]
    rows = spark.createDataFrame([(k, f"source {k % 2}") for k in ids], "id long, name string").repartition(7)
    places = tileset.numbered(catalog.published(rows, rows.select("id", F.lit("add").alias("action"))), "place", "number", 16)
    assert [r["id"] for r in places.orderBy("number").collect()] == sorted(ids, key=lambda k: (k % 2, k))


def test_render_leaves_empty_tiles_out(spark):
    source = lambda coords: coords.withColumn("tile_data", F.when(F.col("x") == 0, F.lit(b"a")).when(F.col("x") == 1, F.lit(b"")))
    rects = ranges.rects_frame(spark, [ranges.Rect(2, 0, 0, 2, 1)])
    assert rows_of(render.render(source, rects).select("z", "x", "y")) == [(2, 0, 2), (2, 0, 3)]  # rows are stored south-up
    there = spark.createDataFrame([(0, 0, 0, bytearray(b"old"))], "z int, x bigint, y bigint, tile_data binary")
    for policy, want in (("override", b"a"), ("ignore", b"old")):
        done = render.render_boxes(spark, source, [0], into=there, on_duplicate=policy).collect()
        assert [bytes(r["tile_data"]) for r in done] == [want]
    with pytest.raises(ValueError):
        render.render_boxes(spark, source, [0], into=there, on_duplicate="abort")


def test_adjacent_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, None)], "k int, v string").withColumn("p", F.lit(1))
    assert [r[0] for r in rows_of(catalog.drop_adjacent(df, ["p"], "k", ["v"]).select("k"))] == [1, 3, 5]


def test_zoom_bounds_of_caches(spark):
    no = F.lit(None).cast("int")
    bounds = lambda *a: spark.range(1).select(cache.zoom_bounds(*a).alias("b")).select("b.*").first()
    assert tuple(bounds(F.lit(3), no, F.lit(1), F.lit(9), F.lit(False))) == (3, 9)
    assert tuple(bounds(F.lit(3), no, F.lit(1), F.lit(9), F.lit(True))) == (255, 0)
    assert spark.range(1).select(cache.within(F.lit(30), cache.zoom_bounds(no, no, no, no, F.lit(False)))).first()[0]


def test_search_box_knows_two_systems():
    with pytest.raises(ValueError):
        vector.search_box("z", "x", "y", 2154)


def test_every_detail_query_has_sql():
    mine = [n for n, f in queries.QUERIES.items() if f.__module__ == detail_queries.__name__]
    assert len(mine) > 20 and set(mine) <= set(queries.ORACLES)
