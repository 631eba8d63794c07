import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import tile_math as tm
from tessella.operators import ranges as r

BOX = (-179.43749999999955, -84.76987877980656, -146.8124999999996, -81.37446385260833)
GOLDEN = {0: (0, 0, 0, 0), 1: (0, 1, 0, 1), 2: (0, 3, 0, 3), 4: (0, 14, 1, 15), 8: (0, 233, 23, 253), 14: (25, 14931, 1510, 16239), 20: (1638, 955647, 96665, 1039339), 30: (1677721, 978583256, 98985574, 1064283385)}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("z", GOLDEN)
def test_bbox_to_range(spark, z):
    assert r.bbox_to_range(*BOX, z) == GOLDEN[z]
    assert tuple(one(spark, tm.tile_range(*map(F.lit, BOX), z).alias("q"))["q"]) == GOLDEN[z]


@pytest.mark.parametrize(("lng", "lat", "z", "want"), [(-180, 85.0511, 2, (0, 0)), (0, 0, 0, (0, 0)), (0, 0, 2, (2, 2)), (0, 1, 1, (1, 0)), (0, 1, 2, (2, 1))])
def test_tile_index(spark, lng, lat, z, want):
    assert r.tile_index(lng, lat, z) == want
    assert tuple(one(spark, tm.tile_x(float(lng), z), tm.tile_y(float(lat), z))) == want


def test_poles_do_not_divide_by_zero(spark):
    assert tuple(one(spark, tm.tile_y(90.0, 3), tm.tile_y(-90.0, 3))) == (0, 7)


@pytest.mark.parametrize(("args", "want"), [((0, 0, 0, 0, 0), (-180, -85.0511287798066, 180, 85.0511287798066)), ((1, 0, 0, 0, 0), (-180, 0, 0, 85.0511287798066)), ((5, 1, 1, 2, 2), (-168.75, 81.09321385260837, -146.25, 83.97925949886205))])
def test_range_box(spark, args, want):
    assert tuple(one(spark, tm.range_box(*map(F.lit, args)).alias("b"))["b"]) == pytest.approx(want, abs=1e-9)


def test_validity_and_inversion(spark):
    rows = spark.createDataFrame([(0, 0, 0), (3, 8, 0), (31, 0, 0), (30, 2**30 - 1, 5), (-1, 0, 0), (None, 1, 1)], "z int, x long, y long")
    assert [x[0] for x in rows.select(tm.valid_tile("z", "x", "y")).collect()] == [True, False, False, True, False, False]
    assert one(spark, tm.invert_y(F.lit(30), F.lit(0)))[0] == 2**30 - 1


def test_zoom_of_resolution(spark):
    rows = spark.createDataFrame([(float(tm.EARTH / 256 / 2**9),), (123.0,)], "m double")
    assert [x[0] for x in rows.select(tm.zoom_of_resolution("m")).collect()] == [9, None]


def test_chunk_index(spark):
    assert tuple(one(spark, tm.chunk_index(F.lit(2), F.lit(1), F.lit(4), F.lit(3)), tm.chunk_index(F.lit(4), F.lit(0), F.lit(4), F.lit(3)))) == (6, None)


rects = st.builds(lambda x, y, w, h: r.Rect(4, x, y, x + w, y + h), *[st.integers(0, 8)] * 2, *[st.integers(0, 6)] * 2)


@settings(max_examples=100, deadline=None)
@given(st.lists(rects, max_size=5))
def test_append_rect_covers_the_union_once(given_rects):
    out = []
    for q in given_rects:
        out = r.append_rect(out, q)
    tiles = lambda q: {(x, y) for x in range(q.min_x, q.max_x + 1) for y in range(q.min_y, q.max_y + 1)}
    assert sum(map(len, out)) == len(set().union(*map(tiles, given_rects), set())) == len(set().union(*map(tiles, out), set()))


def test_tiles_of_ranges(spark):
    found = r.ranges_of([(-10.0, -10.0, 10.0, 10.0), (0.0, 0.0, 20.0, 20.0)], [2, 5])
    frame = r.rects_frame(spark, found)
    tiles = r.tiles_of(frame)
    assert tiles.count() == tiles.distinct().count() == r.tile_count(frame).first()[0] == sum(map(len, found))
    with pytest.raises(ValueError):
        r.check_bbox((-190.0, 0.0, 0.0, 1.0))


def test_zoom_precision(spark):
    got = [r[0] for r in spark.range(31).orderBy("id").select(tm.zoom_precision(F.col("id").cast("int"))).collect()]
    assert got[:30] == [0] * 11 + [1] * 3 + [2] * 3 + [3] * 4 + [4] * 3 + [5] * 3 + [6] * 3 and got[30] == 6
