import gzip
import json
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import codecs
from tessella.functions import geometry as geo
from tessella.functions import tile_math as tm
from tessella.operators import vector


def test_formats():
    png = b"\x89PNG\r\n\x1a\n..."
    assert codecs.detect(png) == ("png", "internal")
    assert codecs.detect(gzip.compress(b'{"a":1}')) == ("json", "gzip")
    assert codecs.detect(b"\x1f\x8bnot gzip") == ("mvt", "gzip") and codecs.detect(b"\x78\x9cnot zlib") == ("mvt", "zlib")
    assert codecs.detect(gzip.compress(png)) == ("mvt", "gzip") and codecs.detect(b"GIF87a") == ("mvt", "uncompressed")
    assert codecs.detect(codecs.encode(b"\x1a\x00", "zlib")) == ("mvt", "zlib")
    assert codecs.detect(b"\x02\x01") == ("mlt", "uncompressed") == codecs.detect(b"\x03\x01\xaa")
    # Framed layers and what is wrong with them.
    framed = {
        b"\x02\x01": None, b"\x03\x01\xaa": None, b"\x80\x04\x01\xaa": None, b"\x80\x80\x05\x01\xdd": None, b"\x03\x02\xaa": "unexpected tag", b"": "truncated size",
        b"\xff" * 64: "size overflow", b"\x00\x01": "size underflow", b"\x80": "truncated size", b"\x05": "truncated tag", b"\x03\x01": "truncated data", b"\x02\x01x": "truncated tag",
    }
    assert {k: codecs.framing_fault(k) for k in framed} == framed
    assert codecs.detect(b"RIFF....WEBPx")[0] == "webp" and codecs.detect(None) is None
    for e in ("gzip", "zlib", "zstd", "uncompressed"):
        assert codecs.decode(codecs.encode(b"abc", e), e) == b"abc"


def test_hash_columns(spark):
    rows = spark.createDataFrame([(b"abc",), (b"",), (None,)], "d binary").select(codecs.xxh3_64("d").alias("h"), codecs.etag("d").alias("e")).collect()
    assert rows[0]["h"] == 8696274497037089104 and rows[2]["h"] is None
    assert rows[1]["e"] == rows[2]["e"] == "A" * 22 and rows[0]["e"] != rows[1]["e"]


def test_wkb_roundtrip():
    assert geo.read_wkb(geo.point_wkb(1.5, -2)) == [(1, [[(1.5, -2.0)]])]
    (kind, rings), = geo.read_wkb(geo.box_wkb(0, 0, 2, 3))
    assert kind == 3 and len(rings[0]) == 5
    collection = struct.pack("<BII", 1, 7, 2) + geo.point_wkb(1, 1) + geo.box_wkb(0, 0, 1, 1)
    assert [s[0] for s in geo.read_wkb(collection)] == [1, 3]


coord = st.floats(-20, 20, allow_nan=False).map(lambda v: round(v, 3))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(coord, coord), min_size=2, max_size=8))
def test_clipped_lines_stay_inside(line):
    for part in geo.clip_line(line, (-5, -5, 5, 5)):
        assert all(-5.001 <= x <= 5.001 and -5.001 <= y <= 5.001 for x, y in part)


@settings(max_examples=80, deadline=None)
@given(coord, coord, st.floats(0.1, 10), st.floats(0.1, 10))
def test_clipped_boxes_have_the_area_of_the_overlap(x, y, w, h):
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    want = max(0, min(x + w, 5) - max(x, -5)) * max(0, min(y + h, 5) - max(y, -5))
    got = geo.clip_ring(ring, (-5, -5, 5, 5))
    assert abs(abs(geo.area2(got)) / 2 - want) < 1e-6


def test_tile_encoding(spark):
    rows = spark.createDataFrame([(1, 10.0, 10.0, "a", 5), (2, 20.0, 20.0, None, 6), (3, -10.0, -10.0, "c", 7)], "id long, lng double, lat double, name string, n long")
    points = vector.point_features(rows, F.col("lng"), F.col("lat")).collect()
    features = spark.createDataFrame([(p["id"], geo.point_wkb(p["minx"], p["miny"]), p["minx"], p["miny"], p["maxx"], p["maxy"], p["name"], p["n"]) for p in points], "id long, geom binary, minx double, miny double, maxx double, maxy double, name string, n long")
    tiles = {(r["z"], r["x"], r["y"]): r for r in vector.encode_tiles(vector.cover(features, [1], buffer=0), "places", props=["name", "n"], buffer=0).collect()}
    assert {k: r["n_features"] for k, r in tiles.items()} == {(1, 1, 0): 2, (1, 0, 1): 1}
    layer, = geo.read_mvt(bytes(tiles[1, 1, 0]["tile_data"]))
    assert layer["name"] == "places" and layer["version"] == 2 and layer["extent"] == 4096
    assert [(f["id"], f["tags"]) for f in layer["features"]] == [(1, {"name": "a", "n": 5}), (2, {"n": 6})]


def test_cover_meets_every_tile_of_a_box(spark):
    size = tm.EARTH / 8
    f = spark.createDataFrame([(1, -size * 1.5, -size * 0.5, size * 1.5, size * 0.5)], "id long, minx double, miny double, maxx double, maxy double")
    assert {(r["x"], r["y"]) for r in vector.cover(f, [3], buffer=0).collect()} == {(x, y) for x in (2, 3, 4, 5) for y in (3, 4)}
    assert vector.join_tiles(f, spark.createDataFrame([(3, 2, 3), (3, 0, 0)], "z int, x long, y long"), [3], buffer=0).count() == 1


def test_extent_and_types(spark):
    f = spark.createDataFrame([(1, 5.0, 5.0, 5.0, 5.0, json.dumps({"a": None, "b": [1], "c": True, "d": 18446744073709551615})), (2, 5.0, 5.0, 5.0, 5.0, json.dumps({"a": 1.5}))], "id long, minx double, miny double, maxx double, maxy double, props string")
    assert tuple(vector.extent_of(f).first()) == (4.0, 4.0, 6.0, 6.0, 2)
    assert {tuple(r) for r in vector.property_types(f).collect()} == {("a", "Number"), ("b", "String"), ("c", "Boolean"), ("d", "Number")}
