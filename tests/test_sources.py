import json

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from tessella.operators import tileset
from tessella.sources import files, mbtiles, pmtiles
from tessella.streaming import reload

from .test_tilesets import V1, as_dict, frame


def test_archives_round_trip(spark, tmp_path):
    meta = spark.createDataFrame([("name", "x")], "name string, value string")
    for layout in ("flat", "flat_with_hash", "normalized", "cache"):
        path = str(tmp_path / f"{layout}.mbtiles")
        mbtiles.write(tileset.to_layout(frame(spark, V1), layout, meta), path)
        back = mbtiles.read(spark, path, partitions=3)
        assert back.layout == layout and as_dict(back.tiles()) == V1
        assert [tuple(r) for r in back.metadata.collect()] == [("name", "x")]


def test_archives_take_filters(spark, tmp_path):
    path = str(tmp_path / "a.mbtiles")
    mbtiles.write(tileset.to_layout(frame(spark, V1), "flat"), path)
    assert sorted(tuple(r) for r in mbtiles.read(spark, path).coords().collect()) == sorted(V1)
    zoom = max(k[0] for k in V1)
    reader = mbtiles._FilteringReader({"path": path, "table": "tiles", "columns": "zoom_level,tile_column,tile_row,tile_data"})
    left = list(reader.pushFilters([EqualTo(("z",), zoom), GreaterThan(("x",), -1), In(("y",), tuple(range(64))), EqualTo(("tile_data",), b"x")]))
    assert left == [EqualTo(("tile_data",), b"x")]
    read = sum(b.num_rows for part in reader.partitions() for b in reader.read(part))
    assert read == sum(k[0] == zoom for k in V1) < len(V1)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = mbtiles.read(spark, path).tiles().filter((F.col("z") == zoom) & F.col("tile_data").isNotNull())
        assert as_dict(rows) == {k: v for k, v in V1.items() if k[0] == zoom and v is not None}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_hilbert_ids():
    assert [pmtiles.tile_id(0, 0, 0), pmtiles.tile_id(1, 0, 0), pmtiles.tile_id(1, 0, 1), pmtiles.tile_id(1, 1, 1), pmtiles.tile_id(1, 1, 0), pmtiles.tile_id(2, 0, 0)] == [0, 1, 2, 3, 4, 5]
    for n in (0, 1, 5, 77, 12345, 19078479):
        assert pmtiles.tile_id(*pmtiles.tile_of(n)) == n


def test_pmtiles(spark, tmp_path):
    want = {(z, x, y): f"{z}/{x}/{y}".encode() for z in range(4) for x in range(1 << z) for y in range(1 << z) if (x + y) % 3}
    (tmp_path / "a.pmtiles").write_bytes(pmtiles.write_bytes(want))
    got = {(r["z"], r["x"], r["y"]): bytes(r["tile_data"]) for r in pmtiles.read(spark, str(tmp_path)).collect()}
    assert got == want
    ranged = pmtiles.read(spark, str(tmp_path), mounted=True, partitions=3)
    assert {(r["z"], r["x"], r["y"]): bytes(r["tile_data"]) for r in ranged.collect()} == want
    assert [r["id"] for r in pmtiles.discover(spark, str(tmp_path)).collect()] == ["a"]


def test_directory_round_trip(spark, tmp_path):
    rows = frame(spark, {k: v for k, v in V1.items() if v})
    files.write_directory(rows, str(tmp_path), "mvt")
    (tmp_path / "readme.txt").write_text("x")
    back = files.read_directory(spark, str(tmp_path), compress="gzip")
    assert back.count() == rows.count()
    files.write_directory(back, str(tmp_path / "again"), "pbf")
    assert as_dict(files.read_directory(spark, str(tmp_path / "again"))) == as_dict(rows)


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": 7, "geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {"a": 1}},
        {"type": "Feature", "geometry": None, "properties": {}},
        {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, {"type": "MultiPoint", "coordinates": [[1, 1], [2, 2]]}]}, "properties": None},
    ]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "LineString", "coordinates": [[0, 0], [10, 10]]}))
    rows = files.read_geojson(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and {r["id"] for r in rows} == {7, None}
    assert all(abs(r["minx"]) < 1e-6 for r in rows if r["id"] == 7)


def test_reload_stream(spark, tmp_path):
    source = tmp_path / "in"
    write = lambda rows: spark.createDataFrame(rows, "id string, version string, ts long").coalesce(1).write.mode("append").parquet(str(source))
    seen = []
    apply = lambda action, ids: seen.extend((action, r["id"]) for r in ids.collect())
    baseline = reload.Baseline(str(tmp_path / "state"))
    snap = lambda rows: spark.createDataFrame(rows, "id string, version string")
    reload.reconcile(snap([("a", "1"), ("b", "1")]), 0, baseline, apply)
    assert seen == []
    reload.reconcile(snap([("a", "2"), ("c", "1")]), 1, baseline, apply)
    assert seen == [("update", "a"), ("add", "c"), ("remove", "b")]
    write([("x", "1", 1), ("y", "1", 1), ("x", "2", 2)])
    stream = spark.readStream.schema("id string, version string, ts long").parquet(str(source))
    reload.watch(stream, str(tmp_path / "s2"), str(tmp_path / "c2"), apply).awaitTermination(60)
    kept = spark.read.parquet(str(tmp_path / "s2" / "0"))
    assert {tuple(r) for r in kept.select("id", "version").collect()} == {("x", "2"), ("y", "1")}


def test_tile_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1, b"abc"), ("2024-01-01 00:50:00", 1, b"d"), ("2024-01-01 05:00:00", 2, b"e")], "ts string, z int, tile_data binary").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = reload.latest_tiles(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["z"], r["n_tiles"], r["bytes"]) for r in spark.table("hours").collect()) == [(1, 2, 4), (2, 1, 1)]
