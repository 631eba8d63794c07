import pytest
from pyspark.sql import functions as F

from tessella.operators import cache, catalog, checks, composite, metadata, patch, tileset, transcode
from tessella.operators.tileset import KEY

# Two versions of a tileset, and their content hashes.
V1 = {(3, 6, 7): "root", (5, 0, 0): "same", (5, 0, 1): "", (5, 1, 1): "edit-v1", (5, 1, 2): "", (5, 1, 3): "non-empty", (5, 2, 2): "remove", (5, 2, 3): "", (6, 0, 3): "same", (6, 0, 5): "1-keep-1-rm", (6, 1, 4): "edit-v1", (6, 2, 6): "1-keep-1-rm"}
V2 = {(3, 6, 7): "root", (5, 0, 0): "same", (5, 0, 1): "", (5, 1, 1): "edit-v2", (5, 1, 2): "not-empty", (5, 1, 3): "", (5, 3, 7): "new", (5, 3, 8): "new", (6, 0, 3): "same", (6, 0, 5): "1-keep-1-rm", (6, 1, 4): "edit-v2a"}
DIF = {(5, 1, 1): "edit-v2", (5, 1, 2): "not-empty", (5, 1, 3): "", (5, 2, 2): None, (5, 2, 3): None, (5, 3, 7): "new", (5, 3, 8): "new", (6, 1, 4): "edit-v2a", (6, 2, 6): None}
HASHES = {"none": "D41D8CD98F00B204E9800998ECF8427E", "v1": "9ED9178D7025276336C783C2B54D6258", "v2": "3BCDEE3F52407FF1315629298CB99133", "dif": "B86122579EDCDD4C51F3910894FCC1A1"}


def frame(spark, rows):
    return spark.createDataFrame([(*k, None if v is None else v.encode()) for k, v in rows.items()], "z int, x long, y long, tile_data binary")


def as_dict(df):
    return {(r["z"], r["x"], r["y"]): None if r["tile_data"] is None else bytes(r["tile_data"]).decode() for r in df.collect()}


@pytest.fixture(scope="module")
def v1(spark):
    return frame(spark, V1)


@pytest.fixture(scope="module")
def v2(spark):
    return frame(spark, V2)


def digest(df):
    return checks.agg_tiles_hash(df).first()[0]


def test_content_hashes(spark, v1, v2):
    assert [digest(df) for df in (v1.limit(0), v1, v2, patch.diff(v1, v2))] == list(HASHES.values())
    with pytest.raises(ValueError, match="too many"):
        checks.agg_tiles_hash(v1, most=3)


def test_tree_hash_tells_tilesets_apart(v1, v2):
    rows = lambda df: {tuple(r) for r in checks.tree_hash(df, 6).collect()}
    assert rows(v1) == rows(v1.repartition(7)) and rows(v1) != rows(v2)


def test_diff_and_apply(v1, v2):
    dif = patch.diff(v1, v2)
    assert as_dict(dif) == DIF
    assert as_dict(patch.apply(v1, dif)) == V2
    assert patch.diff(v1, v1).isEmpty()


def test_patch_checks():
    with pytest.raises(ValueError, match="no hashes"):
        patch.check_patch(None, "a", "b")
    with pytest.raises(ValueError, match="is for"):
        patch.check_patch("x", "a", "b")
    patch.check_patch("x", "a", "b", force=True)


def test_metadata_diff_and_apply(spark):
    m1 = spark.createDataFrame([("same", "s"), ("edit", "v1"), ("remove", "r"), ("agg_tiles_hash", "h")], "name string, value string")
    m2 = spark.createDataFrame([("same", "s"), ("edit", "v2"), ("new", "n")], "name string, value string")
    dif = patch.diff_metadata(m1, m2)
    assert {tuple(r) for r in dif.collect()} == {("edit", "v2"), ("remove", None), ("new", "n")}
    assert {tuple(r) for r in patch.apply_metadata(m1, dif).collect()} == {tuple(r) for r in m2.collect()}
    done = spark.createDataFrame([("agg_tiles_hash", "a"), ("agg_tiles_hash_before_apply", "b"), ("agg_tiles_hash_after_apply", "c"), ("x", None), ("y", "1")], "name string, value string")
    assert {tuple(r) for r in patch.patched_metadata(done).collect()} == {("agg_tiles_hash", "c"), ("y", "1")}


@pytest.mark.parametrize("layout", ["flat", "flat_with_hash", "normalized", "cache"])
def test_layouts_keep_tiles(v1, layout):
    ts = tileset.to_layout(v1, layout)
    assert as_dict(ts.tiles()) == V1
    assert as_dict(tileset.copy(ts, "flat_with_hash").tiles()) == V1
    assert ts.coords().count() == len(V1)


def test_normalized_shares_images_and_keeps_tombstones(spark):
    ts = tileset.to_layout(frame(spark, {**V1, (9, 1, 1): None}), "normalized")
    assert ts.tables["images"].count() == len(set(V1.values()))
    assert as_dict(ts.tiles("left"))[9, 1, 1] is None and (9, 1, 1) not in as_dict(ts.tiles())


def test_detect_layout():
    key = ["zoom_level", "tile_column", "tile_row"]
    assert tileset.detect_layout({"map": [*key, "tile_id", "grid_id"], "images": ["tile_id", "tile_data"], "tiles": [*key, "tile_data"]}) == "normalized"
    assert tileset.detect_layout({"tiles": [*key, "tile_data"]}) == "flat"
    assert tileset.detect_layout({"tile_cache": [*key, "fetched", "expires", "etag", "tile_data"]}) == "cache"
    with pytest.raises(ValueError):
        tileset.detect_layout({"tiles": key})


def test_copy_filters_reach_the_key_table(v1):
    ts = tileset.to_layout(v1, "normalized")
    assert set(as_dict(tileset.copy(ts, zooms=[3]).tiles())) == {(3, 6, 7)}
    assert set(as_dict(tileset.copy(ts, min_zoom=6).tiles())) == {k for k in V1 if k[0] == 6}
    assert tileset.copy(ts, what="metadata").tiles().isEmpty()


def test_lookup(spark, v1):
    ts = tileset.to_layout(v1, "flat")
    coords = spark.createDataFrame([(3, 6, 0), (5, 0, 31), (4, 0, 0)], "z int, x long, y long")
    assert as_dict(ts.get_tiles(coords)) == {(3, 6, 0): "root", (5, 0, 31): "same"}
    assert ts.contains(coords).count() == 2


def test_merge_policies(spark, v1, v2):
    assert as_dict(tileset.merge(v1, v2, "override")) == {**V1, **V2}
    assert as_dict(tileset.merge(v1, v2, "ignore")) == {**V2, **V1}
    with pytest.raises(ValueError, match="there already"):
        tileset.merge(v1, v2, "abort")
    with pytest.raises(ValueError):
        tileset.merge(v1, v1, "abort")
    assert as_dict(tileset.merge(v1.limit(0), v1, "abort")) == V1 == as_dict(tileset.merge(v1.limit(0), v1, "default"))
    with pytest.raises(ValueError):
        tileset.merge(v1, v2, "default")


def test_summary(spark, v1):
    by = {r["z"]: r for r in checks.summary(v1).collect()}
    assert (by[5]["tile_count"], by[5]["min_size"], by[5]["max_size"]) == (7, 0, 9)
    whole = checks.summary_all(v1).first()
    assert whole["tile_count"] == 12 and (whole["min_zoom"], whole["max_zoom"]) == (3, 6)
    assert checks.summary_all(v1.limit(0)).first()["tile_count"] == 0


def test_violations(spark):
    rows = frame(spark, {(1, 0, 0): "a", (1, 2, 0): "b"}).withColumn("tile_hash", F.lit("nope"))
    found = {r["check"]: r["n"] for r in checks.violations(rows.union(rows.limit(1))).collect()}
    assert found == {"duplicate key": 1, "tile out of range": 1 + (found["tile out of range"] - 1), "wrong hash": 3}


def test_cache(spark):
    schema = "z int, x long, y long, fetched long, expires long, etag string, tile_data binary"
    c = spark.createDataFrame([(1, 0, 0, 1, 10, "a", b"xxxx"), (1, 0, 1, 1, None, "b", b"yy"), (1, 1, 0, 1, 30, "c", b""), (1, 1, 1, 1, 30, "d", b"zzz")], schema)
    assert cache.expired(c, 20).count() == 1 and cache.purge(c, 20).count() == 3
    assert {r["etag"] for r in cache.evict(c, 5).collect()} == {"b", "c", "d"}
    assert {r["etag"] for r in cache.evict(c, 2).collect()} == {"b"}
    assert cache.evict(c, 100).count() == 4
    new = spark.createDataFrame([(1, 0, 0, 5, 50, "n", b"new")], schema)
    assert {r["etag"] for r in cache.upsert(c, new).collect()} == {"n", "b", "c", "d"}
    touched = {r["etag"]: bytes(r["tile_data"]) for r in cache.touch(c, new).collect()}
    assert touched["n"] == b"xxxx"
    assert {r["fresh"] for r in cache.lookup(c, c.select(*KEY), 20).collect()} == {True, False}


def test_composite(spark, v1, v2):
    merged = as_dict(composite.merge_tiles(composite.union_sources([("a", v1), ("b", v2)], {"b": (6, 9)})))
    assert merged[3, 6, 7] == "root" and merged[6, 1, 4] == "edit-v1edit-v2a" and (5, 0, 1) not in merged
    with pytest.raises(ValueError):
        composite.split_ids(",".join("x" * 200))


def test_transcode_and_binary_patches(spark, v1, v2):
    rows = v1.withColumn("tile_hash", tileset.md5_hex("tile_data"))

    def upper(data: bytes) -> bytes:
        if data == b"root":
            raise ValueError
        return data.upper()

    assert as_dict(transcode.transcode(rows, upper)) == {k: v.upper() for k, v in V1.items() if v != "root"}
    for encoding in ("uncompressed", "gzip"):
        from tessella.functions import codecs

        a, b = (df.withColumn("tile_data", codecs.recode("tile_data", "uncompressed", encoding)) for df in (v1, v2))
        done = transcode.binary_apply(a, transcode.binary_diff(a, b, encoding), encoding)
        plain = as_dict(done.withColumn("tile_data", codecs.recode("tile_data", encoding, "uncompressed")))
        assert plain == {k: V2[k] for k in V1.keys() & V2.keys() if V1[k] != V2[k]}


def test_snapshot_diff_and_catalog(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "id string, version string")
    b = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", None), ("e", "1")], "id string, version string")
    assert {tuple(r) for r in catalog.snapshot_diff(a, b).collect()} == {("a", "update"), ("d", "remove"), ("e", "add")}
    cols = spark.createDataFrame([("s", "t", "geom", "geometry"), ("s", "t", "name", "_text"), ("s", "u", "geog", "geography")], "schema string, table string, column string, type string")
    idx = spark.createDataFrame([("s", "t", "geom", True)], "schema string, table string, column string, is_spatial boolean")
    found = {r["table"]: r for r in catalog.geometry_tables(cols, idx).collect()}
    assert found["t"]["properties"] == {"name": "text"} and found["t"]["indexed"] and found["u"]["properties"] == {} and not found["u"]["indexed"]
    args = spark.createDataFrame([("f", 1, "z", "integer", "bytea"), ("f", 2, "x", "integer", "bytea"), ("f", 3, "y", "integer", "bytea"), ("g", 1, "zoom", "integer", "bytea,text"), ("g", 2, "x", "integer", "bytea,text"), ("g", 3, "y", "integer", "bytea,text"), ("g", 4, "q", "json", "bytea,text"), ("h", 1, "z", "integer", "text")], "function string, position int, name string, type string, returns string")
    assert {tuple(r) for r in catalog.tile_functions(args).collect()} == {("f", False), ("g", True)}


def test_small_helpers():
    ids = catalog.IdResolver({"catalog"})
    assert [ids.resolve("a b", "1"), ids.resolve("a b", "2"), ids.resolve("a b", "1"), ids.resolve("catalog", "3")] == ["a-b", "a-b.1", "a-b", "catalog.1"]
    assert catalog.find_name("GEOM", ["geom", "x"]) == "geom"
    with pytest.raises(KeyError):
        catalog.find_name("Geom", ["geom", "GEOM"])
    assert catalog.merge_patch({"a": 1, "b": {"c": 1}}, {"a": None, "b": {"d": 2}}) == {"b": {"c": 1, "d": 2}}
    assert catalog.parse_crs("EPSG:3857") == 3857 and catalog.parse_crs("OGC:CRS84") == 4326
    for bad in ("", "EPSG:0", "EPSG:x", "foo"):
        with pytest.raises(ValueError):
            catalog.parse_crs(bad)
    assert catalog.query_value("[1]") == [1] and catalog.query_value("a") == "a"


def test_metadata(spark):
    m = spark.createDataFrame([("minzoom", "3"), ("maxzoom", "x"), ("bounds", "1,2,3,4"), ("center", "1,2"), ("json", "{"), ("name", "n"), ("none", None), ("blank", "")], "name string, value string")
    valid = {r["name"]: r["valid"] for r in metadata.parse(m).collect()}
    assert valid == {"minzoom": True, "maxzoom": False, "bounds": True, "center": False, "json": False, "name": True}
    tiles = frame(spark, V1)
    zooms = lambda df: {r["name"]: r["value"] for r in df.collect() if "zoom" in r["name"]}
    assert zooms(metadata.update_zooms(m, tiles)) == {"minzoom": "3", "maxzoom": "6"}
    assert zooms(metadata.update_zooms(spark.createDataFrame([("minzoom", "1"), ("maxzoom", "4")], "name string, value string"), tiles, "grow")) == {"minzoom": "1", "maxzoom": "6"}
    doc = {"name": "x", "minzoom": 1, "bounds": [1.0, 2.0, 3.0, 4.0], "vector_layers": [{"id": "a"}]}
    assert metadata.from_rows(metadata.to_rows(doc)) == doc
    assert metadata.get(m, "name") == "n"


def test_content_hashes_are_verified(spark, v1, v2):
    empty = spark.createDataFrame([], "name string, value string")
    for stored in (None, "crc:12", "0" * 32):
        meta_ = tileset.upsert_metadata(empty, {"agg_tiles_hash": stored})
        with pytest.raises(ValueError):
            checks.validate(v1, meta_, "verify")
        done = checks.validate(v1, meta_, "update")
        assert checks.validate(v1, done, "verify").collect() == done.collect() and checks.validate(v1, meta_, "off").collect() == meta_.collect()
    with pytest.raises(ValueError, match="duplicate key"):
        checks.validate(v1.union(v1), done, "off")
    with pytest.raises(ValueError, match="no content hash"):
        patch.diff_tilesets(v1, empty, v2, done)
    other = checks.validate(v2, empty, "update")
    made, made_meta = patch.diff_tilesets(v1, done, v2, other)
    assert as_dict(patch.apply_tileset(v1, done, made, made_meta)[0].select("z", "x", "y", "tile_data")) == as_dict(v2)
    with pytest.raises(ValueError, match="the patch is for"):
        patch.apply_tileset(v2, other, made, made_meta)
    with pytest.raises(ValueError, match="is a patch"):
        patch.diff_tilesets(made, made_meta, v2, other)
    with pytest.raises(ValueError, match="content hash is"):
        patch.apply_tileset(v1, done, made.limit(1), made_meta)


def test_a_restarted_reload_knows_its_baseline(spark, tmp_path):
    from tessella.streaming import reload

    seen = []
    apply = lambda action, ids: seen.extend((action, r["id"]) for r in ids.collect())
    snap = lambda rows: spark.createDataFrame(rows, "id string, version string")
    reload.reconcile(snap([("a", "1"), ("b", "1")]), 0, reload.Baseline(str(tmp_path / "b")), apply)
    assert seen == []
    reload.reconcile(snap([("a", "2"), ("c", "1")]), 1, reload.Baseline(str(tmp_path / "b")), apply)
    assert seen == [("update", "a"), ("add", "c"), ("remove", "b")]
    reload.reconcile(snap([("a", "2"), ("c", "1")]), 1, reload.Baseline(str(tmp_path / "b")), apply)
    assert len(seen) == 3


def test_entries_without_expiry_are_evicted_in_order(spark):
    from tessella.operators import cache

    rows = [(z, x, y, 0, None if z else 50 + x, "e", b"d" * (1 + (x + y) % 3)) for z in (0, 3, 4) for x in range(4) for y in range(8)]
    df = spark.createDataFrame(rows, "z int, x long, y long, fetched long, expires long, etag string, tile_data binary")
    order = sorted(rows, key=lambda r: (r[4] if r[4] is not None else 1 << 62, *r[:3]), reverse=True)
    for most in (0, 1, 40, 77, 120, 150, 1000):
        want, held = set(), 0
        for r in order:
            if (held := held + len(r[6])) > most:
                break
            want.add(r[:3])
        assert {(r["z"], r["x"], r["y"]) for r in cache.evict(df, most).collect()} == want, most
