"""Tiles in directories, GeoJSON features and GeoParquet tables."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import codecs
from tessella.functions import tile_math as tm

_PATH = r"/([0-9]+)/([0-9]+)/([0-9]+)\.([A-Za-z]+)$"


def read_directory(spark: SparkSession, path: str, scheme: str = "xyz", compress: str | None = None) -> DataFrame:
    """z, x, y (stored south-up), tile_data and format of files ``{z}/{x}/{y}.{ext}``; others are passed over.

    ``compress`` packs vector tiles; images are compressed in themselves and stay.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = lambda k: F.regexp_extract("path", _PATH, k)
    rows = files.filter(F.col("path").rlike(_PATH)).select(part(1).cast("int").alias("z"), part(2).cast("long").alias("x"), part(3).cast("long").alias("y"), F.lower(part(4)).alias("ext"), F.col("content").alias("tile_data"))
    known = F.create_map(*[F.lit(v) for pair in codecs.NAMES.items() for v in pair])
    rows = rows.withColumn("format", F.try_element_at(known, F.col("ext"))).filter("format is not null").drop("ext")
    if scheme == "xyz":
        rows = rows.withColumn("y", tm.invert_y("z", "y"))
    if compress:
        packed = codecs.recode("tile_data", "uncompressed", compress)
        rows = rows.withColumn("tile_data", F.when(F.col("format").isin("mvt", "mlt"), packed).otherwise(F.col("tile_data")))
    return rows


def write_directory(tiles: DataFrame, path: str, extension: str, scheme: str = "xyz") -> None:
    """A file for each tile with data; gzip is unpacked. Every task writes its own tiles to the shared ``path``."""
    rows = tiles.filter("tile_data is not null")
    rows = rows.withColumn("y", tm.invert_y("z", "y")) if scheme == "xyz" else rows

    def save(part):
        import gzip
        from pathlib import Path

        for r in part:
            data = bytes(r["tile_data"])
            target = Path(path) / str(r["z"]) / str(r["x"])
            target.mkdir(parents=True, exist_ok=True)
            (target / f"{r['y']}.{extension}").write_bytes(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)

    rows.select("z", "x", "y", "tile_data").foreachPartition(save)


def _points(coords) -> list:
    return coords if coords and isinstance(coords[0], int | float) else [p for c in coords for p in _points(c)]


def _wkb(geometry: dict | None) -> list[bytes]:
    """WKB of a GeoJSON geometry; collections come apart, null and empty ones give none."""
    if not geometry:
        return []
    kind, c = geometry.get("type"), geometry.get("coordinates")
    if kind == "GeometryCollection":
        return [w for g in geometry.get("geometries", []) for w in _wkb(g)]
    if not c:
        return []
    pt = lambda p: struct.pack("<2d", *p[:2])
    line = lambda ps: struct.pack("<I", len(ps)) + b"".join(map(pt, ps))
    rings = lambda rs: struct.pack("<I", len(rs)) + b"".join(map(line, rs))
    one = {"Point": (1, pt), "LineString": (2, line), "Polygon": (3, rings)}
    if kind in one:
        code, body = one[kind]
        return [struct.pack("<BI", 1, code) + body(c)]
    code, body = one[kind.removeprefix("Multi")]
    inner = b"".join(struct.pack("<BI", 1, code) + body(part) for part in c)
    return [struct.pack("<BII", 1, code + 3, len(c)) + inner]


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, geom (WKB in mercator metres), props (JSON) and the box of every feature of the files at ``path``.

    FeatureCollections, single features and bare geometries are read; features without a geometry go. Files
    are read whole, a task each, and turned into rows there.
    """
    texts = spark.read.text(path, wholetext=True)

    def run(batches):
        for batch in batches:
            rows = []
            for (text,) in batch.itertuples(index=False):
                doc = json.loads(text)
                kind = doc.get("type")
                features = doc["features"] if kind == "FeatureCollection" else [doc] if kind == "Feature" else [{"geometry": doc, "properties": None}]
                for k, f in enumerate(features):
                    fid = f.get("id") if isinstance(f.get("id"), int) else None
                    for raw in _wkb(_to_mercator(f.get("geometry"))):
                        rows.append((k, fid, raw, json.dumps(f.get("properties") or {})))
            yield pd.DataFrame(rows, columns=["ord", "id", "geom", "props"])

    rows = texts.mapInPandas(run, "ord bigint, id bigint, geom binary, props string")
    return with_boxes(rows)


def _to_mercator(g):
    import math

    if not g:
        return g
    if g.get("type") == "GeometryCollection":
        return {**g, "geometries": [_to_mercator(x) for x in g.get("geometries", [])]}

    def move(c):
        if c and isinstance(c[0], int | float):
            s = math.sin(math.radians(min(max(c[1], -tm.MAX_LAT), tm.MAX_LAT)))
            return [math.radians(c[0]) * tm.RADIUS, tm.RADIUS / 2 * math.log((1 + s) / (1 - s))]
        return [move(x) for x in c]

    return {**g, "coordinates": move(g.get("coordinates") or [])}


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("minx", "miny", "maxx", "maxy")]))
def box_of(geoms: pd.Series) -> pd.DataFrame:
    from tessella.functions.geometry import read_wkb

    out = []
    for g in geoms:
        points = [p for _, parts in (read_wkb(bytes(g)) if g is not None else []) for part in parts for p in part]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        out.append((min(xs), min(ys), max(xs), max(ys)) if points else (None,) * 4)
    return pd.DataFrame(out, columns=["minx", "miny", "maxx", "maxy"])


def with_boxes(df: DataFrame, geometry: str = "geom") -> DataFrame:
    return df.withColumn("__b", box_of(geometry)).select(*df.columns, "__b.*")


def read_geoparquet(spark: SparkSession, path: str, geometry: str | None = None) -> DataFrame:
    """The table with its WKB column as ``geom``; the only binary column, if none is named."""
    df = spark.read.parquet(path)
    binary = [f.name for f in df.schema if f.dataType.simpleString() == "binary"]
    if geometry is None:
        if len(binary) != 1:
            raise ValueError(f"one geometry column is needed, there are {binary}")
        geometry = binary[0]
    return df.withColumnRenamed(geometry, "geom")
