"""Vector tiling: features meet tiles by an equi-join on the tiles they cover, then each tile is encoded.

A feature has columns id, minx, miny, maxx, maxy (metres) and what else it carries. Its box, grown by
the tile's buffer, covers a range of tiles; those are generated from the feature, so no feature is
compared with a tile that it doesn't touch, and the join needs no inequality.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import geometry as geo
from tessella.functions import tile_math as tm


def point_features(df: DataFrame, lng: Column, lat: Column) -> DataFrame:
    """``df`` with mx and my in metres, and its box columns."""
    x, y = tm.mercator_x(lng), tm.mercator_y(lat)
    return df.select("*", x.alias("minx"), y.alias("miny"), x.alias("maxx"), y.alias("maxy"))


def cover(features: DataFrame, zooms: list[int], extent: int = 4096, buffer: int = 64) -> DataFrame:
    """``features`` with z, x, y: a row for each tile that the feature's box touches, buffer included.

    A feature over very many tiles is spread column by column, and its rows are made in the scan's tasks;
    no tile's or feature's rows are gathered.
    """
    half, rows = tm.EARTH / 2, features.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    size, last = tm.tile_length("z"), tm.side("z") - 1
    more = size * (buffer / extent)
    index = lambda metres: F.greatest(F.least(F.floor(metres / size).cast("long"), last), F.lit(0))
    rows = rows.filter((F.col("maxx") + more >= -half) & (F.col("minx") - more <= half) & (F.col("maxy") + more >= -half) & (F.col("miny") - more <= half))
    x0, x1 = index(F.col("minx") - more + half), index(F.col("maxx") + more + half)
    y0, y1 = index(F.lit(half) - F.col("maxy") - more), index(F.lit(half) - F.col("miny") + more)
    return rows.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))


def join_tiles(features: DataFrame, coords: DataFrame, zooms: list[int], extent: int = 4096, buffer: int = 64) -> DataFrame:
    """Features on the tiles of ``coords`` (z, x, y), whose zooms are ``zooms``."""
    return cover(features, zooms, extent, buffer).join(coords.select("z", "x", "y").distinct(), ["z", "x", "y"])


def search_box(z, x, y, srid: int, extent: int = 4096, buffer: int = 64) -> Column:
    """Struct (minx, miny, maxx, maxy) in which a tile's features are looked for, in the reference system of their table.

    Metres are grown in metres; degrees are grown in degrees, as a box past the antimeridian would fold when it is transformed.
    """
    if srid == 3857:
        return tm.buffered_box(z, x, y, extent, buffer)
    if srid != 4326:
        raise ValueError(f"reference system {srid} is not known")
    box, more = tm.range_box(z, x, y, x, y), tm.margin_degrees(z, extent, buffer)
    sides = (box["min_lng"] - more, box["min_lat"] - more, box["max_lng"] + more, box["max_lat"] + more)
    return F.struct(*[side.alias(name) for side, name in zip(sides, ("minx", "miny", "maxx", "maxy"), strict=True)])


@F.pandas_udf(T.BooleanType())
def meets_box(geoms: pd.Series, minx: pd.Series, miny: pd.Series, maxx: pd.Series, maxy: pd.Series) -> pd.Series:
    """Whether a WKB geometry itself has points in the box; null meets nothing. For what a join on boxes has left."""
    boxes = zip(geoms, minx, miny, maxx, maxy, strict=True)
    return pd.Series([g is not None and any(geo.meets(s, tuple(box)) for s in geo.read_wkb(bytes(g))) for g, *box in boxes], dtype=bool)


def limit_features(rows: DataFrame, most: int, order: str = "id") -> DataFrame:
    """The first ``most`` features of each tile, by ``order``."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("z", "x", "y").orderBy(order))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")


def encode_tiles(
    rows: DataFrame, layer: str, geometry: str = "geom", props: list[str] | None = None, id_column: str | None = "id", extent: int = 4096, buffer: int = 64, clip: bool = True
) -> DataFrame:
    """z, x, y, tile_data and n_features: one vector tile a key, from rows of ``cover`` with WKB in metres.

    Each feature is clipped, snapped and written to bytes by itself, in the tasks that made its rows;
    features of a tile then meet sorted, and a tile streams through, so no tile's shapes are held as objects.
    Shapes that vanish on the grid are dropped, and tiles without features too.
    """
    props, hair = props or [], tm.EARTH * 2**-50

    def snap(batches):
        for batch in batches:
            keep, done = [], []
            z, x, y, geoms = (batch.column(c).to_pylist() for c in ("z", "x", "y", geometry))
            for k in range(batch.num_rows):
                size = tm.EARTH / (1 << z[k])
                left, top = x[k] * size - tm.EARTH / 2, tm.EARTH / 2 - y[k] * size
                box, more = (left, top - size, left + size, top), size * buffer / extent
                wide = (box[0] - more, box[1] - more, box[2] + more, box[3] + more)
                for shape in geo.read_wkb(bytes(geoms[k])) if geoms[k] is not None else []:
                    # Tiles were found by other sums than these sides: a shape on an edge may be a hair outside.
                    shape = geo.clip(geo.onto_sides(shape, wide, hair), wide) if clip else shape
                    shape = geo.snap(shape, box, extent) if shape else None
                    if shape:
                        keep.append(k)
                        done.append(json.dumps(shape))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in names], pa.array(done, pa.string())], names=[*names, "shape"])

    names = [c for c in rows.columns if c in {"z", "x", "y", *props, id_column}]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    snapped = rows.select(*dict.fromkeys([*names, geometry])).mapInArrow(snap, ", ".join(f"`{c}` {types[c]}" for c in names) + ", shape string")

    def encode(batches):
        key, held = None, []

        def tile():
            return (*key, geo.write_mvt(layer, held, extent), len(held))

        def emit(out):
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["z", "x", "y", "tile_data", "n_features"])

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                here = (row["z"], row["x"], row["y"])
                if key is not None and here != key:
                    out.append(tile())
                    held = []
                key = here
                kind, parts = json.loads(row["shape"])
                shape = (kind, [[tuple(p) for p in part] for part in parts])
                held.append((row[id_column] if id_column else None, shape, {p: row[p] for p in props}))
            yield emit(out)
        if held:
            yield emit([tile()])

    order = ["z", "x", "y", *([id_column] if id_column else []), "shape"]
    met = snapped.repartition("z", "x", "y").sortWithinPartitions(*order)
    return met.mapInArrow(encode, "z int, x bigint, y bigint, tile_data binary, n_features bigint")


def extent_of(features: DataFrame) -> DataFrame:
    """One row: the box over all features and their number; a box without width or height grows by 1 each way."""
    flat = features.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.count("minx").alias("n"))
    grow = F.when((F.col("minx") == F.col("maxx")) | (F.col("miny") == F.col("maxy")), 1.0).otherwise(0.0)
    return flat.select((F.col("minx") - grow).alias("minx"), (F.col("miny") - grow).alias("miny"), (F.col("maxx") + grow).alias("maxx"), (F.col("maxy") + grow).alias("maxy"), "n")


def property_types(features: DataFrame, props: str = "props", order: str = "id") -> DataFrame:
    """(key, type) of JSON properties: the first value in ``order`` that isn't null decides; arrays and objects are String."""
    pairs = features.select(order, F.explode(F.from_json(props, "map<string,variant>")).alias("key", "value"))
    kind = F.schema_of_variant("value")
    typed = F.when(kind == "BOOLEAN", "Boolean").when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), "Number").when(kind != "VOID", "String")
    return pairs.select(order, "key", typed.alias("type")).filter("type is not null").groupBy("key").agg(F.min_by("type", order).alias("type"))
