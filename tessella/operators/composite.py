"""Composite sources: tiles of several sources at one key become one tile."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import codecs

#: Encodings whose streams may stand one after the other.
CHAINABLE = ("uncompressed", "gzip", "zstd")
MOST_SOURCES = 128


def split_ids(ids: str) -> list[str]:
    found = ids.split(",")
    if len(found) > MOST_SOURCES:
        raise ValueError(f"{len(found)} sources are more than {MOST_SOURCES}")
    return found


def union_sources(sources: list[tuple[str, DataFrame]], zooms: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Tiles of all sources with ``ord`` and ``source``; a source gives none outside its zooms."""
    out = None
    for k, (name, tiles) in enumerate(sources):
        low, high = (zooms or {}).get(name, (0, 30))
        part = tiles.filter(F.col("z").between(low, high)).select(F.lit(k).alias("ord"), F.lit(name).alias("source"), "z", "x", "y", "tile_data")
        out = part if out is None else out.unionByName(part)
    return out


def merge_tiles(rows: DataFrame, encoding: str = "uncompressed") -> DataFrame:
    """z, x, y, tile_data, n_sources: layers of a key in source order. Empty tiles add nothing; a single tile stays as it is.

    A key has at most MOST_SOURCES rows, so its bytes may be gathered. Streams of gzip and zstd are put
    one after the other without unpacking.
    """
    data = F.col("tile_data") if encoding in CHAINABLE else codecs.recode("tile_data", encoding, "uncompressed")
    some = rows.filter(F.octet_length("tile_data") > 0).select("ord", "z", "x", "y", data.alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda r: r["part"])
    whole = some.groupBy("z", "x", "y").agg(parts.alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p)), ""))
    out = whole.select("z", "x", "y", joined.alias("tile_data"), F.size("parts").alias("n_sources"))
    return out if encoding in CHAINABLE else out.withColumn("tile_data", codecs.recode("tile_data", "uncompressed", encoding))


@F.pandas_udf(T.BooleanType())
def mergeable(formats: pd.Series) -> pd.Series:
    """Whether formats (format/encoding, comma-joined) are all one, and one whose layers may be put together."""
    return formats.map(lambda f: len(set(f.split(","))) == 1 and f.split(",")[0].split("/")[0] in ("mvt", "mlt"))
