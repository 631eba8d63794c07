"""Bulk rendering: rectangles of tiles, what a source makes of them, and an archive that takes what isn't empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import tile_math as tm

from . import ranges, tileset
from .tileset import KEY

Source = Callable[[DataFrame], DataFrame]


def render(source: Source, rects: DataFrame) -> DataFrame:
    """Stored rows (south-up) of the tiles of ``rects`` that ``source`` fills; it takes z, x, y north-up and adds tile_data.

    Rectangles don't overlap, so no tile is asked for twice. Empty and missing data make no row.
    """
    made = source(ranges.tiles_of(rects)).select(*KEY, "tile_data").filter(F.octet_length("tile_data") > 0)
    return made.withColumn("y", tm.invert_y("z", "y"))


def render_boxes(
    spark: SparkSession, source: Source, zooms: list[int], boxes: list[tuple[float, float, float, float]] | None = None, into: DataFrame | None = None, on_duplicate: str = "override"
) -> DataFrame:
    """Tiles over ``boxes``, or over the world, put into those that are there by the policy of ``tileset.merge``."""
    made = render(source, ranges.rects_frame(spark, ranges.ranges_of(boxes or [ranges.WORLD], sorted(set(zooms)))))
    return made if into is None else tileset.merge(into.select(*KEY, "tile_data"), made, on_duplicate)
