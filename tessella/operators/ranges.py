"""Rectangles of tiles: from boxes, without overlap, and expanded to rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.tile_math import EARTH, MAX_LAT, RADIUS

WORLD = (-180.0, -85.0511, 180.0, 85.0511)


def tile_index(lng: float, lat: float, zoom: int) -> tuple[int, int]:
    """The tile of a point; the same rule as the Column expressions, for single values on the driver."""
    last, size = (1 << zoom) - 1, EARTH / (1 << zoom)
    s = math.sin(math.radians(min(max(lat, -MAX_LAT), MAX_LAT)))
    x, y = math.radians(lng) * RADIUS, RADIUS / 2 * math.log((1 + s) / (1 - s))
    return min(int(abs(EARTH / 2 + x) / size), last), min(int(abs(EARTH / 2 - y) / size), last)


def bbox_to_range(left: float, bottom: float, right: float, top: float, zoom: int) -> tuple[int, int, int, int]:
    min_x, min_y = tile_index(left, top, zoom)
    max_x, max_y = tile_index(right, bottom, zoom)
    return min_x, min_y, max_x, max_y


def check_bbox(box: tuple[float, float, float, float]) -> None:
    left, bottom, right, top = box
    if not (-180 <= left <= right <= 180 and -MAX_LAT <= bottom <= top <= MAX_LAT):
        raise ValueError(f"box {box} is not within the tiled world")


@dataclass(frozen=True)
class Rect:
    """Tiles from min to max, both included, at one zoom."""

    zoom: int
    min_x: int
    min_y: int
    max_x: int
    max_y: int

    def __len__(self) -> int:
        return (self.max_x - self.min_x + 1) * (self.max_y - self.min_y + 1)

    def overlaps(self, other: Rect) -> bool:
        across = self.min_x <= other.max_x and other.min_x <= self.max_x
        return self.zoom == other.zoom and across and self.min_y <= other.max_y and other.min_y <= self.max_y

    def without(self, other: Rect) -> list[Rect]:
        """Up to four rectangles that cover what ``other`` doesn't: left and right in full height, then above and below."""
        if not self.overlaps(other):
            return [self]
        low, high = max(self.min_x, other.min_x), min(self.max_x, other.max_x)
        pieces = [
            Rect(self.zoom, self.min_x, self.min_y, other.min_x - 1, self.max_y),
            Rect(self.zoom, other.max_x + 1, self.min_y, self.max_x, self.max_y),
            Rect(self.zoom, low, self.min_y, high, other.min_y - 1),
            Rect(self.zoom, low, other.max_y + 1, high, self.max_y),
        ]
        return [p for p in pieces if p.min_x <= p.max_x and p.min_y <= p.max_y]


def append_rect(rects: list[Rect], new: Rect) -> list[Rect]:
    """``rects`` and what of ``new`` none of them covers."""
    pieces = [new]
    for r in rects:
        pieces = [p for piece in pieces for p in piece.without(r)]
    return rects + pieces


def ranges_of(boxes: list[tuple[float, float, float, float]], zooms: list[int]) -> list[Rect]:
    """Rectangles over every box at every zoom, none overlapping another."""
    out: list[Rect] = []
    for z in zooms:
        mine: list[Rect] = []
        for box in boxes:
            check_bbox(box)
            mine = append_rect(mine, Rect(z, *bbox_to_range(*box, z)))
        out += mine
    return out


def rects_frame(spark: SparkSession, rects: list[Rect]) -> DataFrame:
    return spark.createDataFrame([(r.zoom, r.min_x, r.min_y, r.max_x, r.max_y) for r in rects], "zoom int, min_x bigint, min_y bigint, max_x bigint, max_y bigint")


def tiles_of(rects: DataFrame) -> DataFrame:
    """A row (z, x, y) for every tile of every rectangle; columns are dealt out before rows are made."""
    columns = rects.select("zoom", "min_y", "max_y", F.explode(F.sequence("min_x", "max_x")).alias("x"))
    return columns.select(F.col("zoom").alias("z"), "x", F.explode(F.sequence("min_y", "max_y")).alias("y"))


def tile_count(rects: DataFrame) -> DataFrame:
    size = (F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1)
    return rects.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_tiles"))
