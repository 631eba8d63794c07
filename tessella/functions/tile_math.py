"""Tile coordinates as Column expressions: XYZ tiles, web mercator metres and degrees.

All indexes are longs: a 32-bit shift would wrap at high zooms. Everything stays in generated code, so
filters on these expressions cost no Python.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 40075016.6855785  # metres around the equator, as the tile scheme has it
RADIUS = EARTH / 2 / math.pi
MAX_ZOOM = 30
MAX_LAT = 85.0511287798066


def _col(c: Column | str | int | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def side(z: Column | str | int) -> Column:
    """Tiles along one side of zoom ``z``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), _col(z).cast("int"))


def invert_y(z: Column | str | int, y: Column | str | int) -> Column:
    """South-up row to north-up row, and back."""
    return side(z) - 1 - _col(y)


def valid_tile(z: Column | str, x: Column | str, y: Column | str) -> Column:
    """Whether z is from 0 to 30 and x and y lie on that zoom; false for nulls."""
    z, x, y = _col(z), _col(x), _col(y)
    safe = F.greatest(F.least(z, F.lit(MAX_ZOOM)), F.lit(0))
    return F.coalesce(z.between(0, MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < side(safe)) & (y < side(safe)), F.lit(False))


def mercator_x(lng: Column | str | float) -> Column:
    return F.radians(_col(lng)) * RADIUS


def mercator_y(lat: Column | str | float) -> Column:
    """Metres north; latitudes beyond the tiled world are moved to its edge, so poles don't divide by zero."""
    s = F.sin(F.radians(F.greatest(F.least(_col(lat), F.lit(MAX_LAT)), F.lit(-MAX_LAT))))
    return F.log((1 + s) / (1 - s)) * (RADIUS / 2)


def longitude(x: Column | str | float) -> Column:
    return F.degrees(_col(x) / RADIUS)


def latitude(y: Column | str | float) -> Column:
    return F.degrees(F.atan(F.sinh(_col(y) / RADIUS)))


def tile_length(z: Column | str | int) -> Column:
    """Metres along a tile's side."""
    return F.lit(EARTH) / side(z).cast("double")


def _index(metres: Column, z: Column | str | int) -> Column:
    # Points west or north of the world are reflected into it; the far edge belongs to the last tile.
    return F.least(F.floor(F.abs(metres) / tile_length(z)).cast("long"), side(z) - 1)


def tile_x(lng: Column | str | float, z: Column | str | int) -> Column:
    return _index(mercator_x(lng) + EARTH / 2, z)


def tile_y(lat: Column | str | float, z: Column | str | int) -> Column:
    return _index(F.lit(EARTH / 2) - mercator_y(lat), z)


def tile_range(left, bottom, right, top, z) -> Column:
    """Struct (min_x, min_y, max_x, max_y) of the tiles over a box in degrees."""
    return F.struct(tile_x(left, z).alias("min_x"), tile_y(top, z).alias("min_y"), tile_x(right, z).alias("max_x"), tile_y(bottom, z).alias("max_y"))


def tile_box(z, x, y) -> Column:
    """Struct (minx, miny, maxx, maxy) of one tile, in metres."""
    size = tile_length(z)
    left, top = _col(x) * size - EARTH / 2, F.lit(EARTH / 2) - _col(y) * size
    return F.struct(left.alias("minx"), (top - size).alias("miny"), (left + size).alias("maxx"), top.alias("maxy"))


def range_box(z, min_x, min_y, max_x, max_y) -> Column:
    """Struct (min_lng, min_lat, max_lng, max_lat) over a rectangle of tiles, in degrees."""
    size, half = tile_length(z), EARTH / 2
    return F.struct(
        longitude(_col(min_x) * size - half).alias("min_lng"),
        latitude(F.lit(half) - (_col(max_y) + 1) * size).alias("min_lat"),
        longitude((_col(max_x) + 1) * size - half).alias("max_lng"),
        latitude(F.lit(half) - _col(min_y) * size).alias("max_lat"),
    )


def buffered_box(z, x, y, extent: int = 4096, buffer: int = 64) -> Column:
    """``tile_box`` grown on every side by the buffer's share of the tile."""
    box, more = tile_box(z, x, y), tile_length(z) * (buffer / extent)
    return F.struct((box["minx"] - more).alias("minx"), (box["miny"] - more).alias("miny"), (box["maxx"] + more).alias("maxx"), (box["maxy"] + more).alias("maxy"))


def margin_degrees(z, extent: int = 4096, buffer: int = 64) -> Column:
    """The buffer in degrees of longitude; keeps shapes at the antimeridian."""
    return F.lit(360.0 * buffer / extent) / side(z).cast("double")


def exact_corner(z: int, x, y) -> tuple[Column, Column]:
    """Least x and y of a tile in metres, rounded only once: the products are decimals."""
    size, half = (F.lit(Decimal(repr(metres))) for metres in (EARTH / (1 << z), EARTH / 2))
    return (_col(x) * size - half).cast("double"), (half - _col(y) * size - size).cast("double")


def tile_pixel(mx, my, z, x, y, extent: int = 4096, corner: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """Place of a point in metres on a tile's grid, y downwards, from the tile's least corner as it is given or in doubles."""
    box, scale = tile_box(z, x, y), F.lit(float(extent)) / tile_length(z)
    left, bottom = corner or (box["minx"], box["miny"])
    return F.floor((_col(mx) - left) * scale), F.lit(extent) - F.floor((_col(my) - bottom) * scale)


def zoom_precision(z) -> Column:
    """Decimals of a degree that matter at a zoom: those of a tile's width, to the nearest power of ten in half steps."""
    half = F.log10(F.lit(360.0) / side(z).cast("double")) - 0.5
    return F.greatest(F.lit(0), -F.ceil(half)).cast("int")


def camera(min_lng, min_lat, max_lng, max_lat, width, height, most: float = 20.0, point: float = 14.0) -> Column:
    """(lng, lat, zoom) that shows a box on ``width`` x ``height`` pixels: the centre, and the zoom at which both sides fit.

    A single point is shown at zoom ``point``; a box without extent along one side is bound by the other.
    """
    across, down = _col(max_lng) - _col(min_lng), _col(max_lat) - _col(min_lat)
    fit = lambda pixels, degrees, whole: F.when(degrees > 0, F.log2(F.lit(whole) * _col(pixels) / (F.lit(256.0) * degrees))).otherwise(F.lit(most))
    zoom = F.when((across <= 0) & (down <= 0), F.lit(point)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(most), fit(width, across, 360.0), fit(height, down, 180.0))))
    return F.struct(((_col(min_lng) + _col(max_lng)) / 2).alias("lng"), ((_col(min_lat) + _col(max_lat)) / 2).alias("lat"), zoom.alias("zoom"))


def zoom_of_resolution(metres_per_pixel, tile_size: int = 256, absolute: float = 3.0, relative: float = 1e-3) -> Column:
    """The first zoom whose resolution is within ``absolute`` metres and ``relative`` of its own, or null."""
    own = lambda z: F.lit(EARTH / tile_size) / F.pow(F.lit(2.0), z)
    near = lambda z: F.abs(_col(metres_per_pixel) - own(z)) < F.least(F.lit(absolute), own(z) * relative)
    return F.get(F.filter(F.sequence(F.lit(0), F.lit(MAX_ZOOM)), near), F.lit(0))


def chunk_index(x, y, across, down) -> Column:
    """Row-major index of a raster chunk, or null outside the grid."""
    inside = (_col(x) >= 0) & (_col(y) >= 0) & (_col(x) < _col(across)) & (_col(y) < _col(down))
    return F.when(inside, _col(y) * _col(across) + _col(x))


def morton(x, y) -> Column:
    """Place of a tile on the Z-order curve of its zoom: the bits of x and y in turn, y's above x's."""

    def spread(c: Column) -> Column:
        # The bits move apart by halves of what is left: 16, 8, 4, 2 and 1 places.
        for places in (16, 8, 4, 2, 1):
            mask = ((1 << 64) - 1) // ((1 << places) + 1) & ((1 << 63) - 1)
            c = c.bitwiseOR(F.shiftleft(c, places)).bitwiseAND(F.lit(mask))
        return c

    return spread(_col(x).cast("long")).bitwiseOR(F.shiftleft(spread(_col(y).cast("long")), 1))


def in_bbox(z, x, row, box: tuple[float, float, float, float]) -> Column:
    """Whether a stored (south-up) tile's least corner lies in the range of ``box`` at zoom 30.

    Only that corner counts, so a large tile around the box is left out, as in archives of this kind.
    """
    from tessella.operators.ranges import bbox_to_range

    min_x, min_y, max_x, max_y = bbox_to_range(*box, MAX_ZOOM)
    last = (1 << MAX_ZOOM) - 1
    scale = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(MAX_ZOOM) - _col(z))
    return (_col(x) * scale).between(min_x, max_x) & (_col(row) * scale).between(last - max_y, last - min_y)
