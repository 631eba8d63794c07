"""Archive metadata: typed reading, writing, merging, and zoom bounds that follow the tiles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tileset import upsert_metadata

#: Names with a place of their own in a tile description; the others are free.
NUMBERS, TEXTS = ("minzoom", "maxzoom"), ("name", "description", "attribution", "version", "legend", "template")


def readable(metadata: DataFrame) -> DataFrame:
    """Rows with a name and a value that isn't empty."""
    return metadata.filter(F.col("name").isNotNull() & F.col("value").isNotNull() & (F.col("value") != ""))


def get(metadata: DataFrame, name: str) -> str | None:
    row = metadata.filter(F.col("name") == name).select("value").first()
    return row[0] if row else None


def parse(metadata: DataFrame) -> DataFrame:
    """name, value, and what the value is where its name asks for a type: ``number``, ``numbers`` or ``valid``.

    A value that doesn't parse is null there and not valid; it never fails the read.
    """
    numbers = F.transform(F.split("value", ","), lambda v: F.trim(v).try_cast("double"))
    wanted = F.when(F.col("name") == "bounds", 4).when(F.col("name") == "center", 3)
    ok = F.size(numbers).eqNullSafe(wanted) & ~F.exists(numbers, lambda v: v.isNull())
    number = F.when(F.col("name").isin(*NUMBERS), F.col("value").try_cast("int"))
    valid = F.when(F.col("name").isin(*NUMBERS), number.isNotNull()).when(wanted.isNotNull(), ok).when(F.col("name") == "json", F.try_parse_json("value").isNotNull()).otherwise(True)
    return readable(metadata).select("name", "value", number.alias("number"), F.when(wanted.isNotNull() & ok, numbers).alias("numbers"), valid.alias("valid"))


def to_rows(doc: dict) -> dict[str, str]:
    """A tile description as names and values; vector layers go under "json"."""
    out: dict[str, str] = {}
    for k, v in doc.items():
        if v is None or k == "vector_layers":
            continue
        out[k] = ",".join(f"{x:g}" if isinstance(x, float) else str(x) for x in v) if k in ("bounds", "center") else v if isinstance(v, str) else json.dumps(v)
    if "vector_layers" in doc:
        out["json"] = json.dumps({"vector_layers": doc["vector_layers"]}, separators=(",", ":"))
    return out


def from_rows(rows: dict[str, str]) -> dict:
    """The other way round; values that don't parse are left out."""
    doc: dict = {}
    for k, v in rows.items():
        try:
            if k == "json":
                doc |= json.loads(v)
            elif k in ("bounds", "center"):
                doc[k] = [float(x) for x in v.split(",")]
            else:
                doc[k] = int(v) if k in NUMBERS else v
        except ValueError:
            continue
    return doc


def update_zooms(metadata: DataFrame, tiles: DataFrame, mode: str = "reset") -> DataFrame:
    """minzoom and maxzoom from the tiles: "reset" sets them, "grow" only widens, "skip" leaves them."""
    if mode == "skip":
        return metadata
    low, high = tiles.agg(F.min("z"), F.max("z")).first()
    if low is None:
        return metadata
    if mode == "grow":
        known = {r["name"]: r["value"] for r in metadata.filter(F.col("name").isin(*NUMBERS)).collect()}
        number = lambda name, other, pick: pick(int(known[name]), other) if (known.get(name) or "").lstrip("-").isdigit() else other
        low, high = number("minzoom", low, min), number("maxzoom", high, max)
    return upsert_metadata(metadata, {"minzoom": str(low), "maxzoom": str(high)})


def clamp_zooms(declared: DataFrame, actual: DataFrame, key: str = "source") -> DataFrame:
    """Declared zooms of each source, or of each of its layers, held within those that its tiles have; other columns stay."""
    both = declared.join(actual.select(key, F.col("min_zoom").alias("a0"), F.col("max_zoom").alias("a1")), key, "left")
    others = [c for c in declared.columns if c not in NUMBERS]
    return both.select(*others, F.greatest("minzoom", "a0").alias("minzoom"), F.least("maxzoom", "a1").alias("maxzoom"))


def pyramid_zooms(levels: DataFrame) -> DataFrame:
    """A row an image from its ``levels`` (image, zoom, tile_size): least and largest zoom, and whether all have one tile size."""
    return levels.groupBy("image").agg(F.min("zoom").alias("minzoom"), F.max("zoom").alias("maxzoom"), F.min("tile_size").eqNullSafe(F.max("tile_size")).alias("one_size"))


def merge_descriptions(sources: DataFrame) -> DataFrame:
    """One row from descriptions (ord, name, attribution, description, minzoom, maxzoom, bounds, center, layers) in order.

    Layers are put together, zooms and bounds widened, the first center taken; names differ once each,
    joined by a comma, attributions and descriptions by a line feed.
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("v"))))), lambda r: r["v"])
    b = lambda k: F.col("bounds")[k]
    return sources.agg(
        F.array_join(F.array_distinct(ordered("name")), ",").alias("name"),
        F.array_join(F.array_distinct(ordered("attribution")), "\n").alias("attribution"),
        F.array_join(F.array_distinct(ordered("description")), "\n").alias("description"),
        F.min("minzoom").alias("minzoom"),
        F.max("maxzoom").alias("maxzoom"),
        F.array(F.min(b(0)), F.min(b(1)), F.max(b(2)), F.max(b(3))).alias("bounds"),
        F.get(ordered("center"), F.lit(0)).alias("center"),
        F.flatten(ordered("layers")).alias("layers"),
    )
