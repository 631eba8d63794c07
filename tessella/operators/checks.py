"""Summaries, content hashes and validation of tilesets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import codecs
from tessella.functions import tile_math as tm

from .tileset import AGG_HASH, KEY, md5_hex, upsert_metadata

#: Bytes of keys and data of which the exact content hash may be taken; it needs all rows in order, in one task, as one
#: text of two digits a byte, and a text holds 2 GiB.
HASH_BYTES = 1 << 28


def summary(tiles: DataFrame) -> DataFrame:
    """A row a zoom: count, least, largest and mean data size, ranges of columns and rows. Null sizes are no sizes."""
    size = F.octet_length("tile_data")
    return tiles.groupBy("z").agg(
        F.count("*").alias("tile_count"),
        F.coalesce(F.min(size), F.lit(0)).cast("long").alias("min_size"),
        F.coalesce(F.max(size), F.lit(0)).cast("long").alias("max_size"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_size"),
        F.min("x").alias("min_x"),
        F.min("y").alias("min_y"),
        F.max("x").alias("max_x"),
        F.max("y").alias("max_y"),
    )


def summary_all(tiles: DataFrame) -> DataFrame:
    """One row over all zooms, rolled up from ``summary``: means weigh by count; the box is the union in degrees."""
    zooms = summary(tiles)
    y0, y1 = tm.invert_y("z", "max_y"), tm.invert_y("z", "min_y")
    box = tm.range_box("z", "min_x", y0, "max_x", y1)
    return zooms.withColumn("box", box).agg(
        F.coalesce(F.sum("tile_count"), F.lit(0)).cast("long").alias("tile_count"),
        F.min("min_size").alias("min_size"),
        F.max("max_size").alias("max_size"),
        (F.sum(F.col("avg_size") * F.col("tile_count")) / F.sum("tile_count")).alias("avg_size"),
        F.min("z").alias("min_zoom"),
        F.max("z").alias("max_zoom"),
        F.min("box.min_lng").alias("min_lng"),
        F.min("box.min_lat").alias("min_lat"),
        F.max("box.max_lng").alias("max_lng"),
        F.max("box.max_lat").alias("max_lat"),
    )


def agg_tiles_hash(tiles: DataFrame, most: int = HASH_BYTES) -> DataFrame:
    """One row with the content hash: MD5 over key and data of every tile in key order, upper case.

    The digest is one chain over all bytes, so it can't be split; tilesets of more than ``most`` bytes are
    refused, and ``tree_hash`` is for those.
    """
    # A row's key is 25 digits at most, its three numbers and lengths beside it 40 bytes.
    held = tiles.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("tile_data"), F.lit(0)) + 65), F.lit(0))).first()[0]
    if held > most:
        raise ValueError(f"{held} bytes are too many for one digest; tree_hash takes any number")
    row = F.concat(F.encode(F.concat("z", "x", "y"), "utf-8"), F.coalesce("tile_data", F.lit(b"")))
    rows = F.array_sort(F.collect_list(F.struct("z", "x", "y", row.alias("row"))))
    whole = F.concat_ws("", F.transform(rows, lambda r: F.hex(r["row"])))
    return tiles.agg(md5_hex(F.unhex(whole)).alias("agg_tiles_hash"))


def tree_hash(tiles: DataFrame, block: int = 8) -> DataFrame:
    """z, n_blocks and hash a zoom: digests of blocks of 2^block columns and rows, of blocks of these, and so on, in order.

    Blocks are hashed where the shuffle brings them together, and digests alone go on. A block has 4^block
    members at the most on every level, so no task holds more; n_blocks counts the lowest ones.
    """
    keyed = tiles.select(*KEY, F.expr(f"x >> {block}").alias("bx"), F.expr(f"y >> {block}").alias("by"), F.concat_ws(":", "x", "y", F.coalesce(F.md5("tile_data"), F.lit("-"))).alias("item"))
    blocks = keyed.groupBy("z", "bx", "by").agg(F.md5(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "item"))), lambda r: r["item"]))).alias("digest"))
    blocks = blocks.withColumn("n", F.lit(1).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("bx", "by", "digest")))
    for _ in range(block, tm.MAX_ZOOM, block):  # until one block is left, whatever the zoom
        up = blocks.select("z", F.col("bx"), F.col("by"), "digest", "n", F.expr(f"bx >> {block}").alias("ux"), F.expr(f"by >> {block}").alias("uy"))
        blocks = up.groupBy("z", "ux", "uy").agg(F.sum("n").alias("n"), F.md5(F.concat_ws(",", F.transform(rows, lambda r: r["digest"]))).alias("digest")).select("z", F.col("ux").alias("bx"), F.col("uy").alias("by"), "digest", "n")
    return blocks.select("z", F.col("n").alias("n_blocks"), F.upper("digest").alias("hash"))


def verify_hash(stored: str | None, found: str) -> None:
    """Raises where the stored content hash is missing, is none of this kind, or is not the tiles' own."""
    if not stored:
        raise ValueError("the metadata hold no content hash")
    if len(stored) != 32 or set(stored) - set("0123456789ABCDEF"):
        raise ValueError(f"{stored!r} is no content hash of a known kind")
    if stored != found:
        raise ValueError(f"the content hash is {found}, the metadata say {stored}")


def validate(tiles: DataFrame, metadata: DataFrame, hashing: str = "verify") -> DataFrame:
    """Checks tiles and their content hash, and returns the metadata as they then should be; faults raise.

    ``hashing`` "verify" compares the stored content hash, "update" sets it where it differs, "off" leaves it.
    """
    faults = [f"{r['check']}: {r['n']}" for r in violations(tiles).filter("n > 0").collect()]  # a row a check
    if faults:
        raise ValueError("; ".join(sorted(faults)))
    if hashing == "off":
        return metadata
    found = agg_tiles_hash(tiles).first()[0]
    row = metadata.filter(F.col("name") == AGG_HASH).select("value").first()
    stored = row[0] if row else None
    if hashing == "verify":
        verify_hash(stored, found)
        return metadata
    if hashing == "update":
        return metadata if stored == found else upsert_metadata(metadata, {AGG_HASH: found})
    raise ValueError(f"unknown way {hashing}")


def compression_key(tiles: DataFrame, metadata: DataFrame, detect) -> DataFrame:
    """``metadata`` with the key "compression" as a sample tile has it; gone where tiles have none. Without tiles, as it is."""
    row = tiles.filter("tile_data is not null").limit(1).select(codecs.compression_name(detect(F.col("tile_data"))["encoding"])).first()
    return metadata if row is None else upsert_metadata(metadata, {"compression": row[0]})


def duplicate_keys(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy(*KEY).agg(F.count("*").alias("copies")).filter("copies > 1")


def invalid_tiles(tiles: DataFrame) -> DataFrame:
    """Keys outside their zoom's range."""
    return tiles.filter(~tm.valid_tile("z", "x", "y")).select(*KEY)


def wrong_hashes(tiles: DataFrame) -> DataFrame:
    """Tiles whose stored hash is not their data's; null data passes."""
    return tiles.filter(F.upper("tile_hash") != md5_hex("tile_data")).select(*KEY, "tile_hash")


def missing_images(map_: DataFrame, images: DataFrame) -> DataFrame:
    return map_.join(images.select("tile_id"), "tile_id", "left_anti")


def violations(tiles: DataFrame, map_: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """(check, n) of every kind of fault, 0 included."""
    counts = [("duplicate key", duplicate_keys(tiles)), ("tile out of range", invalid_tiles(tiles))]
    if "tile_hash" in tiles.columns:
        counts.append(("wrong hash", wrong_hashes(tiles)))
    if map_ is not None and images is not None:
        counts.append(("missing image", missing_images(map_, images)))
        counts.append(("unused image", images.join(map_.select("tile_id"), "tile_id", "left_anti")))
    parts = [df.agg(F.lit(name).alias("check"), F.count("*").alias("n")) for name, df in counts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def zoom_formats(tiles: DataFrame, detect) -> DataFrame:
    """(z, format) of a sample tile a zoom, the one of the least key; ``detect`` is a Column function."""
    sample = tiles.filter("tile_data is not null").groupBy("z").agg(F.min_by("tile_data", F.struct("x", "y")).alias("tile_data"))
    return sample.select("z", detect(F.col("tile_data")).alias("format"))
