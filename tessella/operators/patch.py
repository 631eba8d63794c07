"""Differences of tilesets and their application. In a patch, null data means that the tile goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checks
from .tileset import AFTER, AGG_HASH, BEFORE, KEY, md5_hex, upsert_metadata

_HASH_NAMES = (AGG_HASH, BEFORE, AFTER)


def diff(src: DataFrame, dst: DataFrame) -> DataFrame:
    """The patch from ``src`` to ``dst``: one full join on the key; both are dealt by it, so further joins on it move nothing."""
    a = src.select(*KEY, F.col("tile_data").alias("old"))
    b = dst.select(*KEY, F.col("tile_data").alias("new"))
    both = a.join(b, KEY, "full")
    changed = F.col("old").isNull() | F.col("new").isNull() | (F.col("old") != F.col("new"))
    return both.filter(changed).select(*KEY, F.col("new").alias("tile_data"), md5_hex("new").alias("tile_hash"))


def apply(src: DataFrame, patch: DataFrame) -> DataFrame:
    """``src`` with the patch's tiles put in and its null ones taken out."""
    a = src.select(*KEY, F.col("tile_data").alias("old"))
    b = patch.select(*KEY, F.col("tile_data").alias("new"), F.lit(True).alias("patched"))
    both = a.join(b, KEY, "full").filter(F.col("patched").isNull() | F.col("new").isNotNull())
    data = F.coalesce("new", "old")
    return both.select(*KEY, data.alias("tile_data"), md5_hex(data).alias("tile_hash"))


def diff_metadata(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Names whose value differs or that one side lacks, with dst's value; content hashes are left out."""
    a, b = src.select("name", F.col("value").alias("old")), dst.select("name", F.col("value").alias("new"))
    both = a.join(b, "name", "full").filter(~F.col("name").isin(*_HASH_NAMES))
    return both.filter(F.col("old").isNull() | F.col("new").isNull() | (F.col("old") != F.col("new"))).select("name", F.col("new").alias("value"))


def apply_metadata(src: DataFrame, patch: DataFrame) -> DataFrame:
    """``src`` with the patch's values; names that the patch holds with null go."""
    a = src.select("name", F.col("value").alias("old"))
    b = patch.select("name", F.col("value").alias("new"), F.lit(True).alias("patched"))
    both = a.join(b, "name", "full").filter(~F.col("name").isin(*_HASH_NAMES))
    return both.filter(F.col("patched").isNull() | F.col("new").isNotNull()).select("name", F.coalesce("new", "old").alias("value"))


def patched_metadata(metadata: DataFrame) -> DataFrame:
    """Metadata after an applied patch: the hash promised for after is the content's now."""
    has_after = F.max(F.when(F.col("name") == AFTER, 1)).alias("has_after")
    flag = metadata.agg(has_after)
    named = metadata.crossJoin(F.broadcast(flag))  # one row
    kept = named.filter(F.col("value").isNotNull() & (F.col("name") != BEFORE) & ~((F.col("name") == AGG_HASH) & F.col("has_after").isNotNull()))
    return kept.select(F.when(F.col("name") == AFTER, AGG_HASH).otherwise(F.col("name")).alias("name"), "value")


def _stored(metadata: DataFrame, name: str) -> str | None:
    row = metadata.filter(F.col("name") == name).select("value").first()
    return row[0] if row else None


def diff_tilesets(src: DataFrame, src_meta: DataFrame, dst: DataFrame, dst_meta: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The patch from src to dst and its metadata, which name the content hashes before and after.

    Raises unless forced where either side is a patch itself or holds no content hash.
    """
    for which, metadata in (("source", src_meta), ("target", dst_meta)):
        if not force and (_stored(metadata, BEFORE) or _stored(metadata, AFTER)):
            raise ValueError(f"the {which} is a patch, not a tileset")
        if not force and not _stored(metadata, AGG_HASH):
            raise ValueError(f"the {which} holds no content hash")
    made = {BEFORE: _stored(src_meta, AGG_HASH), AFTER: _stored(dst_meta, AGG_HASH)}
    return diff(src, dst).select(*KEY, "tile_data"), upsert_metadata(diff_metadata(src_meta, dst_meta), made)


def apply_tileset(src: DataFrame, src_meta: DataFrame, patch: DataFrame, patch_meta: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """``src`` and its metadata under a patch; raises unless forced where the hashes before or after don't fit."""
    if not force and _stored(src_meta, BEFORE):
        raise ValueError("a patch can't be applied to a patch")
    before, after = _stored(patch_meta, BEFORE), _stored(patch_meta, AFTER)
    check_patch(before, after, _stored(src_meta, AGG_HASH), force)
    made = apply(src, patch)
    if not force:
        checks.verify_hash(after, checks.agg_tiles_hash(made).first()[0])
    return made, upsert_metadata(apply_metadata(src_meta, patch_meta), {AGG_HASH: after})


def drop_orphans(images: DataFrame, map_: DataFrame) -> DataFrame:
    """Images that some map row uses."""
    return images.join(map_.select("tile_id"), "tile_id", "left_semi")


def check_patch(before: str | None, after: str | None, base_hash: str | None, force: bool = False) -> None:
    """Raises where a patch lacks its hashes or is meant for another tileset, unless forced."""
    if force:
        return
    if not before or not after:
        raise ValueError("the patch holds no hashes of before and after")
    if before != base_hash:
        raise ValueError(f"the patch is for {before}, not for {base_hash}")
