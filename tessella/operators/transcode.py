"""Changing tile payloads: every distinct blob once; and binary patches between tile versions."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import codecs

from .tileset import KEY, md5_hex


def transcode(tiles: DataFrame, change: Callable[[bytes], bytes]) -> DataFrame:
    """Tiles (with tile_hash) whose data ``change`` has rewritten; blobs it fails on are left out, with their tiles.

    Only distinct blobs cross to Python. A blob that very many tiles share is joined back with AQE's
    splitting of skewed keys.
    """

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column("tile_data").to_pylist():
                try:
                    out.append(change(data))
                except Exception:  # noqa: BLE001  whatever the caller's function raises, the tile is skipped
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("tile_hash"), pa.array(out, pa.binary())], names=["tile_hash", "new_data"])

    blobs = tiles.filter("tile_data is not null").select("tile_hash", "tile_data").dropDuplicates(["tile_hash"])
    done = blobs.mapInArrow(run, "tile_hash string, new_data binary").filter("new_data is not null")
    joined = tiles.select(*KEY, "tile_hash").join(done, "tile_hash")
    return joined.select(*KEY, F.col("new_data").alias("tile_data"), md5_hex("new_data").alias("tile_hash"))


def transcode_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """tiles_written, cache_encoded (distinct blobs that were encoded) and cache_hits (tiles that used one again).

    Blobs that could not be changed are in neither; ``after`` is what ``transcode`` gave for ``before``.
    """
    done = before.filter("tile_data is not null").select(*KEY, F.col("tile_hash").alias("blob")).join(after.select(*KEY), KEY)
    counted = done.agg(F.count("*").alias("tiles_written"), F.countDistinct("blob").alias("cache_encoded"))
    return counted.select("tiles_written", "cache_encoded", (F.col("tiles_written") - F.col("cache_encoded")).alias("cache_hits"))


def _pack(old: bytes, new: bytes) -> bytes:
    """``new`` compressed with ``old`` as dictionary; what both share costs little."""
    c = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_DEFAULT_STRATEGY, old[-32768:])
    return c.compress(new) + c.flush()


def _unpack(old: bytes, patch: bytes) -> bytes:
    d = zlib.decompressobj(-15, old[-32768:])
    return d.decompress(patch) + d.flush()


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def binary_diff(src: DataFrame, dst: DataFrame, encoding: str = "uncompressed") -> DataFrame:
    """Patches (key, patch_data, xxh3) of tiles that both have with different data; ``encoding`` is unpacked before."""

    def run(batches):
        for batch in batches:
            patches, sums = [], []
            for a, b in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True):
                a, b = codecs.decode(a, encoding), codecs.decode(b, encoding)
                patches.append(_pack(a, b))
                sums.append(_signed(xxhash.xxh3_64_intdigest(b)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], pa.array(patches, pa.binary()), pa.array(sums, pa.int64())], names=[*KEY, "patch_data", "xxh3"])

    pairs = src.select(*KEY, F.col("tile_data").alias("old")).join(dst.select(*KEY, F.col("tile_data").alias("new")), KEY).filter("old <> new")
    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.select(*KEY, "old", "new").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in KEY) + ", patch_data binary, xxh3 bigint")


def patch_type(schemas: dict[str, list[str]]) -> str | None:
    """Which binary patches an archive holds, by its tables' columns: "raw", "gzip" or None."""
    needed = {"zoom_level", "tile_column", "tile_row", "patch_data", "tile_xxh3_64_hash"}
    for name, kind in (("bsdiffraw", "raw"), ("bsdiffrawgz", "gzip")):
        if needed <= set(schemas.get(name, ())):
            return kind
    return None


def without_patched(tiles: DataFrame, patches: DataFrame) -> DataFrame:
    """Tiles that no binary patch makes."""
    return tiles.join(patches.select(*KEY), KEY, "left_anti")


def patched(src: DataFrame, plain: DataFrame, patches: DataFrame, encoding: str = "uncompressed") -> DataFrame:
    """``src`` under a patch of both kinds: ``plain`` tiles put in or taken out (null), ``patches`` applied, the rest as it is."""
    made = binary_apply(src, patches, encoding)
    touched = plain.select(*KEY).union(patches.select(*KEY)).distinct()
    rest = src.select(*KEY, "tile_data").join(touched, KEY, "left_anti")
    return rest.unionByName(without_patched(plain, patches).filter("tile_data is not null").select(*KEY, "tile_data")).unionByName(made)


def binary_apply(src: DataFrame, patches: DataFrame, encoding: str = "uncompressed") -> DataFrame:
    """Patched tiles (key, tile_data); a result whose checksum is not the patch's fails the job."""

    def run(batches):
        for batch in batches:
            out = []
            for a, p, want in zip(batch.column("tile_data").to_pylist(), batch.column("patch_data").to_pylist(), batch.column("xxh3").to_pylist(), strict=True):
                b = _unpack(codecs.decode(a, encoding), p)
                if _signed(xxhash.xxh3_64_intdigest(b)) != want:
                    raise ValueError("a patched tile has the wrong checksum")
                out.append(codecs.encode(b, encoding))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], pa.array(out, pa.binary())], names=[*KEY, "tile_data"])

    pairs = src.select(*KEY, "tile_data").join(patches, KEY)
    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.select(*KEY, "tile_data", "patch_data", "xxh3").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in KEY) + ", tile_data binary")
