"""PMTiles archives (version 3, a published format) as rows of tiles."""

from __future__ import annotations

import gzip
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_id(z: int, x: int, y: int) -> int:
    """Place along the Hilbert curves of all zooms, one after the other."""
    out, n = ((1 << 2 * z) - 1) // 3, 1 << z
    s = n >> 1
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        out += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s >>= 1
    return out


def tile_of(number: int) -> tuple[int, int, int]:
    z, first = 0, 0
    while first + (1 << 2 * z) <= number:
        first += 1 << 2 * z
        z += 1
    at, x, y, s = number - first, 0, 0, 1
    while s < 1 << z:
        rx = 1 & (at // 2)
        ry = 1 & (at ^ rx)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, at, s = x + s * rx, y + s * ry, at // 4, s * 2
    return z, x, y


def _directory(raw: bytes) -> list[tuple[int, int, int, int]]:
    """Entries (id, run, length, offset); a run of 0 points to a leaf directory."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            n |= (raw[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if not raw[at - 1] & 0x80:
                return n

    count, ids, last = number(), [], 0
    for _ in range(count):
        last += number()
        ids.append(last)
    runs, lengths, offsets = [number() for _ in ids], [number() for _ in ids], []
    for k in range(count):
        v = number()
        offsets.append(offsets[-1] + lengths[k - 1] if v == 0 and k else v - 1)
    return list(zip(ids, runs, lengths, offsets, strict=True))


def write_bytes(tiles: dict[tuple[int, int, int], bytes], tile_type: int = 1) -> bytes:
    """A small archive in memory, for tests and exports of a few tiles."""
    entries, body = [], b""
    for number, data in sorted((tile_id(*k), v) for k, v in tiles.items()):
        entries.append((number, 1, len(data), len(body)))
        body += data

    def var(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    ids = [e[0] for e in entries]
    root = var(len(entries)) + b"".join(var(b - a) for a, b in zip([0, *ids], ids)) + b"".join(var(e[1]) for e in entries) + b"".join(var(e[2]) for e in entries) + b"".join(var(e[3] + 1) for e in entries)
    root = gzip.compress(root, mtime=0)
    meta = gzip.compress(b"{}", mtime=0)
    places = [127, len(root), 127 + len(root), len(meta), 127 + len(root) + len(meta), 0, 127 + len(root) + len(meta), len(body), len(entries), len(entries), len(entries)]
    zooms = [k[0] for k in tiles] or [0]
    head = b"PMTiles\x03" + struct.pack("<11Q", *places) + bytes([1, 2, 1, tile_type, min(zooms), max(zooms)]) + struct.pack("<4i", -1800000000, -850511290, 1800000000, 850511290) + bytes([0]) + struct.pack("<2i", 0, 0)
    return head + root + meta + body


_MAGIC, _HEAD = b"PMTiles\x03", 127
_KINDS = {"z": pa.int32(), "x": pa.int64(), "y": pa.int64(), "tile_data": pa.binary(), "archive": pa.string()}
_RANGE = {"archive": pa.string(), "first": pa.int64(), "n": pa.int64(), "at": pa.int64(), "length": pa.int64()}


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _entries(name: str, part):
    """(first id, run, place, length) of an archive's data; ``part`` gives the bytes at a place, so directories alone are read."""
    head = part(0, _HEAD)
    if head[:8] != _MAGIC:
        raise ValueError(f"{name} is no archive of version 3")
    root, root_n, _, _, leaves, _, data, *_ = struct.unpack_from("<11Q", head, 8)
    unpack = gzip.decompress if head[97] == 2 else bytes
    todo = [(root, root_n)]
    while todo:
        for first, n, length, offset in _directory(unpack(part(*todo.pop()))):
            if n:
                yield first, n, data + offset, length
            else:
                todo.append((leaves + offset, length))


def _tiles(name: str, entries, part):
    """Batches of rows of the tiles of ``entries``; a run's tiles share their data."""
    rows = []
    for first, n, at, length in entries:
        blob = part(at, length)
        for k in range(n):
            rows.append((*tile_of(first + k), blob, name))
            if len(rows) >= 1000:
                yield _batch(rows, _KINDS)
                rows = []
    yield _batch(rows, _KINDS)


def _opened(path: str):
    file = open(path.removeprefix("file://").removeprefix("file:"), "rb")

    def part(at: int, length: int) -> bytes:
        file.seek(at)
        return file.read(length)

    return file, part


def read(spark: SparkSession, path: str, mounted: bool = False, partitions: int = 64) -> DataFrame:
    """z, x, y (north-up), tile_data and archive of the archives at ``path``; runs come apart.

    Where executors mount ``path``, directories are read by a task an archive, and data by ranges of each
    archive, in any number of tasks. Otherwise Spark hands over an archive whole, a task each, up to 2 GiB.
    """
    schema = "z int, x bigint, y bigint, tile_data binary, archive string"
    files = spark.read.format("binaryFile").load(path)

    def whole(batches):
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = lambda at, n, raw=raw: raw[at : at + n]
                yield from _tiles(name, _entries(name, part), part)

    def listed(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                file, part = _opened(name)
                with file:
                    rows = [(name, *e) for e in _entries(name, part)]
                for k in range(0, len(rows), 10_000):
                    yield _batch(rows[k : k + 10_000], _RANGE)

    def ranged(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for name in dict.fromkeys(r["archive"] for r in rows):
                file, part = _opened(name)
                with file:
                    yield from _tiles(name, ((r["first"], r["n"], r["at"], r["length"]) for r in rows if r["archive"] == name), part)

    if not mounted:
        return files.select("path", "content").mapInArrow(whole, schema)
    found = files.select("path").mapInArrow(listed, "archive string, first bigint, n bigint, at bigint, length bigint")
    return found.repartitionByRange(partitions, "archive", "at").sortWithinPartitions("archive", "at").mapInArrow(ranged, schema)


def discover(spark: SparkSession, path: str) -> DataFrame:
    """id and version of the archives under ``path``: name and time of change."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pmtiles").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.pmtiles$", 1).alias("id"), F.col("modificationTime").cast("string").alias("version"))
