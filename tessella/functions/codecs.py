"""Tile payloads: what format and encoding they have, and changing the encoding, by Arrow batches."""

from __future__ import annotations

import base64
import gzip
import json
import zlib

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File signatures.
SIGNATURES = [
    ("png", b"\x89PNG\r\n\x1a\n"),
    ("jpeg", b"\xff\xd8\xff"),
    ("gif", b"GIF89a"),
]
#: Formats whose files are compressed in themselves.
INTERNAL = ("png", "jpeg", "gif", "webp", "avif")
NAMES = {"jpg": "jpeg", "jpeg": "jpeg", "pbf": "mvt", "mvt": "mvt", "mlt": "mlt", "png": "png", "gif": "gif", "webp": "webp", "avif": "avif", "json": "json"}
CONTENT_TYPES = {
    "jpeg": "image/jpeg",
    "mvt": "application/x-protobuf",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "avif": "image/avif",
    "json": "application/json",
}


def content_type(fmt: Column | str) -> Column:
    """The content type of a format, also by its other names; null for "mlt", which has no registered one, and for unknown ones."""
    known = F.create_map(*[F.lit(x) for name, fmt_ in NAMES.items() if fmt_ in CONTENT_TYPES for x in (name, CONTENT_TYPES[fmt_])])
    return F.try_element_at(known, F.lower(F.col(fmt) if isinstance(fmt, str) else fmt))


#: What may be wrong with framed layers.
FRAMING_FAULTS = ("truncated size", "size overflow", "truncated tag", "unexpected tag", "size underflow", "truncated data")


def framing_fault(data: bytes, tag: int = 1) -> str | None:
    """What keeps ``data`` from being layers of (size, tag, payload); None if nothing does.

    A size has 7 bits a byte, high ones first, in at most 8 bytes, and counts its own bytes and the tag.
    """
    at = 0
    while at < len(data) or not data:
        size, begin = 0, at
        while True:
            if at >= len(data):
                return "truncated size"
            if at - begin == 8:
                return "size overflow"
            byte = data[at]
            size, at = (size << 7) | (byte & 0x7F), at + 1
            if not byte & 0x80:
                break
        if at >= len(data):
            return "truncated tag"
        if data[at] != tag:
            return "unexpected tag"
        if size < at + 1 - begin:
            return "size underflow"
        if begin + size > len(data):
            return "truncated data"
        at = begin + size
    return None


def is_mlt(data: bytes) -> bool:
    return framing_fault(data) is None


def _is_json(data: bytes) -> bool:
    if data[:1] != b"{" or data[-1:] != b"}":
        return False
    try:
        json.loads(data)
    except ValueError:
        return False
    return True


def _raster_format(data: bytes) -> str | None:
    for name, start in SIGNATURES:
        if data.startswith(start):
            return name
    return "webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


def _vector_format(data: bytes) -> str:
    return "mlt" if is_mlt(data) else "json" if _is_json(data) else "mvt"


def detect(data: bytes | None) -> tuple[str, str] | None:
    """(format, encoding); what nothing else fits is a vector tile. None for no data.

    Compressed data are of a vector format or JSON, and vector tiles where they can't be unpacked. AVIF is not told by its bytes.
    """
    if data is None:
        return None
    data = bytes(data)
    for encoding, start, unpack in (("gzip", b"\x1f\x8b", gzip.decompress), ("zlib", b"\x78\x9c", zlib.decompress)):
        if data.startswith(start):
            try:
                return _vector_format(unpack(data)), encoding
            except (OSError, EOFError, zlib.error):
                return "mvt", encoding
    raster = _raster_format(data)
    return (raster, "internal") if raster else (_vector_format(data), "uncompressed")


def compression_name(encoding: Column) -> Column:
    """What an archive's metadata call an encoding; null for uncompressed and internal ones, which go without the key."""
    return F.when(encoding.isin("gzip", "zlib", "brotli", "zstd"), encoding)


@F.pandas_udf(T.StructType([T.StructField("format", T.StringType()), T.StructField("encoding", T.StringType())]))
def detect_format(data: pd.Series) -> pd.DataFrame:
    found = [detect(d) or (None, None) for d in data]
    return pd.DataFrame(found, columns=["format", "encoding"])


def conversion(fmt: Column, accepted: Column, to_mlt: Column, to_mvt: Column) -> Column:
    """Format that a vector tile is to be turned into for a client, or null: as accepted, unless that way is "disabled"."""
    allowed = lambda c: F.coalesce(c, F.lit("auto")) != "disabled"
    return F.when((fmt == "mvt") & (accepted == "mlt") & allowed(to_mlt), "mlt").when((fmt == "mlt") & (accepted == "mvt") & allowed(to_mvt), "mvt")


def encode(data: bytes, encoding: str) -> bytes:
    if encoding == "gzip":
        return gzip.compress(data, 6, mtime=0)
    if encoding == "zlib":
        return zlib.compress(data)
    if encoding == "zstd":
        import zstandard

        return zstandard.compress(data)
    if encoding in ("uncompressed", "internal"):
        return data
    raise ValueError(f"encoding {encoding} is not there")


def decode(data: bytes, encoding: str) -> bytes:
    if encoding == "gzip":
        return gzip.decompress(data)
    if encoding == "zlib":
        return zlib.decompress(data)
    if encoding == "zstd":
        import zstandard

        return zstandard.decompress(data)
    if encoding in ("uncompressed", "internal"):
        return data
    raise ValueError(f"encoding {encoding} is not there")


def recode(data: Column | str, source: str, target: str) -> Column:
    """The same payload in another encoding; nothing is done where both are the same. Null where it can't be decoded."""
    column = F.col(data) if isinstance(data, str) else data
    if source == target:
        return column

    @F.pandas_udf(T.BinaryType())
    def change(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else encode(decode(bytes(v), source), target)
            except (OSError, EOFError, zlib.error):
                return None

        return values.map(one)

    return change(column)


@F.pandas_udf(T.LongType())
def xxh3_64(data: pd.Series) -> pd.Series:
    """XXH3 of 64 bits as a signed number; null for null."""
    return pd.Series([None if d is None else xxhash.xxh3_64_intdigest(bytes(d)) - ((xxhash.xxh3_64_intdigest(bytes(d)) >> 63) << 64) for d in data], dtype="Int64")


@F.pandas_udf(T.StringType())
def etag(data: pd.Series) -> pd.Series:
    """XXH3 of 128 bits in base64 for urls, without padding; that of 0 for empty tiles."""
    digest = lambda d: xxhash.xxh3_128_digest(bytes(d)) if d else bytes(16)
    return pd.Series([base64.urlsafe_b64encode(digest(d)).rstrip(b"=").decode() for d in data])
