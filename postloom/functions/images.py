"""Sizes of images, read off their headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = T.StructType().add("format", T.StringType()).add("width", T.IntegerType()).add("height", T.IntegerType()).add("broken", T.BooleanType())
#: Fixed values of the format: JPEG frames that carry a size, and markers that stand alone.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
ALONE = frozenset((0x01, *range(0xD0, 0xD8)))


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Walks from marker to marker up to the first frame."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:  # fill
            at += 1
        elif kind in ALONE:
            at += 2
        elif kind in (0xD9, 0xDA):  # pixels or the end before any frame
            return None
        else:
            length = int.from_bytes(data[at + 2 : at + 4], "big")
            if kind in FRAMES:
                return (int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")) if length >= 8 and at + 9 <= len(data) else None
            if length < 2:
                return None
            at += 2 + length
    return None


def webp_size(data: bytes) -> tuple[int, int] | None:
    kind, body = data[12:16], data[20:]
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a" and len(body) >= 10:
        return tuple(x & 0x3FFF for x in struct.unpack("<HH", body[6:10]))
    if kind == b"VP8L" and body[:1] == b"\x2f" and len(body) >= 5:
        bits = int.from_bytes(body[1:5], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X" and len(body) >= 10:
        return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
    return None


def image_size(data: bytes | None) -> tuple[str | None, tuple[int, int] | None]:
    """(format, (width, height)); the size is None where the header is cut short or says nothing, the format where it is unknown."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png", struct.unpack(">II", data[16:24]) if data[12:16] == b"IHDR" and len(data) >= 24 else None
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", struct.unpack("<HH", data[6:10]) if len(data) >= 10 else None
    if data[:2] == b"BM" and len(data) >= 18:
        if int.from_bytes(data[14:18], "little") == 12:  # the oldest header has 16-bit sizes
            return "bmp", struct.unpack("<HH", data[18:22]) if len(data) >= 22 else None
        width, height = struct.unpack("<ii", data[18:26]) if len(data) >= 26 else (0, 0)
        return "bmp", (width, abs(height))  # a negative height says that rows go downwards
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp", webp_size(data)
    if data[:2] == b"\xff\xd8":
        return "jpeg", jpeg_size(data)
    return None, None


@F.pandas_udf(SIZE)
def decoded_size(content: pd.Series) -> pd.DataFrame:
    """format, width, height and broken: whether no size can be read, as of null, empty, cut and unknown files and sizes of zero."""
    rows = []
    for data in content:
        kind, size = image_size(bytes(data) if data is not None else None)
        sound = size is not None and min(size) > 0
        rows.append((kind, size[0] if sound else None, size[1] if sound else None, not sound))
    out = pd.DataFrame(rows, columns=["format", "width", "height", "broken"])
    return out.astype({"width": "Int32", "height": "Int32"})
