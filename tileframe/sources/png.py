"""PNG files: a codec of its own in plain Python and numpy, applied to rows of the binaryFile source.

All colour types, depths and interlacing are read. Checksums are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Fixed values of the format: samples a pixel by colour type, and start and step of the seven passes.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
IMAGE = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("rgba", T.ArrayType(T.LongType())),
        T.StructField("idx", T.ArrayType(T.IntegerType())),
        T.StructField("palette", T.ArrayType(T.LongType())),
        T.StructField("error", T.StringType()),
    ]
)


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def _unfiltered(raw: memoryview, rows: int, stride: int, step: int) -> np.ndarray:
    """Scanlines with their filters undone."""
    out = np.zeros((rows + 1, stride + step), np.uint8)
    for y in range(rows):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1)
        above, own = out[y], out[y + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            pad = np.zeros(-(-stride // step) * step, np.uint8)
            pad[:stride] = line
            own[step:] = np.cumsum(pad.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            own[step:] = line + above[step:]
        elif kind in (3, 4):  # each byte needs the one before it; plain lists are several times as fast here as arrays
            up, new = above.tolist(), [0] * step
            for i, v in enumerate(line.tolist()):
                a, b, c = new[i], up[i + step], up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                new.append((v + guess) & 0xFF)
            own[:] = new
        else:
            raise ValueError(f"unknown PNG filter {kind}")
    return out[1:, step:]


def _samples(raw: memoryview, width: int, height: int, depth: int, samples: int) -> tuple[np.ndarray, int]:
    """(height, width, samples) of one pass and the bytes that it took."""
    stride = -(-width * depth * samples // 8)
    lines = _unfiltered(raw, height, stride, max(1, depth * samples // 8))
    if depth == 16:
        values = lines.reshape(height, width * samples, 2).astype(np.uint16)
        values = values[..., 0] * 256 + values[..., 1]
    elif depth == 8:
        values = lines.astype(np.uint16)
    else:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint16)
    return values[:, : width * samples].reshape(height, width, samples), height * (stride + 1)


def decode(data: bytes) -> dict:
    """Width, height, RGBA colours, and for palette images the indices and palette, of a PNG file."""
    head, palette, alpha, body = None, b"", None, []
    for kind, content in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"PLTE":
            palette = content
        elif kind == b"tRNS":
            alpha = content
        elif kind == b"IDAT":
            body.append(content)
    if head is None or not body:
        raise ValueError("PNG without header or data")
    width, height, depth, color, _, _, interlace = head
    raw, samples = memoryview(zlib.decompress(b"".join(body))), SAMPLES[color]
    if interlace:
        values, at = np.zeros((height, width, samples), np.uint16), 0
        for x0, y0, dx, dy in PASSES:
            w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
            if w > 0 and h > 0:
                values[y0::dy, x0::dx], used = _samples(raw[at:], w, h, depth, samples)
                at += used
    else:
        values, _ = _samples(raw, width, height, depth, samples)

    table, idx = None, None
    full = np.full((height, width, 4), 255, np.int64)
    if color == 3:
        table = np.full((len(palette) // 3, 4), 255, np.int64)
        table[:, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        table[: len(alpha or b""), 3] = np.frombuffer(alpha or b"", np.uint8)[: len(table)]
        idx = values[..., 0].astype(np.int64)
        if len(table) == 0 or idx.max(initial=0) >= len(table):
            raise ValueError("PNG palette is too short")
        full = table[idx]
    else:
        wide = values.astype(np.int64)
        eight = wide >> 8 if depth == 16 else wide * 255 // ((1 << depth) - 1)
        full[..., :3] = eight[..., :1] if color in (0, 4) else eight[..., :3]
        if color in (4, 6):
            full[..., 3] = eight[..., -1]
        elif alpha:
            key = np.frombuffer(alpha, ">u2").astype(np.int64)
            full[(wide == key).all(axis=2), 3] = 0
    place = 1 << np.array([0, 8, 16, 24], np.int64)
    out = {"width": width, "height": height, "rgba": (full @ place).reshape(-1), "idx": None, "palette": None, "error": None}
    if table is not None:
        out |= {"idx": idx.reshape(-1), "palette": table @ place}
    return out


def _chunk(kind: bytes, content: bytes) -> bytes:
    return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))


def _octets(rgba: np.ndarray) -> np.ndarray:
    return np.asarray(rgba, np.int64).astype("<u4").view(np.uint8).reshape(-1, 4)


def encode(width: int, height: int, rgba: np.ndarray | None = None, idx: np.ndarray | None = None, palette: np.ndarray | None = None) -> bytes:
    """A PNG file of colours, or of indices with a palette (a grey ramp if none is given)."""
    if idx is None:
        lines, color, extra = _octets(rgba).reshape(height, width * 4), 6, b""
    else:
        lines, color = np.asarray(idx, np.uint8).reshape(height, width), 3
        if palette is None:
            palette = np.arange(256) * 0x010101 + 0xFF000000
        own = _octets(palette)
        extra = _chunk(b"PLTE", own[:, :3].tobytes()) + _chunk(b"tRNS", own[:, 3].tobytes())
    raw = np.hstack([np.zeros((height, 1), np.uint8), lines]).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + extra + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


@F.pandas_udf(IMAGE)
def decoded(contents: pd.Series) -> pd.DataFrame:
    """Images of PNG files; files that can't be read have an error instead."""

    def one(content: bytes) -> dict:
        try:
            return decode(content)
        except (ValueError, KeyError, zlib.error, struct.error, IndexError) as e:
            return {"width": None, "height": None, "rgba": None, "idx": None, "palette": None, "error": str(e) or type(e).__name__}

    return pd.DataFrame([one(c) for c in contents], columns=["width", "height", "rgba", "idx", "palette", "error"])


@F.pandas_udf(T.BinaryType())
def encoded(width: pd.Series, height: pd.Series, rgba: pd.Series) -> pd.Series:
    return pd.Series([encode(w, h, np.asarray(c)) for w, h, c in zip(width, height, rgba, strict=True)])


@F.pandas_udf(T.BinaryType())
def encoded_indexed(width: pd.Series, height: pd.Series, idx: pd.Series, palette: pd.Series) -> pd.Series:
    rows = zip(width, height, idx, palette, strict=True)
    return pd.Series([encode(w, h, idx=np.asarray(i), palette=None if p is None else np.asarray(p)) for w, h, i, p in rows])


def as_files(rows: DataFrame, palette: Column | None = None) -> DataFrame:
    """(image_id, content): PNG files of pixels (image_id, x, y, rgba), or with a ``palette`` of (image_id, x, y, idx); places without a pixel are 0.

    One image is one row from here on, as it is one file.
    """
    value, given = (F.col("rgba"), F.lit(None).cast("array<long>")) if palette is None else (F.col("idx"), palette)
    row = F.struct(F.col("y").cast("int").alias("y"), F.col("found").alias("found"))
    # a pixel of a row is one number of its place and its value, and a row of pixels one element of its image
    lines = rows.groupBy("image_id", "y").agg(F.collect_list(F.shiftleft(F.col("x").cast("long"), 32) + value.cast("long")).alias("found"))
    found = lines.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("height"), F.collect_list(row).alias("rows"))
    return found.select("image_id", placed("height", "rows.y", "rows.found", given).alias("content"))


@F.pandas_udf(T.BinaryType())
def placed(height: pd.Series, y: pd.Series, rows: pd.Series, palette: pd.Series) -> pd.Series:
    """PNG files of rows of places and values (place * 2^32 + value): colours, or indices where there is a palette."""

    def one(h: int, ys, found, colors) -> bytes:
        w = max(int(f.max(initial=-1) >> 32) for f in found) + 1
        grid = np.zeros((h, w), np.int64)
        for at, f in zip(ys, found, strict=True):
            grid[at, f >> 32] = f & 0xFFFFFFFF
        return encode(w, h, grid.reshape(-1)) if colors is None else encode(w, h, idx=grid.reshape(-1), palette=np.asarray(colors))

    return pd.Series([one(*row) for row in zip(height, y, rows, palette, strict=True)])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image): every PNG file under a path, decoded where it is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    return files.select("path", decoded("content").alias("image"))


def whole(images: DataFrame, id_col: str = "path") -> DataFrame:
    """(image_id, width, height, rgba, palette): images that could be read; palette is null where they have none."""
    return images.where("image.error is null").select(F.col(id_col).alias("image_id"), "image.width", "image.height", "image.rgba", "image.palette")


def pixels(images: DataFrame, id_col: str = "path") -> DataFrame:
    """(image_id, x, y, rgba, idx): images as pixels; those with errors have none."""
    rows = images.where("image.error is null").select(F.col(id_col).alias("image_id"), "image.width", F.posexplode(F.arrays_zip("image.rgba", F.coalesce("image.idx", F.array().cast("array<int>")).alias("idx"))).alias("p", "v"))
    return rows.select("image_id", (F.col("p") % F.col("width")).alias("x"), F.expr("p div width").cast("int").alias("y"), F.col("v.rgba"), F.col("v.idx"))
