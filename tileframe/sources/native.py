"""Palettes and tilesets from files: palettes as JSON or native bytes, tiles as native bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import layout, unpack_palette, unpack_tile
from ..functions.color import from_hex, reduce
from ..operators.palettes import from_colors, without_col0_duplicate
from ..operators.tiles import metatiles
from ..plans.modes import Mode


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def palettes_from_json(text: Column, m: Mode) -> Column:
    """Subpalettes of a document {"palettes": [["#rrggbb", ...], ...]}; null for other texts."""
    told = F.from_json(text, "palettes array<array<string>>")["palettes"]
    return F.transform(told, lambda colors: F.transform(F.filter(colors, lambda c: c.isNotNull()), lambda c: reduce(from_hex(c), m)))


def palettes_from_native(hexes: Column, m: Mode, max_colors: int | None = None) -> Column:
    """Subpalettes of native bytes; where modes share the first colour, one that comes twice counts as transparent."""
    split = from_colors(unpack_palette(hexes, m), max_colors or m.colors)
    return F.transform(split, without_col0_duplicate) if m.col0_shared else split


def read_palettes(spark: SparkSession, path: str, m: Mode, max_colors: int | None = None) -> DataFrame:
    """(path, palettes): palette files, read as JSON with subpalettes that fit if they are that, and as native bytes otherwise."""
    told = palettes_from_json(F.regexp_replace(F.col("content").cast("string"), "^\\x{FEFF}", ""), m)
    fits = ~F.exists(told, lambda p: F.size(p) > (max_colors or m.colors))
    rows = files(spark, path).select("path", "content", F.when(F.coalesce(fits, F.lit(False)), told).alias("told"))
    return rows.select("path", F.when(F.col("told").isNotNull(), F.col("told")).otherwise(palettes_from_native(F.lower(F.hex("content")), m, max_colors)).alias("palettes"))


def tiles_of(rows: DataFrame, m: Mode, bpp: int | None = None, width: int = 8, height: int = 8) -> DataFrame:
    """(image_id, tile, data): the tiles of native bytes (image_id, content), in order; a size that isn't whole tiles is an error.

    Larger tiles are put together from 8 by 8 cells: one starts at every cell that has its others.
    """
    bpp = bpp or m.bpp
    layout(m, bpp)
    size = 8 * bpp
    whole = F.when(F.length("content") % size == 0, F.expr(f"length(content) div {size}").cast("int")).otherwise(F.raise_error(F.lit("not a whole number of tiles")).cast("int"))
    rows = rows.withColumn("n", whole).where("n > 0")
    rows = rows.select("image_id", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("tile"))
    part = F.lower(F.hex(F.substring(F.col("content"), F.col("tile") * size + 1, F.lit(size))))
    cells = rows.select("image_id", "tile", part.alias("native")).select("image_id", "tile", unpack_tile(F.col("native"), m, bpp).alias("data"))
    return cells if (width, height) == (8, 8) else metatiles(cells, width, height, per_row=16 if m.name == "snes" else 1)


def read_tiles(spark: SparkSession, path: str, m: Mode, bpp: int | None = None, width: int = 8, height: int = 8) -> DataFrame:
    """``tiles_of`` native files; their paths are image_id."""
    return tiles_of(files(spark, path).withColumnRenamed("path", "image_id"), m, bpp, width, height)
