"""What palettes and tilesets are stored as: native bytes, colour tables, JSON and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import byte_hex, pack_palette, pack_tile
from ..functions.color import OPAQUE, channel, hex_of, normalize
from ..plans.modes import Mode
from .maps import joined
from .palettes import padded
from .tiles import cell_positions


def palette_native(palettes: Column, m: Mode, max_colors: int | None = None) -> Column:
    """Native bytes of subpalettes, each filled up to ``max_colors``."""
    return F.array_join(F.transform(palettes, lambda p: pack_palette(padded(p, max_colors or m.colors), m)), "")


def palette_act(palettes: Column, m: Mode) -> Column:
    """A colour table of 256 RGB entries, with the number of colours behind it."""
    colors = F.slice(F.flatten(palettes), 1, 256)
    rgb = F.array_join(F.transform(colors, lambda c: F.array_join(F.array(*[byte_hex(channel(normalize(c, m), k)) for k in range(3)]), "")), "")
    return F.concat(F.rpad(rgb, 1536, "0"), F.lit("00"), byte_hex(F.size(F.flatten(palettes)) % 256), F.lit("ffff"))


def _lines(items: Column, depth: int) -> Column:
    """JSON of an array of JSON texts, one to a line, for something that stands ``depth`` levels deep."""
    pad = "  " * depth
    listed = F.array_join(F.transform(items, lambda i: F.concat(F.lit(f"{pad}  "), i)), ",\n")
    return F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit("[\n"), listed, F.lit(f"\n{pad}]")))


def palette_json(palettes: Column, m: Mode, indented: bool = False) -> Column:
    """Subpalettes as JSON: colours at full depth as hex, and reduced channels; ``indented`` by two spaces a level, as palette files have it."""
    names = F.transform(palettes, lambda p: F.transform(p, lambda c: hex_of(normalize(c, m))))
    parts = F.transform(palettes, lambda p: F.transform(p, lambda c: F.array(*[channel(c, k).cast("int") for k in range(3)])))
    if not indented:
        return F.to_json(F.struct(names.alias("palettes"), parts.alias("palettes_native_rgb")))
    told = _lines(F.transform(names, lambda p: _lines(F.transform(p, lambda c: F.concat(F.lit('"'), c, F.lit('"'))), 2)), 1)
    channels = _lines(F.transform(parts, lambda p: _lines(F.transform(p, lambda c: _lines(F.transform(c, lambda v: v.cast("string")), 3)), 2)), 1)
    return F.concat(F.lit('{\n  "palettes": '), told, F.lit(',\n  "palettes_native_rgb": '), channels, F.lit("\n}"))


def palette_pixels(palettes: DataFrame, m: Mode, max_colors: int | None = None) -> DataFrame:
    """(image_id, x, y, rgba): a picture of subpalettes, one to a row; places without a colour are transparent."""
    rows = palettes.select("image_id", F.posexplode("palettes").alias("y", "p"))
    rows = rows.select("image_id", "y", F.posexplode(padded(F.col("p"), max_colors or m.colors)).alias("x", "c"))
    return rows.select("image_id", "x", "y", normalize(F.col("c"), m).alias("rgba"))


def tileset_native(tileset: DataFrame, m: Mode, bpp: int | None = None, width: int = 8, height: int = 8) -> DataFrame:
    """(image_id, hex): native bytes of tilesets (image_id, tile, data); larger tiles as cells, with empty cells between."""
    bpp = bpp or m.bpp
    if m.name == "pce_sprite" or (width, height) == (8, 8):
        rows = tileset.select("image_id", F.lit(0).alias("screen"), F.col("tile").alias("pos"), pack_tile(F.col("data"), m, bpp).alias("hex"))
        return joined(rows)
    per_row = 16 if m.name == "snes" else 1
    placed = cell_positions(tileset, width, height, per_row)
    rows_of = per_row * (height // 8)
    ends = placed.groupBy("image_id").agg(((F.floor(F.max("place") / rows_of) + 1) * rows_of).cast("int").alias("n"))
    places = ends.select("image_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
    packed = placed.select("image_id", "place", pack_tile(F.col("data"), m, bpp).alias("hex"))
    filled = places.join(packed, ["image_id", "place"], "left")
    return joined(filled.select("image_id", F.lit(0).alias("screen"), F.col("place").alias("pos"), F.coalesce("hex", F.lit("00" * 8 * bpp)).alias("hex")))


def grey_ramp(bpp: int) -> Column:
    """Colours for tiles that come without a palette: greys from black up, one an index."""
    step = 256 >> bpp
    return F.transform(F.sequence(F.lit(0), F.lit((1 << bpp) - 1)), lambda i: i.cast("long") * (step * 0x010101) + OPAQUE)


def tileset_colors(tileset: DataFrame, palettes: DataFrame, m: Mode, width: int = 8, height: int = 8, image_width: int = 128) -> DataFrame:
    """(image_id, x, y, rgba): the picture of ``tileset_pixels`` in colours: tiles (with palette) in subpalettes of (image_id, palettes)."""
    own = tileset.join(palettes.select("image_id", "palettes"), "image_id")
    full = F.transform(F.get("palettes", F.col("palette")), lambda c: normalize(c, m))
    own = own.select("image_id", "tile", F.col("data").alias("idx"), full.alias("full"))
    colored = own.select("image_id", "tile", F.transform("idx", lambda i: F.get("full", i)).alias("data"))
    return tileset_pixels(colored, width, height, image_width).withColumnRenamed("idx", "rgba")


def tileset_pixels(tileset: DataFrame, width: int = 8, height: int = 8, image_width: int = 128) -> DataFrame:
    """(image_id, x, y, idx): a picture of tilesets, tiles from left to right in rows of ``image_width`` pixels."""
    if image_width % width:
        raise ValueError("tiles don't divide the width")
    across = image_width // width
    rows = tileset.select("image_id", "tile", F.posexplode("data").alias("p", "idx"))
    x = F.col("tile") % across * width + F.col("p") % width
    y = F.floor(F.col("tile") / across) * height + F.floor(F.col("p") / width)
    return rows.select("image_id", x.cast("int").alias("x"), y.cast("int").alias("y"), "idx")
