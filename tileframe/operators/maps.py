"""Tile maps: finding each tile of an image in its tileset, and the order and form in which maps are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codec import pack_entry
from ..plans.modes import Mode
from .palettes import _holds, color_set, reduced, remap
from .tiles import canonical, mirrored, shapes, spread


def build(tiles: DataFrame, palettes: DataFrame, tileset: DataFrame, m: Mode, flip: bool = True, width: int = 8, height: int = 8) -> DataFrame:
    """(image_id, seq, tile, palette, flip_h, flip_v, matched) for tiles (image_id, seq, rgba).

    The first subpalette whose indices give a tile of the tileset decides, then the first such
    tile. Equal tiles of an image are looked up once. Tiles that aren't found, and indices that the mode has no room for, become entry 0.
    """
    own = shapes(tiles)
    rows = own.join(palettes, "image_id").withColumn("colors", color_set(F.col("rgba"), m))
    rows = rows.select("image_id", "seq", reduced(F.col("rgba"), m).alias("reduced"), "colors", F.posexplode_outer("palettes").alias("palette", "p"))
    probes = rows.where(_holds(F.col("p"), F.col("colors"))).withColumn("probe", remap(F.col("reduced"), F.col("p")))
    probes = probes.select("image_id", "seq", "palette", "probe", canonical(F.col("probe"), width, height, flip).alias("canon"))
    hits = probes.join(tileset.select("image_id", "canon", "tile", "data"), ["image_id", "canon"])
    best = hits.groupBy("image_id", "seq").agg(F.min(F.struct("palette", "tile", "probe", "data")).alias("b")).select("image_id", "seq", "b.*")
    return spread(_told(own.select("image_id", "seq", "seqs").join(best, ["image_id", "seq"], "left"), m, width, height))


def _told(found: DataFrame, m: Mode, width: int, height: int) -> DataFrame:
    """(image_id, seq, seqs, tile, palette, flip_h, flip_v, matched) of shapes with the tile that was found for them, if any."""
    ok = F.col("tile").isNotNull() & ((F.col("tile") < m.max_tiles) if m.max_tiles else F.lit(True))
    h, v = flips(F.col("probe"), F.col("data"), width, height)
    pick = lambda value, other: F.when(ok, value).otherwise(F.lit(other))
    return found.select(
        "image_id", "seq", "seqs", pick(F.col("tile"), 0).alias("tile"), pick(F.col("palette"), 0).alias("palette"), pick(h, False).alias("flip_h"), pick(v, False).alias("flip_v"), F.col("tile").isNotNull().alias("matched")
    )


#: Kinds of tiles that are sent to all tasks at most, and parts that more of them are dealt out over.
FEW_KINDS, SALTS = 50_000, 16


def build_shared(tiles: DataFrame, palettes: DataFrame, tileset: DataFrame, m: Mode, flip: bool = True, width: int = 8, height: int = 8, few: int = FEW_KINDS) -> DataFrame:
    """``build`` for one tileset (tile, canon, data) and one list of subpalettes (palettes) that serve all images.

    The subpalettes are one row, bounded by what a mode has, and become a constant. A kind of tile is looked up once
    for all images, by its canonical form. What was found goes back to the images' tiles by their pixels: sent to
    all tasks where there are ``few`` kinds or less, else in a join in which each kind is dealt out over
    SALTS parts, as a kind like the blank tile is in every image.
    """
    given = palettes.select("palettes").limit(2).collect()
    if len(given) != 1:
        raise ValueError("tilesets that serve all images have one list of subpalettes")
    lists = [F.array(*[F.lit(c).cast("long") for c in p]) if p else F.array().cast("array<long>") for p in given[0].palettes or []]
    own = shapes(tiles)
    kinds = own.select("rgba").distinct().withColumn("colors", color_set(F.col("rgba"), m)).withColumn("reduced", reduced(F.col("rgba"), m))
    rows = kinds.select("rgba", "colors", "reduced", F.posexplode(F.array(*lists) if lists else F.array().cast("array<array<long>>")).alias("palette", "p"))
    probes = rows.where(_holds(F.col("p"), F.col("colors"))).withColumn("probe", remap(F.col("reduced"), F.col("p")))
    probes = probes.select("rgba", "palette", "probe", canonical(F.col("probe"), width, height, flip).alias("canon"))
    hits = probes.join(tileset.select("canon", "tile", "data"), "canon")
    best = hits.groupBy("rgba").agg(F.min(F.struct("palette", "tile", "probe", "data")).alias("b")).select("rgba", "b.*").persist()
    rows = own.select("image_id", "seq", "seqs", "rgba")
    if best.limit(few + 1).count() <= few:
        found = rows.join(F.broadcast(best), "rgba", "left")
    else:
        salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("image_id", "seq"), F.lit(SALTS)).cast("int")).join(salted, ["rgba", "salt"], "left")
    return spread(_told(found, m, width, height))


def flips(probe: Column, data: Column, width: int | Column = 8, height: int | Column = 8) -> tuple[Column, Column]:
    """How a tileset's tile must be mirrored to give ``probe``: not at all if that does, else h, v, or both."""
    same, h, v = probe == data, probe == mirrored(data, width, height, True, False), probe == mirrored(data, width, height, False, True)
    return ~same & (h | ~v), ~same & ~h


def offset(entries: DataFrame, tile: int = 0, palette: int = 0) -> DataFrame:
    """Entries with numbers added to tiles and palettes, never below 0."""
    return entries.withColumns({"tile": F.greatest(F.lit(0), F.col("tile") + tile), "palette": F.greatest(F.lit(0), F.col("palette") + palette)})


def cell_number(tile: Column, width: int, height: int) -> Column:
    """The number of the first 8 by 8 cell of a larger tile, eight of which are a row of sixteen cells."""
    return tile % 8 * (1 if width == 8 else 2) + F.floor(tile / 8).cast("int") * (16 if height == 8 else 32)


def stored(entries: DataFrame, width: int, height: int, split_w: int = 0, split_h: int = 0, column_order: bool = False, tile_width: int = 8, tile_height: int = 8) -> DataFrame:
    """(image_id, screen, pos, ...) from (image_id, x, y, ...): the screen of each entry and its place in it.

    Screens go column by column; within one, entries go row by row or, in column order, column
    by column. Entries outside of width and height are left out, and sizes that don't divide
    the map, for which reading would run past its rows, are an error. In maps of several
    screens, tiles larger than 8 by 8 have the numbers of their first cells.
    """
    w, h = (split_w if 0 < split_w <= width else width), (split_h if 0 < split_h <= height else height)
    if width % w or height % h:
        raise ValueError("screens don't divide the map")
    x, y = F.col("x"), F.col("y")
    screen = F.floor(x / w) * (height // h) + F.floor(y / h)
    pos = (x % w) * h + y % h if column_order else (y % h) * w + x % w
    if (w, h) != (width, height) and (tile_width, tile_height) != (8, 8):
        entries = entries.withColumn("tile", cell_number(F.col("tile"), tile_width, tile_height))
    rows = entries.where((x < width) & (y < height) & (x >= 0) & (y >= 0))
    return rows.withColumns({"screen": screen.cast("int"), "pos": pos.cast("int")})


def native(entries: DataFrame, m: Mode) -> DataFrame:
    """(image_id, hex): entries of (image_id, screen, pos, ...) in native form, one after another."""
    one = pack_entry(m, F.col("tile"), F.col("palette"), F.col("flip_h"), F.col("flip_v"))
    return joined(entries.withColumn("hex", one))


def joined(rows: DataFrame) -> DataFrame:
    """(image_id, hex): hex parts by screen and pos, one after another."""
    parts = F.sort_array(F.collect_list(F.struct("screen", "pos", "hex")))
    return rows.groupBy("image_id").agg(F.array_join(F.transform(parts, lambda p: p["hex"]), "").alias("hex"))


def palette_map(entries: DataFrame) -> DataFrame:
    """(image_id, hex): palette numbers as 16-bit words."""
    p = F.col("palette").cast("long")
    byte = lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit(0xFF)))), 2, "0")
    return joined(entries.withColumn("hex", F.concat(byte(p), byte(F.shiftright(p, 8)))))


def check_banks(width: int, height: int) -> None:
    if width % 32 or height % 32:
        raise ValueError("banked maps have sides of a multiple of 32")


def _bytes(hexes: Column) -> Column:
    """The bytes of hex as an array, in one pass: a substring by its place is looked for from the start each time."""
    return F.regexp_extract_all(hexes, F.lit("(..)"), F.lit(1))


def banked(hexes: Column) -> Column:
    """Bytes of two-byte entries with all first bytes in front of all second ones; for maps that ``check_banks`` allows."""
    half = lambda k: F.array_join(F.filter(_bytes(hexes), lambda _, i: i % 2 == k), "")
    return F.when(F.length(hexes) < 4, hexes).otherwise(F.concat(half(0), half(1)))


def interleaved(maps: Column, tiles: Column) -> Column:
    """Bytes of a map and of tiles in turn, the shorter filled up with zeros."""
    both = F.zip_with(_bytes(maps), _bytes(tiles), lambda a, b: F.concat(F.coalesce(a, F.lit("00")), F.coalesce(b, F.lit("00"))))
    return F.array_join(both, "")


def as_json(entries: DataFrame, m: Mode) -> DataFrame:
    """(image_id, json): entries by screen as JSON, with the fields that the mode has use for."""
    fields = ["tile"] + ["palette"] * (m.palettes > 1) + ["flip_h", "flip_v"] * m.flip
    one = F.struct(*[F.col(f).cast("int").alias(f) for f in sorted(fields)])
    screens = entries.groupBy("image_id", "screen").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", one.alias("e")))), lambda p: p["e"]).alias("entries"))
    maps = screens.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("screen", "entries"))), lambda s: s["entries"]).alias("maps"))
    single = F.to_json(F.struct(F.get("maps", F.lit(0)).alias("map")))
    return maps.select("image_id", F.when(F.size("maps") > 1, F.to_json(F.struct("maps"))).otherwise(single).alias("json"))


def first_numbers(rows: DataFrame, order: str) -> DataFrame:
    """Rows of an image numbered from 0 in the order of a column."""
    return rows.withColumn("number", F.row_number().over(W.partitionBy("image_id").orderBy(order)) - 1)
