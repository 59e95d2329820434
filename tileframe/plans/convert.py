"""Whole conversions and their parts: from pixels of many images to palettes, tilesets, maps and their native forms."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..operators import maps, outputs, palettes, tiles
from .modes import TRANSPARENT, Mode, checked, mode


@dataclass(frozen=True)
class Options:
    """What to convert to; None takes the mode's own value.

    ``no_remap`` takes palettes and indices as indexed images have them; ``no_discard`` keeps
    repeated tiles. Sprites (``sprite_mode``, always in mode pce_sprite) have a transparent
    first colour and keep all tiles as they are.
    """

    mode: str = "snes"
    bpp: int | None = None
    tile_width: int | None = None
    tile_height: int | None = None
    max_palettes: int | None = None
    max_tiles: int | None = None
    col0: int | None = None
    no_flip: bool = False
    no_discard: bool = False
    no_remap: bool = False
    sprite_mode: bool = False
    tile_offset: int = 0
    palette_offset: int = 0
    split_width: int = 0
    split_height: int = 0
    column_order: bool = False

    @property
    def sprites(self) -> bool:
        return self.sprite_mode or self.mode == "pce_sprite"

    @property
    def discard(self) -> bool:
        return not (self.no_discard or self.sprites)

    def resolved(self) -> tuple[Mode, int, int, int, bool]:
        """The mode, colour depth, tile size and whether mirrored tiles count as equal."""
        m = mode("pce_sprite" if self.sprite_mode and self.mode == "pce" else self.mode)
        bpp, width, height = checked(m, self.bpp, self.tile_width, self.tile_height)
        return m, bpp, width, height, m.flip and not self.no_flip and not self.sprites

    @property
    def most_tiles(self) -> int:
        """Tiles that a tileset has room for; 0 for any number."""
        return self.resolved()[0].max_tiles if self.max_tiles is None else self.max_tiles


@dataclass(frozen=True)
class Conversion:
    """The relations of a conversion; all carry image_id. What they have in common is kept once it is worked out, until ``release``."""

    tiles: DataFrame
    palettes: DataFrame
    tileset: DataFrame
    entries: DataFrame
    diagnostics: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for part in self.kept:
            part.unpersist()


def sliced(pixels: DataFrame, options: Options) -> DataFrame:
    """(image_id, seq, tx, ty, rgba) for pixels (image_id, x, y, rgba): tiles numbered row by row."""
    _, _, width, height, _ = options.resolved()
    return _row_by_row(tiles.slice_tiles(pixels, width, height))


def sliced_images(images: DataFrame, options: Options) -> DataFrame:
    """The same for whole images (image_id, width, height, rgba), without a shuffle of pixels."""
    _, _, width, height, _ = options.resolved()
    return tiles.slice_images(images, width, height).select("image_id", "seq", "tx", "ty", "rgba")


def _row_by_row(rows: DataFrame) -> DataFrame:
    across = rows.groupBy("image_id").agg((F.max("tx") + 1).alias("across"))
    numbered = rows.join(across, "image_id").withColumn("seq", F.col("ty") * F.col("across") + F.col("tx"))
    return numbered.select("image_id", "seq", "tx", "ty", *[c for c in ("rgba", "idx") if c in rows.columns])


def first_colors(image_tiles: DataFrame, options: Options) -> DataFrame | None:
    """(image_id, col0): the colour that all subpalettes of an image start with: transparent for sprites, a given one, or else
    that of the picture's first pixel; none where the mode doesn't share its first colour and none is given."""
    m, *_ = options.resolved()
    if not options.sprites and options.col0 is None and not m.col0_shared:
        return None
    given = TRANSPARENT if options.sprites else options.col0
    corner = F.min_by(F.get("rgba", F.lit(0)), "seq")
    return image_tiles.groupBy("image_id").agg((corner if given is None else F.lit(given).cast("long")).alias("col0"))


def build_palettes(image_tiles: DataFrame, options: Options, image_palettes: DataFrame | None = None) -> DataFrame:
    """(image_id, palettes, problem) for tiles (image_id, seq, rgba), or with ``no_remap`` for ``image_palettes`` (image_id, palette).

    An image that needs more colours or subpalettes than there is room for has null palettes
    and says so in ``problem``; the other images are not held up.
    """
    m, bpp, *_ = options.resolved()
    if options.no_remap:
        if image_palettes is None:
            raise ValueError("no_remap needs the palettes of indexed images")
        own = palettes.from_colors(palettes.reduced(F.col("palette"), m), 1 << bpp)
        problem = F.when(F.col("palette").isNull(), "not an indexed image")
        return image_palettes.select("image_id", F.when(problem.isNull(), own).alias("palettes"), problem.alias("problem"))
    firsts = first_colors(image_tiles, options)
    sets = palettes.within(palettes.color_sets(image_tiles, m, firsts), 1 << bpp)
    sets = palettes.maximal_sets(palettes.distinct_sets(sets))
    count = F.lit(m.palettes if options.max_palettes is None else options.max_palettes)
    if firsts is None:
        return palettes.fitted(sets, F.lit(1 << bpp), count)
    sets = sets.join(firsts.select("image_id", color.reduce(F.col("col0"), m).alias("first")), "image_id")
    return palettes.fitted(sets, F.lit(1 << bpp), count, F.col("first"), ("first",))


def indexed(image_tiles: DataFrame, found: DataFrame, options: Options) -> DataFrame:
    """(image_id, seq, uses, palette, data): shapes of tiles as indices into the first subpalette that holds their colours.

    ``found`` are palettes (image_id, palettes) made by ``build_palettes``, read from a file
    or those of another image; tiles whose colours no subpalette has are left out. With
    ``no_remap`` the indices (idx) of the image are taken, of which the low bits count.
    """
    m, bpp, *_ = options.resolved()
    if options.no_remap:
        data = F.transform("idx", lambda i: i.bitwiseAND(F.lit((1 << bpp) - 1)))
        return image_tiles.select("image_id", "seq", "seqs", "uses", F.lit(0).alias("palette"), data.alias("data"))
    own = found.where("palettes is not null").select("image_id", "palettes")
    matched = palettes.first_match(palettes.color_sets(image_tiles, m), own).select("image_id", "seq", "palette")
    rows = image_tiles.join(matched, ["image_id", "seq"]).join(own, "image_id")
    reduced = palettes.reduced(F.col("rgba"), m).alias("reduced")
    rows = rows.select("image_id", "seq", "seqs", "uses", "palette", reduced, F.get("palettes", F.col("palette")).alias("p"))
    return rows.where("p is not null").select("image_id", "seq", "seqs", "uses", "palette", palettes.remap(F.col("reduced"), F.col("p")).alias("data"))


def build_tileset(image_tiles: DataFrame, found: DataFrame, options: Options) -> DataFrame:
    """(image_id, tile, data, canon, uses, palette): the tiles of each image in its palettes, without repeats unless these are kept."""
    _, _, width, height, flip = options.resolved()
    rows = indexed(tiles.shapes(image_tiles), found, options)
    if options.discard:
        return tiles.dedupe(rows, width, height, flip)
    return tiles.numbered(tiles.spread(rows), width, height, flip)


def build_map(image_tiles: DataFrame, found: DataFrame, tileset: DataFrame, options: Options, map_width: int = 0, map_height: int = 0) -> DataFrame:
    """(image_id, seq, x, y, tile, palette, flip_h, flip_v, matched) for tiles (image_id, seq, tx, ty, rgba), or their shapes with positions, in given palettes and a given tileset.

    With a map size the image is cut or filled up with empty tiles to that many of them.
    Without image_id, ``found`` (one row) and ``tileset`` serve all images, which need no copies of them.
    """
    m, _, width, height, flip = options.resolved()
    if m.name == "pce_sprite":
        raise ValueError("sprites have no maps")
    if map_width and map_height:
        image_tiles = tiles.grid(image_tiles, map_width, map_height, width * height)
    rows = image_tiles if "seqs" in image_tiles.columns else image_tiles.select("image_id", "seq", "rgba")
    if "image_id" not in tileset.columns:
        entries = maps.build_shared(rows, found, tileset, m, flip, width, height)
    else:
        own = found.where("palettes is not null").select("image_id", "palettes")
        entries = maps.build(rows, own, tileset, m, flip, width, height)
    entries = entries.join(tiles.positions(image_tiles).toDF("image_id", "seq", "x", "y"), ["image_id", "seq"])
    return maps.offset(entries, options.tile_offset, options.palette_offset)


def diagnose(image_tiles: DataFrame, found: DataFrame, tileset: DataFrame, options: Options) -> DataFrame:
    """(image_id, seq, problem): images without palettes, tiles with too many colours or without a matching subpalette, tilesets that are too large."""
    m, bpp, width, height, _ = options.resolved()
    own = tiles.shapes(image_tiles)
    nowhere = F.lit(None).cast("int").alias("seq")
    problems = found.where("palettes is null").select("image_id", nowhere, F.col("problem") if "problem" in found.columns else F.lit("no palettes").alias("problem"))
    if not options.no_remap:
        matched = palettes.first_match(palettes.color_sets(own, m), found.where("palettes is not null").select("image_id", "palettes"))
        sets = palettes.color_sets(own, m).select("image_id", "seq", F.array_remove("colors", F.lit(TRANSPARENT)).alias("own"))
        lost = tiles.spread(matched.where("palette is null").join(sets, ["image_id", "seq"]))
        why = F.when(F.size("own") > (1 << bpp), "too many colors").otherwise("no matching palette")
        problems = problems.union(lost.select("image_id", "seq", why.alias("problem")))
    if options.most_tiles:
        large = tileset.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > options.most_tiles)
        problems = problems.union(large.select("image_id", nowhere, F.lit("too many tiles").alias("problem")))
    return problems


def _uneven(pixels: DataFrame, width: int, height: int) -> DataFrame:
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    uneven = sizes.where((F.col("w") % width != 0) | (F.col("h") % height != 0))
    return uneven.select("image_id", F.lit(None).cast("int").alias("seq"), F.lit(f"sides are not multiples of {width}").alias("problem"))


def convert(pixels: DataFrame, options: Options | None = None, image_palettes: DataFrame | None = None) -> Conversion:
    """Convert images given as pixels (image_id, x, y, rgba; with ``no_remap`` idx too), all of them in one job.

    Nothing is collected: every relation is lazy and the work on one image is spread over
    its distinct tiles, but for packing its distinct colour sets. An image that can't be
    converted has a row in ``diagnostics`` and the others go on.
    """
    options = options or Options()
    m, _, width, height, _ = options.resolved()
    more = None
    if m.name == "pce_sprite":
        more = _uneven(pixels, width, height)
        pixels = pixels.join(more.select("image_id"), "image_id", "left_anti")
    done = convert_tiles(sliced(pixels, options), options, image_palettes)
    return done if more is None else replace(done, diagnostics=done.diagnostics.union(more))


def convert_tiles(image_tiles: DataFrame, options: Options, image_palettes: DataFrame | None = None) -> Conversion:
    """``convert`` for tiles made by ``sliced`` or ``sliced_images``.

    Shapes, palettes and tilesets feed several relations and are persisted (in memory, then on disk), so pictures are
    read and cut once; a lost part is worked out again.
    """
    m, *_ = options.resolved()
    own = tiles.shapes(image_tiles, positions=True).persist()
    found = build_palettes(own, options, image_palettes).persist()
    tileset = build_tileset(own, found, options).persist()
    if m.name == "pce_sprite":  # sprites have no maps
        entries = tiles.spread(own.select("image_id", "seqs")).where("false").selectExpr(
            "image_id", "seq", "0 as tile", "0 as palette", "false as flip_h", "false as flip_v", "false as matched", "0 as x", "0 as y"
        )
    else:
        entries = build_map(own, found, tileset, options)
    return Conversion(image_tiles, found, tileset, entries, diagnose(own, found, tileset, options), (own, found, tileset))


def native(conversion: Conversion, options: Options, map_width: int, map_height: int) -> DataFrame:
    """(image_id, problem, palette_hex, tiles_hex, map_hex): all parts of a conversion in native form; null where an image has a problem."""
    m, bpp, width, height, _ = options.resolved()
    stored = maps.stored(conversion.entries, map_width, map_height, options.split_width, options.split_height, options.column_order, width, height)
    parts = conversion.palettes.select("image_id", "problem", outputs.palette_native(F.col("palettes"), m, 1 << bpp).alias("palette_hex"))
    parts = parts.join(outputs.tileset_native(conversion.tileset, m, bpp, width, height).withColumnRenamed("hex", "tiles_hex"), "image_id", "left")
    known = stored.join(conversion.palettes.where("palettes is not null").select("image_id"), "image_id", "left_semi")
    return parts.join(maps.native(known, m).withColumnRenamed("hex", "map_hex"), "image_id", "left")
