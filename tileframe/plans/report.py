"""What conversions made: sizes of palettes, tilesets and maps, by image and in all."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.color import hex_of
from .convert import Conversion, Options

# The lines that tell of a conversion.
PALETTE, FIRST, COLORS = "Mapping optimized palette (%dx%d entries)", "Setting color zero to %s", "Created palette with %s"
KEPT, OPTIMIZED = "Created tileset with %d entries", "Created optimized tileset with %d entries (discarded %d redundant tiles)"
MAPPING = "Mapping %d %dx%dpx tiles from image"


def described(sizes: Column) -> Column:
    """The number of colours of subpalettes of these sizes, and the sizes where there are several."""
    total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    listed = F.concat(F.lit(" ["), F.array_join(sizes.cast("array<string>"), ","), F.lit("]"))
    return F.when(total == 0, "zero colors").otherwise(F.concat(total.cast("string"), F.lit(" colors"), F.when(F.size(sizes) > 1, listed).otherwise("")))


def sizes(done: Conversion) -> DataFrame:
    """(image_id, problem, sizes, tiles, discarded, mapped, unmatched): one row an image, of one aggregate each over its tileset and its map.

    ``sizes`` are the colours of each subpalette, ``discarded`` the tiles that were repeats
    and ``unmatched`` the places of the map without a tile: all of them where an image has no
    palettes, and then null sizes.
    """
    made = done.tileset.groupBy("image_id").agg(F.count("*").alias("tiles"), F.sum(F.col("uses") - 1).cast("long").alias("discarded"))
    placed = done.entries.groupBy("image_id").agg(F.count("*").alias("mapped"), F.count_if(~F.col("matched")).alias("unmatched"))
    known = F.col("palettes").isNotNull()
    own = done.palettes.select("image_id", "problem", F.when(known, F.transform("palettes", F.size)).alias("sizes"))
    rows = own.join(made, "image_id", "left").join(placed, "image_id", "left")
    counted = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("tiles", "discarded", "mapped", "unmatched")}
    return rows.withColumns(counted).select("image_id", "problem", "sizes", *counted)


def reports(done: Conversion, options: Options) -> DataFrame:
    """(image_id, problem, report): the sizes as lines of text; null for an image with a problem."""
    m, bpp, width, height, _ = options.resolved()
    count = m.palettes if options.max_palettes is None else options.max_palettes
    first = options.sprites or options.col0 is not None or m.col0_shared
    rows = sizes(done).join(done.palettes.select("image_id", F.get(F.get("palettes", F.lit(0)), F.lit(0)).alias("first")), "image_id")
    lines = []
    if not options.no_remap:
        lines.append(F.lit(PALETTE % (count, 1 << bpp)))
    if first and not options.no_remap:
        lines.append(F.lit("Setting color zero to transparent") if options.sprites else F.format_string(FIRST, hex_of(F.col("first"))))
    lines.append(F.format_string(COLORS, described(F.col("sizes"))))
    lines.append(F.format_string(OPTIMIZED, "tiles", "discarded") if options.discard else F.format_string(KEPT, "tiles"))
    if m.name != "pce_sprite":
        lines.append(F.format_string(MAPPING, "mapped", F.lit(width), F.lit(height)))
    return rows.select("image_id", "problem", F.when(F.col("sizes").isNotNull(), F.concat_ws("\n", *lines)).alias("report"))


def observed(done: Conversion) -> tuple[Conversion, Observation, Observation]:
    """The conversion, with observations of its tilesets (tiles, discarded) and maps (mapped, unmatched) in all.

    They are filled by the first action on ``tileset`` and on ``entries``, such as the write
    that is run anyway: nothing is read or counted a second time. Places of images that have
    no palettes count as unmatched.
    """
    made, placed = Observation(), Observation()
    tileset = done.tileset.observe(made, F.count(F.lit(1)).alias("tiles"), F.coalesce(F.sum(F.col("uses") - 1), F.lit(0)).alias("discarded"))
    entries = done.entries.observe(placed, F.count(F.lit(1)).alias("mapped"), F.count_if(~F.col("matched")).alias("unmatched"))
    return replace(done, tileset=tileset, entries=entries), made, placed
