"""Colour sets of tiles, packing them into subpalettes, and matching tiles with these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.color import reduce, sort_key
from ..plans.modes import TRANSPARENT, Mode


def color_set(rgba: Column, m: Mode) -> Column:
    """The reduced colours of an array, distinct and rising."""
    return F.sort_array(F.array_distinct(F.transform(F.array_distinct(rgba), lambda c: reduce(c, m))))


def _places(rows: DataFrame) -> list[str]:
    """The columns that tell tiles, or shapes of equal ones, apart."""
    return ["image_id", "seq", *(["seqs"] if "seqs" in rows.columns else [])]


def color_sets(tiles: DataFrame, m: Mode, firsts: DataFrame | None = None) -> DataFrame:
    """(image_id, seq, colors) from (image_id, seq, rgba) or shapes, which keep seqs, with the shared first colour of (image_id, col0) in each set if given."""
    colors = color_set(F.col("rgba"), m)
    if firsts is not None:
        tiles = tiles.join(firsts, "image_id")
        colors = F.sort_array(F.array_union(colors, F.array(reduce(F.col("col0"), m))))
    return tiles.select(*_places(tiles), colors.alias("colors"))


def distinct_sets(sets: DataFrame) -> DataFrame:
    """(image_id, colors, seq): each set of an image once, with its first place; empty sets go, null ones (``within``) count as one."""
    return sets.where(F.col("colors").isNull() | (F.size("colors") > 0)).groupBy("image_id", "colors").agg(F.min("seq").alias("seq"))


def within(sets: DataFrame, most: int | Column) -> DataFrame:
    """Sets, null those of more than ``most`` colours: as distinct sets these are one row an image, however many they are."""
    return sets.withColumn("colors", F.when(F.size("colors") <= most, F.col("colors")))


def maximal_sets(sets: DataFrame) -> DataFrame:
    """Distinct sets that no other set of their image holds; null ones (``within``) stay.

    A set and what holds it share all its colours, so they are joined on the one that the
    fewest sets of the image have: a colour that most of them share brings no pairs together.
    """
    colors = sets.select("image_id", "seq", "colors", F.explode_outer("colors").alias("color"))
    colors = colors.withColumn("n", F.count("*").over(W.partitionBy("image_id", "color")))
    own = colors.groupBy("image_id", "seq", "colors").agg(F.min(F.struct("n", "color"))["color"].alias("rarest"))
    larger = colors.where("n > 1").select("image_id", F.col("color").alias("rarest"), F.col("colors").alias("larger"))
    inside = (F.size(larger["larger"]) > F.size(own["colors"])) & (F.size(F.array_except(own["colors"], larger["larger"])) == 0)
    return own.join(larger, (own["image_id"] == larger["image_id"]) & (own["rarest"] == larger["rarest"]) & inside, "left_anti").drop("rarest")


def packed(sets: DataFrame, m: Mode, max_colors: int | None = None, firsts: DataFrame | None = None) -> DataFrame:
    """(image_id, palettes): an image's sets in as few subpalettes as a greedy pass gives.

    Larger sets come first, of equal ones the later. Each goes to the last subpalette that
    then has ``max_colors`` at most, or opens a new one. Subpalettes come out by falling size,
    each with its colours rising but the shared first colour in front, and the others by
    hue, brightness and value. ``firsts`` (image_id, col0) are the shared first colours. One
    image's distinct maximal sets are one row.
    """
    most = F.lit(max_colors or m.colors)
    if firsts is None:
        return packed_within(sets, most)
    sets = sets.join(firsts.select("image_id", reduce(F.col("col0"), m).alias("first")), "image_id")
    return packed_within(sets, most, F.col("first"), ("first",)).drop("first")


def fitted(sets: DataFrame, most: Column, count: Column, first: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, palettes, problem): ``packed_within`` of maximal sets (``within`` ``most``) into ``count`` subpalettes; images that these don't hold have null palettes and say so.

    A set that no subpalette holds settles it without packing, and packing ends with the
    first subpalette too many, so the work on an image grows with its sets and not with their square.
    """
    found = packed_within(sets, most, first, keys, count)
    problem = F.when(F.col("palettes").isNull(), "colors do not fit in a palette").when(F.size("palettes") > count, "colors do not fit in the available palettes")
    return found.select("image_id", F.when(problem.isNull(), F.col("palettes")).alias("palettes"), problem.alias("problem"))


def packed_within(sets: DataFrame, most: Column, first: Column | None = None, keys: tuple[str, ...] = (), count: Column | None = None) -> DataFrame:
    """``packed`` for subpalettes of ``most`` colours with ``first`` in front where it isn't null; both may be columns of ``sets``, which follow from image_id and are named in ``keys``.

    Images with a null set have null palettes. With ``count``, packing ends with the first subpalette beyond it, so that there are more than ``count`` but not all.
    """
    by_size = F.struct((-F.size("colors")).alias("size"), (-F.col("seq")).alias("seq"), "colors")
    listed = F.sort_array(F.collect_list(F.when(F.col("colors").isNotNull(), by_size)))
    rows = sets.groupBy("image_id", *keys).agg(F.when(~F.bool_or(F.col("colors").isNull()), listed).alias("sets"))

    def put(bins: Column, s: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(1), F.size(bins)), lambda i: F.size(F.array_union(F.element_at(bins, i), s["colors"])) <= most)
        last = F.when(F.size(bins) == 0, F.lit(0)).otherwise(F.coalesce(F.array_max(fits), F.lit(0)))
        merged = F.transform(bins, lambda b, j: F.when(j == last - 1, F.array_union(b, s["colors"])).otherwise(b))
        more = F.when(last == 0, F.concat(bins, F.array(s["colors"]))).otherwise(merged)
        return more if count is None else F.when(F.size(bins) > count, bins).otherwise(more)

    none = F.array().cast("array<array<long>>")
    rows = rows.withColumn("bins", F.aggregate("sets", none, put))
    ordered = F.transform(F.sort_array(F.transform("bins", lambda b, i: F.struct((-F.size(b)).alias("size"), i.alias("i"), F.sort_array(b).alias("colors")))), lambda b: b["colors"])
    rows = rows.select("image_id", *keys, ordered.alias("ordered"))
    if first is not None:
        rows = rows.withColumn("ordered", F.transform("ordered", lambda b: F.when(first.isNull(), b).otherwise(_moved_to_front(b, first))))
    return rows.select("image_id", *keys, F.transform("ordered", sorted_after_first).alias("palettes"))


def _moved_to_front(colors: Column, first: Column) -> Column:
    """Colours with ``first`` and the one in front exchanged, if it is there."""
    at = F.array_position(colors, first)
    swapped = F.transform(colors, lambda c, i: F.when(i == 0, first).when(i == at - 1, F.element_at(colors, 1)).otherwise(c))
    return F.when(at > 1, swapped).otherwise(colors)


def sorted_after_first(colors: Column) -> Column:
    """Colours but the first by hue, brightness and value, rising; fewer than three stay as they are."""
    rest = F.transform(F.sort_array(F.transform(F.slice(colors, 2, F.greatest(F.size(colors) - 1, F.lit(0))), sort_key)), lambda k: k["c"])
    return F.when(F.size(colors) < 3, colors).otherwise(F.concat(F.slice(colors, 1, 1), rest))


def overflow(palettes: DataFrame, m: Mode) -> DataFrame:
    """(image_id, subpalettes, overflow): whether an image needs more subpalettes than the mode has."""
    return palettes.select("image_id", F.size("palettes").alias("subpalettes"), (F.size("palettes") > m.palettes).alias("overflow"))


def from_colors(colors: Column, max_colors: int) -> Column:
    """A list of colours as subpalettes of ``max_colors``, in order."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(colors), F.lit(1)), F.lit(max_colors))
    return F.transform(starts, lambda i: F.slice(colors, i, max_colors))


def padded(colors: Column, max_colors: int) -> Column:
    return F.concat(colors, F.array_repeat(F.lit(TRANSPARENT).cast("long"), F.greatest(F.lit(max_colors) - F.size(colors), F.lit(0))))


def without_col0_duplicate(colors: Column) -> Column:
    """Colours, the first without alpha if it comes again."""
    rest = F.slice(colors, 2, F.greatest(F.size(colors) - 1, F.lit(0)))
    first = F.element_at(colors, 1)
    return F.when(F.array_contains(rest, first), F.concat(F.array(first.bitwiseAND(F.lit(0xFFFFFF))), rest)).otherwise(colors)


def _holds(palette: Column, colors: Column) -> Column:
    return F.size(F.array_except(colors, palette)) == 0


def first_match(sets: DataFrame, palettes: DataFrame) -> DataFrame:
    """(image_id, seq, palette): the first subpalette with all of a tile's colours but the transparent one; null if none has."""
    rows = sets.join(palettes, "image_id").withColumn("own", F.array_remove("colors", F.lit(TRANSPARENT)))
    at = F.array_position(F.transform("palettes", lambda p: _holds(p, F.col("own"))), F.lit(True))
    return rows.select(*_places(sets), F.when(at > 0, at - 1).cast("int").alias("palette"))


def all_matches(sets: DataFrame, palettes: DataFrame) -> DataFrame:
    """(image_id, seq, palette): every subpalette with all of a tile's colours, the transparent one too."""
    rows = sets.join(palettes, "image_id")
    rows = rows.select(*_places(sets), "colors", F.posexplode("palettes").alias("palette", "p"))
    return rows.where(_holds(F.col("p"), F.col("colors"))).select(*_places(sets), "palette")


def reduced(rgba: Column, m: Mode) -> Column:
    return F.transform(rgba, lambda c: reduce(c, m))


def remap(colors: Column, palette: Column) -> Column:
    """Indices of reduced colours: the first equal one of the palette, 0 for transparent ones, null where there is none.

    Colours are equal if they are once normalized, which for reduced ones comes to the same.
    """
    at = lambda c: F.nullif(F.array_position(palette, c), F.lit(0)) - 1
    return F.transform(colors, lambda c: F.when(c == TRANSPARENT, F.lit(0)).otherwise(at(c)).cast("int"))
