"""Slicing images into tiles, mirrors of tiles and tilesets without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.modes import Mode


def slice_tiles(pixels: DataFrame, width: int | Column = 8, height: int | Column = 8, fill: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, tx, ty, rgba): pixels gathered by tile, row by row; pixels that an edge tile lacks are ``fill``. Indices (idx) come along.

    Sizes may be columns, which are named in ``keys``; these tell tiles apart like image_id and come along. A pixel without
    index is gathered as one number of its place and colour (0 to 2^32 - 1, or null).
    """
    x, y = F.col("x"), F.col("y")
    own = ["rgba", *(["idx"] if "idx" in pixels.columns else [])]
    rows = pixels.select(
        "image_id", *keys, F.floor(x / width).cast("int").alias("tx"), F.floor(y / height).cast("int").alias("ty"), ((y % height) * width + x % width).cast("int").alias("p"), *own
    )
    one = F.struct("p", *own) if "idx" in own else F.shiftleft(F.col("p").cast("long"), 33) + F.coalesce(F.col("rgba") + 1, F.lit(0))
    found = rows.groupBy("image_id", *keys, "tx", "ty").agg(F.sort_array(F.collect_list(one)).alias("found"))
    size = width * height
    sequence = F.sequence(F.lit(0), size - 1 if isinstance(size, Column) else F.lit(size - 1))
    place = (lambda f: f["p"]) if "idx" in own else (lambda f: F.shiftright(f, 33))
    value = (lambda f, name: f[name]) if "idx" in own else (lambda f, _: F.nullif(f.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(0)) - 1)
    at = lambda i: F.get(F.filter("found", lambda f: place(f) == i), F.lit(0))

    def whole(name: str, other: Column) -> Column:
        return F.when(F.size("found") == size, F.transform("found", lambda f: value(f, name))).otherwise(F.transform(sequence, lambda i: F.coalesce(value(at(i), name), other))).alias(name)

    others = {"rgba": F.lit(fill).cast("long"), "idx": F.lit(0)}
    return found.select("image_id", *keys, "tx", "ty", *[whole(c, others[c]) for c in own])


def slice_images(images: DataFrame, width: int = 8, height: int = 8, fill: int = 0) -> DataFrame:
    """(image_id, seq, tx, ty, rgba) from whole images (image_id, width, height, rgba): tiles are cut and numbered where the image is, nothing is shuffled."""
    across, down = F.ceil(F.col("width") / width).cast("int"), F.ceil(F.col("height") / height).cast("int")
    inside = lambda x, y: F.when((x < F.col("width")) & (y < F.col("height")), F.get("rgba", y * F.col("width") + x))

    def tile(n: Column) -> Column:
        left, top = n % F.col("across") * width, F.floor(n / F.col("across")).cast("int") * height
        pixel = lambda p: F.coalesce(inside(left + p % width, top + F.floor(p / width).cast("int")), F.lit(fill).cast("long"))
        return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)

    rows = images.where("width > 0 and height > 0").select("image_id", "width", "height", "rgba", across.alias("across"), down.alias("down"))
    cut = F.transform(F.sequence(F.lit(0), F.col("across") * F.col("down") - 1), tile)
    rows = rows.select("image_id", "across", F.posexplode(cut).alias("seq", "rgba"))
    return rows.select("image_id", "seq", (F.col("seq") % F.col("across")).alias("tx"), F.floor(F.col("seq") / F.col("across")).cast("int").alias("ty"), "rgba")


def shapes(tiles: DataFrame, positions: bool = False) -> DataFrame:
    """Equal tiles of an image as one row: their columns, ``seq``, the first place, ``seqs``, all places in order, and ``uses``.

    With ``positions`` there are also ``txs`` and ``tys``, where these places are.

    All that follows from a tile's pixels is then worked out once for each kind of tile.
    Other columns but image_id and seq must follow from the pixels too.
    """
    if "seqs" in tiles.columns:
        return tiles
    own = [c for c in ("image_id", "rgba", "idx") if c in tiles.columns]
    if positions:
        found = tiles.groupBy(*own).agg(F.min("seq").alias("seq"), F.sort_array(F.collect_list(F.struct("seq", "tx", "ty"))).alias("at"), F.count("*").alias("uses"))
        return found.select(*own, "seq", F.col("at.seq").alias("seqs"), F.col("at.tx").alias("txs"), F.col("at.ty").alias("tys"), "uses")
    places = F.sort_array(F.collect_list("seq"))
    return tiles.groupBy(*own).agg(F.min("seq").alias("seq"), places.alias("seqs"), F.count("*").alias("uses"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of ``shapes`` again as a row for each place."""
    return rows.withColumn("seq", F.explode("seqs")).drop("seqs")


def positions(tiles: DataFrame) -> DataFrame:
    """(image_id, seq, tx, ty) of tiles, or of shapes with positions."""
    if "seqs" not in tiles.columns:
        return tiles.select("image_id", "seq", "tx", "ty")
    at = F.explode(F.arrays_zip(F.col("seqs").alias("seq"), F.col("txs").alias("tx"), F.col("tys").alias("ty"))).alias("at")
    return tiles.select("image_id", at).select("image_id", "at.*")


def grid(tiles: DataFrame, width: int, height: int, size: int = 64, fill: int = 0) -> DataFrame:
    """(image_id, seq, tx, ty, rgba): tiles (image_id, tx, ty, rgba) cut or filled up to ``width`` by ``height`` of them, numbered row by row."""
    places = tiles.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("seq"))
    places = places.withColumns({"tx": F.col("seq") % width, "ty": F.floor(F.col("seq") / width).cast("int")})
    rows = places.join(tiles.select("image_id", "tx", "ty", "rgba"), ["image_id", "tx", "ty"], "left")
    return rows.select("image_id", "seq", "tx", "ty", F.coalesce("rgba", F.array_repeat(F.lit(fill).cast("long"), size)).alias("rgba"))


def mirrored(data: Column, width: int | Column, height: int | Column, h: bool, v: bool) -> Column:
    """A tile's values, mirrored from left to right (h) and from top to bottom (v)."""
    if h and v:
        return F.reverse(data)
    if isinstance(width, Column):
        rows = F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.slice(data, y * width + 1, width))
    else:
        rows = F.array(*[F.slice(data, y * width + 1, width) for y in range(height)])
    if h:
        rows = F.transform(rows, F.reverse)
    return F.flatten(F.reverse(rows) if v else rows) if h or v else data


def canonical(data: Column, width: int | Column = 8, height: int | Column = 8, flip: bool | Column = True) -> Column:
    """The least of a tile's four orientations: equal for tiles that are mirrors of each other."""
    if flip is False:
        return data
    least = F.least(data, *(mirrored(data, width, height, h, v) for h, v in ((True, False), (False, True), (True, True))))
    return least if flip is True else F.when(flip, least).otherwise(data)


def dedupe(tiles: DataFrame, width: int | Column = 8, height: int | Column = 8, flip: bool | Column = True, keys: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(image_id, tile, data, canon, uses) from (image_id, seq, data): tiles as first seen, numbered in that order.

    Equal tiles are put together before their mirrors are looked at. A column ``palette`` of
    the tiles is kept, and ``uses``, if they have it, is what a tile counts as. Sizes and
    ``flip`` may be columns, which follow from image_id and are named in ``keys``.
    """
    more = [c for c in ("palette",) if c in tiles.columns]
    uses = F.sum("uses") if "uses" in tiles.columns else F.count("*")
    first = tiles.groupBy("image_id", *keys, "data").agg(F.min(F.struct("seq", *more)).alias("s"), uses.alias("uses"))
    rows = first.select("image_id", *keys, "s.*", "data", "uses").withColumn("canon", canonical(F.col("data"), width, height, flip))
    kept = rows.groupBy("image_id", "canon").agg(F.min(F.struct("seq", *more, "data")).alias("first"), F.sum("uses").alias("uses"))
    order = W.partitionBy("image_id").orderBy("first.seq")
    return kept.select("image_id", (F.row_number().over(order) - 1).alias("tile"), F.col("first.data").alias("data"), "canon", "uses", *[F.col(f"first.{c}").alias(c) for c in more])


#: Places of an image that are numbered by one task.
NUMBERED = 1 << 16


def numbered(tiles: DataFrame, width: int | Column = 8, height: int | Column = 8, flip: bool | Column = True) -> DataFrame:
    """(image_id, tile, data, canon, uses) from (image_id, seq, data): every tile, repeated or not, numbered in order of seq.

    An image's places are parted by NUMBERED: each part is numbered by itself, from the sum of the sizes of those in front of it.
    """
    more = [c for c in ("palette",) if c in tiles.columns]
    rows = tiles.withColumn("part", F.floor(F.col("seq") / NUMBERED))
    before = F.sum("n").over(W.partitionBy("image_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = rows.groupBy("image_id", "part").agg(F.count("*").alias("n")).select("image_id", "part", F.coalesce(before, F.lit(0)).alias("start"))
    rows = rows.join(starts, ["image_id", "part"])
    number = F.row_number().over(W.partitionBy("image_id", "part").orderBy("seq")) - 1 + F.col("start")
    return rows.select("image_id", number.cast("int").alias("tile"), "data", canonical(F.col("data"), width, height, flip).alias("canon"), F.lit(1).cast("long").alias("uses"), *more)


def check_capacity(tileset: DataFrame, m: Mode) -> DataFrame:
    """(image_id, tiles, discarded, overflow): sizes of tilesets, and whether the mode has no room for them (0 allows any)."""
    sizes = tileset.groupBy("image_id").agg(F.count("*").alias("tiles"), (F.sum("uses") - F.count("*")).alias("discarded"))
    return sizes.withColumn("overflow", (F.col("tiles") > m.max_tiles) if m.max_tiles else F.lit(False))


def cells(tiles: DataFrame, width: int, height: int, cell: int = 8) -> DataFrame:
    """(image_id, tile, cell, data): the cells of metatiles, row by row."""
    across, down = width // cell, height // cell
    one = lambda cx, cy: F.flatten(F.array(*[F.slice("data", (cy * cell + y) * width + cx * cell + 1, cell) for y in range(cell)]))
    split = F.array(*[one(cx, cy) for cy in range(down) for cx in range(across)])
    return tiles.select("image_id", "tile", F.posexplode(split).alias("cell", "data"))


def cell_positions(tiles: DataFrame, width: int, height: int, per_row: int = 16) -> DataFrame:
    """(image_id, place, data): the cells of metatiles where native data has them, ``per_row`` to a row; places between are holes."""
    across, down = width // 8, height // 8
    tiles_per_row = per_row // across
    if tiles_per_row == 0:
        raise ValueError("tiles are wider than a row of cells")
    base = F.floor(F.col("tile") / tiles_per_row) * down * per_row + (F.col("tile") % tiles_per_row) * across
    place = base + F.floor(F.col("cell") / across) * per_row + F.col("cell") % across
    return cells(tiles, width, height).select("image_id", place.cast("int").alias("place"), "data")


def metatiles(cell_rows: DataFrame, width: int, height: int, per_row: int = 16) -> DataFrame:
    """(image_id, tile, data): the metatile that starts at each 8 by 8 cell of (image_id, tile, data); those that miss cells are left out."""
    across, down = width // 8, height // 8
    offsets = [(cy * per_row + cx, cy * across + cx) for cy in range(down) for cx in range(across)]
    starts = F.explode(F.array(*[F.struct((F.col("tile") - off).alias("start"), F.lit(k).alias("k")) for off, k in offsets])).alias("s")
    rows = cell_rows.select("image_id", "data", starts).select("image_id", "s.start", "s.k", "data")
    whole = rows.groupBy("image_id", "start").agg(F.sort_array(F.collect_list(F.struct("k", "data"))).alias("parts"))
    whole = whole.where((F.size("parts") == len(offsets)) & (F.col("start") >= 0))
    part = lambda k, y: F.slice(F.get("parts", F.lit(k))["data"], y * 8 + 1, 8)
    rows_of = [part(cy * across + cx, y) for cy in range(down) for y in range(8) for cx in range(across)]
    return whole.select("image_id", F.col("start").cast("int").alias("tile"), F.flatten(F.array(*rows_of)).alias("data"))
