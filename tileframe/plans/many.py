"""Conversions to many modes in one job: modes are a relation, and what to convert to is a column of each request.

A request names a source picture and a mode and may set depth, tile size and limits of its own;
nulls take the mode's values. Pictures are cut into cells of 8 by 8 pixels once, of which the tiles of all
sizes are made, and their distinct tiles meet the requests; all that follows is one plan, whatever the
number of modes, in which settings are columns.

A tile of n colours is a string of as many characters as it has pixels (``look``), the k-th of ALPHABET for
its k-th colour. A mode reduces and looks up n colours and then exchanges characters. Of a tile in a mode only the least of its
orientations is kept (``canon``), and which of them that is (``turns``, a bit each as in TURNS).
"""

from __future__ import annotations

import tempfile
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color
from ..operators import palettes, tiles
from .convert import Conversion
from .modes import MODES, TRANSPARENT

#: Settings of a request that may be null.
WISHES = {"bpp": "int", "tile_width": "int", "tile_height": "int", "max_palettes": "int", "max_tiles": "int", "col0": "long", "no_flip": "boolean", "no_discard": "boolean", "sprite_mode": "boolean"}
_BITS = {"grey4": -2, "grey8": -3}
#: Sides of all tiles are multiples of a cell's.
CELL = 8
#: A character for each index that a tile can have, in the order of indices.
FIRST = ord("0")
ALPHABET = [chr(FIRST + i) for i in range(256)]
#: Orientations of a tile by bit: as it is, mirrored from left to right, from top to bottom, both.
TURNS = ((False, False), (True, False), (False, True), (True, True))


def modes(spark: SparkSession) -> DataFrame:
    """A row for each mode: its name and fields, with ``bits`` a channel, below 0 for modes of greys."""
    rows = [asdict(m) | {"bits": _BITS.get(m.reduce) or int(m.reduce)} for m in MODES.values()]
    schema = (
        "name string, bpp int, bpps array<int>, tile int, widths array<int>, heights array<int>, max_tiles int, flip boolean, map_size int, palettes int, "
        "col0_shared boolean, gated boolean, bits int"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in (r[n] for n in names)) for r in rows], schema)


def settings(requests: DataFrame) -> DataFrame:
    """(image_id, source_id, mode, ..., problem): requests (image_id, source_id, mode, and WISHES as far as they are there) with the values that hold for them.

    ``modes`` has sixteen rows and is broadcast. Unknown modes, and depths and tile sizes
    that a mode doesn't allow, are problems of their requests alone.
    """
    asked = requests.select("image_id", "source_id", "mode", *[(F.col(c).cast(t) if c in requests.columns else F.lit(None).cast(t)).alias(f"own_{c}") for c, t in WISHES.items()])
    sprites = F.coalesce("own_sprite_mode", F.lit(False)) & (F.col("mode") == "pce")
    asked = asked.withColumn("mode", F.when(sprites, "pce_sprite").otherwise(F.col("mode")))
    rows = asked.join(F.broadcast(modes(requests.sparkSession)).withColumnRenamed("name", "mode"), "mode", "left")
    sprites = F.coalesce("own_sprite_mode", F.lit(False)) | (F.col("mode") == "pce_sprite")
    bpp, width, height = (F.coalesce(f"own_{c}", of) for c, of in (("bpp", "bpp"), ("tile_width", "tile"), ("tile_height", "tile")))
    problem = F.when(F.col("bits").isNull(), F.concat(F.lit("no such mode: "), F.coalesce("mode", F.lit("null"))))
    for what, value, allowed in (("bpp", bpp, "bpps"), ("tile width", width, "widths"), ("tile height", height, "heights")):
        problem = problem.when(~F.array_contains(allowed, value), F.concat(F.lit(f"{what} "), value.cast("string"), F.lit(" isn't allowed in mode "), F.col("mode")))
    given = F.when(sprites, F.lit(TRANSPARENT).cast("long")).otherwise(F.col("own_col0"))
    return rows.select(
        "image_id", "source_id", "mode", bpp.alias("bpp"), width.alias("tile_width"), height.alias("tile_height"), "bits", "gated",
        F.coalesce("own_max_palettes", "palettes").alias("most_palettes"), F.coalesce("own_max_tiles", "max_tiles").alias("most_tiles"), F.col("max_tiles").alias("reach"),
        (F.col("flip") & ~F.coalesce("own_no_flip", F.lit(False)) & ~sprites).alias("flip"),
        (~F.coalesce("own_no_discard", F.lit(False)) & ~sprites).alias("discard"), (F.col("mode") != "pce_sprite").alias("mapped"),
        (F.col("col0_shared") | given.isNotNull()).alias("primed"), given.alias("given"), problem.alias("problem"),
    )


def reduced(c: Column, bits: Column, gated: Column) -> Column:
    """``color.reduce`` for a mode given by columns."""
    shift = lambda f, v, n: F.call_function(f, v, n.cast("int"))
    cut, y = 8 - F.abs(bits), color.luma(c)
    part = lambda k: shift("shiftleft", shift("shiftrightunsigned", color.channel(c, k), cut), F.lit(8 * k))
    grey4 = F.when(y <= 0x40, 0).when(y <= 0x80, 1).when(y <= 0xC0, 2).otherwise(3)
    level = F.when(bits == -2, grey4).otherwise(F.shiftright(y, 5)).cast("long")
    own = F.when(bits < 0, level * F.lit(0x010101)).otherwise(part(0) + part(1) + part(2)) + F.lit(color.OPAQUE)
    return F.when(color.channel(c, 3) < 0x80, F.when(gated, F.lit(TRANSPARENT).cast("long")).otherwise(F.lit(color.OPAQUE))).otherwise(own)


def checked(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """``settings`` with width and height of their pictures (``cut_cells``); missing pictures, and sprite sheets whose sides aren't multiples of a sprite's, are problems."""
    sides = cells.groupBy("source_id").agg(F.max("right").alias("width"), F.max("bottom").alias("height"))
    uneven = ~F.col("mapped") & ((F.col("width") % F.col("tile_width") != 0) | (F.col("height") % F.col("tile_height") != 0))
    problem = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("width").isNull(), "no such picture")
    problem = problem.when(uneven, F.concat(F.lit("sides are not multiples of "), F.col("tile_width").cast("string")))
    return asked.join(sides, "source_id", "left").withColumn("problem", problem)


def cut_cells(pixels: DataFrame) -> DataFrame:
    """(source_id, kinds, look, cell, places, right, bottom): the distinct cells of pictures (source_id, x, y, rgba), with the rows and columns of their places.

    ``kinds`` are a cell's different colours, the first pixel's in front. ``cell``, the first place, tells cells of a picture apart; ``right`` and ``bottom`` are where
    their last pixels end. Pixels that a cell lacks are transparent, null ones too. A cell's pixels are columns of one aggregate, so none are gathered in lists and sorted.
    """
    x, y, size = F.col("x").cast("int"), F.col("y").cast("int"), CELL * CELL
    rows = pixels.select("source_id", F.expr(f"x div {CELL}").cast("int").alias("cx"), F.expr(f"y div {CELL}").cast("int").alias("cy"), (y % CELL * CELL + x % CELL).alias("p"), "rgba", x.alias("x"), y.alias("y"))
    own = [F.min(F.when(F.col("p") == k, F.col("rgba"))).alias(f"c{k}") for k in range(size)]
    found = rows.groupBy("source_id", "cx", "cy").agg(*own, (F.max("x") + 1).alias("right"), (F.max("y") + 1).alias("bottom"))
    rgba = F.array(*[F.coalesce(f"c{k}", F.lit(0).cast("long")) for k in range(size)])
    found = found.select("source_id", "cx", "cy", "right", "bottom", rgba.alias("rgba")).withColumn("kinds", F.array_distinct("rgba"))
    look = _text(F.transform("rgba", lambda c: F.array_position("kinds", c).cast("int") - 1))
    found = found.select("source_id", "cx", "cy", "right", "bottom", "kinds", look.alias("look")).groupBy("source_id", "kinds", "look")
    found = found.agg(F.sort_array(F.collect_list(F.struct("cy", "cx"))).alias("places"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    return found.withColumn("cell", F.get("places", F.lit(0)))


def sliced(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """(source_id, tile_width, tile_height, seq, uses, places, kinds, look): the distinct tiles of pictures (``cut_cells``) in each size that ``asked`` (``checked``) has for them.

    ``places`` are the numbers, columns and rows of a tile's places, row by row; ``seq`` is the first number. Larger tiles are told apart by the cells that
    they are made of, transparent ones left out, and put together once for each kind.
    """
    keys = ["source_id", "tile_width", "tile_height"]
    sizes = asked.where("problem is null").select(*keys, F.ceil(F.col("width") / F.col("tile_width")).cast("int").alias("across")).distinct()
    whole = (F.col("tile_width") == CELL) & (F.col("tile_height") == CELL)
    at = F.transform("places", lambda p: F.struct((p["cy"] * F.col("across") + p["cx"]).alias("seq"), p["cx"].alias("x"), p["cy"].alias("y")))
    small = cells.join(sizes.where(whole), "source_id").select(*keys, at.alias("places"), "kinds", "look")

    wide, tall = F.expr(f"tile_width div {CELL}").cast("int"), F.expr(f"tile_height div {CELL}").cast("int")
    none = F.array(F.lit(0).cast("long"))
    rows = cells.select("source_id", "cell", (F.col("kinds") == none).alias("blank"), F.explode("places").alias("place")).join(sizes.where(~whole), "source_id")
    cx, cy = F.col("place.cx"), F.col("place.cy")
    part = F.when(~F.col("blank"), F.struct((cy % tall * wide + cx % wide).alias("k"), "cell"))
    rows = rows.select(*keys, "across", F.floor(cx / wide).cast("int").alias("x"), F.floor(cy / tall).cast("int").alias("y"), part.alias("part"))
    made = rows.groupBy(*keys, "across", "x", "y").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    places = F.sort_array(F.collect_list(F.struct((F.col("y") * F.col("across") + F.col("x")).alias("seq"), "x", "y")))
    made = made.groupBy(*keys, "parts").agg(places.alias("places"))
    pieces = made.select(*keys, "places", F.get("places", F.lit(0))["seq"].alias("seq"), F.explode_outer("parts").alias("part")).select(*keys, "places", "seq", "part.k", "part.cell")
    pieces = pieces.join(cells.select("source_id", "cell", "kinds", "look"), ["source_id", "cell"], "left")
    pieces = pieces.groupBy(*keys, "seq").agg(F.collect_list(F.struct("k", "kinds", "look")).alias("parts"), F.first("places").alias("places"))
    blank = F.struct(F.lit(None).cast("int").alias("k"), none.alias("kinds"), F.lit(ALPHABET[0] * CELL * CELL).alias("look"))
    all_parts = F.transform(F.sequence(F.lit(0), wide * tall - 1), lambda k: F.coalesce(F.get(F.filter("parts", lambda p: p["k"] == k), F.lit(0)), blank))
    pieces = pieces.select(*keys, "places", all_parts.alias("parts"))
    pieces = pieces.withColumn("kinds", F.array_distinct(F.flatten("parts.kinds")))
    texts = F.transform("parts", lambda p: _exchanged(p["look"], p["kinds"], _text(F.transform(p["kinds"], lambda c: F.array_position("kinds", c).cast("int") - 1))))
    pieces = pieces.select(*keys, "places", "kinds", texts.alias("texts"))
    line = lambda y, k: F.substring(F.get("texts", F.floor(y / CELL).cast("int") * wide + k), y % CELL * CELL + 1, F.lit(CELL))
    lines = F.transform(F.sequence(F.lit(0), F.col("tile_height") - 1), lambda y: F.array_join(F.transform(F.sequence(F.lit(0), wide - 1), lambda k: line(y, k)), ""))
    # looked at twice, texts are a column of their own in the plan and not worked out again for each line
    look = F.when(F.size("texts") > 0, F.array_join(lines, ""))
    found = small.unionByName(pieces.select(*keys, "places", "kinds", look.alias("look")))
    return found.select(*keys, F.get("places", F.lit(0))["seq"].alias("seq"), F.size("places").cast("long").alias("uses"), "places", "kinds", "look")


def _letters() -> Column:
    return F.array(*[F.lit(c) for c in ALPHABET])


def _text(indices: Column) -> Column:
    return F.array_join(F.transform(indices, lambda i: F.element_at(_letters(), i + 1)), "")


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - FIRST)


def _exchanged(look: Column, kinds: Column, letters: Column) -> Column:
    """``look`` with a character of ``letters`` in place of that of each of ``kinds``."""
    return F.call_function("translate", look, F.substring(F.lit("".join(ALPHABET)), F.lit(1), F.size(kinds)), letters)


def turned(text: Column, width: Column, h: bool, v: bool) -> Column:
    """A tile's characters, mirrored; lines beyond the last are empty."""
    if h == v:
        return F.reverse(text) if h else text
    of = lambda w: F.concat(*[F.reverse(F.substring(text, y * w + 1, w)) for y in range(2 * CELL)])
    across = F.when(width == CELL, of(CELL)).otherwise(of(2 * CELL))
    return across if h else F.reverse(across)


def drawn(rows: DataFrame, palette: Column) -> DataFrame:
    """``rows`` with canon and turns: tiles (look, of, tile_width, flip) as indices into ``palette``; null where it is null."""
    names = [c for c in rows.columns if c not in ("canon", "turns")]
    letters = rows.withColumn("own_p", palette).select(*names, F.when(F.col("own_p").isNotNull(), _text(palettes.remap(F.col("of"), F.col("own_p")))).alias("letters"))
    found = letters.select(*names, _exchanged(F.col("look"), F.col("of"), F.col("letters")).alias("t0"))
    found = found.withColumn("t1", F.when(F.col("flip"), turned(F.col("t0"), F.col("tile_width"), True, False)))
    found = found.withColumns({"t2": F.reverse("t1"), "t3": F.when(F.col("flip"), F.reverse("t0"))})
    found = found.select(*names, *[f"t{k}" for k in range(4)], F.least(*[f"t{k}" for k in range(4)]).alias("canon"))
    bits = [F.when(F.col(f"t{k}") == F.col("canon"), 1 << k).otherwise(0) for k in range(4)]
    return found.select(*names, "canon", (bits[0] + bits[1] + bits[2] + bits[3]).alias("turns"))


def flips(probe: Column, turns: Column) -> tuple[Column, Column]:
    """``maps.flips`` by the turns of a tile and of the one in the tileset that has the same canon."""
    swap = lambda m, a, b: F.shiftleft(m.bitwiseAND(F.lit(a)), b).bitwiseOR(F.shiftright(m, b).bitwiseAND(F.lit(a)))
    same, h, v = (probe.bitwiseAND(m) != 0 for m in (turns, swap(turns, 5, 1), swap(turns, 3, 2)))
    return ~same & (h | ~v), ~same & ~h


def _kept(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in the session's shared folder, so that what follows is planned from them alone. Only a local session may do without such a folder and gets a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def convert_many(pixels: DataFrame, requests: DataFrame) -> Conversion:
    """Convert pictures (source_id, x, y, rgba) as ``requests`` say, each to its own mode; relations carry the requests' image_id.

    Entries are (image_id, seq, x, y, tile, palette, flip_h, flip_v, matched). A request that
    can't be met has null palettes and its problem in ``palettes`` and ``diagnostics`` and holds up no other.
    Tiles, palettes and tilesets are worked out at once and checkpointed, entries and diagnostics come from them.
    """
    cells = _kept(cut_cells(pixels))
    asked = _kept(checked(settings(requests), cells))
    cut = _kept(sliced(cells, asked))
    good = asked.where("problem is null").drop("width", "height", "problem")
    own = cut.drop("places").join(good, ["source_id", "tile_width", "tile_height"])
    corner = F.coalesce("given", F.get("kinds", F.lit(0)))
    own = own.select(
        "image_id", "source_id", "seq", "uses", "look", F.transform("kinds", lambda c: reduced(c, F.col("bits"), F.col("gated"))).alias("of"), "tile_width", "tile_height", "flip", "discard", "mapped",
        F.when(F.col("primed") & (F.col("seq") == 0), reduced(corner, F.col("bits"), F.col("gated"))).alias("first"), "reach",
    )
    own = _kept(own.withColumn("colors", F.sort_array(F.array_distinct("of"))))
    found = _kept(_palettes(own, good).unionByName(asked.where("problem is not null").selectExpr("image_id", "cast(null as array<array<long>>) as palettes", "problem")))
    usable = found.where("palettes is not null").select("image_id", "palettes")
    rows = _kept(_matched(own, usable))
    tileset = _kept(_tileset(rows, cut))
    entries = _entries(rows.where("mapped"), usable, tileset)
    places = cut.select("source_id", "tile_width", "tile_height", "seq", "places")
    entries = entries.join(places, ["source_id", "tile_width", "tile_height", "seq"])
    entries = entries.withColumn("place", F.explode("places")).select("image_id", "place.*", "tile", "palette", "flip_h", "flip_v", "matched")
    nowhere = F.lit(None).cast("int").alias("seq")
    problems = found.where("palettes is null").select("image_id", nowhere, "problem")
    large = tileset.groupBy("image_id").agg(F.count("*").alias("n")).join(asked.where("most_tiles > 0").select("image_id", "most_tiles"), "image_id").where("n > most_tiles")
    told = F.col("canon")
    for k, turn in enumerate(TURNS):
        told = F.when(F.col("turns").bitwiseAND(F.lit(1 << k)) != 0, turned(F.col("canon"), F.col("tile_width"), *turn)).otherwise(told)
    whole = tileset.select("image_id", "tile", _numbers(told).alias("data"), _numbers(F.col("canon")).alias("canon"), "uses", "palette")
    rgba = F.transform(_numbers(F.col("look")), lambda i: F.get("kinds", i))
    return Conversion(cut.withColumn("rgba", rgba).drop("look"), found, whole, entries, problems.unionByName(large.select("image_id", nowhere, F.lit("too many tiles").alias("problem"))))


def _palettes(own: DataFrame, asked: DataFrame) -> DataFrame:
    """(image_id, palettes, problem) of tiles with their colours, by the limits that each request has."""
    firsts = own.where("first is not null").select("image_id", "first")
    limits = asked.select("image_id", "most_palettes", F.call_function("shiftleft", F.lit(1), F.col("bpp")).alias("most")).join(firsts, "image_id", "left")
    sets = own.select("image_id", "seq", "colors").join(limits.select("image_id", "first", "most"), "image_id")
    primed = F.when(F.col("first").isNull(), F.col("colors")).otherwise(F.sort_array(F.array_union("colors", F.array("first"))))
    sets = palettes.within(sets.select("image_id", "seq", "most", primed.alias("colors")), F.col("most")).drop("most")
    sets = palettes.maximal_sets(palettes.distinct_sets(sets)).join(limits, "image_id")
    return palettes.fitted(sets, F.col("most"), F.col("most_palettes"), F.col("first"), ("most", "first", "most_palettes"))


def _matched(own: DataFrame, usable: DataFrame) -> DataFrame:
    """Distinct tiles with palette, canon and turns: how they are in the first subpalette that holds their colours but the transparent one; null if none does.

    ``settled`` tells whether that subpalette holds the transparent one too, if the tile has it. Then it is the first of those that a map
    may take, and the tile is in the tileset as it is there.
    """
    rows = own.drop("first").join(usable, "image_id", "left")
    solid = F.array_remove("colors", F.lit(TRANSPARENT))
    rows = rows.withColumn("place", F.array_position(F.transform("palettes", lambda p: F.size(F.array_except(solid, p)) == 0), F.lit(True)))
    rows = rows.withColumn("palette", F.when(F.col("place") > 0, F.col("place") - 1).cast("int")).drop("place")
    rows = rows.withColumn("p", F.get("palettes", F.col("palette"))).drop("palettes")
    clear = F.lit(TRANSPARENT).cast("long")
    rows = rows.withColumn("settled", F.col("p").isNotNull() & F.coalesce(~F.array_contains("colors", clear) | F.array_contains("p", clear), F.lit(False)))
    found = drawn(rows, F.col("p")).drop("p")
    # only what isn't settled is looked at again
    return found.withColumns({c: F.when(~F.col("settled"), F.col(c)) for c in ("of", "colors", "look")})


def _tileset(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """(image_id, tile, canon, turns, uses, palette, tile_width) of ``_matched`` tiles: each kind once, as first seen, or all places where repeats are kept."""
    own = rows.where("canon is not null")
    order = F.shiftleft(F.col("seq").cast("long"), 32) + F.col("palette") * 16 + F.col("turns")
    kinds = own.where("discard").groupBy("image_id", "tile_width", "canon").agg(F.min(order).alias("at"), F.sum("uses").alias("uses"))
    number = F.row_number().over(W.partitionBy("image_id").orderBy("at")) - 1
    rest = F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    kinds = kinds.select("image_id", "tile_width", number.alias("tile"), "canon", rest.bitwiseAND(F.lit(15)).cast("int").alias("turns"), "uses", F.shiftright(rest, 4).cast("int").alias("palette"))
    spread = own.where("not discard").join(cut.select("source_id", "tile_width", "tile_height", "seq", "places"), ["source_id", "tile_width", "tile_height", "seq"])
    spread = spread.select("image_id", "palette", F.struct("canon", "turns", "tile_width").alias("data"), F.explode("places").alias("place")).select("image_id", F.col("place.seq").alias("seq"), "palette", "data")
    return kinds.unionByName(tiles.numbered(spread, flip=False).select("image_id", "tile", "data.*", "uses", "palette"))


def _entries(rows: DataFrame, usable: DataFrame, tileset: DataFrame) -> DataFrame:
    """(image_id, source_id, tile_width, tile_height, seq, tile, palette, flip_h, flip_v, matched) of ``_matched`` tiles.

    Settled ones are found in the tileset by what they are; the others are looked for as each subpalette that holds all their colours has them.
    """
    known = tileset.groupBy("image_id", "canon").agg(F.min(F.shiftleft(F.col("tile").cast("long"), 4) + F.col("turns")).alias("hit"))
    keys = ["image_id", "seq", "source_id", "tile_width", "tile_height", "reach"]
    settled = rows.where("settled").join(known, ["image_id", "canon"]).select(*keys, "palette", F.col("turns").alias("probe"), "hit")
    others = rows.where("not settled")
    probes = palettes.all_matches(others.select("image_id", "seq", "colors"), usable).join(others.drop("palette", "canon", "turns"), ["image_id", "seq"]).join(usable, "image_id")
    probes = _kept(drawn(probes, F.get("palettes", F.col("palette"))).select("image_id", "seq", "palette", "canon", F.col("turns").alias("probe")))
    best = probes.join(known, ["image_id", "canon"]).groupBy("image_id", "seq").agg(F.min(F.struct("palette", "hit", "probe")).alias("b")).select("image_id", "seq", "b.palette", "b.probe", "b.hit")
    found = settled.unionByName(others.select(*keys).join(best, ["image_id", "seq"], "left"))
    tile, (h, v) = F.shiftright("hit", 4).cast("int"), flips(F.col("probe"), F.col("hit").bitwiseAND(F.lit(15)).cast("int"))
    ok = F.col("hit").isNotNull() & ((F.col("reach") == 0) | (tile < F.col("reach")))
    pick = lambda value, other: F.when(ok, value).otherwise(F.lit(other))
    return found.select(*keys[:-1], pick(tile, 0).alias("tile"), pick(F.col("palette"), 0).alias("palette"), pick(h, False).alias("flip_h"), pick(v, False).alias("flip_v"), F.col("hit").isNotNull().alias("matched"))
