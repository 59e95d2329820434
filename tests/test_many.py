"""Conversions to many modes at once, and tilesets that serve many images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_images import image, pixels
from tileframe.operators import maps, tiles
from tileframe.plans.convert import Options, build_map, convert, sliced, sliced_images
from tileframe.plans.many import convert_many, modes, settings
from tileframe.plans.modes import MODES


@pytest.fixture(scope="module")
def pictures(spark):
    return pixels(spark, {1: image(1), 2: image(2)}).withColumnRenamed("image_id", "source_id")


def told(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_modes_are_a_relation(spark):
    found = {r.name: r for r in modes(spark).collect()}
    assert set(found) == set(MODES)
    assert all(found[n].bpp == m.bpp and tuple(found[n].heights) == m.heights and found[n].flip == m.flip for n, m in MODES.items())


def test_settings_of_requests(spark):
    rows = [(1, 1, "snes", None, None, None), (2, 1, "snes", 3, None, None), (3, 1, "md", None, 16, None), (4, 1, "nes", None, None, None), (5, 1, None, None, None, None), (6, 1, "pce", None, None, True), (7, 1, "gb", 1, None, None)]
    asked = spark.createDataFrame(rows, "image_id long, source_id long, mode string, bpp int, tile_width int, sprite_mode boolean")
    got = {r.image_id: r for r in settings(asked).collect()}
    assert {i: r.problem for i, r in got.items() if r.problem} == {
        2: "bpp 3 isn't allowed in mode snes", 3: "tile width 16 isn't allowed in mode md", 4: "no such mode: nes", 5: "no such mode: null",
    }
    assert (got[1].bpp, got[1].most_palettes, got[1].flip, got[1].discard) == (4, 8, True, True)
    assert (got[6].mode, got[6].tile_width, got[6].flip, got[6].discard, got[6].given) == ("pce_sprite", 16, False, False, 0)
    assert (got[7].bpp, got[7].most_tiles) == (1, 256)


@pytest.mark.parametrize("wishes, names", [({}, ["snes", "gb", "sms"]), ({"bpp": 2, "no_flip": True, "max_tiles": 3}, ["gbc", "wsc"]), ({"tile_width": 16, "tile_height": 16, "col0": 0xFF202020, "no_discard": True}, ["snes"])])
def test_each_request_gives_what_its_own_conversion_gives(spark, pictures, wishes, names):
    types = {"bpp": "int", "no_discard": "boolean", "no_flip": "boolean", "max_tiles": "int", "tile_width": "int", "tile_height": "int", "col0": "long"}
    requests = spark.createDataFrame([(10 * k + s, s, n, *wishes.values()) for k, n in enumerate(names) for s in (1, 2)], "image_id long, source_id long, mode string" + "".join(f", {k} {types[k]}" for k in wishes))
    done = convert_many(pictures, requests)
    entries = ["image_id", "seq", "x", "y", "tile", "palette", "flip_h", "flip_v", "matched"]
    own = {"palettes": (["image_id", "palettes", "problem"], []), "tileset": (["image_id", "tile", "data", "uses"], []), "entries": (entries, []), "diagnostics": (["image_id", "problem"], [])}
    for k, name in enumerate(names):
        one = convert(pictures.withColumnRenamed("source_id", "image_id"), Options(mode=name, **wishes))
        for part, (columns, rows) in own.items():
            of = getattr(one, part)
            if part == "diagnostics":  # tiles without a palette are what unmatched entries tell
                of = of.where("seq is null")
            rows += [str(r) for r in of.withColumn("image_id", F.col("image_id") + 10 * k).select(*columns).collect()]
        one.release()
    for part, (columns, rows) in own.items():
        assert told(getattr(done, part), *columns) == sorted(rows), part
    done.release()


def test_requests_that_can_not_be_met(spark, pictures):
    requests = spark.createDataFrame([(1, 1, "snes"), (2, 9, "snes"), (3, 1, "nes"), (4, 1, "pce_sprite"), (5, 2, "gg")], "image_id long, source_id long, mode string")
    done = convert_many(pictures, requests)
    assert {r.image_id: r.problem for r in done.diagnostics.collect()} == {
        2: "no such picture", 3: "no such mode: nes", 4: "sides are not multiples of 16", 5: "colors do not fit in the available palettes",
    }
    assert {r.image_id for r in done.entries.where("matched").collect()} == {1}
    assert convert_many(pictures, requests.limit(0)).entries.count() == 0 and convert_many(pictures.limit(0), requests).tileset.count() == 0


def test_sprites_among_other_requests(spark):
    sheet = pixels(spark, {1: image(1)}).where("x < 32 and y < 16").withColumnRenamed("image_id", "source_id")
    requests = spark.createDataFrame([(1, 1, "pce", True), (2, 1, "pce", False)], "image_id long, source_id long, mode string, sprite_mode boolean")
    done = convert_many(sheet, requests)
    one = convert(sheet.withColumnRenamed("source_id", "image_id"), Options(mode="pce", sprite_mode=True))
    assert told(done.tileset.where("image_id = 1"), "tile", "data") == told(one.tileset, "tile", "data")
    assert {r.image_id for r in done.entries.collect()} == {2}


@pytest.mark.parametrize("few", [0, 50_000])
def test_one_tileset_for_all_images(spark, few):
    options = Options()
    done = convert(pixels(spark, {1: image(1)}), options)
    rows = sliced(pixels(spark, {1: image(1), 2: image(2), 3: image(1)}), options)
    one, two = done.palettes.select("palettes"), done.tileset.drop("image_id")
    each = rows.select("image_id").distinct()
    copied = build_map(rows, each.crossJoin(one), each.crossJoin(two), options)
    columns = ["image_id", "seq", "tile", "palette", "flip_h", "flip_v", "matched"]
    want = told(copied, *columns)
    assert told(maps.build_shared(rows, one, two, options.resolved()[0], few=few), *columns) == want
    assert told(build_map(rows, one, two, options), *columns, "x", "y") == told(copied, *columns, "x", "y")
    assert {r.image_id for r in copied.where("matched").collect()} == {1, 2, 3} or any("matched=False" in w for w in want)
    with pytest.raises(ValueError, match="one list"):
        maps.build_shared(rows, one.union(one), two, options.resolved()[0])
    assert maps.build_shared(rows, one, two.limit(0), options.resolved()[0], few=few).where("matched").count() == 0


def test_whole_images_are_numbered_where_they_are(spark):
    own = image(2)[:21, :37]
    images = spark.createDataFrame([(7, 37, 21, own.reshape(-1).tolist())], "image_id long, width int, height int, rgba array<long>")
    cut = sliced_images(images, Options())
    assert told(cut, "seq", "tx", "ty", "rgba") == told(sliced(pixels(spark, {7: own}), Options()), "seq", "tx", "ty", "rgba")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_positions_of_shapes(spark):
    rows = sliced(pixels(spark, {1: image(1), 2: image(2)}), Options())
    assert told(tiles.positions(tiles.shapes(rows, positions=True)), "image_id", "seq", "tx", "ty") == told(rows, "image_id", "seq", "tx", "ty")


def test_a_conversion_cuts_its_pictures_once(spark):
    source = pixels(spark, {1: image(1)})
    done = convert(source, Options())
    for part in (done.palettes, done.tileset, done.entries, done.diagnostics):
        part.count()
        assert "InMemoryTableScan" in part._jdf.queryExecution().optimizedPlan().toString() or "InMemoryRelation" in part._jdf.queryExecution().optimizedPlan().toString()
    done.release()


def test_tiles_of_a_map_are_not_drawn_in_filters(spark, pictures):
    """Tiles are drawn once and kept: keys that a join wants not null would have them drawn again, for each line."""
    done = convert_many(pictures, spark.createDataFrame([(1, 1, "snes"), (2, 2, "gb")], "image_id long, source_id long, mode string"))
    plan = done.entries._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "array_position(" not in plan


@pytest.mark.parametrize("width, height", [(8, 8), (16, 8), (8, 16), (16, 16)])
def test_large_tiles_of_many_colors(spark, width, height):
    """Up to 256 colours a tile, cells that are missing or have no colour, transparent pixels, mirrors and tiles of one picture in another place."""
    rng = np.random.default_rng(width + 2 * height)
    own = rng.integers(0, 1 << 24, (40, 56)).astype(np.int64) + (255 << 24)
    own[:16, 16:32], own[:16, 32:48], own[16:32, :16] = own[:16, :16][:, ::-1], own[:16, :16][::-1], own[:16, :16][::-1, ::-1]
    own[16:24, 16:24], own[3, 3:6], own[32:, 8:] = 0, 0, own[0, 0]
    rows = pixels(spark, {1: own}).where("not (x between 24 and 31 and y between 16 and 31)")
    wishes = {"tile_width": width, "tile_height": height, "bpp": 8, "max_palettes": 40}
    requests = spark.createDataFrame([(1, 1, "snes", *wishes.values())], "image_id long, source_id long, mode string, tile_width int, tile_height int, bpp int, max_palettes int")
    done, one = convert_many(rows.withColumnRenamed("image_id", "source_id"), requests), convert(rows, Options(mode="snes", **wishes))
    assert told(done.tileset, "tile", "data", "canon", "uses", "palette") == told(one.tileset, "tile", "data", "canon", "uses", "palette")
    columns = ["seq", "x", "y", "tile", "palette", "flip_h", "flip_v", "matched"]
    # a tile of which no pixel is given has no row in either
    assert told(done.entries, *columns) == told(one.entries, *columns)
    assert {(r.seq, str(r.rgba)) for r in done.tiles.selectExpr("explode(places.seq) as seq", "rgba").collect()} == {(r.seq, str(r.rgba)) for r in one.tiles.collect()}
    one.release()
