"""Reports of conversions and their observed totals, and colour functions in SQL."""

import pytest
from pyspark.sql import functions as F

from tileframe.functions import codec, color, sql
from tileframe.plans.convert import Options, convert
from tileframe.plans.modes import MODES, TRANSPARENT
from tileframe.plans.report import described, observed, reports, sizes

RED, BLUE = 0xFF0000F8, 0xFFF80000


@pytest.fixture(scope="module")
def pixels(spark):
    """Image 0: 16 by 8, two equal tiles of one colour. Image 1: 8 by 8, two colours. Image 2: too many colours."""
    rows = [(0, x, y, RED) for x in range(16) for y in range(8)] + [(1, x, y, RED if x < 4 else BLUE) for x in range(8) for y in range(8)]
    rows += [(2, x, y, 0xFF000000 + (x * 8 + y) * 0x080408) for x in range(8) for y in range(8)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, rgba long")


def test_sizes_and_lines(pixels):
    options = Options(bpp=2)
    done = convert(pixels, options)
    got = {r.image_id: tuple(r)[1:] for r in sizes(done).collect()}
    assert got == {0: (None, [1], 1, 1, 2, 0), 1: (None, [2], 1, 0, 1, 0), 2: ("colors do not fit in a palette", None, 0, 0, 1, 1)}
    told = {r.image_id: r.report for r in reports(done, options).collect()}
    assert told[2] is None and told[0].split("\n")[2:] == ["Created palette with 1 colors", "Created optimized tileset with 1 entries (discarded 1 redundant tiles)", "Mapping 2 8x8px tiles from image"]
    assert reports(convert(pixels, Options(no_discard=True)), Options(no_discard=True)).where("image_id = 0 and report like '%Created tileset with 2 entries%'").count() == 1
    assert sizes(convert(pixels.limit(0), options)).count() == 0
    done.release()


def test_described(spark):
    rows = spark.createDataFrame([([16, 8],), ([5],), ([],), ([0],)], "s array<int>").select(described(F.col("s")).alias("d")).collect()
    assert [r.d for r in rows] == ["24 colors [16,8]", "5 colors", "zero colors", "zero colors"]


def test_totals_come_with_the_write(pixels, tmp_path):
    done, made, placed = observed(convert(pixels, Options(bpp=2)))
    done.tileset.write.parquet(str(tmp_path / "tileset"))
    done.entries.write.parquet(str(tmp_path / "entries"))
    assert made.get == {"tiles": 2, "discarded": 1} and placed.get == {"mapped": 4, "unmatched": 1}  # the place of the image that has no palettes
    done.release()


def test_sql_gives_what_columns_give(spark):
    sql.register(spark)
    sql.register(spark)
    rows = spark.createDataFrame([(c, i) for i, c in enumerate([0, 0xFFFFFFFF, 0x7F123456, 0x80ABCDEF, 0xFF00FF00, None])], "c long, i int").withColumn("e", F.struct((F.col("i") * 211).alias("t"), (F.col("i") * 3).alias("p")))
    for m in MODES.values():
        reduced = color.reduce(F.col("c"), m)
        own = rows.select(reduced, color.normalize(reduced, m), codec.pack_color(reduced, m).cast("long"), codec.pack_entry(m, F.col("e.t"), F.col("e.p"), F.lit(True), F.lit(False))).where("c is not null")
        told = rows.where("c is not null").selectExpr(f"tile_reduce(c, '{m.name}') AS r", f"tile_normalize(tile_reduce(c, '{m.name}'), '{m.name}')", f"tile_color_word(tile_reduce(c, '{m.name}'), '{m.name}')", f"tile_entry(e.t, e.p, true, false, '{m.name}')")
        assert list(map(tuple, own.collect())) == list(map(tuple, told.collect())), m.name
    plan = rows.selectExpr("tile_reduce(c, 'snes') AS r")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CASE WHEN (snes" not in plan
    assert rows.where("c is null").selectExpr("tile_reduce(c, 'snes') AS r", "tile_hex(c) AS h").first() == (None, None)
    assert rows.where("i = 0").selectExpr(f"tile_reduce(c, 'snes') = {TRANSPARENT} AS same").first().same
    with pytest.raises(Exception, match="no such mode"):
        rows.selectExpr("tile_reduce(c, 'nes')").collect()
