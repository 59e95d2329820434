"""Pixels are gathered as narrow numbers, from partitions of a given number, and hex is read in one pass."""

import re

import numpy as np
from pyspark.sql import functions as F

from tileframe.operators import maps, tiles
from tileframe.plans import many
from tileframe.sources import png
from tileframe.sources.events import event_pixels

SF = "/root/testdata/sf0.001"
ENDS = [0, 1, 0xFFFFFFFF, 0x80000000, None]


def gathered(frame) -> list[str]:
    return re.findall(r"collect_list\((\w+)\(", frame._jdf.queryExecution().optimizedPlan().toString())


def test_pixels_of_tiles_are_numbers(spark):
    rows = [(0, x, y, ENDS[(x + y) % 5]) for x in range(8) for y in range(8)] + [(1, 3, 2, 0xFFFFFFFF), (1, 0, 0, None)]
    cut = tiles.slice_tiles(spark.createDataFrame(rows, "image_id long, x int, y int, rgba long"), fill=7)
    assert "struct" not in gathered(cut) and "named_struct" not in gathered(cut)
    got = {r.image_id: r.rgba for r in cut.collect()}
    assert got[0] == [ENDS[(p % 8 + p // 8) % 5] for p in range(64)]
    assert got[1] == [0xFFFFFFFF if p == 2 * 8 + 3 else 7 for p in range(64)]


def test_event_pixels_keep_their_partitions(spark):
    """A read of so few bytes would be put together to one partition otherwise, and likewise millions of pixels."""
    assert event_pixels(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pixels_of_files_are_numbers_by_row(spark):
    rng = np.random.default_rng(1)
    want = rng.integers(0, 1 << 32, 5 * 7)
    rows = [(0, x, y, int(want[y * 5 + x])) for x in range(5) for y in range(7) if (x, y) != (2, 3)] + [(1, 70_000, 1, 0xFF0000FF)]
    files = png.as_files(spark.createDataFrame(rows, "image_id long, x int, y int, rgba long"))
    assert "shiftleft" in files._jdf.queryExecution().optimizedPlan().toString()
    got = {r.image_id: png.decode(r.content) for r in files.collect()}
    want[3 * 5 + 2] = 0
    assert got[0]["rgba"].tolist() == want.tolist() and (got[1]["width"], got[1]["height"]) == (70_001, 2)
    assert got[1]["rgba"][-1] == 0xFF0000FF and not got[1]["rgba"][:-1].any()


def test_bytes_are_found_in_one_pass(spark):
    rows = [("a1b2c3", "0102030405"), ("", "01"), ("ff", ""), ("", ""), (None, "01")]
    df = spark.createDataFrame(rows, "a string, b string").select(maps.interleaved(F.col("a"), F.col("b")).alias("i"), maps.banked(F.col("a")).alias("k"))
    assert [r.i for r in df.collect()] == ["a101b202c30300040005", "0001", "ff00", "", None]
    assert [r.k for r in df.collect()] == ["a1c3b2", "", "ff", "", None]
    assert "substr" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_pictures_of_many_modes_tell_their_colors_once(spark):
    """Modes reduce the different colours of a kind of tile, not each of its pixels; tiles are gathered by plain keys."""
    rows = [(5, x, y, ENDS[(x // 3) % 4]) for x in range(16) for y in range(9)]
    asked = spark.createDataFrame([(5, 8, 8, 16, 9, None), (5, 16, 16, 16, 9, None)], "source_id long, tile_width int, tile_height int, width int, height int, problem string")
    cut = many.sliced(spark.createDataFrame(rows, "source_id long, x int, y int, rgba long"), asked)
    got = cut.collect()
    assert sorted((r.tile_width, r.seq, r.uses) for r in got) == [(8, 0, 1), (8, 1, 1), (8, 2, 1), (8, 3, 1), (16, 0, 1)]
    for r in got:
        assert len(set(r.kinds)) == len(r.kinds) and [r.kinds[i] for i in r.at] == r.rgba
