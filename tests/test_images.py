"""PNG files, whole conversions and the folder stream."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileframe.functions.color import normalize, reduce
from tileframe.operators import tiles
from tileframe.plans.convert import Options, build_map, build_tileset, convert, diagnose, native, sliced
from tileframe.plans.modes import mode
from tileframe.sources import png
from tileframe.sources.sinks import write_files
from tileframe.streaming.folder import convert_folder


def raw_png(width, height, depth, color, lines, extra=b"", interlace=0):
    import struct

    head = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace)
    return png.SIGNATURE + png._chunk(b"IHDR", head) + extra + png._chunk(b"IDAT", zlib.compress(lines)) + png._chunk(b"IEND", b"")


def test_round_trips():
    rng = np.random.default_rng(1)
    rgba = rng.integers(0, 1 << 32, 35)
    assert (png.decode(png.encode(7, 5, rgba))["rgba"] == rgba).all()
    palette = rng.integers(0, 1 << 32, 9)
    idx = rng.integers(0, 9, 35)
    got = png.decode(png.encode(7, 5, idx=idx, palette=palette))
    assert (got["idx"] == idx).all() and (got["palette"] == palette).all() and (got["rgba"] == palette[idx]).all()


def test_depths_and_kinds():
    black, white = 0xFF000000, 0xFFFFFFFF
    assert png.decode(raw_png(3, 1, 1, 0, b"\0\xa0"))["rgba"].tolist() == [white, black, white]
    assert png.decode(raw_png(2, 1, 16, 0, b"\0\xff\xff\x00\x00"))["rgba"].tolist() == [white, black]
    assert png.decode(raw_png(1, 1, 8, 4, b"\0\x10\x20"))["rgba"].tolist() == [0x20101010]
    assert png.decode(raw_png(2, 1, 8, 2, b"\0\x01\x02\x03\x04\x05\x06", png._chunk(b"tRNS", b"\0\x04\0\x05\0\x06")))["rgba"].tolist() == [0xFF030201, 0x060504]
    plte = png._chunk(b"PLTE", b"\xff\0\0\0\xff\0\0\0\xff")
    got = png.decode(raw_png(3, 2, 2, 3, b"\0\x18\0\x90", plte))
    assert got["idx"].tolist() == [0, 1, 2, 2, 1, 0]


@pytest.mark.parametrize("kind", range(5))
def test_filters(kind):
    rng = np.random.default_rng(kind)
    rgba = rng.integers(0, 1 << 32, 24)
    lines = png._octets(rgba).reshape(4, 24).astype(int)
    out = b""
    for y in range(4):
        row = []
        for i in range(24):
            a = lines[y][i - 4] if i >= 4 else 0
            b = lines[y - 1][i] if y else 0
            c = lines[y - 1][i - 4] if y and i >= 4 else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((lines[y][i] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out += bytes([kind, *row])
    assert (png.decode(raw_png(6, 4, 8, 6, out))["rgba"] == rgba).all()


def test_interlaced():
    rgba = np.arange(9 * 5) * 0x01020304 % (1 << 32)
    grid, lines = png._octets(rgba).reshape(5, 9, 4), b""
    for x0, y0, dx, dy in png.PASSES:
        part = grid[y0::dy, x0::dx]
        if part.size:
            lines += b"".join(b"\0" + row.tobytes() for row in part)
    assert (png.decode(raw_png(9, 5, 8, 6, lines, interlace=1))["rgba"] == rgba).all()


def test_bad_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"nothing")
    (tmp_path / "b.png").write_bytes(png.encode(1, 1, np.array([5])))
    got = {r.path[-5:]: r.image for r in png.read_images(spark, str(tmp_path)).collect()}
    assert got["a.png"].error == "not a PNG file" and got["a.png"].rgba is None and got["b.png"].rgba == [5]
    assert png.pixels(png.read_images(spark, str(tmp_path))).count() == 1


def image(seed):
    """Tiles of 8 by 8 out of a few shapes, mirrored at random, each in one of two groups of colours."""
    rng = np.random.default_rng(seed)
    shapes = rng.integers(0, 4, (5, 8, 8))
    groups = np.array([[0xFF808080, 0xFF0000F8, 0xFF00F800, 0xFFF80000], [0xFF808080, 0xFF202020, 0xFF404040, 0xFF606060]])
    out = np.zeros((24, 40), np.int64)
    for y in range(3):
        for x in range(5):
            tile = shapes[rng.integers(5)][:: rng.choice([1, -1]), :: rng.choice([1, -1])]
            out[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = groups[rng.integers(2)][tile]
    return out


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pixels(spark, images):
    rows = [(i, x, y, int(v)) for i, im in images.items() for y, line in enumerate(im) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, rgba long")


@pytest.mark.parametrize("name", ["snes", "gbc", "gba", "md", "wsc", "wsc_packed"])
def test_conversions_can_be_drawn_again(spark, name):
    """What map, tileset and palette draw is the image at the mode's depth."""
    images, m = {1: image(1), 2: image(2)}, mode(name)
    options = Options(mode=name)
    source = pixels(spark, images)
    done = convert(source, options)
    want = {(r.image_id, r.x, r.y): r.c for r in source.select("image_id", "x", "y", normalize(reduce(F.col("rgba"), m), m).alias("c")).collect()}
    if m.col0_shared:
        corner = {i: value(spark, reduce(F.lit(int(im[0, 0])).cast("long"), m)) for i, im in images.items()}
        assert all(p[0] == corner[r.image_id] for r in done.palettes.collect() for p in r.palettes)
    palettes = {r.image_id: r.palettes for r in done.palettes.select("image_id", F.transform("palettes", lambda p: F.transform(p, lambda c: normalize(c, m))).alias("palettes")).collect()}
    tileset = {(r.image_id, r.tile): np.array(r.data).reshape(8, 8) for r in done.tileset.collect()}
    entries = done.entries.collect()
    assert len(entries) == 30 and all(e.matched for e in entries) and done.diagnostics.count() == 0
    assert len(tileset) < 30
    for e in entries:
        data = tileset[e.image_id, e.tile][:: -1 if e.flip_v else 1, :: -1 if e.flip_h else 1]
        for (py, px), i in np.ndenumerate(data):
            assert palettes[e.image_id][e.palette][i] == want[e.image_id, e.x * 8 + px, e.y * 8 + py]


def test_partitions_do_not_matter(spark):
    source = pixels(spark, {1: image(3)})
    options = Options(split_width=5, split_height=3, column_order=True)
    got = [native(convert(source.repartition(n), options), options, 5, 3).collect() for n in (1, 7)]
    assert got[0] == got[1] and len(got[0][0].map_hex) == 60


def test_large_tiles_and_limits(spark):
    source = pixels(spark, {1: image(4)})
    done = convert(source, Options(tile_width=16, tile_height=16))
    assert done.entries.count() == 6 and done.tileset.first().data is not None
    few = convert(source, Options(max_palettes=0))
    assert [(r.palettes, r.problem) for r in few.palettes.collect()] == [(None, "colors do not fit in the available palettes")]
    assert [(r.image_id, r.seq, r.problem) for r in few.diagnostics.collect()] == [(1, None, "colors do not fit in the available palettes")]
    assert few.tileset.count() == 0 and few.entries.where("matched").count() == 0
    with pytest.raises(ValueError, match="tile width"):
        convert(source, Options(mode="md", tile_width=16))


def test_sprites_keep_repeated_tiles(spark):
    sheet = np.full((16, 48), 0xFF0000F8)
    sheet[3, 5] = 0
    done = convert(pixels(spark, {1: sheet, 2: sheet[:, :20]}), Options(mode="pce", sprite_mode=True))
    assert [r.tile for r in done.tileset.orderBy("tile").collect()] == [0, 1, 2]
    assert all(p[0] == 0 for r in done.palettes.collect() for p in r.palettes)
    assert [(r.image_id, r.problem) for r in done.diagnostics.collect()] == [(2, "sides are not multiples of 16")]
    assert native(done, Options(mode="pce_sprite"), 3, 1).first().map_hex is None


def test_repeated_tiles_can_be_kept(spark):
    done = convert(pixels(spark, {1: image(1)}), Options(no_discard=True))
    assert done.tileset.count() == 15 and all(e.matched for e in done.entries.collect())


def test_indexed_images_as_they_are(spark, tmp_path):
    palette = np.array([0xFF000000 + k * 0x081018 for k in range(8)])
    idx = np.arange(128).reshape(8, 16) % 8
    (tmp_path / "a.png").write_bytes(png.encode(16, 8, idx=idx, palette=palette))
    images = png.read_images(spark, str(tmp_path))
    done = convert(png.pixels(images), Options(no_remap=True), png.whole(images))
    assert [r.data for r in done.tileset.collect()] == [idx[:, :8].reshape(-1).tolist()]
    assert [len(p) for r in done.palettes.collect() for p in r.palettes] == [8]
    assert [(e.tile, e.matched) for e in done.entries.collect()] == [(0, True)] * 2


def test_whole_images_are_sliced_alike(spark):
    own = {1: image(1), 2: image(2)[:21, :37]}
    rows = [(i, im.shape[1], im.shape[0], im.reshape(-1).tolist()) for i, im in own.items()]
    cut = tiles.slice_images(spark.createDataFrame(rows, "image_id long, width int, height int, rgba array<long>"))
    gathered = tiles.slice_tiles(pixels(spark, own))
    told = lambda df: sorted((r.image_id, r.tx, r.ty, tuple(r.rgba)) for r in df.collect())
    assert told(cut) == told(gathered) and cut.count() == 30


def test_given_palettes_and_tilesets(spark):
    """One image's palettes and tileset serve another; tiles that they lack are told, and a larger map is filled up."""
    first, second = pixels(spark, {1: image(1)}), image(1).copy()
    second[0, 0], second[8, 0:3] = 0xFF123456, [0xFF0000F8, 0xFF202020, 0xFF808080]
    options, rows = Options(), sliced(pixels(spark, {1: second}), Options())
    done = convert(first, options)
    entries = {(e.x, e.y): e for e in build_map(rows, done.palettes, done.tileset, options, 6, 4).collect()}
    assert len(entries) == 24 and not entries[0, 0].matched and not entries[5, 3].matched
    assert entries[1, 0].matched and entries[4, 2].matched
    problems = diagnose(rows, done.palettes, build_tileset(rows, done.palettes, options), options).collect()
    assert sorted((p.seq, p.problem) for p in problems)[0] == (0, "no matching palette")
    with pytest.raises(ValueError, match="have no maps"):
        build_map(rows, done.palettes, done.tileset, Options(mode="pce_sprite"))
    small = diagnose(rows, done.palettes, done.tileset, Options(max_tiles=1)).where("problem = 'too many tiles'")
    assert small.count() == 1


def test_files_are_written(spark, tmp_path):
    own = pixels(spark, {1: image(1), 2: image(2)})
    write_files(png.as_files(own), f"file://{tmp_path}/out", F.concat(F.col("image_id").cast("string"), F.lit(".png")), F.col("content"))
    got = {p.name: p for p in (tmp_path / "out").iterdir()}
    assert sorted(got) == ["1.png", "2.png"]
    assert (png.decode(got["2.png"].read_bytes())["rgba"].reshape(24, 40) == image(2)).all()


def test_folder_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(png.encode(40, 24, image(5).reshape(-1)))
    options = Options()
    run = lambda: convert_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), options, 5, 3).awaitTermination(120)
    run()
    (tmp_path / "in/b.png").write_bytes(png.encode(40, 24, image(6).reshape(-1)))
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.image_id[-5:], r.batch) for r in rows) == [("a.png", 0), ("b.png", 1)] and all(len(r.map_hex) == 60 for r in rows)
