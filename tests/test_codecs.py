"""Native forms of hand-computed values."""

import pytest
from pyspark.sql import functions as F

from tileframe.functions import codec, color
from tileframe.operators import maps, outputs, palettes, tiles
from tileframe.plans.modes import MODES, checked, mode
from tileframe.sources import native


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rgb(r, g, b, a=255):
    return F.lit(r | g << 8 | b << 16 | a << 24).cast("long")


WORDS = {"snes": "410c", "gbc": "410c", "gba": "410c", "md": "4206", "pce": "8b00", "wsc": "2301", "gg": "2301", "ngpc": "2103", "sms": "39"}


@pytest.mark.parametrize("name", WORDS)
def test_color_words(spark, name):
    m = mode(name)
    assert value(spark, codec.pack_palette(F.array(rgb(1, 2, 3)), m)) == WORDS[name]


def test_grey_palettes(spark):
    grey = lambda *levels: F.array(*[rgb(v, v, v) for v in levels])
    assert value(spark, codec.pack_palette(grey(0, 1, 2, 3), mode("gb"))) == "1b"
    assert value(spark, codec.pack_palette(grey(0, 1, 2, 7), mode("ws"))) == "6705"
    assert value(spark, codec.pack_palette(grey(0, 1, 2, 7), mode("ngp"))) == "07060500"
    with pytest.raises(Exception, match="four colours"):
        value(spark, codec.pack_palette(grey(0, 1), mode("gb")))


def test_palettes_that_come_back(spark):
    for name in ("snes", "md", "wsc", "ngpc"):
        m = mode(name)
        colors = F.array(rgb(1, 2, 4), rgb(3, 0, 1))
        assert value(spark, codec.unpack_palette(codec.pack_palette(colors, m), m)) == value(spark, colors)
    swapped = {"pce": (1, 4, 0), "gg": (4, 2, 1)}
    for name, want in swapped.items():
        m = mode(name)
        assert value(spark, codec.unpack_palette(codec.pack_palette(F.array(rgb(1, 2, 4)), m), m)) == [value(spark, rgb(*want))]
    with pytest.raises(Exception, match="size"):
        value(spark, codec.unpack_palette(F.lit("aabbcc"), mode("snes")))


ENTRIES = {"snes": "2355", "gba": "2355", "md": "2329", "pce": "2351", "gbc": "232d", "ws": "234b", "ngp": "23a1", "ngpc": "238b", "sms": "230b", "gg": "230b", "gb": "23", "snes_mode7": "23", "gba_affine": "23", "pce_sprite": ""}


@pytest.mark.parametrize("name", ENTRIES)
def test_map_entries(spark, name):
    assert value(spark, codec.pack_entry(mode(name), F.lit(0x123), F.lit(5), F.lit(True), F.lit(False))) == ENTRIES[name]


TILES = {
    ("snes", 2): (0, "5533"), ("gb", 2): (0, "5533"), ("ws", 2): (0, "5533"), ("wsc", 4): (0, "55330f00"), ("sms", 4): (0, "55330f00"), ("gb", 1): (0, "55"),
    ("gba", 4): (0, "10325476"), ("md", 4): (0, "10325476"), ("wsc_packed", 4): (0, "01234567"), ("ngp", 2): (0, "1b1b"), ("ngpc", 2): (0, "1b1b"), ("snes_mode7", 8): (0, "0001020304050607"),
}


@pytest.mark.parametrize(("name", "bpp"), TILES)
def test_tile_layouts(spark, name, bpp):
    data = F.array(*[F.lit(i % (1 << bpp)) for i in range(8)] + [F.lit(0)] * 56)
    at, want = TILES[name, bpp]
    got = value(spark, codec.pack_tile(data, mode(name), bpp))
    assert got.startswith(want) and set(got[len(want) :]) <= {"0"} and len(got) == 16 * bpp


def test_sprites_and_planes(spark):
    data = F.array(*[F.lit(i if i < 16 else 0) for i in range(256)])
    got = value(spark, codec.pack_tile(data, mode("pce_sprite"), 4))
    assert [got[64 * p : 64 * p + 4] for p in range(4)] == ["aaaa", "cccc", "f0f0", "00ff"]
    for name, bpp in (("pce_sprite", 4), ("gb", 1)):
        with pytest.raises(ValueError, match="can't be read"):
            codec.unpack_tile(F.lit(""), mode(name), bpp)
    with pytest.raises(ValueError, match="no tiles"):
        codec.layout(mode("ws"), 1)


def test_color_rules(spark):
    assert value(spark, color.reduce(rgb(9, 9, 9, 127), mode("snes"))) == 0
    assert value(spark, color.reduce(rgb(9, 9, 9, 127), mode("sms"))) == 0xFF000000
    assert value(spark, color.from_hex(F.lit("'#0102ff'"))) == 0xFFFF0201
    with pytest.raises(Exception, match="not a colour"):
        value(spark, color.from_hex(F.lit("#123")))
    assert value(spark, color.reversed_bytes(rgb(1, 2, 3, 4))) == 0x01020304
    assert value(spark, palettes.without_col0_duplicate(F.array(rgb(1, 1, 1), rgb(2, 2, 2), rgb(1, 1, 1))))[0] == 0x010101


def test_modes():
    assert len(MODES) == 16
    assert checked(mode("snes"), 2, 16, 16) == (2, 16, 16)
    with pytest.raises(ValueError, match="bpp 8"):
        checked(mode("md"), 8)
    with pytest.raises(ValueError, match="no such mode"):
        mode("nes")


def test_packing_rules(spark):
    sets = spark.createDataFrame([(1, 0, [1, 2, 3]), (1, 1, [7, 8]), (1, 2, [3, 4]), (1, 3, [9])], "image_id long, seq int, colors array<long>")
    got = palettes.packed(sets, mode("snes"), 4).first().palettes
    assert sorted(map(sorted, got)) == [[1, 2, 3, 4], [7, 8, 9]]
    maximal = palettes.maximal_sets(spark.createDataFrame([(1, 0, [1, 2]), (1, 1, [1, 2, 3]), (1, 2, [2, 3]), (2, 3, [1, 2])], sets.schema))
    assert sorted((r.image_id, r.seq) for r in maximal.collect()) == [(1, 1), (2, 3)]


def test_mirrors_and_flips(spark):
    data = F.array(*[F.lit(i) for i in range(6)])
    assert value(spark, tiles.mirrored(data, 3, 2, True, False)) == [2, 1, 0, 5, 4, 3]
    assert value(spark, tiles.mirrored(data, 3, 2, False, True)) == [3, 4, 5, 0, 1, 2]
    for h, v in ((False, False), (True, False), (False, True), (True, True)):
        got = maps.flips(tiles.mirrored(data, 3, 2, h, v), data, 3, 2)
        assert (value(spark, got[0]), value(spark, got[1])) == (h, v)


def test_large_tiles_and_screens(spark):
    cells = spark.createDataFrame([(1, k, [k] * 64) for k in range(40)], "image_id long, tile int, data array<int>")
    got = {r.tile: r.data for r in tiles.metatiles(cells, 16, 16).collect()}
    assert sorted(got) == list(range(23)) and [got[3][p] for p in (0, 8, 128, 136)] == [3, 4, 19, 20]
    numbers = [value(spark, maps.cell_number(F.lit(t), 16, 16)) for t in (0, 7, 8, 9)]
    assert numbers == [0, 14, 32, 34] and value(spark, maps.cell_number(F.lit(9), 8, 16)) == 33
    entries = spark.createDataFrame([(1, x, 0, 9) for x in range(4)], "image_id long, x int, y int, tile int")
    assert [r.tile for r in maps.stored(entries, 4, 1, 2, 1, tile_width=16, tile_height=16).collect()] == [34] * 4
    assert [r.tile for r in maps.stored(entries, 4, 1, tile_width=16, tile_height=16).collect()] == [9] * 4
    with pytest.raises(ValueError, match="multiple of 32"):
        maps.check_banks(32, 20)
    assert value(spark, outputs.grey_ramp(2)) == [0xFF000000, 0xFF404040, 0xFF808080, 0xFFC0C0C0]


def test_palettes_that_look_like_json(spark, tmp_path):
    """Bytes that start like JSON are native; JSON behind blanks or a byte-order mark is JSON; JSON that doesn't fit isn't taken."""
    (tmp_path / "a.bin").write_bytes(b"{\x0c")
    (tmp_path / "b.bin").write_bytes('\ufeff \n{"palettes": [["#ffffff"]]}'.encode())
    got = {r.path[-5:]: r.palettes for r in native.read_palettes(spark, str(tmp_path / "*.bin"), mode("snes"), 2).collect()}
    assert got["b.bin"] == [[0xFF1F1F1F]] and got["a.bin"] == [[0xFF000000 + 27 + 3 * 256 + 3 * 65536]]


def test_files(spark, tmp_path):
    m = mode("snes")
    (tmp_path / "p.json").write_text('{"palettes": [["#0810f8", "#000000"], ["#ffffff"]]}')
    (tmp_path / "p.bin").write_bytes(bytes.fromhex("410c") * 2)
    got = {r.path[-6:]: r.palettes for r in native.read_palettes(spark, str(tmp_path / "p.*"), m, 2).collect()}
    assert got["p.json"] == [[0xFF1F0201, 0xFF000000], [0xFF1F1F1F]] and got["/p.bin"] == [[0x030201, 0xFF030201]]
    tile = F.array(*[F.lit(i % 16) for i in range(64)])
    packed = bytes.fromhex(value(spark, codec.pack_tile(tile, m, 4)))
    (tmp_path / "t.chr").write_bytes(packed * 3)
    rows = native.read_tiles(spark, str(tmp_path / "t.chr"), m).orderBy("tile").collect()
    assert [r.tile for r in rows] == [0, 1, 2] and rows[2].data == [i % 16 for i in range(64)]
    (tmp_path / "bad.chr").write_bytes(packed + b"x")
    with pytest.raises(Exception, match="whole number"):
        native.read_tiles(spark, str(tmp_path / "bad.chr"), m).collect()
    table = value(spark, outputs.palette_act(F.array(F.array(rgb(1, 2, 31))), m))
    assert len(table) == 2 * 772 and table.startswith("0810ff00") and table.endswith("0001ffff")
