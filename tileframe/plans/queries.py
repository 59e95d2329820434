"""Registered queries of the image conversion over tiles and colours drawn from events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, color, sql
from ..operators import maps, outputs, palettes, tiles
from ..sources import native as sources
from ..sources import png
from ..sources.events import COLUMNS, GREY, event_pixels, event_tiles
from .convert import Options, build_tileset, convert, first_colors, native
from .many import convert_many
from .modes import MODES, Mode, mode
from .report import reports, sizes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SNES = mode("snes")


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


# ---- colours: each event gives one, of any alpha ----


def event_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return events.withColumn("rgba", (F.col("event_id") * F.lit(2654435761)) % F.lit(1 << 32))


COLORS_SQL = "SELECT event_id, user_id, event_id * 2654435761 % 4294967296 AS rgba FROM events"


def _reduce_sql(name: str, c: str = "rgba") -> str:
    r, g, b, a = (f"(({c} >> {8 * k}) & 255)" for k in range(4))
    how = MODES[name].reduce
    if how.startswith("grey"):
        y = f"CAST(floor(CASE WHEN {a} < 128 THEN 0 ELSE 0.299::DOUBLE * {r} + 0.587::DOUBLE * {g} + 0.114::DOUBLE * {b} END) AS BIGINT)"
        level = f"(CASE WHEN {y} <= 64 THEN 0 WHEN {y} <= 128 THEN 1 WHEN {y} <= 192 THEN 2 ELSE 3 END)" if how == "grey4" else f"({y} // 32)"
        return f"(4278190080 + 65793 * {level})"
    cut = 1 << (8 - int(how))
    below = 0 if MODES[name].gated else 4278190080
    return f"(CASE WHEN {a} < 128 THEN {below} ELSE 4278190080 + {r} // {cut} + {g} // {cut} * 256 + {b} // {cut} * 65536 END)"


def _normalize_sql(name: str, c: str) -> str:
    bits = {"grey4": 2, "grey8": 3}.get(MODES[name].reduce) or int(MODES[name].reduce)
    spread = {2: "({v} * 64 | {v} * 16 | {v} * 4 | {v})", 3: "({v} * 32 | {v} * 4 | {v} // 2)", 4: "({v} * 16 | {v})", 5: "({v} * 8 | {v} // 4)"}[bits]
    return " + ".join(f"({spread.format(v=f'(({c} >> {8 * k}) & 255)')} & 255) * {256**k}" for k in range(4))


def _colored(name: str, make: Callable[[Column], Column], alias: str) -> Query:
    return lambda spark, sf_dir: event_colors(spark, sf_dir).select("event_id", make(F.col("rgba")).cast("long").alias(alias))


for _name, _m in MODES.items():
    _reduced = _reduce_sql(_name)
    query(f"reduce_{_name}", f"SELECT event_id, {_reduced} AS reduced FROM ({COLORS_SQL})")(_colored(_name, lambda c, m=_m: color.reduce(c, m), "reduced"))
    query(f"normalize_{_name}", f"SELECT event_id, {_normalize_sql(_name, 'c')} AS normalized FROM (SELECT event_id, {_reduced} AS c FROM ({COLORS_SQL}))")(
        _colored(_name, lambda c, m=_m: color.normalize(color.reduce(c, m), m), "normalized")
    )


@query(
    "hex_color",
    f"""SELECT event_id, printf('#%02x%02x%02x', rgba & 255, (rgba >> 8) & 255, (rgba >> 16) & 255) AS hex,
    printf('#%02x%02x%02x%02x', rgba & 255, (rgba >> 8) & 255, (rgba >> 16) & 255, rgba >> 24) AS hex_alpha, rgba AS again, rgba % 16777216 + 4278190080 AS opaque FROM ({COLORS_SQL})""",
)
def hex_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("rgba")
    rows = event_colors(spark, sf_dir).select("event_id", color.hex_of(c).alias("hex"), color.hex_of(c, alpha=True).alias("hex_alpha"))
    return rows.withColumns({"again": color.from_hex(F.col("hex_alpha")), "opaque": color.from_hex(F.col("hex"))})


@query("reversed_bytes", f"SELECT event_id, (rgba & 255) * 16777216 + ((rgba >> 8) & 255) * 65536 + ((rgba >> 16) & 255) * 256 + (rgba >> 24) AS reversed FROM ({COLORS_SQL})")
def reversed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_colors(spark, sf_dir).select("event_id", color.reversed_bytes(F.col("rgba")).alias("reversed"))


@query(
    "hsv_sort_key",
    f"""WITH c AS (SELECT event_id, (rgba & 255)::FLOAT AS r, ((rgba >> 8) & 255)::FLOAT AS g, ((rgba >> 16) & 255)::FLOAT AS b FROM ({COLORS_SQL})),
    e AS (SELECT *, greatest(r, g, b) AS top, (greatest(r, g, b) - least(r, g, b))::FLOAT AS span FROM c),
    h AS (SELECT *, CASE WHEN span = 0 THEN 0::FLOAT WHEN top = r THEN 60::FLOAT * ((g - b) / span)::FLOAT
        WHEN top = g THEN 60::FLOAT * (((b - r) / span)::FLOAT + 2::FLOAT) ELSE 60::FLOAT * (((r - g) / span)::FLOAT + 4::FLOAT) END AS h0 FROM e)
    SELECT event_id, CAST(floor((CASE WHEN h0 < 0 THEN h0 + 360::FLOAT ELSE h0 END) * 8) AS INT) AS hue,
    CAST(floor(8 * sqrt(0.241::DOUBLE * r + 0.691::DOUBLE * g + 0.068::DOUBLE * b)) AS INT) AS light, CAST(top * 8 AS INT) AS value FROM h""",
)
def hsv_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = event_colors(spark, sf_dir).select("event_id", color.sort_key(F.col("rgba")).alias("k"))
    return k.select("event_id", F.col("k.h").alias("hue"), F.col("k.l").alias("light"), F.col("k.v").alias("value"))


# ---- native colours, map entries and tiles ----

_CH = tuple(f"((c >> {8 * k}) & 255)" for k in range(3))
_WORD_SQL = {
    **dict.fromkeys(("snes", "snes_mode7", "gbc", "gba", "gba_affine"), "{0} + {1} * 32 + {2} * 1024"),
    "md": "{0} * 2 + {1} * 32 + {2} * 512",
    **dict.fromkeys(("pce", "pce_sprite"), "{2} + {0} * 8 + {1} * 64"),
    **dict.fromkeys(("wsc", "wsc_packed", "gg"), "{2} + {1} * 16 + {0} * 256"),
    "ngpc": "{0} + {1} * 16 + {2} * 256",
    "sms": "{0} + {1} * 4 + {2} * 16",
}


def _four_sql(name: str) -> str:
    return f"SELECT event_id, j, {_reduce_sql(name, 'x')} AS c FROM (SELECT event_id, j, rgba * (j + 1) % 4294967296 AS x FROM ({COLORS_SQL}), range(4) r(j))"


def _pack_palette_sql(name: str) -> str:
    if name == "gb":
        return f"SELECT event_id, printf('%02x', CAST(sum((3 - (c & 3)) << (2 * j)) AS BIGINT)) AS native FROM ({_four_sql(name)}) GROUP BY event_id"
    if name == "ws":
        return f"SELECT event_id, printf('%02x%02x', w & 255, w >> 8) AS native FROM (SELECT event_id, CAST(sum((7 - (c & 255)) << (4 * j)) AS BIGINT) AS w FROM ({_four_sql(name)}) GROUP BY event_id)"
    word = "7 - (c & 255)" if name == "ngp" else _WORD_SQL[name].format(*_CH)
    form = "printf('%02x', w)" if name in ("ngp", "sms") else "printf('%02x%02x', w & 255, w >> 8)"
    return f"SELECT event_id, string_agg({form}, '' ORDER BY j) AS native FROM (SELECT event_id, j, {word} AS w FROM ({_four_sql(name)})) GROUP BY event_id"


def _packed_palette(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = mode(name)
        four = F.array(*[color.reduce((F.col("rgba") * (j + 1)) % F.lit(1 << 32), m) for j in range(4)])
        return event_colors(spark, sf_dir).select("event_id", four.alias("colors")).select("event_id", codec.pack_palette(F.col("colors"), m).alias("native"))

    return run


def _unpack_palette_sql(name: str) -> str:
    byte = "((rgba >> (24 - 8 * ({k}))) & 255)"
    if name in ("gb", "ws", "ngp"):
        value = {"gb": f"3 - (({byte.format(k=0)} >> (2 * j)) & 3)", "ws": f"7 - (({byte.format(k='j // 2')} >> (4 * (j % 2))) & 7)", "ngp": f"7 - ({byte.format(k='j')} & 7)"}[name]
        return f"SELECT event_id, string_agg(4278190080 + 65793 * ({value}), ',' ORDER BY j) AS colors FROM ({COLORS_SQL}), range(4) r(j) GROUP BY event_id"
    if name == "sms":
        w = byte.format(k="j")
        return f"SELECT event_id, string_agg(4278190080 + ({w} & 3) + (({w} >> 2) & 3) * 256 + (({w} >> 4) & 3) * 65536, ',' ORDER BY j) AS colors FROM ({COLORS_SQL}), range(4) r(j) GROUP BY event_id"
    w = f"({byte.format(k='2 * j')} + 256 * {byte.format(k='2 * j + 1')})"
    parts = {
        **dict.fromkeys(("snes", "snes_mode7", "gbc", "gba", "gba_affine"), "(w & 31) + ((w >> 5) & 31) * 256 + ((w >> 10) & 31) * 65536"),
        "md": "((w >> 1) & 7) + ((w >> 5) & 7) * 256 + ((w >> 9) & 7) * 65536",
        **dict.fromkeys(("pce", "pce_sprite"), "((w >> 3) & 7) + (w & 7) * 256 + ((w >> 10) & 7) * 1048576"),
        **dict.fromkeys(("wsc", "wsc_packed"), "((w >> 8) & 15) + ((w >> 4) & 15) * 256 + (w & 15) * 65536"),
        **dict.fromkeys(("ngpc", "gg"), "(w & 15) + ((w >> 4) & 15) * 256 + ((w >> 8) & 15) * 65536"),
    }[name]
    return f"SELECT event_id, string_agg(4278190080 + {parts}, ',' ORDER BY j) AS colors FROM (SELECT event_id, j, {w} AS w FROM ({COLORS_SQL}), range(2) r(j)) GROUP BY event_id"


def _unpacked_palette(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = F.substring(F.lpad(F.lower(F.hex("rgba")), 8, "0"), 1, {"gb": 2, "ws": 4}.get(name, 8))
        return event_colors(spark, sf_dir).select("event_id", F.array_join(codec.unpack_palette(data, mode(name)), ",").alias("colors"))

    return run


_ENTRY_SQL = {
    "snes": "(t // 256 & 3) + (p & 7) * 4 + h * 64 + v * 128",
    **dict.fromkeys(("snes_mode7", "gb", "gba_affine"), None),
    **dict.fromkeys(("sms", "gg"), "(t // 256 & 1) + h * 2 + v * 4 + (p & 1) * 8"),
    "gbc": "(p & 7) + (t // 256 & 1) * 8 + h * 32 + v * 64",
    "gba": "(t // 256 & 3) + h * 4 + v * 8 + (p & 15) * 16",
    "md": "(t // 256 & 7) + h * 8 + v * 16 + (p & 3) * 32",
    "pce": "(t // 256 & 15) + (p & 15) * 16",
    **dict.fromkeys(("ws", "wsc", "wsc_packed"), "(t // 256 & 1) + (p & 15) * 2 + (t // 512 & 1) * 32 + h * 64 + v * 128"),
    "ngp": "(t // 256 & 1) + (p & 1) * 32 + v * 64 + h * 128",
    "ngpc": "(t // 256 & 1) + (p & 15) * 2 + v * 64 + h * 128",
}


def _packed_entry(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = event_colors(spark, sf_dir)
        fields = (F.col("rgba") % 2048, F.col("user_id") % 16, F.expr("event_id div 2") % 2 == 1, F.expr("event_id div 4") % 2 == 1)
        return e.select("event_id", codec.pack_entry(mode(name), *fields).alias("native"))

    return run


for _name in MODES:
    query(f"palette_pack_{_name}", _pack_palette_sql(_name))(_packed_palette(_name))
    query(f"palette_unpack_{_name}", _unpack_palette_sql(_name))(_unpacked_palette(_name))
    if _name in _ENTRY_SQL:
        _second = _ENTRY_SQL[_name]
        _form = f"printf('%02x%02x', t & 255, {_second})" if _second else "printf('%02x', t & 255)"
        query(f"mapentry_pack_{_name}", f"SELECT event_id, {_form} AS native FROM (SELECT event_id, rgba % 2048 AS t, user_id % 16 AS p, event_id // 2 % 2 AS h, event_id // 4 % 2 AS v FROM ({COLORS_SQL}))")(
            _packed_entry(_name)
        )

#: Modes and depths with a layout of their own, and where SQL puts the bits of pixel p: (byte, value) by plane or whole.
_LAYOUTS = {
    ("gb", 1): ("p // 8", "((i >> pl) & 1) << (7 - p % 8)"),
    ("gb", 2): ("pl // 2 * 16 + p // 8 * 2 + pl % 2", "((i >> pl) & 1) << (7 - p % 8)"),
    ("snes", 4): ("pl // 2 * 16 + p // 8 * 2 + pl % 2", "((i >> pl) & 1) << (7 - p % 8)"),
    ("snes", 8): ("pl // 2 * 16 + p // 8 * 2 + pl % 2", "((i >> pl) & 1) << (7 - p % 8)"),
    ("wsc", 4): ("p // 8 * 4 + pl", "((i >> pl) & 1) << (7 - p % 8)"),
    ("pce_sprite", 4): ("pl * 32 + p // 8", "((i >> pl) & 1) << (p % 8)"),
    ("md", 4): ("p // 2", "i << (4 * (p % 2))"),
    ("wsc_packed", 4): ("p // 2", "i << (4 - 4 * (p % 2))"),
    ("ngp", 2): ("p // 8 * 2 + (7 - p % 8) // 4", "i << (2 * ((7 - p % 8) % 4))"),
    ("snes_mode7", 8): ("p", "i"),
}


def _index_tiles(spark: SparkSession, sf_dir: str, pixels: int, bpp: int) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").repartition("event_id")
    data = F.transform(F.sequence(F.lit(0), F.lit(pixels - 1)), lambda p: ((F.col("event_id") * 31 + p * p * 7 + p * 3) % (1 << bpp)).cast("int"))
    return e.select("event_id", data.alias("data"))


def _packed_tile(name: str, bpp: int) -> Query:
    size = 256 if name == "pce_sprite" else 64
    return lambda spark, sf_dir: _index_tiles(spark, sf_dir, size, bpp).select("event_id", codec.pack_tile(F.col("data"), mode(name), bpp).alias("native"))


def _repacked_tile(name: str, bpp: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        native = _index_tiles(spark, sf_dir, 64, bpp).select("event_id", codec.pack_tile(F.col("data"), mode(name), bpp).alias("native"))
        return native.select("event_id", F.array_join(codec.unpack_tile(F.col("native"), mode(name), bpp), ",").alias("indices"))

    return run


for (_name, _bpp), (_byte, _value) in _LAYOUTS.items():
    _size = 256 if _name == "pce_sprite" else 64
    _idx = f"SELECT event_id, p, (event_id * 31 + p * p * 7 + p * 3) % {1 << _bpp} AS i FROM events, range({_size}) r(p)"
    _rows = f"SELECT event_id, {_byte} AS b, {_value} AS v FROM ({_idx})" + (f", range({_bpp}) s(pl)" if "pl" in _value else "")
    query(f"tile_pack_{_name}_{_bpp}", f"SELECT event_id, string_agg(printf('%02x', v), '' ORDER BY b) AS native FROM (SELECT event_id, b, CAST(sum(v) AS BIGINT) AS v FROM ({_rows}) GROUP BY event_id, b) GROUP BY event_id")(
        _packed_tile(_name, _bpp)
    )
    if (_name, _bpp) not in (("gb", 1), ("pce_sprite", 4)):
        query(f"tile_unpack_{_name}_{_bpp}", f"SELECT event_id, string_agg(i, ',' ORDER BY p) AS indices FROM ({_idx}) GROUP BY event_id")(_repacked_tile(_name, _bpp))

# ---- images: tiles, colour sets, palettes, tilesets and maps ----

PIXELS_SQL = f"""ev AS (SELECT event_id // 1024 AS image_id, event_id % 1024 AS seq, user_id % 5 AS k, user_id // 5 % 2 AS fh, CAST(second(ts) AS BIGINT) % 2 AS fv,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS g FROM events),
s AS (SELECT *, CASE WHEN fh = 1 THEN 7 - p % 8 ELSE p % 8 END AS sx, CASE WHEN fv = 1 THEN 7 - p // 8 ELSE p // 8 END AS sy FROM ev, range(64) r(p)),
ix AS (SELECT image_id, seq, g, p, (sx * (k + 3) + sy * sy * (k + 1) + sx * sy) % 7 AS m FROM s),
px AS (SELECT image_id, seq, p, CASE WHEN i = 0 THEN {GREY} ELSE 4278190080 + (g * 48 + i * 16) % 256 + 256 * ((g * 24 + i * 64) % 256) + 65536 * ((200 - g * 32 - i * 8) % 256) END AS rgba
    FROM (SELECT image_id, seq, g, p, CASE WHEN m < 4 THEN m ELSE 0 END AS i FROM ix)),
rx AS (SELECT *, {_reduce_sql("snes")} AS c FROM px),
cs AS (SELECT image_id, seq, list_sort(list(DISTINCT c)) AS colors FROM rx GROUP BY image_id, seq),
ds AS (SELECT image_id, colors, min(seq) AS seq FROM cs GROUP BY image_id, colors),
ms AS (SELECT * FROM ds a WHERE NOT EXISTS (SELECT 1 FROM ds b WHERE b.image_id = a.image_id AND len(b.colors) > len(a.colors) AND len(list_filter(a.colors, lambda x: NOT list_contains(b.colors, x))) = 0))"""


def _list(c: str) -> Column:
    return F.array_join(c, ",")


@query("crops_grid", f"WITH {PIXELS_SQL} SELECT image_id, CAST(seq % 32 AS INT) AS tx, CAST(seq // 32 AS INT) AS ty, string_agg(rgba, ',' ORDER BY p) AS pixels FROM px GROUP BY image_id, seq")
def crops_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.slice_tiles(event_pixels(spark, sf_dir)).select("image_id", "tx", "ty", _list("rgba").alias("pixels"))


@query(
    "crops_padded",
    f"""WITH {PIXELS_SQL}, q AS (SELECT image_id, seq % 32 * 8 + p % 8 AS x, seq // 32 * 8 + p // 8 AS y, rgba FROM px),
    t AS (SELECT DISTINCT image_id, x // 12 AS tx, y // 12 AS ty FROM q)
    SELECT t.image_id, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, string_agg(coalesce(rgba, 0), ',' ORDER BY p) AS pixels
    FROM t CROSS JOIN range(144) r(p) LEFT JOIN q ON q.image_id = t.image_id AND q.x = tx * 12 + p % 12 AND q.y = ty * 12 + p // 12 GROUP BY t.image_id, tx, ty""",
)
def crops_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.slice_tiles(event_pixels(spark, sf_dir), 12, 12).select("image_id", "tx", "ty", _list("rgba").alias("pixels"))


def event_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.shapes(event_tiles(spark, sf_dir))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.color_sets(event_shapes(spark, sf_dir), SNES)


@query("color_sets", f"WITH {PIXELS_SQL} SELECT image_id, CAST(seq AS INT) AS seq, array_to_string(colors, ',') AS colors FROM cs")
def color_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.spread(_sets(spark, sf_dir)).select("image_id", "seq", _list("colors").alias("colors"))


@query("distinct_color_sets", f"WITH {PIXELS_SQL} SELECT image_id, CAST(seq AS INT) AS seq, array_to_string(colors, ',') AS colors FROM ds")
def distinct_color_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.distinct_sets(_sets(spark, sf_dir)).select("image_id", "seq", _list("colors").alias("colors"))


def _with_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour sets, every third of them without its last colour."""
    sets = tiles.spread(_sets(spark, sf_dir))
    return sets.withColumn("colors", F.when(F.col("seq") % 3 == 0, F.slice("colors", 1, F.size("colors") - 1)).otherwise(F.col("colors")))


_SUBSETS_SQL = f"""WITH {PIXELS_SQL}, sub AS (SELECT image_id, seq, CASE WHEN seq % 3 = 0 THEN colors[1:len(colors) - 1] ELSE colors END AS colors FROM cs),
d AS (SELECT image_id, colors, min(seq) AS seq FROM sub GROUP BY image_id, colors)
SELECT image_id, CAST(seq AS INT) AS seq, array_to_string(colors, ',') AS colors FROM d a WHERE NOT EXISTS
(SELECT 1 FROM d b WHERE b.image_id = a.image_id AND len(b.colors) > len(a.colors) AND len(list_filter(a.colors, lambda x: NOT list_contains(b.colors, x))) = 0)"""


@query("subset_antifilter", _SUBSETS_SQL)
def subset_antifilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = palettes.maximal_sets(palettes.distinct_sets(_with_subsets(spark, sf_dir)))
    return found.select("image_id", "seq", _list("colors").alias("colors"))


def _packed(spark: SparkSession, sf_dir: str, colors: int) -> DataFrame:
    sets = palettes.maximal_sets(palettes.distinct_sets(_sets(spark, sf_dir)))
    return palettes.packed(sets, SNES, colors)


def _pack_sql(colors: int) -> str:
    fit = f"list_filter(range(1, len(acc) + 1), lambda i: len(list_distinct(list_concat(acc[i], x[1]))) <= {colors})"
    put = f"""CASE WHEN len({fit}) = 0 THEN list_concat(acc, x)
        ELSE list_transform(range(1, len(acc) + 1), lambda j: CASE WHEN j = list_max({fit}) THEN list_distinct(list_concat(acc[j], x[1])) ELSE acc[j] END) END"""
    return f"""o AS (SELECT image_id, list([colors] ORDER BY len(colors) DESC, seq DESC) AS xs FROM ms GROUP BY image_id),
    bins AS (SELECT image_id, list_reduce(xs, lambda acc, x: {put}) AS bins FROM o)"""


for _n in (4, 8, 16):
    query(f"packed_palettes_{_n}", f"WITH {PIXELS_SQL}, {_pack_sql(_n)} SELECT image_id, array_to_string(list_sort(b), ',') AS colors FROM (SELECT image_id, unnest(bins) AS b FROM bins)")(
        lambda spark, sf_dir, n=_n: _packed(spark, sf_dir, n).select("image_id", F.explode("palettes").alias("b")).select("image_id", F.array_join(F.sort_array("b"), ",").alias("colors"))
    )


@query("palette_overflow", f"WITH {PIXELS_SQL}, {_pack_sql(4)} SELECT image_id, CAST(len(bins) AS INT) AS subpalettes, len(bins) > 8 AS overflow FROM bins")
def palette_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.overflow(_packed(spark, sf_dir, 4), SNES)


_ORDERED_SQL = f"""{_pack_sql(8)},
ob AS (SELECT image_id, bins, list_sort(list_transform(range(1, len(bins) + 1), lambda i: [-len(bins[i]), i])) AS by_size FROM bins),
pal AS (SELECT image_id, generate_subscripts(by_size, 1) - 1 AS palette, bins[unnest(by_size)[2]] AS colors FROM ob)"""


@query(
    "subpalette_first_match",
    f"""WITH {PIXELS_SQL}, {_ORDERED_SQL} SELECT cs.image_id, CAST(cs.seq AS INT) AS seq, CAST(min(palette) AS INT) AS palette
    FROM cs JOIN pal ON pal.image_id = cs.image_id AND len(list_filter(cs.colors, lambda x: x != 0 AND NOT list_contains(pal.colors, x))) = 0 GROUP BY cs.image_id, cs.seq""",
)
def subpalette_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.spread(palettes.first_match(_sets(spark, sf_dir), _packed(spark, sf_dir, 8))).select("image_id", "seq", "palette")


@query(
    "subpalette_all_matches",
    f"""WITH {PIXELS_SQL}, {_ORDERED_SQL} SELECT cs.image_id, CAST(cs.seq AS INT) AS seq, CAST(palette AS INT) AS palette
    FROM cs JOIN pal ON pal.image_id = cs.image_id AND len(list_filter(cs.colors, lambda x: NOT list_contains(pal.colors, x))) = 0""",
)
def subpalette_all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.spread(palettes.all_matches(_sets(spark, sf_dir), _packed(spark, sf_dir, 8))).select("image_id", "seq", "palette")


def _sorted_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's colours as one subpalette, in rising order, which SQL can give as well."""
    colors = event_shapes(spark, sf_dir).select("image_id", F.explode(palettes.color_set(F.col("rgba"), SNES)).alias("c"))
    return colors.groupBy("image_id").agg(F.array(F.sort_array(F.collect_set("c"))).alias("palettes"))


_INDEX_SQL = """pal AS (SELECT image_id, list_sort(list(DISTINCT c)) AS colors FROM rx GROUP BY image_id),
di AS (SELECT image_id, seq, list(list_position(colors, c) - 1 ORDER BY p) AS data FROM rx JOIN pal USING (image_id) GROUP BY image_id, seq)"""
_FLIP_SQL = """fl AS (SELECT *, list_transform(range(64), lambda p: data[p // 8 * 8 + 7 - p % 8 + 1]) AS fh, list_transform(range(64), lambda p: data[(7 - p // 8) * 8 + p % 8 + 1]) AS fv,
    list_reverse(data) AS fhv FROM di),
ca AS (SELECT *, least(data, fh, fv, fhv) AS canon FROM fl),
ts AS (SELECT image_id, canon, min(seq) AS seq, arg_min(data, seq) AS first, count(*) AS uses, row_number() OVER (PARTITION BY image_id ORDER BY min(seq)) - 1 AS tile FROM ca GROUP BY image_id, canon)"""


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of tiles as indices into their image's sorted palette."""
    rows = event_shapes(spark, sf_dir).join(_sorted_palette(spark, sf_dir), "image_id")
    rows = rows.select("image_id", "seq", "seqs", "uses", palettes.reduced(F.col("rgba"), SNES).alias("reduced"), F.get("palettes", F.lit(0)).alias("p"))
    return rows.select("image_id", "seq", "seqs", "uses", palettes.remap(F.col("reduced"), F.col("p")).alias("data"))


@query("remap_indices", f"WITH {PIXELS_SQL}, {_INDEX_SQL} SELECT image_id, CAST(seq AS INT) AS seq, array_to_string(data, ',') AS indices FROM di")
def remap_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.spread(_indexed(spark, sf_dir)).select("image_id", "seq", _list("data").alias("indices"))


@query(
    "tile_dedupe_noflip",
    f"""WITH {PIXELS_SQL}, {_INDEX_SQL}, t AS (SELECT image_id, data, min(seq) AS seq, count(*) AS uses FROM di GROUP BY image_id, data)
    SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY seq) - 1 AS INT) AS tile, array_to_string(data, ',') AS data, uses FROM t""",
)
def tile_dedupe_noflip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.dedupe(_indexed(spark, sf_dir), flip=False).select("image_id", "tile", _list("data").alias("data"), "uses")


@query("tile_dedupe_flip", f"WITH {PIXELS_SQL}, {_INDEX_SQL}, {_FLIP_SQL} SELECT image_id, CAST(tile AS INT) AS tile, array_to_string(first, ',') AS data, uses FROM ts")
def tile_dedupe_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.dedupe(_indexed(spark, sf_dir)).select("image_id", "tile", _list("data").alias("data"), "uses")


@query("tileset_capacity", f"WITH {PIXELS_SQL}, {_INDEX_SQL}, {_FLIP_SQL} SELECT image_id, count(*) AS tiles, CAST(sum(uses) - count(*) AS BIGINT) AS discarded, count(*) > 1024 AS overflow FROM ts GROUP BY image_id")
def tileset_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.check_capacity(tiles.dedupe(_indexed(spark, sf_dir)), SNES)


_MAP_SQL = f"""WITH {PIXELS_SQL}, {_INDEX_SQL}, {_FLIP_SQL},
en AS (SELECT ca.image_id, ca.seq, ca.seq % 32 AS x, ca.seq // 32 AS y, tile, 0 AS palette,
    CASE WHEN data = first THEN false WHEN fh = first THEN true WHEN fv = first THEN false ELSE true END AS flip_h,
    CASE WHEN data = first THEN false WHEN fh = first THEN false ELSE true END AS flip_v FROM ca JOIN ts USING (image_id, canon))"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = maps.build(event_shapes(spark, sf_dir), _sorted_palette(spark, sf_dir), tiles.dedupe(_indexed(spark, sf_dir)), SNES)
    return entries.withColumns({"x": F.col("seq") % COLUMNS, "y": F.expr(f"seq div {COLUMNS}").cast("int")})


@query("map_entries", f"{_MAP_SQL} SELECT image_id, CAST(seq AS INT) AS seq, CAST(tile AS INT) AS tile, CAST(palette AS INT) AS palette, flip_h, flip_v, true AS matched FROM en")
def map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).drop("x", "y")


@query("map_offset", f"{_MAP_SQL} SELECT image_id, CAST(seq AS INT) AS seq, CAST(greatest(0, tile - 2) AS INT) AS tile, CAST(greatest(0, palette + 3) AS INT) AS palette FROM en")
def map_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.offset(_entries(spark, sf_dir), -2, 3).select("image_id", "seq", "tile", "palette")


_BYTES_SQL = "printf('%02x%02x', tile & 255, (tile // 256 & 3) + (palette & 7) * 4 + flip_h::INT * 64 + flip_v::INT * 128)"


@query("map_native", f"{_MAP_SQL} SELECT image_id, string_agg({_BYTES_SQL}, '' ORDER BY seq) AS hex FROM en GROUP BY image_id")
def map_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.native(maps.stored(_entries(spark, sf_dir), 32, 32), SNES)


@query("map_split", f"{_MAP_SQL} SELECT image_id, string_agg({_BYTES_SQL}, '' ORDER BY x // 16 * 4 + y // 8, y % 8 * 16 + x % 16) AS hex FROM en GROUP BY image_id")
def map_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.native(maps.stored(_entries(spark, sf_dir), 32, 32, 16, 8), SNES)


@query("map_column_order", f"{_MAP_SQL} SELECT image_id, string_agg({_BYTES_SQL}, '' ORDER BY x // 16 * 2 + y // 16, x % 16 * 16 + y % 16) AS hex FROM en GROUP BY image_id")
def map_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.native(maps.stored(_entries(spark, sf_dir), 32, 32, 16, 16, column_order=True), SNES)


@query("palette_map", f"{_MAP_SQL} SELECT image_id, string_agg(printf('%02x%02x', palette & 255, palette >> 8), '' ORDER BY seq) AS hex FROM en GROUP BY image_id")
def palette_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.palette_map(maps.stored(_entries(spark, sf_dir), 32, 32))


@query("banked_map", f"{_MAP_SQL} SELECT image_id, string_agg(substr(b, 1, 2), '' ORDER BY seq) || string_agg(substr(b, 3, 2), '' ORDER BY seq) AS hex FROM (SELECT image_id, seq, {_BYTES_SQL} AS b FROM en) GROUP BY image_id")
def banked_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.native(maps.stored(_entries(spark, sf_dir), 32, 32), SNES).select("image_id", maps.banked(F.col("hex")).alias("hex"))


@query(
    "map_json",
    f"""{_MAP_SQL} SELECT image_id, '{{"map":[' || string_agg(printf('{{"flip_h":%d,"flip_v":%d,"palette":%d,"tile":%d}}', flip_h::INT, flip_v::INT, palette, tile), ',' ORDER BY seq) || ']}}' AS json FROM en GROUP BY image_id""",
)
def map_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.as_json(maps.stored(_entries(spark, sf_dir), 32, 32), SNES)


@query(
    "mode7_interleave",
    f"""{_MAP_SQL}, mb AS (SELECT image_id, seq AS place, tile & 255 AS b FROM en),
    tb AS (SELECT image_id, tile * 64 + p AS place, first[p + 1] AS b FROM ts, range(64) r(p))
    SELECT image_id, string_agg(printf('%02x%02x', coalesce(mb.b, 0), coalesce(tb.b, 0)), '' ORDER BY place) AS hex FROM mb FULL JOIN tb USING (image_id, place) GROUP BY image_id""",
)
def mode7_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mode("snes_mode7")
    entries = maps.native(maps.stored(_entries(spark, sf_dir), 32, 32), m)
    native = tiles.dedupe(_indexed(spark, sf_dir)).select("image_id", F.lit(0).alias("screen"), F.col("tile").alias("pos"), codec.pack_tile(F.col("data"), m, 8).alias("hex"))
    both = entries.join(maps.joined(native).withColumnRenamed("hex", "tile_hex"), "image_id", "full")
    none = F.lit("")
    return both.select("image_id", maps.interleaved(F.coalesce("hex", none), F.coalesce("tile_hex", none)).alias("hex"))


_COLORS_OF_SQL = "pc AS (SELECT image_id, c, row_number() OVER (PARTITION BY image_id ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM (SELECT DISTINCT image_id, c FROM rx))"
_FULL_SQL = [f"((((c >> {8 * k}) & 255) * 8 | ((c >> {8 * k}) & 255) // 4) & 255)" for k in range(3)]


@query("palette_native", f"WITH {PIXELS_SQL}, {_COLORS_OF_SQL} SELECT image_id, rpad(string_agg(printf('%02x%02x', w & 255, w >> 8), '' ORDER BY i), 64, '0') AS hex FROM (SELECT *, {_WORD_SQL['snes'].format(*_CH)} AS w FROM pc) GROUP BY image_id")
def palette_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted_palette(spark, sf_dir).select("image_id", outputs.palette_native(F.col("palettes"), SNES).alias("hex"))


@query("palette_act", f"WITH {PIXELS_SQL}, {_COLORS_OF_SQL} SELECT image_id, rpad(string_agg(printf('%02x%02x%02x', {', '.join(_FULL_SQL)}), '' ORDER BY i), 1536, '0') || '00' || printf('%02x', any_value(n)) || 'ffff' AS hex FROM pc GROUP BY image_id")
def palette_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted_palette(spark, sf_dir).select("image_id", outputs.palette_act(F.col("palettes"), SNES).alias("hex"))


@query(
    "palette_json",
    f"""WITH {PIXELS_SQL}, {_COLORS_OF_SQL} SELECT image_id, '{{"palettes":[[' || string_agg(printf('"#%02x%02x%02x"', {', '.join(_FULL_SQL)}), ',' ORDER BY i)
    || ']],"palettes_native_rgb":[[' || string_agg(printf('[%d,%d,%d]', {', '.join(_CH)}), ',' ORDER BY i) || ']]}}' AS json FROM pc GROUP BY image_id""",
)
def palette_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted_palette(spark, sf_dir).select("image_id", outputs.palette_json(F.col("palettes"), SNES).alias("json"))


@query(
    "palette_pixels",
    f"""WITH {PIXELS_SQL}, {_COLORS_OF_SQL}, im AS (SELECT DISTINCT image_id FROM pc)
    SELECT im.image_id, CAST(x AS INT) AS x, 0 AS y, CASE WHEN c IS NULL THEN 0 ELSE 4278190080 + {_FULL_SQL[0]} + {_FULL_SQL[1]} * 256 + {_FULL_SQL[2]} * 65536 END AS rgba
    FROM im CROSS JOIN range(16) r(x) LEFT JOIN pc ON pc.image_id = im.image_id AND pc.i = x""",
)
def palette_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.palette_pixels(_sorted_palette(spark, sf_dir), SNES)


_PLANES_SQL = "SELECT image_id, tile, pl // 2 * 16 + p // 8 * 2 + pl % 2 AS b, CAST(sum(((first[p + 1] >> pl) & 1) << (7 - p % 8)) AS BIGINT) AS v FROM ts, range(64) r(p), range(4) s(pl) GROUP BY ALL"


@query("tileset_native", f"WITH {PIXELS_SQL}, {_INDEX_SQL}, {_FLIP_SQL} SELECT image_id, string_agg(printf('%02x', v), '' ORDER BY tile, b) AS hex FROM ({_PLANES_SQL}) GROUP BY image_id")
def tileset_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.tileset_native(tiles.dedupe(_indexed(spark, sf_dir)), SNES)


@query("tileset_pixels", f"WITH {PIXELS_SQL}, {_INDEX_SQL}, {_FLIP_SQL} SELECT image_id, CAST(tile % 4 * 8 + p % 8 AS INT) AS x, CAST(tile // 4 * 8 + p // 8 AS INT) AS y, first[p + 1] AS idx FROM ts, range(64) r(p)")
def tileset_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.tileset_pixels(tiles.dedupe(_indexed(spark, sf_dir)), image_width=32)


@query(
    "metatiles",
    f"""WITH {PIXELS_SQL}, {_INDEX_SQL}, {_FLIP_SQL}, mt AS (SELECT a.image_id, a.tile, p, CASE
        WHEN p // 16 < 8 AND p % 16 < 8 THEN a.first[p // 16 * 8 + p % 16 + 1] WHEN p // 16 < 8 THEN b.first[p // 16 * 8 + p % 16 - 8 + 1]
        WHEN p % 16 < 8 THEN c.first[(p // 16 - 8) * 8 + p % 16 + 1] ELSE d.first[(p // 16 - 8) * 8 + p % 16 - 8 + 1] END AS v
    FROM ts a JOIN ts b ON b.image_id = a.image_id AND b.tile = a.tile + 1 JOIN ts c ON c.image_id = a.image_id AND c.tile = a.tile + 2
    JOIN ts d ON d.image_id = a.image_id AND d.tile = a.tile + 3, range(256) r(p))
    SELECT image_id, CAST(tile AS INT) AS tile, string_agg(v, ',' ORDER BY p) AS data FROM mt GROUP BY image_id, tile""",
)
def metatiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.metatiles(tiles.dedupe(_indexed(spark, sf_dir)), 16, 16, per_row=2).select("image_id", "tile", _list("data").alias("data"))


@query(
    "metatile_cells",
    f"""WITH {PIXELS_SQL}, {_INDEX_SQL}, {_FLIP_SQL}, w AS (SELECT image_id, tile, first || first || first || first AS big FROM ts)
    SELECT image_id, CAST(tile // 8 * 32 + tile % 8 * 2 + cell // 2 * 16 + cell % 2 AS INT) AS place,
    string_agg(big[(cell // 2 * 8 + p // 8) * 16 + cell % 2 * 8 + p % 8 + 1], ',' ORDER BY p) AS data
    FROM w, range(4) c(cell), range(64) r(p) GROUP BY image_id, tile, cell""",
)
def metatile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 16 by 16, here four times the indices of an 8 by 8 one, as cells in their native places."""
    large = tiles.dedupe(_indexed(spark, sf_dir)).withColumn("data", F.concat("data", "data", "data", "data"))
    return tiles.cell_positions(large, 16, 16).select("image_id", "place", _list("data").alias("data"))


# ---- several subpalettes, whole conversions and files ----


def _key_sql(c: str) -> str:
    """What colours are sorted by, as a list: hue, brightness and value in eighths, then the colour."""
    r, g, b = (f"(({c} >> {8 * k}) & 255)::FLOAT" for k in range(3))
    top, span = f"greatest({r}, {g}, {b})", f"(greatest({r}, {g}, {b}) - least({r}, {g}, {b}))::FLOAT"
    turn = lambda x, y, off: f"60::FLOAT * ((({x} - {y}) / {span})::FLOAT + {off}::FLOAT)"
    hue = f"CASE WHEN {span} = 0 THEN 0::FLOAT WHEN {top} = {r} THEN {turn(g, b, 0)} WHEN {top} = {g} THEN {turn(b, r, 2)} ELSE {turn(r, g, 4)} END"
    light = f"floor(8 * sqrt(0.241::DOUBLE * {r} + 0.691::DOUBLE * {g} + 0.068::DOUBLE * {b}))"
    return f"[CAST(floor((CASE WHEN {hue} < 0 THEN {hue} + 360::FLOAT ELSE {hue} END) * 8) AS BIGINT), CAST({light} AS BIGINT), CAST({top} * 8 AS BIGINT), {c}]"


def _in_order_sql(colors: int) -> str:
    """Subpalettes of up to ``colors`` in the order they are used in: the picture's first colour, which all tiles have here, and the others sorted."""
    return f"""{_pack_sql(colors)},
    ob AS (SELECT image_id, bins, list_sort(list_transform(range(1, len(bins) + 1), lambda i: [-len(bins[i]), i])) AS by_size FROM bins),
    pu AS (SELECT image_id, generate_subscripts(by_size, 1) - 1 AS palette, bins[unnest(by_size)[2]] AS colors FROM ob),
    co AS (SELECT image_id, c AS col0 FROM rx WHERE seq = 0 AND p = 0),
    pk AS (SELECT image_id, palette, c, c = col0 AS front, {_key_sql("c")} AS key FROM (SELECT image_id, palette, unnest(colors) AS c FROM pu) JOIN co USING (image_id)),
    po AS (SELECT image_id, palette, list(c ORDER BY front DESC, key) AS colors FROM pk GROUP BY image_id, palette)"""


_PACKED_MAP_SQL = """tt AS (SELECT rx.image_id, rx.seq, po.palette, list(list_position(po.colors, c) - 1 ORDER BY p) AS data
    FROM rx JOIN cs USING (image_id, seq) JOIN po ON po.image_id = rx.image_id AND len(list_filter(cs.colors, lambda x: NOT list_contains(po.colors, x))) = 0 GROUP BY rx.image_id, rx.seq, po.palette),
di AS (SELECT image_id, seq, arg_min(data, palette) AS data FROM tt GROUP BY image_id, seq)"""


def _packed_map_sql(cut: int = 1 << 20, most: int = 1 << 20) -> str:
    """Entries over all subpalettes that hold a tile, for a tileset of which the first ``cut`` tiles are left and a map that counts up to ``most``."""
    flip = lambda by: f"list_transform(range(64), lambda p: data[{by} + 1])"
    return f"""WITH {PIXELS_SQL}, {_in_order_sql(8)}, {_PACKED_MAP_SQL}, {_FLIP_SQL},
    pf AS (SELECT *, {flip("p // 8 * 8 + 7 - p % 8")} AS fh, {flip("(7 - p // 8) * 8 + p % 8")} AS fv, list_reverse(data) AS fhv FROM tt),
    pc AS (SELECT *, least(data, fh, fv, fhv) AS canon FROM pf),
    hit AS (SELECT pc.image_id, pc.seq, palette, tile, CASE WHEN data = first THEN 0 WHEN fh = first THEN 1 WHEN fv = first THEN 2 ELSE 3 END AS how
        FROM pc JOIN ts ON ts.image_id = pc.image_id AND ts.canon = pc.canon AND ts.tile < {cut}),
    be AS (SELECT image_id, seq, min([palette, tile, how]) AS b FROM hit GROUP BY image_id, seq),
    en AS (SELECT cs.image_id, cs.seq, b IS NOT NULL AS matched, coalesce(b[2] < {most}, false) AS ok, b FROM cs LEFT JOIN be USING (image_id, seq)),
    me AS (SELECT image_id, CAST(seq AS INT) AS seq, CAST(CASE WHEN ok THEN b[2] ELSE 0 END AS INT) AS tile, CAST(CASE WHEN ok THEN b[1] ELSE 0 END AS INT) AS palette,
        ok AND b[3] IN (1, 3) AS flip_h, ok AND b[3] IN (2, 3) AS flip_v, matched FROM en)"""


PACKED = Options(mode="snes", bpp=4)


def _packed_in_order(spark: SparkSession, sf_dir: str, colors: int) -> DataFrame:
    own = event_shapes(spark, sf_dir)
    firsts = first_colors(own, PACKED)
    sets = palettes.maximal_sets(palettes.distinct_sets(palettes.color_sets(own, SNES, firsts)))
    return palettes.packed(sets, SNES, colors, firsts)


@query("packed_palettes_in_order", f"WITH {PIXELS_SQL}, {_in_order_sql(8)} SELECT image_id, CAST(palette AS INT) AS palette, array_to_string(colors, ',') AS colors FROM po")
def packed_palettes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _packed_in_order(spark, sf_dir, 8)
    return found.select("image_id", F.posexplode("palettes").alias("palette", "p")).select("image_id", "palette", _list("p").alias("colors"))


def _packed_entries(spark: SparkSession, sf_dir: str, cut: int | None = None, m: Mode = SNES) -> DataFrame:
    own, found = event_shapes(spark, sf_dir), _packed_in_order(spark, sf_dir, 8)
    tileset = build_tileset(own, found, PACKED)
    return maps.build(own, found, tileset if cut is None else tileset.where(F.col("tile") < cut), m)


@query("map_entries_packed", f"{_packed_map_sql()} SELECT * FROM me")
def map_entries_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps over several subpalettes."""
    return _packed_entries(spark, sf_dir)


@query("map_entries_missing", f"{_packed_map_sql(4, 3)} SELECT * FROM me")
def map_entries_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a tileset of only four tiles and a mode that counts up to three, so that tiles are missing or out of reach."""
    return _packed_entries(spark, sf_dir, 4, replace(SNES, max_tiles=3))


@query("palette_map_packed", f"{_packed_map_sql()} SELECT image_id, string_agg(printf('%02x%02x', palette & 255, palette >> 8), '' ORDER BY seq) AS hex FROM me GROUP BY image_id")
def palette_map_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _packed_entries(spark, sf_dir).withColumns({"x": F.col("seq") % COLUMNS, "y": F.expr(f"seq div {COLUMNS}").cast("int")})
    return maps.palette_map(maps.stored(entries, 32, 32))


@query("tileset_overflow", f"WITH {PIXELS_SQL}, {_INDEX_SQL}, {_FLIP_SQL} SELECT image_id, count(*) AS tiles, CAST(sum(uses) - count(*) AS BIGINT) AS discarded, count(*) > 4 AS overflow FROM ts GROUP BY image_id")
def tileset_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.check_capacity(tiles.dedupe(_indexed(spark, sf_dir)), replace(SNES, max_tiles=4))


@query("tileset_all", f"WITH {PIXELS_SQL}, {_INDEX_SQL} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY seq) - 1 AS INT) AS tile, array_to_string(data, ',') AS data FROM di")
def tileset_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilesets that keep repeated tiles."""
    return tiles.numbered(tiles.spread(_indexed(spark, sf_dir))).select("image_id", "tile", _list("data").alias("data"))


@query("tileset_colors", f"WITH {PIXELS_SQL}, {_INDEX_SQL}, {_FLIP_SQL} SELECT image_id, CAST(tile % 16 * 8 + p % 8 AS INT) AS x, CAST(tile // 16 * 8 + p // 8 AS INT) AS y, {_normalize_sql('snes', 'pal.colors[first[p + 1] + 1]')} AS rgba FROM ts JOIN pal USING (image_id), range(64) r(p)")
def tileset_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of tilesets in their colours."""
    found = tiles.dedupe(_indexed(spark, sf_dir).withColumn("palette", F.lit(0)))
    return outputs.tileset_colors(found, _sorted_palette(spark, sf_dir), SNES).select("image_id", "x", "y", F.col("rgba").cast("decimal(38,0)").cast("long").alias("rgba"))


@query(
    "map_filled",
    f"""WITH {PIXELS_SQL}, im AS (SELECT DISTINCT image_id FROM ev), tl AS (SELECT image_id, seq % 32 AS tx, seq // 32 AS ty, string_agg(rgba, ',' ORDER BY p) AS pixels FROM px GROUP BY image_id, seq)
    SELECT im.image_id, CAST(n AS INT) AS seq, coalesce(pixels, array_to_string(list_transform(range(64), lambda i: 0), ',')) AS pixels
    FROM im CROSS JOIN range(1400) r(n) LEFT JOIN tl ON tl.image_id = im.image_id AND tx = n % 40 AND ty = n // 40""",
)
def map_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images cut and filled up to maps of 40 by 35 tiles."""
    return tiles.grid(event_tiles(spark, sf_dir), 40, 35).select("image_id", "seq", _list("rgba").alias("pixels"))


@query(
    "png_scaled",
    f"""WITH {PIXELS_SQL}, w AS (SELECT image_id, 256 AS width, CAST(max(seq // 32 * 8 + p // 8) + 1 AS INT) AS height FROM px GROUP BY image_id),
    q AS (SELECT image_id, seq % 32 * 8 + p % 8 AS x, seq // 32 * 8 + p // 8 AS y, {_normalize_sql('snes', 'c')} AS rgba FROM rx)
    SELECT w.image_id, width, height, md5(string_agg(coalesce(rgba, 0)::BIGINT, ',' ORDER BY n)) AS pixels FROM w CROSS JOIN range(65536) r(n)
    LEFT JOIN q ON q.image_id = w.image_id AND q.x = n % 256 AND q.y = n // 256 WHERE n < width * height GROUP BY w.image_id, width, height""",
)
def png_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images at the mode's depth as PNG files, which are read again."""
    own = event_pixels(spark, sf_dir).withColumn("rgba", color.normalize(color.reduce(F.col("rgba"), SNES), SNES))
    read = png.as_files(own).select("image_id", png.decoded("content").alias("image"))
    return read.select("image_id", "image.width", "image.height", F.md5(_list("image.rgba").cast("binary")).alias("pixels"))


def _with_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of all images and of one more, whose tiles have too many colours."""
    noise = event_colors(spark, sf_dir).select(F.lit(-1).cast("long").alias("image_id"), (F.col("event_id") % 8).alias("x"), F.expr("event_id div 8").alias("y"), F.col("rgba").bitwiseOR(F.lit(0xFF000000)).alias("rgba"))
    return event_pixels(spark, sf_dir).unionByName(noise)


@query(
    "convert_native",
    f"""WITH {PIXELS_SQL}, {_in_order_sql(4)}, {_PACKED_MAP_SQL}, {_FLIP_SQL},
    pn AS (SELECT image_id, string_agg(rpad(hex, 16, '0'), '' ORDER BY palette) AS palette_hex FROM (
        SELECT image_id, palette, string_agg(printf('%02x%02x', w & 255, w >> 8), '' ORDER BY i) AS hex FROM (
            SELECT image_id, palette, i, {_WORD_SQL['snes'].format(*_CH)} AS w FROM (SELECT image_id, palette, unnest(colors) AS c, generate_subscripts(colors, 1) AS i FROM po)) GROUP BY ALL) GROUP BY image_id),
    pl AS (SELECT image_id, tile, p // 8 * 2 + pl AS b, CAST(sum(((first[p + 1] >> pl) & 1) << (7 - p % 8)) AS BIGINT) AS v FROM ts, range(64) r(p), range(2) s(pl) GROUP BY ALL),
    tn AS (SELECT image_id, string_agg(printf('%02x', v), '' ORDER BY tile, b) AS tiles_hex FROM pl GROUP BY image_id),
    pf AS (SELECT tt.*, first, tile FROM (SELECT *, list_transform(range(64), lambda p: data[p // 8 * 8 + 7 - p % 8 + 1]) AS fh, list_transform(range(64), lambda p: data[(7 - p // 8) * 8 + p % 8 + 1]) AS fv,
        list_reverse(data) AS fhv FROM tt) tt JOIN ts ON ts.image_id = tt.image_id AND ts.canon = least(data, fh, fv, fhv)),
    be AS (SELECT image_id, seq, min([palette, tile, CASE WHEN data = first THEN 0 WHEN fh = first THEN 1 WHEN fv = first THEN 2 ELSE 3 END]) AS b FROM pf GROUP BY image_id, seq),
    mn AS (SELECT image_id, string_agg(printf('%02x%02x', b[2] & 255, (b[2] // 256 & 3) + (b[1] & 7) * 4 + (b[3] % 2) * 64 + (b[3] // 2) * 128), '' ORDER BY seq) AS map_hex FROM be GROUP BY image_id)
    SELECT image_id, CAST(NULL AS VARCHAR) AS problem, palette_hex, tiles_hex, map_hex FROM pn JOIN tn USING (image_id) JOIN mn USING (image_id)
    UNION ALL SELECT -1, 'colors do not fit in a palette', NULL, NULL, NULL""",
)
def convert_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversions; one image more has tiles of too many colours, which holds up none of the others."""
    options = Options(bpp=2)
    return native(convert(_with_noise(spark, sf_dir), options), options, 32, 32)


_JSON_LINES = """'{{\n  "palettes": [\n    [\n' || string_agg('      "' || printf('#%02x%02x%02x', {full}) || '"', ',\n' ORDER BY i) || '\n    ]\n  ],\n  "palettes_native_rgb": [\n    [\n'
    || string_agg(printf('      [\n        %d,\n        %d,\n        %d\n      ]', {parts}), ',\n' ORDER BY i) || '\n    ]\n  ]\n}}'"""


@query("palette_json_indented", f"WITH {PIXELS_SQL}, {_COLORS_OF_SQL} SELECT image_id, {_JSON_LINES.format(full=', '.join(_FULL_SQL), parts=', '.join(_CH))} AS json FROM pc GROUP BY image_id")
def palette_json_indented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted_palette(spark, sf_dir).select("image_id", outputs.palette_json(F.col("palettes"), SNES, indented=True).alias("json"))


@query("palette_read_json", f"WITH {PIXELS_SQL}, {_INDEX_SQL} SELECT image_id, CAST(0 AS INT) AS palette, array_to_string(colors, ',') AS colors FROM pal")
def palette_read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes read back from their JSON documents."""
    told = _sorted_palette(spark, sf_dir).select("image_id", outputs.palette_json(F.col("palettes"), SNES, indented=True).alias("json"))
    read = told.select("image_id", F.posexplode(sources.palettes_from_json(F.col("json"), SNES)).alias("palette", "p"))
    return read.select("image_id", "palette", _list("p").alias("colors"))


@query("palette_read_native", f"WITH {PIXELS_SQL}, {_INDEX_SQL} SELECT image_id, CAST(k AS INT) AS palette, array_to_string(colors[k * 4 + 1:k * 4 + 4], ',') AS colors FROM pal, range(4) r(k)")
def palette_read_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes read back from their native bytes, in subpalettes of four colours."""
    told = _sorted_palette(spark, sf_dir).select("image_id", outputs.palette_native(F.col("palettes"), SNES).alias("hex"))
    read = told.select("image_id", F.posexplode(sources.palettes_from_native(F.col("hex"), SNES, 4)).alias("palette", "p"))
    return read.select("image_id", "palette", _list("p").alias("colors"))


@query("tiles_read_native", f"WITH {PIXELS_SQL}, {_INDEX_SQL}, {_FLIP_SQL} SELECT image_id, CAST(tile AS INT) AS tile, array_to_string(first, ',') AS data FROM ts")
def tiles_read_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilesets read back from their native bytes."""
    told = outputs.tileset_native(tiles.dedupe(_indexed(spark, sf_dir)), SNES)
    return sources.tiles_of(told.select("image_id", F.unhex("hex").alias("content")), SNES).select("image_id", "tile", _list("data").alias("data"))


@query(
    "conversion_diagnostics",
    f"""WITH {PIXELS_SQL}, {_in_order_sql(4)}, {_PACKED_MAP_SQL}, {_FLIP_SQL}
    SELECT image_id, 'too many tiles' AS problem FROM ts GROUP BY image_id HAVING count(*) > 4 UNION ALL SELECT -1, 'colors do not fit in a palette'""",
)
def conversion_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds up conversions: too many colours in one image, and tilesets of more than four tiles in others."""
    return convert(_with_noise(spark, sf_dir), Options(bpp=2, max_tiles=4)).diagnostics.select("image_id", "problem")


def _shared_sql(cut: int) -> str:
    """Maps of all images in the palettes and the first ``cut`` tiles of image 0."""
    flip = lambda by: f"list_transform(range(64), lambda p: data[{by} + 1])"
    return f"""WITH {PIXELS_SQL}, {_in_order_sql(8)}, {_PACKED_MAP_SQL}, {_FLIP_SQL},
    t0 AS (SELECT canon, first, tile FROM ts WHERE image_id = 0 AND tile < {cut}),
    tf AS (SELECT rx.image_id, rx.seq, po.palette, list(list_position(po.colors, c) - 1 ORDER BY p) AS data
        FROM rx JOIN cs USING (image_id, seq) JOIN po ON po.image_id = 0 AND len(list_filter(cs.colors, lambda x: NOT list_contains(po.colors, x))) = 0 GROUP BY rx.image_id, rx.seq, po.palette),
    pf AS (SELECT *, {flip("p // 8 * 8 + 7 - p % 8")} AS fh, {flip("(7 - p // 8) * 8 + p % 8")} AS fv, list_reverse(data) AS fhv FROM tf),
    hit AS (SELECT pf.image_id, pf.seq, palette, tile, CASE WHEN data = first THEN 0 WHEN fh = first THEN 1 WHEN fv = first THEN 2 ELSE 3 END AS how FROM pf JOIN t0 ON t0.canon = least(data, fh, fv, fhv)),
    be AS (SELECT image_id, seq, min([palette, tile, how]) AS b FROM hit GROUP BY image_id, seq)
    SELECT cs.image_id, CAST(cs.seq AS INT) AS seq, CAST(coalesce(b[2], 0) AS INT) AS tile, CAST(coalesce(b[1], 0) AS INT) AS palette, coalesce(b[3] IN (1, 3), false) AS flip_h, coalesce(b[3] IN (2, 3), false) AS flip_v, b IS NOT NULL AS matched
    FROM cs LEFT JOIN be USING (image_id, seq)"""


def _shared_entries(spark: SparkSession, sf_dir: str, few: int) -> DataFrame:
    own, first = event_shapes(spark, sf_dir), event_shapes(spark, sf_dir).where("image_id = 0")
    sets = palettes.maximal_sets(palettes.distinct_sets(palettes.color_sets(first, SNES, first_colors(first, PACKED))))
    found = palettes.packed(sets, SNES, 8, first_colors(first, PACKED)).persist()
    tileset = build_tileset(first, found, PACKED).where("tile < 4").drop("image_id")
    return maps.build_shared(own, found.drop("image_id"), tileset, SNES, few=few)


@query("map_shared_tileset", _shared_sql(4))
def map_shared_tileset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of all images in one image's palettes and four of its tiles."""
    return _shared_entries(spark, sf_dir, maps.FEW_KINDS)


@query("map_shared_tileset_salted", _shared_sql(4))
def map_shared_tileset_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the way for more kinds of tiles than are broadcast."""
    return _shared_entries(spark, sf_dir, 0)


_MANY = [m for m in MODES.values() if m.name != "pce_sprite"]  # sprites have no maps
_MANY_SQL = f"""WITH {PIXELS_SQL.split("rx AS")[0].rstrip().rstrip(",")},
md(mode, k, n, flip, shared, most, reach) AS (VALUES {", ".join(f"('{m.name}', {list(MODES).index(m.name)}, {m.colors}, {m.flip}, {m.col0_shared}, {m.palettes}, {m.max_tiles})" for m in _MANY)}),
tl AS (SELECT image_id, seq, list(rgba ORDER BY p) AS rgba FROM px GROUP BY image_id, seq),
sh AS (SELECT image_id, rgba, min(seq) AS seq, list(seq) AS seqs FROM tl GROUP BY image_id, rgba),
re AS (SELECT image_id * 16 + k AS id, sh.seq, md.*, p, CASE mode {" ".join(f"WHEN '{m.name}' THEN {_reduce_sql(m.name, 'rgba[p + 1]')}" for m in _MANY)} END AS c FROM sh, md, range(64) r(p)),
st AS (SELECT id, any_value(n) AS n, any_value(flip) AS flip, any_value(shared) AS shared, any_value(most) AS most, any_value(reach) AS reach FROM re GROUP BY id),
co AS (SELECT id AS image_id, c AS col0 FROM re WHERE seq = 0 AND p = 0 AND shared),
ow AS (SELECT id AS image_id, seq, list_sort(list(DISTINCT c)) AS colors FROM re GROUP BY id, seq),
cs AS (SELECT image_id, seq, CASE WHEN col0 IS NULL THEN colors ELSE list_sort(list_distinct(list_append(colors, col0))) END AS colors FROM ow LEFT JOIN co USING (image_id)),
ds AS (SELECT image_id, colors, min(seq) AS seq FROM cs GROUP BY image_id, colors),
ms AS (SELECT a.*, n FROM ds a JOIN st ON st.id = a.image_id WHERE NOT EXISTS (SELECT 1 FROM ds b WHERE b.image_id = a.image_id AND len(b.colors) > len(a.colors) AND len(list_filter(a.colors, lambda x: NOT list_contains(b.colors, x))) = 0)),
{_pack_sql("n").replace("GROUP BY image_id)", "GROUP BY image_id, n)").replace("SELECT image_id, list([colors]", "SELECT image_id, n, list([colors]")},
ok AS (SELECT bins.* FROM bins JOIN st ON st.id = image_id WHERE len(bins) <= most AND len(list_filter(bins, lambda b: len(b) > n)) = 0),
ob AS (SELECT image_id, bins, list_sort(list_transform(range(1, len(bins) + 1), lambda i: [-len(bins[i]), i])) AS by_size FROM ok),
pu AS (SELECT image_id, generate_subscripts(by_size, 1) - 1 AS palette, bins[unnest(by_size)[2]] AS colors FROM ob),
pk AS (SELECT image_id, palette, c, c = coalesce(col0, low) AS front, {_key_sql("c")} AS key FROM (SELECT image_id, palette, list_min(colors) AS low, unnest(colors) AS c FROM pu) LEFT JOIN co USING (image_id)),
po AS (SELECT image_id, palette, list(c ORDER BY front DESC, key) AS colors FROM pk GROUP BY image_id, palette),
tt AS (SELECT re.id AS image_id, re.seq, po.palette, any_value(re.flip) AS flip, list(list_position(po.colors, c) - 1 ORDER BY p) AS data
    FROM re JOIN ow ON ow.image_id = re.id AND ow.seq = re.seq JOIN po ON po.image_id = re.id AND len(list_filter(ow.colors, lambda x: NOT list_contains(po.colors, x))) = 0 GROUP BY re.id, re.seq, po.palette),
pf AS (SELECT *, list_transform(range(64), lambda p: data[p // 8 * 8 + 7 - p % 8 + 1]) AS fh, list_transform(range(64), lambda p: data[(7 - p // 8) * 8 + p % 8 + 1]) AS fv, list_reverse(data) AS fhv FROM tt),
pc AS (SELECT *, CASE WHEN flip THEN least(data, fh, fv, fhv) ELSE data END AS canon FROM pf),
fi AS (SELECT image_id, seq, arg_min(data, palette) AS data, arg_min(canon, palette) AS canon FROM pc GROUP BY image_id, seq),
ts AS (SELECT image_id, canon, arg_min(data, seq) AS first, row_number() OVER (PARTITION BY image_id ORDER BY min(seq)) - 1 AS tile FROM fi GROUP BY image_id, canon),
be AS (SELECT pc.image_id, pc.seq, min([palette, tile, CASE WHEN data = first THEN 0 WHEN fh = first THEN 1 WHEN fv = first THEN 2 ELSE 3 END]) AS b FROM pc JOIN ts ON ts.image_id = pc.image_id AND ts.canon = pc.canon GROUP BY pc.image_id, pc.seq),
en AS (SELECT sh.image_id, md.k, unnest(seqs) AS seq, b IS NOT NULL AS matched, coalesce(reach = 0 OR b[2] < reach, false) AND b IS NOT NULL AS ok, b FROM sh CROSS JOIN md LEFT JOIN be ON be.image_id = sh.image_id * 16 + k AND be.seq = sh.seq)
SELECT image_id * 16 + k AS image_id, CAST(seq AS INT) AS seq, CAST(seq % 32 AS INT) AS x, CAST(seq // 32 AS INT) AS y, CAST(CASE WHEN ok THEN b[2] ELSE 0 END AS INT) AS tile, CAST(CASE WHEN ok THEN b[1] ELSE 0 END AS INT) AS palette,
    ok AND b[3] IN (1, 3) AS flip_h, ok AND b[3] IN (2, 3) AS flip_v, matched FROM en"""


@query("convert_modes", _MANY_SQL)
def convert_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of each picture in all sixteen modes, in one job; a mode without palettes matches no tile, sprites have no maps."""
    pictures = event_pixels(spark, sf_dir).withColumnRenamed("image_id", "source_id")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("mode")) for k, name in enumerate(MODES)])).alias("asked")
    requests = event_tiles(spark, sf_dir).select(F.col("image_id").alias("source_id")).distinct().select("source_id", asked).select("source_id", (F.col("source_id") * 16 + F.col("asked.k")).alias("image_id"), "asked.mode")
    return convert_many(pictures, requests).entries


def _all_modes_sql(select: Callable[[str], str]) -> str:
    return " UNION ALL ".join(select(name) for name in MODES)


def _over_modes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """SQL over view colors of all events in all modes, the mode being a column. The sixteen names are spread by a generator, not a join."""
    sql.register(spark)
    names = ", ".join(f"'{name}'" for name in MODES)
    event_colors(spark, sf_dir).createOrReplaceTempView("colors")
    return spark.sql(f"SELECT event_id, mode, {', '.join(columns)} FROM (SELECT *, explode(array({names})) AS mode FROM colors)")


@query("sql_reduce_modes", _all_modes_sql(lambda n: f"SELECT event_id, '{n}' AS mode, {_reduce_sql(n)} AS reduced FROM ({COLORS_SQL})"))
def sql_reduce_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_modes(spark, sf_dir, "tile_reduce(rgba, mode) AS reduced")


@query("sql_normalize_modes", _all_modes_sql(lambda n: f"SELECT event_id, '{n}' AS mode, {_normalize_sql(n, 'c')} AS normalized FROM (SELECT event_id, {_reduce_sql(n)} AS c FROM ({COLORS_SQL}))"))
def sql_normalize_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_modes(spark, sf_dir, "tile_normalize(tile_reduce(rgba, mode), mode) AS normalized")


_GREY_WORD_SQL = {"gb": "3 - (c & 3)", "ws": "7 - (c & 7)", "ngp": "7 - (c & 7)"}


@query(
    "sql_color_words",
    _all_modes_sql(lambda n: f"SELECT event_id, '{n}' AS mode, {_GREY_WORD_SQL.get(n) or _WORD_SQL[n].format(*_CH)} AS word FROM (SELECT event_id, {_reduce_sql(n)} AS c FROM ({COLORS_SQL}))"),
)
def sql_color_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_modes(spark, sf_dir, "tile_color_word(tile_reduce(rgba, mode), mode) AS word")


def _mode_entry_sql(name: str) -> str:
    low, high = "printf('%02x', t & 255)", _ENTRY_SQL.get(name)
    told = "''" if name not in _ENTRY_SQL else low if high is None else f"{low} || printf('%02x', {high})"
    return f"SELECT event_id, '{name}' AS mode, {told} AS native FROM (SELECT event_id, rgba % 2048 AS t, user_id % 16 AS p, event_id // 2 % 2 AS h, event_id // 4 % 2 AS v FROM ({COLORS_SQL}))"


@query("sql_map_entries", _all_modes_sql(_mode_entry_sql))
def sql_map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "CAST(rgba % 2048 AS INT), CAST(user_id % 16 AS INT), event_id div 2 % 2 = 1, event_id div 4 % 2 = 1"
    return _over_modes(spark, sf_dir, f"tile_entry({own}, mode) AS native")


@query("sql_hex_color", f"SELECT event_id, printf('#%02x%02x%02x', rgba & 255, (rgba >> 8) & 255, (rgba >> 16) & 255) AS hex, printf('#%02x%02x%02x%02x', rgba & 255, (rgba >> 8) & 255, (rgba >> 16) & 255, rgba >> 24) AS hex_alpha FROM ({COLORS_SQL})")
def sql_hex_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    event_colors(spark, sf_dir).createOrReplaceTempView("colors")
    return spark.sql("SELECT event_id, tile_hex(rgba) AS hex, tile_hex_alpha(rgba) AS hex_alpha FROM colors")


_REPORT_SQL = f"""WITH {PIXELS_SQL}, {_in_order_sql(4)}, {_PACKED_MAP_SQL}, {_FLIP_SQL},
    rp AS (SELECT image_id, string_agg(CAST(len(colors) AS VARCHAR), ',' ORDER BY palette) AS sizes, count(*) AS n, CAST(sum(len(colors)) AS BIGINT) AS colors, min_by(colors, palette)[1] AS c FROM po GROUP BY image_id),
    rt AS (SELECT image_id, count(*) AS tiles, CAST(sum(uses) - count(*) AS BIGINT) AS discarded FROM ts GROUP BY image_id),
    rm AS (SELECT image_id, count(*) AS mapped FROM cs GROUP BY image_id)"""


@query("conversion_sizes", f"{_REPORT_SQL} SELECT image_id, CAST(NULL AS VARCHAR) AS problem, sizes, tiles, discarded, mapped, CAST(0 AS BIGINT) AS unmatched FROM rp JOIN rt USING (image_id) JOIN rm USING (image_id) UNION ALL SELECT -1, 'colors do not fit in a palette', NULL, 0, 0, count(DISTINCT event_id // 64), count(DISTINCT event_id // 64) FROM events")
def conversion_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of each subpalette, tiles kept and discarded, and places mapped, of each image."""
    return sizes(convert(_with_noise(spark, sf_dir), Options(bpp=2))).withColumn("sizes", _list("sizes"))


@query(
    "conversion_report",
    f"""{_REPORT_SQL} SELECT image_id, CAST(NULL AS VARCHAR) AS problem, 'Mapping optimized palette (8x4 entries)' || chr(10) || 'Setting color zero to ' || printf('#%02x%02x%02x', {', '.join(_CH)}) || chr(10)
    || 'Created palette with ' || colors || ' colors' || CASE WHEN n > 1 THEN ' [' || sizes || ']' ELSE '' END || chr(10) || 'Created optimized tileset with ' || tiles || ' entries (discarded ' || discarded || ' redundant tiles)' || chr(10)
    || 'Mapping ' || mapped || ' 8x8px tiles from image' AS report FROM rp JOIN rt USING (image_id) JOIN rm USING (image_id) UNION ALL SELECT -1, 'colors do not fit in a palette', NULL""",
)
def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as lines of text."""
    options = Options(bpp=2)
    return reports(convert(_with_noise(spark, sf_dir), options), options)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilesets without repeats, their tiles in native form."""
    found = tiles.dedupe(_indexed(spark, sf_dir))
    return found.select("image_id", "tile", codec.pack_tile(F.col("data"), SNES, 4).alias("data_hex"), "uses")
