"""Colours and map entries from SQL: temporary functions in the SQL language, so that Catalyst inlines their bodies and no Python runs.

The mode is an argument, by name: a literal leaves one branch of the body after constant
folding, a column takes each row's own mode. Unknown modes are an error, nulls give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from ..plans.modes import MODES, TRANSPARENT, Mode
from .codec import ENTRIES, WORDS
from .color import OPAQUE


def _by_mode(body: Callable[[Mode], str]) -> str:
    """``body`` of each row's mode; modes that share a body share a branch."""
    groups: dict[str, list[str]] = {}
    for m in MODES.values():
        groups.setdefault(body(m), []).append(m.name)
    branches = " ".join(f"WHEN mode IN ({', '.join(repr(n) for n in names)}) THEN {b}" for b, names in groups.items())
    return f"CASE WHEN mode IS NULL THEN NULL {branches} ELSE raise_error(concat('no such mode: ', mode)) END"


def _channel(k: int) -> str:
    return f"(shiftrightunsigned(c, {8 * k}) & 255)"


def _reduced(m: Mode) -> str:
    luma = f"CAST(0.299D * {_channel(0)} + 0.587D * {_channel(1)} + 0.114D * {_channel(2)} AS INT)"
    if m.reduce == "grey4":
        out = f"{OPAQUE} + 65793L * CASE WHEN {luma} <= 64 THEN 0 WHEN {luma} <= 128 THEN 1 WHEN {luma} <= 192 THEN 2 ELSE 3 END"
    elif m.reduce == "grey8":
        out = f"{OPAQUE} + 65793L * shiftright({luma}, 5)"
    else:
        cut = 8 - int(m.reduce)
        out = " + ".join([str(OPAQUE), *(f"shiftleft(shiftright({_channel(k)}, {cut}), {8 * k})" for k in range(3))])
    return f"CASE WHEN {_channel(3)} < 128 THEN {TRANSPARENT if m.gated else OPAQUE}L ELSE {out} END"


def _normalized(m: Mode) -> str:
    bits = {"grey4": 2, "grey8": 3}.get(m.reduce) or int(m.reduce)
    places = range(8 - bits, -bits, -bits)
    spread = lambda v: " | ".join(f"shiftleft({v}, {at})" if at >= 0 else f"shiftright({v}, {-at})" for at in places)
    return " + ".join(f"shiftleft(({spread(_channel(k))}) & 255, {8 * k})" for k in range(4))


def _word(m: Mode) -> str:
    if m.name == "gb":
        return f"3 - ({_channel(0)} & 3)"
    if m.name in ("ws", "ngp"):
        return f"{_channel(0)} ^ 7"
    places, width, _ = WORDS[m.name]
    return " + ".join(f"shiftleft({_channel(k)} & {(1 << width) - 1}, {places[k]})" for k in range(3))


def _byte(value: str) -> str:
    return f"lpad(lower(hex({value})), 2, '0')"


def _entry(m: Mode) -> str:
    if m.name not in ENTRIES:
        return "''"
    own = {"tile": "tile", "palette": "palette", "flip_h": "CAST(flip_h AS INT)", "flip_v": "CAST(flip_v AS INT)"}
    parts = [f"shiftleft(shiftrightunsigned({own[f]}, {at}) & {(1 << width) - 1}, {to})" for f, at, width, to in ENTRIES[m.name] or ()]
    return f"concat({', '.join([_byte('tile & 255'), *([_byte(' + '.join(parts))] if parts else [])])})"


_HEX = "concat('#', lower(lpad(hex(shiftleft(c & 255, 16) + (c & 65280) + (shiftrightunsigned(c, 16) & 255)), 6, '0')))"
#: Name, arguments, type and body of each function. Colours are longs with red in the low byte.
FUNCTIONS = (
    ("tile_reduce", "c BIGINT, mode STRING", "BIGINT", _by_mode(_reduced)),
    ("tile_normalize", "c BIGINT, mode STRING", "BIGINT", _by_mode(_normalized)),
    ("tile_color_word", "c BIGINT, mode STRING", "BIGINT", _by_mode(_word)),
    ("tile_hex", "c BIGINT", "STRING", _HEX),
    ("tile_hex_alpha", "c BIGINT", "STRING", f"concat({_HEX}, {_byte('shiftrightunsigned(c, 24) & 255')})"),
    ("tile_entry", "tile INT, palette INT, flip_h BOOLEAN, flip_v BOOLEAN, mode STRING", "STRING", _by_mode(_entry)),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names. Again is harmless."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]
