"""Native formats of colours, map entries and tiles, as columns; bytes are given as lower-case hex."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.modes import Mode
from .color import OPAQUE, channel

# Where red, green and blue lie in a native colour word, their bits, and its bytes.
WORDS = {
    **dict.fromkeys(("snes", "snes_mode7", "gbc", "gba", "gba_affine"), ((0, 5, 10), 5, 2)),
    "md": ((1, 5, 9), 3, 2),
    **dict.fromkeys(("pce", "pce_sprite"), ((3, 6, 0), 3, 2)),
    **dict.fromkeys(("wsc", "wsc_packed", "gg"), ((8, 4, 0), 4, 2)),
    "ngpc": ((0, 4, 8), 4, 2),
    "sms": ((0, 2, 4), 2, 1),
}
#: Where reading differs from writing: gg reads red and blue the other way round, pce reads blue as green.
READ = {"gg": ((0, 4, 8), 4, 2)}

# Second byte of a map entry, (field, lowest bit taken, bits, place).
ENTRIES = {
    "snes": (("tile", 8, 2, 0), ("palette", 0, 3, 2), ("flip_h", 0, 1, 6), ("flip_v", 0, 1, 7)),
    "snes_mode7": None,
    "gb": None,
    "gba_affine": None,
    **dict.fromkeys(("sms", "gg"), (("tile", 8, 1, 0), ("flip_h", 0, 1, 1), ("flip_v", 0, 1, 2), ("palette", 0, 1, 3))),
    "gbc": (("palette", 0, 3, 0), ("tile", 8, 1, 3), ("flip_h", 0, 1, 5), ("flip_v", 0, 1, 6)),
    "gba": (("tile", 8, 2, 0), ("flip_h", 0, 1, 2), ("flip_v", 0, 1, 3), ("palette", 0, 4, 4)),
    "md": (("tile", 8, 3, 0), ("flip_h", 0, 1, 3), ("flip_v", 0, 1, 4), ("palette", 0, 2, 5)),
    "pce": (("tile", 8, 4, 0), ("palette", 0, 4, 4)),
    **dict.fromkeys(("ws", "wsc", "wsc_packed"), (("tile", 8, 1, 0), ("palette", 0, 4, 1), ("tile", 9, 1, 5), ("flip_h", 0, 1, 6), ("flip_v", 0, 1, 7))),
    "ngp": (("tile", 8, 1, 0), ("palette", 0, 1, 5), ("flip_v", 0, 1, 6), ("flip_h", 0, 1, 7)),
    "ngpc": (("tile", 8, 1, 0), ("palette", 0, 4, 1), ("flip_v", 0, 1, 6), ("flip_h", 0, 1, 7)),
}


def _bits(value: Column, low: int, width: int, to: int) -> Column:
    return F.shiftleft(F.shiftrightunsigned(value.cast("long"), low).bitwiseAND(F.lit((1 << width) - 1)), to)


def _hex_le(word: Column, size: int) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(_bits(word, 8 * k, 8, 0))), 2, "0") for k in range(size)))


def byte_hex(b: Column) -> Column:
    return F.lpad(F.lower(F.hex(b)), 2, "0")


def pack_color(c: Column, m: Mode) -> Column:
    """The native word of a reduced colour; for grey modes the inverted level."""
    if m.name == "gb":
        return F.lit(3) - channel(c, 0).bitwiseAND(F.lit(3))
    if m.name in ("ws", "ngp"):
        return channel(c, 0).bitwiseXOR(F.lit(7))
    places, width, _ = WORDS[m.name]
    return sum((_bits(c, 8 * k, width, places[k]) for k in (1, 2)), _bits(c, 0, width, places[0]))


def pack_palette(colors: Column, m: Mode) -> Column:
    """Native bytes of an array of reduced colours; gb and ws take four at once, other numbers are an error."""
    if m.name in ("gb", "ws"):
        step, size = (2, 1) if m.name == "gb" else (4, 2)
        word = sum((F.shiftleft(pack_color(F.get(colors, F.lit(k)), m).cast("long"), step * k) for k in range(1, 4)), pack_color(F.get(colors, F.lit(0)), m).cast("long"))
        return F.when(F.size(colors) == 4, _hex_le(word, size)).otherwise(F.raise_error(F.lit(f"a {m.name} palette has four colours")).cast("string"))
    size = 1 if m.name == "ngp" else WORDS[m.name][2]
    return F.array_join(F.transform(colors, lambda c: _hex_le(pack_color(c, m), size)), "")


def _byte_at(data: Column, k: Column) -> Column:
    return F.conv(F.substring(data, k * 2 + 1, F.lit(2)), 16, 10).cast("long")


def unpack_palette(data: Column, m: Mode) -> Column:
    """Reduced colours of native bytes; sizes that the mode can't have are an error."""
    grey = {"gb": 1, "ws": 2, "ngp": 4}.get(m.name)
    if grey:
        per_byte, top = 4 // grey, 3 if m.name == "gb" else 7
        levels = [_level(data, k, per_byte, top) for k in range(4)]
        out, fits = F.array(*[v * 0x010101 + OPAQUE for v in levels]), F.length(data) == 2 * grey
    else:
        places, width, size = READ.get(m.name, WORDS[m.name])
        words = F.sequence(F.lit(0), (F.length(data) / (2 * size) - 1).cast("int"))
        word = lambda i: sum((F.shiftleft(_byte_at(data, i * size + k), 8 * k) for k in range(1, size)), _byte_at(data, i * size))
        if m.name in ("pce", "pce_sprite"):
            color = lambda w: _bits(w, 3, 3, 0) + _bits(w, 0, 3, 8) + _bits(w, 10, 3, 20) + OPAQUE
        else:
            color = lambda w: sum((_bits(w, places[k], width, 8 * k) for k in range(3)), F.lit(OPAQUE))
        out = F.when(F.length(data) == 0, F.array().cast("array<long>")).otherwise(F.transform(words, lambda i: color(word(i))))
        fits = F.length(data) % (2 * size) == 0
    return F.when(fits, out).otherwise(F.raise_error(F.lit(f"not the size of a {m.name} palette")).cast("array<long>"))


def _level(data: Column, k: int, per_byte: int, top: int) -> Column:
    """Grey level k of inverted levels packed ``per_byte`` to a byte."""
    return F.lit(top) - F.shiftrightunsigned(_byte_at(data, F.lit(k // per_byte)), (k % per_byte) * (8 // per_byte)).bitwiseAND(F.lit(top))


def pack_entry(m: Mode, tile: Column, palette: Column, flip_h: Column, flip_v: Column) -> Column:
    """Native bytes of a map entry; none in modes without maps."""
    if m.name not in ENTRIES:
        return F.lit("")
    low, fields = byte_hex(_bits(tile, 0, 8, 0)), ENTRIES[m.name]
    if fields is None:
        return low
    own = {"tile": tile, "palette": palette, "flip_h": flip_h.cast("int"), "flip_v": flip_v.cast("int")}
    return F.concat(low, byte_hex(sum((_bits(own[f], at, width, to) for f, at, width, to in fields[1:]), _bits(own[fields[0][0]], *fields[0][1:]))))


def layout(m: Mode, bpp: int) -> str:
    """The name of the tile layout of a mode at a depth; depths that it has none for are an error."""
    found = {
        **dict.fromkeys(("snes", "gb", "gbc", "pce"), {1: "plane", 2: "pairs", 4: "pairs", 8: "pairs"}),
        **dict.fromkeys(("ws", "wsc", "gg", "sms"), {2: "pairs", 4: "rows"}),
        **dict.fromkeys(("ngp", "ngpc"), {2: "crumbs"}),
        "snes_mode7": {8: "raw"},
        **dict.fromkeys(("gba", "gba_affine", "md"), {4: "nibbles", 8: "raw"}),
        "wsc_packed": {4: "nibbles_high", 8: "raw"},
        "pce_sprite": {4: "sprite"},
    }[m.name].get(bpp)
    if found is None:
        raise ValueError(f"mode {m.name} has no tiles of {bpp} bpp")
    return found


def _by_plane(planes: np.ndarray, kind: str) -> np.ndarray:
    """Bytes by (tile, row of eight pixels, plane) in the order of a layout, and back for those that can be read."""
    n, rows, bpp = planes.shape
    if kind == "pairs":
        planes = planes.reshape(n, rows, bpp // 2, 2).transpose(0, 2, 1, 3)
    elif kind == "sprite":
        planes = planes.transpose(0, 2, 1)
    return planes.reshape(n, rows * bpp)


def _packed(idx: np.ndarray, kind: str, bpp: int) -> np.ndarray:
    """Bytes of tiles, one to a row; ``idx`` are their pixels."""
    n = len(idx)
    if kind == "raw":
        return idx
    if kind in ("nibbles", "nibbles_high"):
        first, second = idx[:, ::2] & 15, idx[:, 1::2] & 15
        return first | second << 4 if kind == "nibbles" else first << 4 | second
    if kind == "crumbs":  # the second half of a row comes first
        return ((idx & 3).reshape(n, 8, 2, 4)[:, :, ::-1] << np.array([6, 4, 2, 0], np.uint8)).sum(axis=3, dtype=np.uint8).reshape(n, 16)
    bits = (idx[:, :, None] >> np.arange(bpp, dtype=np.uint8) & 1).reshape(n, -1, 8, bpp)
    return _by_plane(np.packbits(bits, axis=2, bitorder="little" if kind == "sprite" else "big")[:, :, 0], kind)


def _unpacked(native: np.ndarray, kind: str, bpp: int) -> np.ndarray:
    """Pixels of tiles, 64 to a row, from their bytes."""
    n = len(native)
    if kind == "raw":
        return native
    if kind in ("nibbles", "nibbles_high"):
        both = np.stack([native & 15, native >> 4], axis=2)
        return (both if kind == "nibbles" else both[:, :, ::-1]).reshape(n, 64)
    if kind == "crumbs":
        return (native[:, :, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(n, 8, 2, 4)[:, :, ::-1].reshape(n, 64)
    planes = native.reshape(n, bpp // 2, 8, 2).transpose(0, 2, 1, 3) if kind == "pairs" else native
    bits = np.unpackbits(planes.reshape(n, 8, bpp, 1), axis=3)
    return (bits << np.arange(bpp, dtype=np.uint8)[:, None]).sum(axis=2, dtype=np.uint8).reshape(n, 64)


def pack_tile(data: Column, m: Mode, bpp: int) -> Column:
    """Native bytes of a tile's colour indices (8 by 8; 16 by 16 for sprites), of which the low ``bpp`` bits count.

    Null indices count as 0, null tiles stay null and tiles of other sizes are an error. The
    bits of a tile are moved about with numpy, a batch at once: higher-order functions take
    about a hundred times as long for them.
    """
    kind = layout(m, bpp)
    pixels = 256 if kind == "sprite" else 64

    @F.arrow_udf("string")
    def packed(tiles: pa.Array) -> pa.Array:
        own = tiles.drop_null()
        idx = np.asarray(pc.fill_null(own.flatten(), 0)).astype(np.uint8).reshape(len(own), pixels)
        told = _packed(idx, kind, bpp)
        hexes = np.ascontiguousarray(told).tobytes().hex()
        width = 2 * told.shape[1]
        found = iter([hexes[at : at + width] for at in range(0, len(hexes), width)])
        return pa.array([next(found) if there else None for there in tiles.is_valid().to_pylist()], pa.string())

    return packed(data)


def unpack_tile(data: Column, m: Mode, bpp: int) -> Column:
    """The 64 colour indices of an 8 by 8 tile's native bytes; null for null. Sprites can't be read, nor single planes."""
    kind = layout(m, bpp)
    if kind in ("sprite", "plane"):
        raise ValueError(f"tiles of mode {m.name} at {bpp} bpp can't be read")

    @F.arrow_udf("array<int>")
    def unpacked(texts: pa.Array) -> pa.Array:
        own = texts.drop_null().to_pylist()
        idx = _unpacked(np.frombuffer(bytes.fromhex("".join(own)), np.uint8).reshape(len(own), 8 * bpp), kind, bpp)
        ends = np.cumsum(np.concatenate([[0], 64 * np.asarray(texts.is_valid())]), dtype=np.int32)
        return pa.ListArray.from_arrays(ends, idx.astype(np.int32).reshape(-1), mask=texts.is_null())

    return unpacked(data)
