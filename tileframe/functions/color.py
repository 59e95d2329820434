"""Colours as columns: longs with red in the low byte, then green, blue and alpha."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.modes import TRANSPARENT, Mode

OPAQUE = 0xFF000000


def channel(c: Column, k: int) -> Column:
    """Red, green, blue or alpha (k from 0 to 3) of a colour."""
    return F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(0xFF))


def joined(r: Column, g: Column, b: Column, a: Column | int = 0xFF) -> Column:
    a = a if isinstance(a, Column) else F.lit(a)
    wide = [x.cast("long") for x in (r, g, b, a)]
    return wide[0] + F.shiftleft(wide[1], 8) + F.shiftleft(wide[2], 16) + F.shiftleft(wide[3], 24)


def gated(c: Column) -> Column:
    """A colour, all zero if its alpha is below 128."""
    return F.when(channel(c, 3) < 0x80, F.lit(TRANSPARENT).cast("long")).otherwise(c)


def luma(c: Column) -> Column:
    """Brightness of a colour, cut to a whole number."""
    r, g, b = (channel(c, k).cast("double") for k in range(3))
    return (F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b).cast("int")


def reduce(c: Column, m: Mode) -> Column:
    """A colour at the depth that the mode has; one of alpha below 128 counts as transparent, or as black where the mode has no such colour."""
    if m.reduce == "grey4":
        y = luma(c)
        out = F.when(y <= 0x40, 0).when(y <= 0x80, 1).when(y <= 0xC0, 2).otherwise(3) * F.lit(0x010101).cast("long") + OPAQUE
    elif m.reduce == "grey8":
        out = F.shiftright(luma(c), 5) * F.lit(0x010101).cast("long") + OPAQUE
    else:
        cut = 8 - int(m.reduce)
        part = lambda k: F.shiftleft(F.shiftrightunsigned(c, 8 * k + cut).bitwiseAND(F.lit((1 << 8 - cut) - 1)), 8 * k)
        out = part(0) + part(1) + part(2) + OPAQUE
    return F.when(c.bitwiseAND(F.lit(1 << 31)) == 0, F.lit(TRANSPARENT if m.gated else OPAQUE).cast("long")).otherwise(out)


def _replicated(value: Column, bits: int) -> Column:
    """A channel of few bits spread over eight, by repeating its bits."""
    out, at = F.lit(0), 8 - bits
    while at > -bits:
        out = out.bitwiseOR(F.shiftleft(value, at) if at >= 0 else F.shiftright(value, -at))
        at -= bits
    return out.bitwiseAND(F.lit(0xFF))


def normalize(c: Column, m: Mode) -> Column:
    """A reduced colour back at eight bits a channel; alpha too, of which only the low bits count."""
    bits = {"grey4": 2, "grey8": 3}.get(m.reduce) or int(m.reduce)
    return joined(*(_replicated(channel(c, k), bits) for k in range(4)))


def hex_of(c: Column, alpha: bool = False) -> Column:
    """#rrggbb, or #rrggbbaa."""
    parts = [F.lpad(F.lower(F.hex(channel(c, k))), 2, "0") for k in range(4 if alpha else 3)]
    return F.concat(F.lit("#"), *parts)


def from_hex(text: Column) -> Column:
    """The colour of six or eight hex digits, with or without marks around them; other lengths are an error."""
    plain = F.regexp_replace(text, "[#\"']", "")
    full = F.when(F.length(plain) == 6, F.concat(plain, F.lit("ff"))).otherwise(plain)
    part = lambda k: F.conv(F.substring(full, 2 * k + 1, 2), 16, 10).cast("long")
    return F.when(F.length(full) == 8, joined(*(part(k) for k in range(4)))).otherwise(
        F.raise_error(F.concat(F.lit("not a colour: "), text)).cast("long")
    )


def reversed_bytes(c: Column) -> Column:
    return joined(*(channel(c, k) for k in (3, 2, 1, 0)))


def hsv(c: Column) -> Column:
    """Hue in degrees, saturation and value (the largest channel), as floats."""
    r, g, b = (channel(c, k).cast("float") for k in range(3))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("float")
    turn = lambda x, y, off: (F.lit(60.0).cast("float") * (((x - y) / span).cast("float") + F.lit(off).cast("float"))).cast("float")
    hue = F.when(span == 0, F.lit(0.0)).when(top == r, turn(g, b, 0.0)).when(top == g, turn(b, r, 2.0)).otherwise(turn(r, g, 4.0)).cast("float")
    hue = F.when(hue < 0, hue + F.lit(360.0).cast("float")).otherwise(hue).cast("float")
    return F.struct(hue.alias("h"), F.when(span > 0, (span / top).cast("float")).otherwise(F.lit(0.0)).cast("float").alias("s"), top.alias("v"))


def sort_key(c: Column) -> Column:
    """What colours of a palette are sorted by: hue, brightness and value in eighths; then the colour, so that ties are settled."""
    parts = hsv(c)
    r, g, b = (channel(c, k).cast("float") for k in range(3))
    light = F.sqrt(F.lit(0.241) * r + F.lit(0.691) * g + F.lit(0.068) * b)
    return F.struct(
        F.floor(parts["h"] * 8).cast("int").alias("h"), F.floor(light * 8).cast("int").alias("l"), F.floor(parts["v"] * 8).cast("int").alias("v"), c.alias("c")
    )
