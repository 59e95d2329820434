"""The video modes and what they allow: the configuration that plans are made from."""

from __future__ import annotations

from dataclasses import dataclass

TRANSPARENT = 0


@dataclass(frozen=True)
class Mode:
    """One video mode. ``reduce``: bits a channel, or a grey rule; ``gated``: whether colours of alpha below 128 become transparent."""

    name: str
    bpp: int
    bpps: tuple[int, ...]
    tile: int
    widths: tuple[int, ...]
    heights: tuple[int, ...]
    max_tiles: int
    flip: bool
    map_size: int
    palettes: int
    col0_shared: bool
    reduce: str
    gated: bool

    @property
    def colors(self) -> int:
        return 1 << self.bpp


def _mode(name: str, bpp: int, bpps: tuple, sizes: tuple, tiles: int, flip: bool, size: int, palettes: int, shared: bool, reduce: str, gated: bool) -> Mode:
    widths, heights = sizes
    return Mode(name, bpp, bpps, widths[0], widths, heights, tiles, flip, size, palettes, shared, reduce, gated)


_EIGHT, _TALL, _BOTH, _SIXTEEN = ((8,), (8,)), ((8,), (8, 16)), ((8, 16), (8, 16)), ((16,), (16,))

# What each mode's hardware has.
MODES = {
    m.name: m
    for m in (
        _mode("snes", 4, (2, 4, 8), _BOTH, 1024, True, 32, 8, True, "5", True),
        _mode("snes_mode7", 8, (8,), _EIGHT, 256, False, 128, 1, True, "5", True),
        _mode("gb", 2, (1, 2), _TALL, 256, False, 32, 1, False, "grey4", False),
        _mode("gbc", 2, (1, 2), _TALL, 512, True, 32, 8, False, "5", True),
        _mode("gba", 4, (4, 8), _EIGHT, 1024, True, 32, 16, True, "5", True),
        _mode("gba_affine", 8, (8,), _EIGHT, 256, False, 32, 1, True, "5", True),
        _mode("md", 4, (4,), _EIGHT, 2048, True, 32, 4, True, "3", True),
        _mode("pce", 4, (4,), _EIGHT, 2048, False, 32, 16, True, "3", True),
        _mode("pce_sprite", 4, (4,), _SIXTEEN, 0, False, 0, 16, True, "3", True),
        _mode("ws", 2, (1, 2), _EIGHT, 512, True, 32, 16, True, "grey8", False),
        _mode("wsc", 4, (2, 4), _EIGHT, 1024, True, 32, 16, True, "4", True),
        _mode("wsc_packed", 4, (4,), _EIGHT, 1024, True, 32, 16, True, "4", True),
        _mode("ngp", 2, (1, 2), _EIGHT, 512, True, 32, 2, True, "grey8", False),
        _mode("ngpc", 2, (2,), _EIGHT, 512, True, 32, 16, True, "4", True),
        _mode("sms", 4, (4,), _EIGHT, 512, False, 0, 2, False, "2", False),
        _mode("gg", 4, (4,), _EIGHT, 512, False, 0, 0, False, "4", True),
    )
}


def mode(name: str) -> Mode:
    if name not in MODES:
        raise ValueError(f"no such mode: {name}")
    return MODES[name]


def checked(m: Mode, bpp: int | None = None, width: int | None = None, height: int | None = None) -> tuple[int, int, int]:
    """Colour depth and tile size, those of the mode where not given; errors for what the mode doesn't allow."""
    bpp, width, height = bpp or m.bpp, width or m.tile, height or m.tile
    for what, value, allowed in (("bpp", bpp, m.bpps), ("tile width", width, m.widths), ("tile height", height, m.heights)):
        if value not in allowed:
            raise ValueError(f"{what} {value} isn't allowed in mode {m.name}")
    return bpp, width, height
