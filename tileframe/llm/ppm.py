"""Prediction by partial matching over bytes, with frozen counts.

A text is its UTF-8 bytes, A-Z in lower case, and an end symbol, each predicted from the
(up to) ``order`` bytes before it. END and START are bytes that UTF-8 never has. Counts of
every context are gathered by Spark; a model is the trie of these contexts, kept as one
sorted table a depth. A symbol unseen in a context escapes to the context one byte
shorter. Escapes are estimated by method D: with n occurrences of d symbols, an escape has
d / 2n and a symbol seen c times (2c - 1) / 2n. Symbols of the contexts escaped from are
excluded: all that a context has seen its suffix has seen too, so it is enough to take the
counts that these symbols have in the suffix off its total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

START, END = 0xFE, 0xFF
#: Symbols there are: all bytes but START.
SYMBOLS = 255
#: Bytes of texts and places worked on at once; a longer text is taken by itself.
TEXTS, CHUNK = 1 << 22, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def portions(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in portions of about TEXTS bytes, each with the place of its first."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    cuts = np.flatnonzero(np.diff(ends // TEXTS)) + 1 if len(ends) else []
    for at, stop in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        yield int(at), texts.slice(at, stop - at)


def padded(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after another, each behind ``order`` START symbols and before END, and the text of each place."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    lengths = np.diff(offsets)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    of = np.repeat(np.arange(n, dtype=np.int32), lengths + order + 1)
    out = np.full(len(of), START, np.uint8)
    ends = np.cumsum(lengths + order + 1)
    out[ends - 1] = END
    out[np.arange(len(data)) + np.repeat(np.arange(n) * (order + 1) + order, lengths)] = _LOWER[data]
    return out, of


def grams(symbols: np.ndarray, of: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunk by chunk, each symbol with the ``order`` before it as one number, and its text."""
    for at in range(0, len(symbols), CHUNK):
        stop = min(at + CHUNK, len(symbols))
        places = np.flatnonzero(symbols[at:stop] != START) + at
        g = np.zeros(len(places), np.uint64)
        for back in range(order, -1, -1):
            g = (g << np.uint64(8)) | symbols[places - back]
        yield g, of[places]


class Counter:
    """Counts of numbers, merged in sorted arrays."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2_000_000:
            self.parts = [self.merged()]
            self.size = 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Model:
    """The trie of contexts of ``order`` bytes at most, from the counts of its longest paths.

    ``low`` are the paths of ``low_depth`` context bytes of the whole corpus with their counts;
    given these, ``keys`` may be only those with some of the contexts of one byte more (a shard).
    """

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None = None, low_depth: int = 1):
        self.order = order
        levels: list[tuple] = [()] * (order + 1)
        for k in range(order, -1, -1):
            if k < order:
                keys, counts = summed(keys & np.uint64((1 << 8 * (k + 1)) - 1), np.ones(len(keys), np.int64))
            if k == low_depth and low is not None:
                keys, counts = summed(*low)
            levels[k] = keys, counts
        self.levels = []
        for k, (keys, counts) in enumerate(levels):
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            seen = np.diff(np.append(first, len(keys)))
            total = np.add.reduceat(counts, first) if len(keys) else counts
            shorter = np.zeros(len(keys), np.int64)
            if k:
                at, _ = _find(levels[k - 1][0], keys & np.uint64((1 << 8 * k) - 1))
                shorter = levels[k - 1][1][at] if len(keys) else shorter
            excluded = np.add.reduceat(shorter, first) if len(keys) else shorter
            self.levels.append((keys, counts, contexts, total, seen, excluded))

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last symbol of each number after the symbols before it."""
        out = np.zeros(len(g))
        left = np.arange(len(g))
        taken, gone = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for k in range(self.order, -1, -1):
            keys, counts, contexts, total, seen, excluded = self.levels[k]
            own = g[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, known = _find(contexts, own >> np.uint64(8))
            if not known.any():
                continue
            n, d = total[at] - taken, seen[at] - gone
            use = known & (d > 0)
            place, hit = _find(keys, own)
            hit &= use
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(hit, np.log10((2 * counts[place] - 1) / (2 * n)), np.log10(d / (2 * n)))
            out[left[use]] += step[use]
            taken, gone = np.where(known, excluded[at], taken), np.where(known, seen[at], gone)
            left, taken, gone = left[~hit], taken[~hit], gone[~hit]
        out[left] -= np.log10(SYMBOLS - gone)
        return out


def count_batch(texts: pa.Array, order: int, counter: Counter) -> None:
    for _, part in portions(texts):
        for g, _ in grams(*padded(part, order), order):
            keys, counts = np.unique(g, return_counts=True)
            counter.add(keys, counts.astype(np.int64))


def paths_of(texts: pa.Array, order: int) -> np.ndarray:
    """The distinct longest paths of texts, sorted."""
    found = [np.unique(g) for _, part in portions(texts) for g, _ in grams(*padded(part, order), order)]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))


def added_up(texts: pa.Array, order: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum over each text's places of the value that its path has; ``keys`` are sorted and have all of them."""
    out = np.zeros(len(texts))
    for at, part in portions(texts):
        for g, of in grams(*padded(part, order), order):
            out[at : at + len(part)] += np.bincount(of, values[np.searchsorted(keys, g)], len(part))
    return out


def score_batch(texts: pa.Array, order: int, models: list[Model]) -> np.ndarray:
    """log10 probabilities of each text under each model."""
    out = np.zeros((len(models), len(texts)))
    for at, part in portions(texts):
        for g, of in grams(*padded(part, order), order):
            distinct, inverse = np.unique(g, return_inverse=True)
            for m, model in enumerate(models):
                out[m, at : at + len(part)] += np.bincount(of, model.log10(distinct)[inverse], len(part))
    return out

