"""A generative model of labelled texts to shun (toxic ones, say) against one of labelled target texts.

A text that is well written but for a few words looks like target text to a sum over all its
n-grams. So the two models differ only where the labelled texts surely do: words and their
beginnings that significantly more of the shunned texts have are markers. A text is taken as
tokens of which some are markers (as Poisson counts, so a long text needs more of them), with
the labelled shares as prior.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import Cache
from .importance import tokens_of

BUCKETS = 1 << 18
#: Lengths of the beginnings of words that count besides whole words: word formation goes on behind them.
BEGINNINGS = (4, 5, 6, 7)
#: Standard errors by which more of the shunned texts have a marker, by the likelihood ratio, which holds for markers that no target text has.
SURE = 3.5


def _parts(token: str) -> tuple[int, ...]:
    return tuple({xxh32_intdigest(x) % BUCKETS for x in (token, *[f"^{token[:n]}" for n in BEGINNINGS if len(token) > n])})


def _counts(texts: DataFrame) -> np.ndarray:
    """Of (text, kind), kind 1 to shun and 0 target, by kind and bucket the texts and the tokens that have it; the last bucket has all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, parts = np.zeros((2, 2, BUCKETS + 1), np.int64), Cache(_parts)
        for b in batches:
            for text, kind in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                tokens = Counter(tokens_of(text.as_py()))
                inside = Counter({BUCKETS: tokens.total()})
                for token, n in tokens.items():
                    for p in parts[token]:
                        inside[p] += n
                own = np.fromiter(inside, np.int64, len(inside))
                found[0, kind, own] += 1
                found[1, kind, own] += np.fromiter(inside.values(), np.int64, len(inside))
        kind, some = np.nonzero(found[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, some, found[0, kind, some], found[1, kind, some])], ["kind", "bucket", "texts", "tokens"])

    found, out = texts.mapInArrow(run, "kind long, bucket long, texts long, tokens long"), np.zeros((2, 2, BUCKETS + 1))
    for r in found.groupBy("kind", "bucket").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens")).collect():
        out[:, r.kind, r.bucket] = r.texts, r.tokens
    return out


def sureness(a: np.ndarray, n: float, b: np.ndarray, m: float) -> np.ndarray:
    """By how many standard errors the share a / n lies above b / m: the signed root of the likelihood ratio statistic."""
    both = (a + b) / (n + m)
    part = lambda k, all_, p: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(all_ * p, 1e-300)), 0.0)
    g = sum(part(k, all_, both) + part(all_ - k, all_, 1 - both) for k, all_ in ((a, n), (b, m)))
    return np.sign(a / n - b / m) * np.sqrt(2 * np.maximum(g, 0))


class Markers:
    """Log ratios of the markers, what a token costs and the prior log odds, from (text, kind); nothing is shunned without both kinds of texts."""

    def __init__(self, texts: DataFrame, prior: float):
        (had, often) = _counts(texts)
        (nt, ns), (tt, ts) = had[:, -1], often[:, -1]
        self.ratios: dict[int, float] = {}
        self.cost, self.prior = 0.0, prior
        if not (ts and tt):
            return
        sure = np.flatnonzero(sureness(had[1, :-1], ns, had[0, :-1], nt) > SURE)
        logs = np.log((often[1, sure] + 0.5) / ts) - np.log((often[0, sure] + 0.5) / tt)
        self.ratios = dict(zip(sure[logs > 0].tolist(), logs[logs > 0].tolist(), strict=True))
        rates = self._marked(texts)
        self.cost = rates.get(1, 0) / ts - rates.get(0, 0) / tt

    def of(self, token: str) -> float:
        """The best log ratio of a token's parts; 0 for a token without a marker."""
        return max((self.ratios.get(p, 0.0) for p in _parts(token)), default=0.0)

    def _marked(self, texts: DataFrame) -> dict[int, int]:
        """How many tokens of the texts of each kind are markers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, cache = [0, 0], Cache(self.of)
            for b in batches:
                for text, kind in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    found[kind] += sum(cache[t] > 0 for t in tokens_of(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(found)], ["kind", "n"])

        return {r.kind: r.n for r in texts.mapInArrow(run, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect()}

    def log_odds(self, tokens: list[str], cache: Cache) -> float:
        """Log odds that a text of these tokens is one to shun; ``cache`` is one of ``of``."""
        if not self.ratios:
            return -math.inf
        return self.prior + sum(map(cache.__getitem__, tokens)) - len(tokens) * self.cost
