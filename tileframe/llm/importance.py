"""Quality classification by importance resampling.

Two generative models over hashed word n-grams, one of target text and one of raw text, give
each document a log importance weight; Gumbel noise on the weights and a top-k turn these
into a sample without replacement, with chances in proportion to the weights. A text is taken
as tokens (runs of letters or digits, and runs of other marks) in lower case; features are its
tokens and pairs of neighbours, hashed to BUCKETS. A third model, of text to shun, is weighed
against the target model likewise (``markers``), and a document's weight is then the lesser one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import Cache, checkpoint, free

if TYPE_CHECKING:
    from .markers import Markers

BUCKETS = 1 << 16
#: Labelled target documents that the target model is fitted on, about: those whose hash falls below the share that gives so many.
TARGET_SAMPLE = 50_000
#: The same for labelled documents that markers of what to shun are looked for in, of either kind.
MARKED_SAMPLE = 10_000
#: Counts added to both sides of a ratio.
SHRINK = 20.0
#: Log odds, before its text is looked at, that a document is target text. Weights of target text scatter around 0 by some nats.
LOG_ODDS = 10.0
#: Power that weights are raised to where there is text to shun: what has even odds to be good is drawn half of the time, but little else is left to chance.
SHARP = 8.0
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def _hash(token: str) -> int:
    return xxh32_intdigest(token, 1)


def _features(tokens: list[str], hashes: Cache) -> np.ndarray:
    if not tokens:
        return np.zeros(0, np.int64)
    single = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (single[:-1] * np.uint64(0x9E3779B1) + single[1:] * np.uint64(0x85EBCA77)) ^ (single[:-1] >> np.uint64(7))
    return (np.concatenate([single, pairs >> np.uint64(16)]) % np.uint64(BUCKETS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Buckets of the tokens and token pairs of a text."""
    return _features(tokens_of(text), Cache(_hash))


def feature_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket comes up in all of column text, and in the rows with target: BUCKETS numbers each, whatever the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros((2, BUCKETS), np.int64), Cache(_hash)
        for b in batches:
            for t, target in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = _features(tokens_of(t.as_py()), hashes)
                for counts in total[: 1 + target]:
                    np.add.at(counts, own, 1)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["bucket", "n", "target"])

    rows = docs.select(F.col("text").cast("string").alias("text"), "target")
    found = rows.mapInArrow(run, "bucket long, n long, target long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("target").alias("target"))
    out = np.zeros((2, BUCKETS), np.int64)
    for r in found.collect():
        out[:, r.bucket] = r.n, r.target
    return out[0], out[1]


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability by bucket. SHRINK counts are added to what the target has of a
    bucket and to what it would have at the raw rate, so that rare features say little."""
    expected = target.sum() * raw / max(raw.sum(), 1)
    return np.log((target + SHRINK) / (expected + SHRINK))


def _picked(ids: DataFrame, sample: int, n: int) -> DataFrame:
    """About ``sample`` of the ``n`` ids in column target, by their hash."""
    return ids.where(F.pmod(F.xxhash64("target"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)))


def labelled_texts(texts: DataFrame, kinds: list[DataFrame], ns: list[int]) -> DataFrame:
    """(text, kind): the texts (target, text) of about MARKED_SAMPLE of the ``ns`` ids of each kind, equal texts once.

    The samples bound what is broadcast; the hint stands on their union, as those of its parts don't count in a join.
    """
    some = [_picked(ids, MARKED_SAMPLE, n).withColumn("kind", F.lit(k)) for k, (ids, n) in enumerate(zip(kinds, ns, strict=True))]
    rows = texts.select("target", F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(some[0].union(some[1])), "target").select("text", "kind").distinct()


def shun_model(texts: DataFrame, kinds: list[DataFrame], ns: list[int]) -> Markers | None:
    """What tells texts to shun from target texts, from labelled texts of each kind (target ones, to shun); none unless there are both."""
    from .markers import Markers

    if not all(ns):
        return None
    return Markers(checkpoint(labelled_texts(texts, kinds, ns)), math.log(ns[1] / ns[0]))


def weighed(docs: DataFrame, ratios: np.ndarray, text_col: str, shun: Markers | None, out: str) -> DataFrame:
    """``docs`` with ``out``: log_weight, the sum of the log ratios of each whole text's features (0 for a text without any), and shun_log_odds, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast((ratios, shun))

    @F.pandas_udf("log_weight double, shun_log_odds double")
    def weight(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ratios, shun = sent.value
        hashes, marks = Cache(_hash), Cache(shun.of) if shun else None
        for texts in batches:
            found = []
            for t in texts:
                tokens = tokens_of(t)
                found.append((float(ratios[_features(tokens, hashes)].sum()), shun.log_odds(tokens, marks) if shun else -math.inf))
            yield pd.DataFrame(found, columns=["log_weight", "shun_log_odds"])

    return docs.withColumn(out, weight(F.col(text_col).cast("string")))


def gumbel(*key: Column) -> Column:
    """Gumbel noise settled by a key, so that a task that runs again draws the same."""
    uniform = (F.shiftrightunsigned(F.xxhash64(*key, F.lit("gumbel")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def top_k(keys: DataFrame, key: Column, tie: Column, k: int) -> Column:
    """Whether a row is among the ``k`` with the largest keys (finite doubles) of ``keys``; equal keys go by ``tie``, a long.

    Rows equal in both are alike. The k-th row is found from counts of 2^16 values at most:
    the range of the keys is parted evenly, then the part that has the k-th row, until all
    keys of a part are equal; ties go digit by digit. So no sort of all rows and no group of
    rows is needed.
    """
    if k <= 0:
        return F.lit(False)
    left = keys.select(key.alias("key"), tie.alias("tie"))
    low, high = left.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return F.lit(True)
    while low < high:
        part = F.least(F.floor((F.col("key") / 2 - low / 2) / (high / 2 - low / 2) * 65536), F.lit(65535)).cast("int")
        found = {r.d: r for r in left.groupBy(part.alias("d")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        k, d = _part_of(k, {d: r.n for d, r in found.items()})
        if d is None:
            return F.lit(True)
        left, low, high = left.where(part == d), found[d].low, found[d].high
    least = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("tie", 48) if shift == 48 else F.shiftrightunsigned("tie", shift).bitwiseAND(F.lit(0xFFFF))
        k, d = _part_of(k, {r.d: r.n for r in left.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()})
        if d is None:
            return F.lit(True)
        left, least = left.where(digit == d), (least << 16) + d
    return (key > low) | ((key == low) & (tie >= least))


def _part_of(k: int, counts: dict[int, int]) -> tuple[int, int | None]:
    """The part that has the k-th row from above, and how many rows into it; none if there are fewer rows."""
    for d in sorted(counts, reverse=True):
        if k <= counts[d]:
            return k, d
        k -= counts[d]
    return k, None


def resample(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None, sample: int = TARGET_SAMPLE, keep_text: bool = True, shun_ids: DataFrame | None = None
) -> DataFrame:
    """Sample ``docs`` to look like the documents of ``target_ids`` (one column, ids).

    Returns all rows with log_weight, gumbel_key (log weight and noise) and chosen, true for
    the ``size`` largest keys. Without ``size`` it is the number of documents expected to be
    target text: the sum of their posteriors for prior LOG_ODDS. The raw model counts all
    texts; the target model those of about ``sample`` target documents. Noise goes by id and
    text, so equal rows are chosen alike. Null texts weigh 0. Without target documents all
    weights are 0. Columns named like a result are replaced, others pass through; without
    ``keep_text`` the texts don't.

    With ``shun_ids`` there are also shun_log_odds, of a model of the texts with these ids
    against one of the target texts, and kept: a second sample with the same noise. Its log
    weight is the lesser of a document's log odds against raw text and against text to shun,
    raised to the power SHARP, and its size the sum of the posteriors (at most ``size``). A
    document of low weight in either way seldom gets in, however well it does in the other.
    """
    ids, tie, parts = target_ids.toDF("target").where("target is not null").distinct(), free(docs, "tie"), free(docs, "parts")
    n = ids.count()
    texts = docs.select(F.col(id_col).alias("target"), F.col(text_col).alias("text"))
    # the sample bounds what is broadcast: about ``sample`` ids
    flagged = texts.join(F.broadcast(_picked(ids, sample, n).withColumn("picked", F.lit(True))), "target", "left").select("text", F.col("picked").isNotNull().alias("target"))
    raw, target = feature_counts(flagged) if n else (np.zeros(BUCKETS), np.zeros(BUCKETS))
    shun = None
    if shun_ids is not None:
        bad = shun_ids.toDF("target").where("target is not null").distinct()
        shun = shun_model(texts, [ids, bad], [n, bad.count()])
    rows = weighed(docs, log_ratios(target, raw), text_col, shun, parts).withColumn("log_weight", F.col(parts)["log_weight"])
    if shun_ids is not None:
        rows = rows.withColumn("shun_log_odds", F.col(parts)["shun_log_odds"])
    own = (F.col(id_col), F.col(text_col).cast("string"))
    rows = rows.drop(parts).withColumn("gumbel_key", F.col("log_weight") + gumbel(*own)).withColumn(tie, F.xxhash64(*own))
    # weights are worked out once, so they are written with all that is returned
    rows = keys = checkpoint(rows if keep_text else rows.drop(text_col))
    if size is None:
        expected = _posteriors(keys, F.col("log_weight") + LOG_ODDS)
    chosen = top_k(keys, F.col("gumbel_key"), F.col(tie), expected if size is None else size)
    rows = rows.withColumn("chosen", chosen)
    if shun_ids is not None:
        weight = SHARP * F.least(F.col("log_weight") + LOG_ODDS, -F.col("shun_log_odds"))
        drawn = _posteriors(keys, weight)
        rows = rows.withColumn("kept", top_k(keys, weight + F.col("gumbel_key") - F.col("log_weight"), F.col(tie), drawn if size is None else min(size, drawn)))
    return rows.drop(tie)


def _posteriors(rows: DataFrame, log_odds: Column) -> int:
    """The number of rows expected to be of a kind that they are of with these log odds."""
    odds = F.greatest(F.least(log_odds, F.lit(500.0)), F.lit(-500.0))
    return round(rows.agg(F.coalesce(F.sum(1 / (1 + F.exp(-odds))), F.lit(0.0))).first()[0])
