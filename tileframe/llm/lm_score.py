"""Language-model scoring: code lengths under a byte-wise PPM model, beside word counts.

One pass over the training texts counts contexts (see ppm) and words; a second pass scores
every text. A PPM model of MAX_GRAMS longest paths at most is broadcast. A larger one stays
on Spark: texts are taken in portions, the distinct paths of each portion meet their
probabilities, worked out once a path in shards of the model, in a join, and come back to
their portion. That takes one more pass over the texts whatever the size of the model, and no
key is frequent, as a portion asks for a path once. Of the word counts the most frequent
MAX_WORDS at most are broadcast; rarer words of each document meet their counts in a join too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import ppm
from .common import checkpoint, written

MAX_GRAMS, MAX_WORDS = 4_000_000, 500_000
#: Bytes of the texts of a portion, about.
PORTION = 1 << 25
#: Words and the end of a text are counted by XXH64 (seed 42); the end is the empty word.
END_KEY = xxh64_intdigest(b"", 42)
WORD, GRAM = 0, 1


def _tokens(text: pa.StringScalar) -> list[bytes]:
    return (text.as_py() or "").encode("utf-8", "replace").lower().split()


def corpus_counts(texts: DataFrame, order: int) -> DataFrame:
    """(kind, key, n): occurrences of words (and ends) and of the longest PPM paths in a column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        paths = ppm.Counter()

        def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 100_000):
                k, n = keys[at : at + 100_000], counts[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        def hashed() -> tuple[np.ndarray, np.ndarray]:
            return np.fromiter((xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)), np.fromiter(words.values(), np.int64, len(words))

        for b in batches:
            ppm.count_batch(b.column(0), order, paths)
            for t in b.column(0):
                words.update(_tokens(t))
            words[b""] += b.num_rows
            if len(words) > 1_000_000:
                yield from out(WORD, *hashed())
                words.clear()
        yield from out(WORD, *hashed())
        yield from out(GRAM, *paths.merged())

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a table of a checked size, by key."""
    t = counts.select("key", "n").toArrow()
    return ppm.summed(t["key"].to_numpy().view(np.uint64), t["n"].to_numpy().copy())


def frequent_words(words: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The words seen at least 2^j times, for the least j that leaves ``most`` at most; and 2^j."""
    sizes = {r.j: r.words for r in words.groupBy(F.floor(F.log2("n")).alias("j")).agg(F.count("*").alias("words")).collect()}
    j = 0
    while sum(v for k, v in sizes.items() if k >= j) > most:
        j += 1
    return words.where(F.col("n") >= 1 << j), 1 << j


def score(
    docs: DataFrame, held_out: Column, order: int = 5, id_col: str = "doc_id", text_col: str = "text", max_grams: int = MAX_GRAMS, max_words: int = MAX_WORDS
) -> DataFrame:
    """Score every whole text by what all texts that aren't held out teach.

    Returns a row for each row of ``docs``: id, held_out, n_tokens (words and one end),
    n_known (tokens that training has), train_tokens, base_score (log10 probability by
    word counts with one added) and score (log10 probability of the text's bytes and end
    under the PPM model). Null texts count as empty; null ``held_out`` as false. Repeated
    rows count and are scored as often as given. Without training texts every byte has the
    same probability. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    counts = checkpoint(corpus_counts(rows.where("not held_out").select("text"), order))
    words, paths = counts.where(F.col("kind") == WORD), counts.where(F.col("kind") == GRAM)
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = float(np.log10(total + kinds + 1))
    frequent, least = frequent_words(words, max_words)
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(_arrays(frequent))

    large = paths.count() > max_grams
    model = None if large else sc.broadcast(ppm.Model(order, *_arrays(paths)))
    if large:
        rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = known.value
        for b in batches:
            n_tokens, n_known, gained, rare, times = [], [], [], [], []
            for t in b.column(2):
                own = Counter(_tokens(t))
                own[b""] = 1
                h = np.fromiter((xxh64_intdigest(w, 42) for w in own), np.uint64, len(own))
                c = np.fromiter(own.values(), np.int64, len(own))
                at, hit = ppm._find(keys, h)
                n_tokens.append(int(c.sum()))
                n_known.append(int(c[hit].sum()))
                gained.append(float((c[hit] * np.log10(seen[at[hit]] + 1)).sum()))
                rare.append(h[~hit].view(np.int64))
                times.append(c[~hit])
            scores = np.zeros(b.num_rows) if large else ppm.score_batch(b.column(2), order, [model.value])[0]
            arrays = [b.column(0), b.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(gained, pa.float64())]
            arrays += [pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64())), pa.array(scores)]
            yield pa.RecordBatch.from_arrays([*arrays, *b.columns[3:]], ["id", "held_out", "n_tokens", "known", "gained", "rare", "times", "score", "row"][: 8 + large])

    schema = "id long, held_out boolean, n_tokens long, known long, gained double, rare array<long>, times array<long>, score double" + ", row long" * large
    scored = checkpoint(rows.mapInArrow(run, schema))
    if large:
        scored = scored.drop("score").join(scores_by_portion(rows, paths, order, max_grams), "row")
    else:
        scored = scored.withColumn("row", F.monotonically_increasing_id())
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("key"), "p.times")
    rarely = words.where(F.col("n") < least).select("key", "n")
    found = pairs.join(rarely, "key").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_gained")
    )
    return scored.join(found, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("gained") + F.coalesce("more_gained", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )


def probabilities(paths: DataFrame, asked: DataFrame, order: int, max_grams: int) -> DataFrame:
    """(key, value): log10 of the probability of the last symbol of each path of ``asked`` (key), for the counts of ``paths`` (key, n).

    A shard has all paths with some of the contexts of three bytes (as many as the order, if
    that is less), so it has all that these contexts and longer ones need; shorter contexts
    are broadcast, which are 256^3 at most. One context of three bytes has 256^(order - 2)
    paths at most.
    """
    depth = min(3, order)
    cut = lambda size: F.col("key").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("key")
    low = _arrays(paths.select(cut(depth + 1)).distinct().groupBy(cut(depth)).agg(F.count("*").alias("n")))
    low = paths.sparkSession.sparkContext.broadcast(low)
    every = paths.select("key", "n").union(asked.select("key", F.lit(0).cast("long"))).groupBy("key").agg(F.sum("n").alias("n"))
    size = paths.select("key").union(asked.select("key")).agg(F.approx_count_distinct("key")).first()[0]
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1))
    every = every.withColumn("shard", F.pmod(F.xxhash64(context), F.lit(max(2, 2 * size // max_grams))))

    def run(own: pa.Table) -> pa.Table:
        keys, n = own["key"].to_numpy().view(np.uint64), own["n"].to_numpy()
        model = ppm.Model(order, *ppm.summed(keys[n > 0], n[n > 0]), low.value, depth - 1)
        return pa.table({"key": own["key"], "value": model.log10(keys)})

    return every.groupBy("shard").applyInArrow(run, "key long, value double")


def scores_by_portion(rows: DataFrame, paths: DataFrame, order: int, max_grams: int) -> DataFrame:
    """(row, score) for rows (row, text) of a checkpoint, whose numbers rise without gaps in each partition."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    step = max(1, n * PORTION // max(size, 1))
    texts = rows.select("row", "text", (F.col("row") - F.col("row") % step).alias("portion"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            portion = np.asarray(b.column(0))
            for p in np.unique(portion):
                keys = ppm.paths_of(b.column(1).filter(pa.array(portion == p)), order)
                for at in range(0, len(keys), 100_000):
                    k = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), p)), pa.array(k.view(np.int64))], ["portion", "key"])

    asked = written(texts.select("portion", "text").mapInArrow(run, "portion long, key long"))
    found = asked.join(probabilities(paths, asked, order, max_grams), "key")

    def add_up(own: pa.Table, told: pa.Table) -> pa.Table:
        keys, first = np.unique(told["key"].to_numpy().view(np.uint64), return_index=True)
        values = told["value"].to_numpy()[first]
        parts = [ppm.added_up(chunk, order, keys, values) for chunk in own["text"].chunks]
        return pa.table({"row": own["row"], "score": np.concatenate([np.zeros(0), *parts])})

    return texts.groupBy("portion").cogroup(found.groupBy("portion")).applyInArrow(add_up, "row long, score double")
