"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands find candidates, all their shingles settle them.

Texts that agree in all ROWS minima of one of BANDS bands share a bucket: 99.9 % of the pairs
at similarity 0.8 do, and more above. Each text's shingles are hashed once to 64 bits and kept with
its id; these sets, not texts, are compared. First every text is compared with the hub of its largest bucket: the text
of a bucket whose buckets are the largest in all, which a text that was copied with changes comes out as. Then, ROUNDS times, the texts
of each bucket that holds more than one component with its heaviest text in a component not asked yet. So far
pairs are in proportion to the texts in buckets. What is still mixed is compared in full inside the tasks: a bucket falls into blocks of about
BLOCK_BYTES of sets and each pair of blocks is a group, so sets are copied once for each block of their bucket; pairs never become rows, and
only links that join components come out. Many texts that stay apart in one bucket cost the square of
their number in comparisons, over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import written
from .components import connected_components

BANDS, ROWS = 24, 6
#: Shingles whose minima are taken at once.
CHUNK = 2048
#: Rounds of hubs after the first, and bytes of sets in a block of a bucket.
ROUNDS, BLOCK_BYTES = 2, 8 << 20
_rng = np.random.default_rng(17)
_FACTORS = (_rng.integers(0, 1 << 31, (BANDS * ROWS, 1)) * 2 + 1).astype(np.uint32)
_TERMS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1)).astype(np.uint32)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(text: str | None, size: int) -> set[bytes]:
    """Runs of ``size`` words; the whole text if it has no more words than that, nothing for a text without words."""
    words = _words(text)
    return set(map(b" ".join, zip(*(words[i : len(words) - size + 1 + i] for i in range(size))))) if len(words) > size else {b" ".join(words)} - {b""}


def similarity(a: str | None, b: str | None, size: int) -> float:
    one, other = shingles(a, size), shingles(b, size)
    both = len(one & other)
    return both / max(1, len(one) + len(other) - both)


def bands(text: str | None, size: int) -> list[int]:
    """A hash of each band of minima as a signed long; none for a text without words."""
    own = shingles(text, size)
    if not own:
        return []
    hashes = np.fromiter(map(xxh64_intdigest, own, repeat(7)), np.uint64, len(own)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[None, i : i + CHUNK] * _FACTORS + _TERMS).min(axis=1))
    found = [xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(found, np.uint64).view(np.int64).tolist()


def banded(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, key, bands) of each text; texts of the same words have the same key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = [], []
            for x in b.column(1):
                t = x.as_py()
                keys.append(xxh64_intdigest(b" ".join(_words(t))))
                found.append(bands(t, size))
            told = [b.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(told, ["id", "key", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, key long, bands array<long>")


def hashed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, own): the hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(t.as_py(), size) for t in b.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([b.column(0), own], ["id", "own"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, own array<long>")


def joined(docs: DataFrame, roots: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root): what components of ``roots`` (id, root) become by links between texts of similarity ``least`` or more.

    Ids are distinct longs. Only components that become part of another are told, with the least one they reach.
    """
    found = written(banded(docs, id_col, text_col, shingle))
    one = found.join(found.groupBy("key").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")
    at = written(one.select("id", F.explode("bands").alias("band")))
    at = written(at.join(at.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band"))
    # what a text weighs as a hub, and its largest bucket
    ids = written(at.groupBy("id").agg(F.sum("n").alias("weight"), F.max(F.struct("n", "band"))["band"].alias("top")))
    sets = written(hashed(docs.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi"), id_col, text_col, shingle))
    now = written(roots.join(ids, "id").select("id", "weight", "top", F.col("root").alias("node"), "root"))
    asked = None
    for _ in range(1 + ROUNDS):
        members = at.join(now.select("id", "root", "weight", "top"), "id")
        mixed = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
        members = written(members.join(mixed, "band", "left_semi"))
        at = members.select("id", "band", "n")
        if members.isEmpty():
            break
        free, ask = members, members
        if asked is None:
            ask = members.where("band = top")
        else:  # hubs of components that were asked in a bucket have been compared with all of it
            gone = asked.join(now.select("id", "root"), "id").select("band", "root").distinct()
            free = members.join(gone, ["band", "root"], "left_anti")
        hubs = free.groupBy("band").agg(F.max(F.struct("weight", "id", "root")).alias("hub")).select("band", F.col("hub.id").alias("v"), F.col("hub.root").alias("rv"))
        pairs = ask.join(hubs, "band").where("root != rv").select(F.col("id").alias("u"), F.col("root").alias("ru"), "v", "rv").distinct()
        now = _merged(now, _alike(pairs, sets, least))
        hubs = hubs.select("band", F.col("v").alias("id"))
        asked = members.limit(0).select("band", "id") if asked is None else written(asked.union(hubs))
    members = at.join(now.select("id", "root"), "id")
    mixed = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    members = written(members.join(mixed, "band", "left_semi").select("band", "id", "root"))
    now = _merged(now, _block_links(members, sets, least))
    return now.where("node != root").select("node", "root").distinct()


def _merged(now: DataFrame, links: DataFrame) -> DataFrame:
    """(..., root) with roots that ``links`` (u, v) join made one."""
    moved = connected_components(links).toDF("old", "new")
    return written(now.join(moved, F.col("root") == F.col("old"), "left").withColumn("root", F.coalesce("new", "root")).drop("old", "new"))


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v): roots of those of ``pairs`` (u, ru, v, rv) whose ``sets`` are of a similarity of ``least`` or more."""
    rows = pairs.join(sets.toDF("u", "one"), "u").join(sets.toDF("v", "other"), "v")
    both, total = F.size(F.array_intersect("one", "other")), F.size("one") + F.size("other")
    # as many shared ones as the smaller set has don't do where the larger one is too large
    near = (F.least(F.size("one"), F.size("other")) >= least * F.greatest(F.size("one"), F.size("other"))) & (both >= least * (total - both))
    return rows.where(near).select(F.col("ru").alias("u"), F.col("rv").alias("v"))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    own = shingles(text, size)
    return np.fromiter(map(xxh64_intdigest, own, repeat(11)), np.uint64, len(own)).view(np.int64)


def spanning_links(roots: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join the roots that all pairs of sets of a similarity of ``least`` or more join. Sets of one root aren't compared."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    of = np.repeat(np.arange(len(sets)), sizes)
    kinds, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    holders, starts = of[order], np.searchsorted(inverse[order], np.arange(len(kinds) + 1))
    ends, label, found = np.cumsum(sizes), roots.copy(), []
    for a in range(len(sets)):
        if (label == label[a]).all():
            break
        own = inverse[ends[a] - sizes[a] : ends[a]]
        both = np.bincount(np.concatenate([np.zeros(0, np.int64), *[holders[starts[k] : starts[k + 1]] for k in own]]), minlength=len(sets))
        near = (both >= least * (sizes + sizes[a] - both)) & (both > 0)
        for other in np.unique(label[near & (label != label[a])]):
            found.append((int(label[a]), int(other)))
            label[label == other] = label[a]
    return found


def _block_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v): links between roots of all texts that are alike and in one bucket of ``members`` (band, id, root)."""
    rows = members.select("band", "id", "root").join(sets.select("id", F.size("own").alias("size")), "id")
    blocks = rows.groupBy("band").agg(F.ceil(F.sum(8 * F.col("size")) / BLOCK_BYTES).cast("int").alias("blocks"))
    rows = rows.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "root")
    rows = rows.hint("merge").join(sets, "id")  # sized as before they were spread over blocks, so never a broadcast

    def run(own: pa.Table) -> pa.Table:
        table = own.combine_chunks()
        found = spanning_links(table["root"].to_numpy(), [np.asarray(x.values) for x in table["own"]], least)
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return rows.groupBy("band", "i", "j").applyInArrow(run, "u long, v long")
