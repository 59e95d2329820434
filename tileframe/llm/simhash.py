"""SimHash near-duplicates by anchor-point covering.

Fingerprints are split into two halves. Of two fingerprints that differ in at most
three bits, one half differs in at most one (pigeonhole). The anchors of a half are
the 2^26 words of the perfect [31, 26] Hamming code over 31 of its 32 bits, whose
covering radius is 1: each fingerprint has one home anchor within the radius, and a
fingerprint whose half differs from it by one bit lies within radius + 1 of that
anchor. So each fingerprint is replicated to every anchor within 2 of its half (1 or
16 of them), and at each anchor the fingerprints at home there are compared, over all
64 bits, with all that were replicated to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpoint
from .components import connected_components

#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Rows of an anchor above which its comparisons are dealt out over several groups.
BLOCK = 8192


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over XXH64 (seed 42) of word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    joined = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle))))
    hashes = np.fromiter(map(xxh64_intdigest, joined, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        octets = hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long; null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _errors() -> list[list[int]]:
    """For each syndrome the error patterns of weight 2 at most, the one of least weight first."""
    bit = lambda i: 1 << (i - 1)
    return [[0]] + [[bit(s)] + [bit(i) | bit(i ^ s) for i in range(1, 32) if i < i ^ s] for s in range(1, 32)]


def _syndrome(half: Column) -> Column:
    """The 5-bit syndrome of a 31-bit word: the xor of the (one-based) places of its ones."""
    masks = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]
    parts = [F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)), j) for j, m in enumerate(masks)]
    return parts[0] + parts[1] + parts[2] + parts[3] + parts[4]


def anchored(fps: DataFrame) -> DataFrame:
    """(anchor, fp, home): each fingerprint at every anchor within radius + 1 of one of its halves."""
    errors = F.array(*[F.array(*[F.lit(e).cast("long") for e in row]) for row in _errors()])
    low31 = F.lit((1 << 31) - 1)
    half = lambda n: (F.col("fp") if n == 0 else F.shiftrightunsigned("fp", 32)).bitwiseAND(low31)
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), half(n).alias("half")) for n in (0, 1)])).alias("h"))
    rows = rows.select("fp", "h.*").withColumn("patterns", F.element_at(errors, _syndrome(F.col("half")) + 1))
    rows = rows.select("fp", "n", "half", F.posexplode("patterns").alias("k", "e"))
    return rows.select(
        (F.col("half").bitwiseXOR(F.col("e")) + F.col("n") * F.lit(1 << 31)).alias("anchor"), "fp", (F.col("k") == 0).alias("home")
    )


def _spanning_links(fps: np.ndarray, home: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links that join what the pairs within ``bits`` (one of them at home) join: one per fingerprint at most."""
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    label = np.arange(len(fps))
    for h in np.flatnonzero(home):
        found = np.unique(label[np.bitwise_count(fps ^ fps[h]) <= bits])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    for i in np.flatnonzero(label != np.arange(len(fps))):
        yield int(fps[i].view(np.int64)), int(fps[label[i]].view(np.int64))


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(u, v): links between distinct fingerprints within ``bits`` that span their components.

    Only anchors with a fingerprint at home and another one are looked at. An anchor of
    more than BLOCK rows is split: its rows fall into blocks by hash, and each pair of
    blocks is a group of its own, so every pair is still compared. The join is never a
    broadcast: the rows at anchors are sized by the fingerprints, of which they are 31 times as many.
    """
    if bits > 3:
        raise ValueError("two halves cover 3 differing bits at most")
    at = anchored(fps)
    busy = at.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    rows = at.hint("merge").join(busy.select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "anchor")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    rows = rows.select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "home")
    rows = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []

        def fresh(groups: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero((groups[1:, :3] != groups[:-1, :3]).any(axis=1)) + 1
            out = []
            for g in np.split(groups, edges):
                out += [x for x in _spanning_links(g[:, 3].view(np.uint64), g[:, 4] == 1, bits) if x not in told]
                told.update(out[-len(g) :])
            if len(told) > 1_000_000:
                told.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            a = np.column_stack([np.asarray(c.cast(pa.int64())) for c in b.columns])
            if not len(a):
                continue
            whole = np.concatenate([*held, a]) if held and (held[-1][-1, :3] != a[-1, :3]).any() else None
            if whole is None and (a[0, :3] == a[-1, :3]).all():  # still the same group
                held.append(a)
                continue
            whole = np.concatenate([*held, a]) if whole is None else whole
            cut = int(np.flatnonzero((whole[:, :3] != whole[-1, :3]).any(axis=1))[-1]) + 1
            held = [whole[cut:]]
            yield fresh(whole[:cut])
        if held:
            yield fresh(np.concatenate(held))

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """(id, fp, component): each row with its fingerprint and the least id of its component.

    Texts link where their fingerprints differ in ``bits`` or fewer of 64; components are
    transitive. Null and blank texts have fingerprint 0 and link like any other. Repeated
    rows come back as often as given. Null ids belong to a component but never name one:
    a component of null ids only is null. Other columns are ignored, an empty table gives
    an empty one.
    """
    fp_of = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    least = fp_of.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(links(least.select("fp"), bits))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return fp_of.join(rooted.join(named, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
