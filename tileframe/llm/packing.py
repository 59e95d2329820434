"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own partition, in their order, in batches that fill
a fixed number of windows but for a small slack. What exceeds whole windows of a document
is cut into pieces; the pieces of a batch are dealt to its windows by differencing: every
piece starts as a partial partition of its own, and the two partial partitions with the
largest spreads are merged again and again, the fullest window of one with the emptiest
of the other. Where the fullest window comes out above the capacity, the batch is dealt
out again over one window more.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows of a batch, tokens a window that a batch leaves free, and the longest piece that is dealt out.
WINDOWS, SLACK, PIECE = 128, 4, 256


def difference(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each size: largest differencing method over ``windows`` windows."""
    n = len(sizes)
    nodes: list[tuple] = [()] * n
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = s
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a, x), (_, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        total = x + y[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order] - total[order[-1]]
        nodes.append((a, b, order))
        heapq.heappush(heap, (-int(total[0]), len(nodes) - 1, total))
    place = np.zeros(n, np.int64)
    at = {heap[0][1]: np.arange(windows)} if heap else {}
    for k in range(len(nodes) - 1, -1, -1):
        where = at.pop(k)
        if k < n:
            place[k] = where[0]
            continue
        a, b, order = nodes[k]
        own = np.empty(windows, np.int64)
        own[order] = where
        at[a], at[b] = own, own[::-1]
    return place


def deal(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of each size and the number of windows, none of them over ``capacity``."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        place = difference(sizes, windows)
        if np.bincount(place, weights=sizes, minlength=windows).max(initial=0) <= capacity:
            return place, windows
        windows += 1


def load_encoding(path: str, special: bool = True):
    """A tiktoken encoding with the vocabulary of a byte-level BPE file of the tokenizers library.

    It gives the ids of ``tokenizers.Tokenizer.from_file(path)`` several times as fast.
    The ranks of such a vocabulary are its ids; special tokens in a text keep their ids.
    """
    import tiktoken

    # The byte-level alphabet and pattern of this kind of vocabulary.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    added = {t["content"]: t["id"] for t in told["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added if special else {})


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs one partition's documents; pieces come out as rows of PIECES."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next, self.held, self.total = capacity, first_sequence, [], 0
        self.target = WINDOWS * max(1, capacity - SLACK)  # ``total`` stays below it: a piece ends where the batch is full
        self.piece = min(PIECE, capacity)

    def _row(self, doc, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int) -> tuple:
        return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield self._row(doc, start, ids[start : start + self.capacity], len(ids), self.next, 0)
            self.next += 1
        start = whole
        while start < len(ids):
            piece = ids[start : min(start + self.piece, start + self.target - self.total)]
            self.held.append((doc, start, piece, len(ids)))
            start += len(piece)
            self.total += len(piece)
            if self.total == self.target:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.held:
            return
        place, windows = deal([len(p[2]) for p in self.held], self.capacity)
        filled = [0] * windows
        for k, (doc, start, ids, tokens) in zip(place.tolist(), self.held, strict=True):
            yield self._row(doc, start, ids, tokens, self.next + k, filled[k])
            filled[k] += len(ids)
        self.next += windows
        self.held, self.total = [], 0


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (PIECES) of all documents, packed into sequences of ``capacity`` tokens at most.

    A document is the ids of its whole text (null: empty) and ``end_id``; each id lies in
    exactly one piece. ``vocabulary`` is a file that all executors can read. No rows move:
    every partition is packed by itself and numbers its sequences from its own start, so a
    task that is run again gives the same pieces. A partition leaves one window partly
    empty. Null ids and repeated rows are packed like others, an empty table gives no
    pieces, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(vocabulary)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        names = [c.split()[0] for c in PIECES.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)

        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoding.encode_to_numpy(text.as_py() or "", allowed_special="all")
                rows += packer.add(doc, np.append(ids, np.uint32(end_id)))
            yield batch(rows)
        yield batch(list(packer.flush()))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)
