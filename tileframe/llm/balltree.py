"""Ranked lexical search by an exact sparse ball tree over inner products.

A document is a sparse vector: for each of its terms a whole number that grows with the term's
count and falls with the document's length; a query is the vector of its terms' weights, and
a score is their inner product. Documents are dealt out to trees as they come, PORTION at a time. A node of
a tree knows the centroid of its documents and radii around it. No document below it scores more than the
centroid's score and the query's length times the radius: for the whole vector, and also summed up over GROUPS
of terms with a radius each, of which the lesser holds. Bounds are rounded up safely. Nodes are
looked at best first; those whose bound is below the query's last rank so far are left out with
all that is below them. At the leaves scores are exact whole numbers.

Only terms of the queries count for scores, so vectors have no others; counts of
documents and lengths cover all terms.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Documents, and entries of their vectors, of a tree; documents of a leaf; groups of terms with a radius of their own.
PORTION, ENTRIES, LEAF, GROUPS = 4096, 1 << 20, 64, 4096
#: Terms of the queries that are sent to tasks at once; more queries are searched in several passes.
TERMS = 50_000
#: Relative and absolute slack of bounds over what rounding can take off.
SLACK, LEAST_SLACK = 1e-9, 1.0

#: Bytes of terms: letters in lower case, digits and all bytes outside of ASCII; others part terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text, repeats included, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split(b" ") if text else []


def term_counts(text: str | None) -> Counter:
    found = Counter(terms(text))
    found.pop(b"", None)
    return found


def vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of each document with a term: how many it has, and places in ``vocabulary`` with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        for b in batches:
            ids, ns, places, counts = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = term_counts(text.as_py())
                if found:
                    own = sorted((place[t], c) for t, c in found.items() if t in place)
                    ids.append(doc)
                    ns.append(found.total())
                    places.append([p for p, _ in own])
                    counts.append([c for _, c in own])
            told = [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(told, ["id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each start to the next, in their own type; 0 where there are none."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


class Tree:
    """A ball tree over documents given as rows of a sparse matrix (starts, places, values), ids and ``width`` terms."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, places: np.ndarray, values: np.ndarray, width: int):
        self.ids, self.width = ids, width
        self.group = (np.arange(width) * 2654435761 % (1 << 32)) % GROUPS
        self.starts, self.places, self.values = starts, places, values
        self.nodes: list[tuple[int, int, int, int]] = []  # first and last row, left and right node (-1 for a leaf)
        self.centroids: list[np.ndarray] = []
        self.radii: list[float] = []
        self.group_radii: list[np.ndarray] = []
        self.order = np.arange(len(ids))
        self._build()

    def _rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, places and values of the entries of ``rows``."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        of = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[rows], sizes)
        return of, self.places[at], self.values[at].astype(np.float64)

    def _build(self) -> None:
        todo = [(0, len(self.ids))]
        self.nodes.append((0, len(self.ids), -1, -1))
        for k, (a, b) in enumerate(todo):
            rows = self.order[a:b]
            of, places, values = self._rows(rows)
            centroid = np.bincount(places, weights=values, minlength=self.width) / (b - a)
            # |x - c|^2 = |c|^2 + the sum over x's entries of (x - c)^2 - c^2, for all terms and for those of a group
            more = (values - centroid[places]) ** 2 - centroid[places] ** 2
            square = np.bincount(of, weights=more, minlength=b - a) + centroid @ centroid
            grouped = np.bincount(self.group, weights=centroid**2, minlength=GROUPS)
            kinds, inverse = np.unique(of * GROUPS + self.group[places], return_inverse=True)
            own = np.bincount(inverse, weights=more, minlength=len(kinds)) + grouped[kinds % GROUPS]
            largest = grouped.copy()  # what a document without a term of the group is away from the centroid, at least for a bound
            np.maximum.at(largest, kinds % GROUPS, own)
            self.centroids.append(centroid)
            self.radii.append(float(np.sqrt(max(square.max(), 0.0))))
            self.group_radii.append(np.sqrt(np.maximum(largest, 0.0)))
            if b - a > LEAF:
                self._split(k, a, b, of, places, values, square, todo)

    def _split(self, k: int, a: int, b: int, of: np.ndarray, places: np.ndarray, values: np.ndarray, square: np.ndarray, todo: list[tuple[int, int]]) -> None:
        """Part a node's rows by which of two far apart ones they lean to; in halves, so that the tree is even."""
        rows = self.order[a:b]
        one = int(square.argmax())
        toward = self._dots(of, places, values, rows[one], b - a)
        norms = np.bincount(of, weights=values**2, minlength=b - a)
        other = int((norms - 2 * toward).argmax())
        lean = 2 * (toward - self._dots(of, places, values, rows[other], b - a))
        order = np.argsort(lean, kind="stable")
        middle = a + (b - a) // 2
        self.order[a:b] = rows[order]
        left = len(self.nodes)
        self.nodes[k] = (a, b, left, left + 1)
        for part in ((a, middle), (middle, b)):
            self.nodes.append((*part, -1, -1))
            todo.append(part)

    def _dots(self, of: np.ndarray, places: np.ndarray, values: np.ndarray, row: int, n: int) -> np.ndarray:
        one = np.zeros(self.width)
        own = slice(self.starts[row], self.starts[row + 1])
        one[self.places[own]] = self.values[own]
        return np.bincount(of, weights=values * one[places], minlength=n)

    def finish(self) -> None:
        """Put rows in the tree's order and bounds into matrices."""
        sizes = self.starts[self.order + 1] - self.starts[self.order]
        _, places, _ = self._rows(self.order)
        at = np.repeat(self.starts[self.order], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.ids, self.places, self.values = self.ids[self.order], places, self.values[at]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.center = np.array(self.centroids)
        self.radius, self.group_radius = np.array(self.radii), np.array(self.group_radii)

    def bounds(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node what no score of a query (terms with weights) below it exceeds."""
        w = weights.astype(np.float64)
        center = self.center[:, places] @ w
        length = np.sqrt(w @ w)
        parts = np.sqrt(np.bincount(self.group[places], weights=w * w, minlength=GROUPS))
        used = np.flatnonzero(parts)
        most = center + np.minimum(length * self.radius, self.group_radius[:, used] @ parts[used])
        return most + SLACK * (np.abs(center) + length * self.radius) + LEAST_SLACK

    def search(self, places: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Put the tree's documents with a score above 0 among the ``k`` ``best`` (a heap of score and negative id); the number of leaves looked at.

        ``dense`` has a place for each term and is all 0 before and after.
        """
        bounds, seen = self.bounds(places, weights), 0
        dense[places] = weights
        front = [(-bounds[0], 0)]
        while front:
            bound, node = heapq.heappop(front)
            if len(best) == k and -bound < best[0][0]:
                break
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if len(best) < k or bounds[child] >= best[0][0]:
                        heapq.heappush(front, (-bounds[child], child))
                continue
            seen += 1
            own = slice(self.starts[a], self.starts[b])
            scores = _sums(dense[self.places[own]] * self.values[own], self.starts[a : b + 1] - self.starts[a])
            for i in np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1)):
                found = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        dense[places] = 0
        return seen


def _values(n: np.ndarray, counts: np.ndarray, starts: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What each count is worth in a document of ``n`` terms: exact in longs while terms of a document times documents stay below 10^17."""
    m = 10 + 90 * n.astype(object) * docs // total if n.max(initial=0) > 10**17 // max(docs, 1) else 10 + 90 * n * docs // total
    m = np.repeat(np.asarray(m, np.int64), np.diff(starts))
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """(query, rank, id, score): the ``k`` documents with the highest scores above 0 for each query, equal scores by rising id.

    Null and blank texts have no terms; a query without any has no rows. Repeated documents are ranked one by one, those with a
    null id after others of the same score. Repeated queries get their rows as often as given. Other columns
    are ignored; empty tables give no rows. Queries are sent to tasks, those of TERMS terms at a
    time; what a task holds is a portion of documents, and what goes on to the ranking is ``k``
    rows for each query and task.
    """
    asked = queries.select(F.col(query_id_col).alias("query"), F.col(query_text_col).cast("string").alias("text"))
    found = [_search(docs, part, k, id_col, text_col) for part in _parts(asked)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _parts(asked: DataFrame) -> list[DataFrame]:
    """Queries by hash of their text, so many parts that each has about TERMS terms at most."""
    spaces = F.regexp_count("text", F.lit("[^A-Za-z0-9\\x{80}-\\x{10FFFF}]+")) + 1
    total = asked.agg(F.coalesce(F.sum(spaces), F.lit(0))).first()[0]
    n = 1 + total // TERMS
    return [asked.where(F.pmod(F.coalesce(F.xxhash64("text"), F.lit(0)), F.lit(n)) == i) for i in range(n)] if n > 1 else [asked]


def _search(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    texts = [r.text for r in asked.select("text").where("text is not null").distinct().collect()]
    own = [sorted(term_counts(t)) for t in texts]
    vocabulary = sorted({t for ts in own for t in ts})
    rows = written(vectors(docs, vocabulary, id_col, text_col))
    n_docs, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = np.zeros(len(vocabulary))
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        holders[r.t] = r.n
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * holders + 1))).astype(np.int64)
    place = {t: i for i, t in enumerate(vocabulary)}
    sent = spark.sparkContext.broadcast([np.array([place[t] for t in ts], np.int64) for ts in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in sent.value]
        dense = np.zeros(len(weights), np.int64)
        for ids, n, starts, places, counts in _portions(batches):
            tree = Tree(ids, starts, places, _values(n, counts, starts, n_docs, total), len(weights))
            tree.finish()
            for q, places in enumerate(sent.value):
                if len(places):
                    tree.search(places, weights[places], dense, best[q], k)
        told = [(q, -i, s) for q, heap in enumerate(best) for s, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([t[c] for t in told], pa.int64()) for c in range(3)], ["q", "id", "score"])

    hits = rows.select("id", "n", "terms", "counts").mapInArrow(run, "q long, id long, score long")
    nameless = F.lit(NAMELESS)
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    numbers = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q long, text string")
    named = asked.join(numbers, "text").join(ranked, "q")
    return named.select("query", "rank", F.nullif("id", nameless).alias("id"), "score")


#: What null ids are meanwhile, so that they come last.
NAMELESS = (1 << 63) - 1


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, n, starts, places, counts) of up to PORTION documents, or about ENTRIES entries, at a time."""
    held, docs, entries = [], 0, 0
    for b in batches:
        sizes = np.diff(b.column(2).offsets.to_numpy())
        at = 0
        while at < b.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), ENTRIES - entries, side="right")
            take = int(max(1, min(room, PORTION - docs, b.num_rows - at)))
            held.append(b.slice(at, take))
            docs, entries, at = docs + take, entries + int(sizes[at : at + take].sum()), at + take
            if docs >= PORTION or entries >= ENTRIES or at < b.num_rows:
                yield _matrix(held)
                held, docs, entries = [], 0, 0
    if held:
        yield _matrix(held)


def _matrix(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    table = pa.Table.from_batches(batches).combine_chunks()
    ids = np.array([NAMELESS if i is None else i for i in table["id"].to_pylist()], np.int64)
    lists = table["terms"].combine_chunks()
    starts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
    places, counts = np.asarray(lists.flatten()).astype(np.int64), np.asarray(table["counts"].combine_chunks().flatten())
    return ids, np.asarray(table["n"]), starts, places, counts
