import math
import re
from collections import Counter

import numpy as np
import pytest

from tileframe.llm import balltree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total, df = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        own, found = set(TERM.findall((text or "").translate(LOWER))), []
        for i, c in counts:
            m = 100 - 90 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, place + 1, i, -s) for place, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(map(str, out))


def told(found):
    return sorted(str((r["query"], r["rank"], r.id, r.score)) for r in found.collect())


def test_gives_what_comparing_all_gives(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert told(balltree.search(documents, items)) == told(balltree.search(documents.repartition(5), items)) == want


@pytest.mark.parametrize("terms, portion", [(20, 3), (50_000, 4096)])
def test_odd_rows_and_passes(spark, odd_docs, monkeypatch, terms, portion):
    monkeypatch.setattr(balltree, "TERMS", terms)
    monkeypatch.setattr(balltree, "PORTION", portion)
    monkeypatch.setattr(balltree, "LEAF", 2)
    items = [(1, "a b C the same LINE"), (1, "a b C the same LINE"), (2, None), (3, " .,; "), (None, "word é ß x"), (5, "nothing has thisterm"), (6, "one two " * 200)]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'clash' as q", "'clash' as query", "'clash' as id", "'clash' as score")
    want = plain([tuple(r) for r in odd_docs.select("doc_id", "text").collect()], items, 4)
    assert told(balltree.search(odd_docs, asked, k=4)) == want
    assert balltree.search(odd_docs.limit(0), asked).count() == balltree.search(odd_docs, asked.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    width, n = 300, 4000
    topics = rng.integers(0, 20, n)
    rows = [np.unique(np.concatenate([rng.integers(0, 30, 5), topics[i] * 13 + 30 + rng.integers(0, 13, 6)])) for i in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    places, values = np.concatenate(rows), rng.integers(1, 900_000, starts[-1])
    dense = np.zeros((n, width), np.int64)
    for i, r in enumerate(rows):
        dense[i, r] = values[starts[i] : starts[i + 1]]
    tree = balltree.Tree(np.arange(n), starts, places, values, width)
    tree.finish()
    looked, leaves = 0, sum(left < 0 for _, _, left, _ in tree.nodes)
    for t in range(20):
        query = np.unique(np.concatenate([rng.integers(0, 30, 3), t * 13 + 30 + rng.integers(0, 13, 4)]))
        weights = rng.integers(0, 9000, len(query))
        scores = dense[:, query] @ weights
        bounds = tree.bounds(query, weights)
        for (a, b, _, _), bound in zip(tree.nodes, bounds, strict=True):
            assert scores[tree.ids[a:b]].max() <= bound
        best = []
        looked += tree.search(query, weights, np.zeros(width, np.int64), best, 10)
        want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == want
    assert looked < 0.9 * 20 * leaves


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 400_000), (2, "ab")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "ab")], "item_id long, text string")
    assert told(balltree.search(docs, asked)) == plain([tuple(r) for r in docs.collect()], [(1, "ab")])
