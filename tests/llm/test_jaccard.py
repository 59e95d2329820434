import random

import numpy as np

import corpus_pipeline
from tileframe.llm import jaccard
from tileframe.llm.common import written


def planted():
    """Texts of 120 to 400 words, in 4 copies each with a word in 120 changed, which leaves two of them at a similarity near 0.85, and one of them in 60."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for g in range(40):
        base = [word() for _ in range(rng.randint(120, 400))]
        for _ in range(60 if g == 0 else 4):
            copy = list(base)
            for i in rng.sample(range(len(copy)), len(copy) // 120):
                copy[i] = word()
            texts.append(" ".join(copy))
    return texts


def plain_roots(texts):
    """The least index that each text reaches over pairs at 0.8 or more, all of them compared."""
    sets, root = [jaccard.shingles(t, 5) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= 0.8 * len(a | b) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_planted_near_copies_are_found(spark, sf):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    roots = plain_roots(texts)
    assert len(set(roots)) < len(texts) / 2
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.coalesce(1), sf).collect()}
    assert kept == set(roots)


def test_odd_texts():
    assert jaccard.bands(None, 5) == jaccard.bands(" \n", 5) == []
    assert jaccard.similarity("a b", "A  b", 5) == 1 and jaccard.similarity(None, "a", 5) == 0
    assert jaccard.shingles("a b c d e f", 5) == {b"a b c d e", b"b c d e f"}


def test_links_of_all_pairs(monkeypatch):
    """Groups of texts far and near: block by block the same components come out as from all pairs."""
    texts = planted()
    sets = [jaccard.shingle_hashes(t, 5) for t in texts] + [jaccard.shingle_hashes(None, 5)]
    links = jaccard.spanning_links(np.arange(len(sets)), sets, 0.8)
    root = list(range(len(sets)))
    for u, v in links:
        old, new = max(root[u], root[v]), min(root[u], root[v])
        root = [new if r == old else r for r in root]
    assert root[:-1] == plain_roots(texts) and root[-1] == len(texts)


def test_wide_spread_copies_are_compared_in_blocks(spark, sf, monkeypatch):
    """Copies of one text with up to a tenth of their words changed: no hub is near all of them."""
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 20_000)
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(150)]
    texts = []
    for k in range(120):
        copy = list(base)
        for i in rng.sample(range(150), k % 12):
            copy[i] = f"changed{k}x{i}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.coalesce(1), sf).collect()}
    assert kept == set(plain_roots(texts))


def test_texts_spread_over_blocks_are_never_broadcast(spark, monkeypatch):
    """Each is there once for each block of its bucket, but sized as if it were there once."""
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 64)
    members = written(spark.range(200).selectExpr("1L as band", "id", "id as root"))
    sets = written(spark.range(200).selectExpr("id", "sequence(id, id + 20) as own"))
    found = jaccard._block_links(members, sets, 0.8)
    assert found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("Generate")
