import random
import re

import xxhash
from pyspark.sql import functions as F

from tileframe.llm import simhash
from tileframe.llm.components import connected_components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """rows: (id, fingerprint) -> component id by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted((-(1 << 63) if i is None else i, f, least.get(find(f), -(1 << 63))) for i, f in rows)


def check(docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs).collect()
    none = lambda x: -(1 << 63) if x is None else x
    assert sorted((none(r.id), r.fp % (1 << 64), none(r.component)) for r in got) == plain_components(rows)


def test_whole_table(documents):
    check(documents)


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_empty(documents):
    assert simhash.near_duplicates(documents.limit(0)).count() == 0


def test_links_find_every_component(spark, monkeypatch):
    """Chains of flipped bits, far ends and both halves; also with blocks as small as two rows."""

    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(25):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
            f = rng.choice([f, g])
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {}
    for x, _, component in plain_components([(x, x % (1 << 64)) for x in signed]):
        want.setdefault(component, set()).add(x)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block in (8192, 2):
        monkeypatch.setattr(simhash, "BLOCK", block)
        roots = {r.node: r.root for r in connected_components(simhash.links(df)).collect()}
        got = {}
        for x in signed:
            got.setdefault(roots.get(x, x), set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100), (200, 201), (201, 200), (203, 201)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {201: 200, 203: 200}


def test_rows_at_anchors_are_never_broadcast(spark):
    """They come from few fingerprints, by whose size planning would hold them for small."""
    fps = spark.range(20_000).select(F.xxhash64("id").alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).select("fp")
    found = simhash.links(fps)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
