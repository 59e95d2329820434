import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tileframe.llm import mixing, prefix


def plain(rows):
    """taken and target by (id, text) for rows (id, source, text), with every step in plain Python."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    sizes = {s: sum(size(t) for _, x, t in rows if x == s) for s in sources}
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    target, free = {}, set(sources)
    while free:
        left = sum(sizes.values()) - sum(target.values())
        over = [s for s in free if 3 * sizes[s] < left / sum(weight[x] for x in free) * weight[s]]
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= set(over)
    left, all_weight = sum(sizes.values()) - sum(target.values()), sum(weight[x] for x in free)
    target |= {s: left / all_weight * weight[s] for s in free}

    def key(doc, text):
        noise = hashlib.md5(f"{'' if doc is None else doc}:{text or ''}".encode()).hexdigest()
        quality = max(0.05, 1 - sum(not (c.isalpha() or c in " \t\n\v\f\r") for c in text) / len(text)) if text else 1.0
        return -math.log((int(noise[:12], 16) + 0.5) / (1 << 48)) / quality, noise

    found = []
    for s in sources:
        own = sorted(((doc, t) for doc, x, t in rows if x == s), key=lambda d: key(*d))
        times = min(3, int(target[s] // sizes[s])) if sizes[s] else 0
        budget, before = math.floor(target[s] - times * sizes[s] + 0.5), 0
        for doc, t in own:
            found.append((doc, size(t), sizes[s], target[s], times * size(t) + max(0, min(size(t), budget - before))))
            before += size(t)
    return found


def told(found):
    return sorted((str(d), n, of, round(t, 6), k) for d, n, of, t, k in found)


def test_gives_what_plain_python_gives(odd_docs, documents):
    for docs in (odd_docs, documents):
        got = [tuple(r) for r in mixing.mix(docs).select("id", "size", "source_size", "target", "taken").collect()]
        assert told(got) == told(plain([tuple(r) for r in docs.select("doc_id", "source", "text").collect()]))
        assert all(k <= 3 * n for _, n, _, _, k in got)


def test_reruns_and_other_partitions_agree(documents):
    one, other = (sorted(map(str, mixing.mix(d).drop("quality").collect())) for d in (documents, documents.repartition(7)))
    assert one == other


def test_hot_source_and_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "big").when(F.col("id") < 2990, "mid").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    found = mixing.mix(docs, keep=("text", "source"))
    sums = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("told"))
    for r in sums.collect():
        assert abs(r.taken - r.target) <= 1 and r.size == r.told and r.target <= 3 * r.size
    assert abs(sums.agg(F.sum("target")).first()[0] - sums.agg(F.sum("size")).first()[0]) < 1e-6
    out = mixing.drawn(found)
    assert out.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == found.agg(F.sum("taken")).first()[0]
    assert out.groupBy("id", "copy").count().where("count > 1").count() == 0


def test_quality_makes_documents_more_likely(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.lit("x y").alias("text"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("q"))
    found = mixing.mix(docs, weights=(1, 3), keep=("q",), quality=F.col("q")).where("source_size = 4000 and id < 2000")
    half = {r.q: r.n for r in found.where("taken > 0").groupBy("q").agg(F.count("*").alias("n")).collect()}
    assert half[4.0] > 2 * half[1.0]


def test_shares_stop_at_three_times(spark):
    sources = spark.createDataFrame([("a", 10, 1), ("b", 10, 2), ("c", 1000, 3), ("d", 0, 1)], "s string, size long, weight long")
    assert {r.s: r.target for r in mixing.shares(sources).collect()} == {"a": 30.0, "b": 30.0, "c": 960.0, "d": 0.0}
    assert mixing.shares(sources.limit(0)).count() == 0
    assert {r.target for r in mixing.shares(sources.withColumn("size", F.lit(0))).collect()} == {0.0}


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_running_sums_and_numbers(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 7 as string)) g", "xxhash64(id) % 50 as k", "id % 11 as v", "'x' as range_part")
        got = defaultdict(list)
        for r in prefix.running_sum(rows, "v", ["g"], [F.col("k"), F.col("id")]).collect():
            got[r.g].append((r.k, r.id, r.v, r.before))
        for own in got.values():
            at = 0
            for _, _, v, b in sorted(own):
                assert b == at
                at += v
        assert sum(map(len, got.values())) == 1000
        assert sorted(r.n for r in prefix.dense(rows.repartition(6), "n").collect()) == list(range(1000))
        assert prefix.running_sum(rows.limit(0), "v", ["g"], [F.col("k")]).count() == prefix.dense(rows.limit(0), "n").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty(documents, odd_docs):
    assert mixing.mix(documents.limit(0)).count() == 0
    assert mixing.mix(odd_docs.where("text is null")).where("taken = 0 and target = 0").count() == odd_docs.where("text is null").count()
