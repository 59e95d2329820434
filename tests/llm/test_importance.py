import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tileframe.llm import importance, markers
from tileframe.llm.queries import QUERIES


def test_counts_and_weights_are_those_of_a_plain_pass(documents, spark, sf):
    rows = documents.select("doc_id", "text").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(importance.features(r.text).tolist())
        if r.doc_id in good:
            target.update(importance.features(r.text).tolist())
    share, c = sum(target.values()) / sum(raw.values()), importance.SHRINK
    want = {r.doc_id: sum(math.log((target[k] + c) / (raw[k] * share + c)) for k in importance.features(r.text).tolist()) for r in rows}
    got = QUERIES["op7_quality_classifier"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.log_weight - want[r.doc_id]) < 1e-6 * max(1, abs(want[r.doc_id]))
    k = round(sum(1 / (1 + math.exp(-max(-500, min(500, w + importance.LOG_ODDS)))) for w in want.values()))
    best = sorted(got, key=lambda r: -r.gumbel_key)[:k]
    assert {r.doc_id for r in got if r.chosen} == {r.doc_id for r in best}


def test_kept_is_the_sample_by_the_lesser_weight(spark):
    """``kept`` against a plain top-k, and its recall of toxic documents where few are labelled."""
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_quality_classifier"](spark, sf).collect()
    weight = {r.doc_id: importance.SHARP * min(r.log_weight + importance.LOG_ODDS, -r.shun_log_odds) for r in got}
    k = round(sum(1 / (1 + math.exp(-max(-500, min(500, w)))) for w in weight.values()))
    best = sorted(got, key=lambda r: -(weight[r.doc_id] + r.gumbel_key - r.log_weight))[:k]
    kept = {r.doc_id for r in got if r.kept}
    assert 0 < k < len(got) and kept == {r.doc_id for r in best}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()
    toxic, clean = ({r.doc_id for r in labels if r.toxic == t} for t in (1, 0))
    assert len(toxic - kept) >= 0.9 * len(toxic) and len(clean & kept) > 0.97 * len(clean)


def test_markers_against_a_plain_count(spark):
    bad, good = ["you scum, go away scum", "such scum is bad"] * 20, ["you go away", "such a day is good", None, ""] * 30
    rows = [(f"{t} {i}", 1) for i, t in enumerate(bad)] + [(t and f"{t} {i}", 0) for i, t in enumerate(good)]
    found = markers.Markers(spark.createDataFrame(rows, "text string, kind int"), -1.0)
    tokens = [[importance.tokens_of(t) for t, k in rows if k == kind] for kind in (0, 1)]
    often = sum(t.count("scum") for t in tokens[1]) / sum(map(len, tokens[1]))
    assert abs(found.of("scum") - math.log((60 + 0.5) / 0.5 * sum(map(len, tokens[0])) / sum(map(len, tokens[1])))) < 1e-9
    assert found.of("you") == 0 and found.of("go") == 0 and found.cost > 0.9 * often
    cache = importance.Cache(found.of)
    assert found.log_odds(["scum", "you"], cache) > 0 > found.log_odds(["you"], cache) and found.log_odds([], cache) == -1.0
    x = markers.sureness(np.array([12.0, 10.0, 0.0]), 51, np.array([0.0, 60.0, 9.0]), 300)
    p = 12 / 351
    assert abs(x[0] - math.sqrt(2 * (12 * math.log(12 / (51 * p)) + 39 * math.log(39 / (51 * (1 - p))) - 300 * math.log(1 - p)))) < 1e-9
    assert abs(x[1]) < 0.1 and x[2] < 0


def test_good_stays_and_junk_goes(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    target = labels.where("quality = 1 and toxic = 0 and doc_id % 2 = 0").select("doc_id")
    found = importance.resample(docs, target, keep_text=False).join(labels.where("doc_id % 2 = 1"), "doc_id")
    share = {r.quality: r.share for r in found.where("toxic = 0 or quality = 0").groupBy("quality").agg(F.avg(F.col("chosen").cast("int")).alias("share")).collect()}
    assert share[1] > 0.97 and share[0] < 0.06


def test_toxic_goes_however_well_written(spark):
    """Of held-out documents of quality 1 toxic ones go and others stay, short or long."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    target, toxic = labels.where("quality = 1 and toxic = 0 and doc_id % 2 = 0").select("doc_id"), labels.where("toxic = 1 and doc_id % 2 = 0").select("doc_id")
    found = importance.resample(docs, target, keep_text=False, shun_ids=toxic).join(labels.where("doc_id % 2 = 1 and quality = 1"), "doc_id")
    share = {r.toxic: r.share for r in found.groupBy("toxic").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[0] > 0.96 and share[1] < 0.03


def test_nothing_to_shun(odd_docs):
    ids = odd_docs.select("doc_id").limit(4)
    for shun in (ids, ids.limit(0)):
        got = importance.resample(odd_docs, ids, shun_ids=shun)
        assert got.count() == odd_docs.count() and got.where("kept != chosen").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(float(k), int(t)) for k, t in zip(rng.integers(-40, 40, 500) * 17.25, rng.integers(-(1 << 62), 1 << 62, 500), strict=True)]
    df = spark.createDataFrame(rows, "k double, t long")
    for size in (0, 1, 17, 250, 500, 900):
        got = [tuple(r)[:2] for r in df.withColumn("c", importance.top_k(df, F.col("k"), F.col("t"), size)).where("c").collect()]
        assert sorted(got) == sorted(sorted(rows, reverse=True)[:size])
    far = spark.createDataFrame([(-2e6, 1), (-3e6, 2), (5e11, 3), (5e11 + 1e-3, 4), (-1e300, 5)], "k double, t long")
    for size, want in ((1, {4}), (2, {3, 4}), (3, {1, 3, 4}), (4, {1, 2, 3, 4}), (5, {1, 2, 3, 4, 5})):
        assert {r.t for r in far.where(importance.top_k(far, F.col("k"), F.col("t"), size)).collect()} == want
    same = spark.createDataFrame([(1.0, 5)] * 4, "k double, t long")
    assert same.where(importance.top_k(same, F.col("k"), F.col("t"), 2)).count() == 4


def test_gumbel_noise(spark):
    x = np.array([r.g for r in spark.range(20000).select(importance.gumbel(F.col("id"), F.lit("a")).alias("g")).collect()])
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.var() - math.pi**2 / 6) < 0.1


def test_odd_rows(spark, odd_docs):
    ids = odd_docs.select("doc_id").limit(4)
    got = importance.resample(odd_docs, ids)
    assert got.count() == odd_docs.count() and got.where("log_weight is null or chosen is null").count() == 0
    assert set(odd_docs.columns) <= set(got.columns) and got.where("_tie != 'clash' or tie != 'clash' or _target != 'clash'").count() == 0
    assert importance.resample(odd_docs, ids, shun_ids=ids).count() == odd_docs.count()
    assert importance.resample(odd_docs, ids.limit(0)).where("log_weight != 0").count() == 0
    assert importance.resample(odd_docs.limit(0), ids).count() == 0
    assert importance.resample(odd_docs, ids, size=3).where("chosen").count() >= 3


def test_texts_of_labels_are_found_without_a_shuffle_of_all_texts(spark):
    """However large the tables are: only the samples of ids are sent, and only labelled texts are dealt out."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "target long, text string")
        kinds = [spark.range(k, 50, 5).toDF("target") for k in (0, 1)]
        found = importance.labelled_texts(texts, kinds, [10, 10])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(map(tuple, found.collect())) == sorted((f"text {i}", k) for i in range(7) for k in (0, 1))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
