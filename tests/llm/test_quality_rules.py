import re
from collections import Counter

from pyspark.sql import functions as F

from tileframe.llm import quality_rules as q
from tileframe.llm.queries import QUERIES


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def check(docs):
    rows = q.measured(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    for r in rows:
        assert tuple(r)[1:] == plain(r.text), r.text
    return len(rows)


def test_measures_of_whole_tables(spark, documents, odd_docs):
    assert check(documents) == documents.count()
    assert check(odd_docs) == odd_docs.count()
    tricky = ["a b c a b c", "a a a a a", "a b c d a b c", "x x x", " lead trail ", "a\n\na\n a\na", "a b c d e f g a b c x d e f"]
    check(spark.createDataFrame([(t,) for t in tricky], "text string"))


def test_estimates_of_known_rules():
    """Votes drawn from known rates give these back."""
    import random

    rng = random.Random(3)
    good, bad = [(0.9, 0.08, 0.02), (0.7, 0.25, 0.05), (0.8, 0.15, 0.05)], [(0.2, 0.2, 0.6), (0.3, 0.2, 0.5), (0.1, 0.3, 0.6)]
    drawn = Counter(tuple(rng.choices((1, 0, -1), r)[0] for r in (good if rng.random() < 0.7 else bad)) for _ in range(30_000))
    share, rates = q.estimate(sorted(drawn.items()))
    assert abs(share - 0.7) < 0.05
    for (g, b), g0, b0 in zip(rates, good, bad, strict=True):
        assert max(abs(x - y) for x, y in zip(g, g0, strict=True)) < 0.05 and max(abs(x - y) for x, y in zip(b, b0, strict=True)) < 0.1


def test_no_votes_and_no_rows():
    assert q.estimate([])[0] == q.START_SHARE
    share, rates = q.estimate([((0, 0), 5)])
    assert 0 < share < 1 and len(rates) == 2


def test_posterior_in_spark_is_that_of_the_estimates(documents):
    rows = q.judged(documents).select("votes", "p_good").collect()
    estimates = q.estimate(sorted(Counter(tuple(r.votes) for r in rows).items()))
    for r in rows:
        assert abs(r.p_good - q.posterior_of(tuple(r.votes), *estimates)) < 1e-9


def test_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op4_quality_rules"](spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right = found.agg(F.avg(((F.col("quality") == 1) == F.col("kept")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int")))).first()
    assert right[0] > 0.97 and right[1] > 0.98


def test_odd_rows(odd_docs):
    assert q.judged(odd_docs).where("_words = 'clash' and own_words = 'clash' and _at = 'clash' and own_at = 'clash'").count() == odd_docs.count()
    assert q.judged(odd_docs.limit(0)).count() == 0
