import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tileframe.llm import lang_id, lm_score, ppm


def symbols(text):
    return [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()] + [ppm.END]


def train(texts, order):
    """Counts of each context (a tuple) by symbol: the longest count all, shorter ones a symbol once a longer context."""
    trie = defaultdict(Counter)
    for t in texts:
        s = [ppm.START] * order + symbols(t)
        for i in range(order, len(s)):
            trie[tuple(s[i - order : i])][s[i]] += 1
    for k in range(order - 1, -1, -1):
        for ctx in [c for c in trie if len(c) == k + 1]:
            for x in trie[ctx]:
                trie[ctx[1:]][x] += 1
    return trie


def plain_log10(trie, text, order):
    s, total = [ppm.START] * order + symbols(text), 0.0
    for i in range(order, len(s)):
        out = set()
        for k in range(order, -1, -1):
            own = trie.get(tuple(s[i - k : i]))
            if not own:
                continue
            left = {x: c for x, c in own.items() if x not in out}
            if left:
                n = sum(left.values())
                if s[i] in left:
                    total += math.log10((2 * left[s[i]] - 1) / (2 * n))
                    break
                total += math.log10(len(left) / (2 * n))
            out |= set(own)
        else:
            total -= math.log10(ppm.SYMBOLS - len(out))
    return total


def model(texts, order):
    counter = ppm.Counter()
    ppm.count_batch(pa.array(texts, pa.string()), order, counter)
    return ppm.Model(order, *counter.merged())


TEXT = st.text("abAB é\n", max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6), st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=4), st.integers(1, 4))
def test_model_is_that_of_explicit_exclusion(training, texts, order):
    trie = train(training, order)
    got = ppm.score_batch(pa.array(texts, pa.string()), order, [model(training, order)])[0]
    assert np.allclose(got, [plain_log10(trie, t, order) for t in texts])


def test_probabilities_of_a_symbol_sum_to_one():
    m = model(["abracadabra", "banana", ""], 3)
    for ctx in (b"abr", b"zzz", b"\xfe\xfea", b"\xfe\xfe\xfe"):
        g = np.array([int.from_bytes(ctx + bytes([x])) for x in range(256) if x != ppm.START], np.uint64)
        assert abs((10 ** m.log10(g)).sum() - 1) < 1e-9


def test_chunks_do_not_matter(monkeypatch):
    texts = ["some text here", None, "", "more of it " * 30]
    want = ppm.score_batch(pa.array(texts), 3, [model(texts, 3)])
    monkeypatch.setattr(ppm, "CHUNK", 7)
    assert np.allclose(want, ppm.score_batch(pa.array(texts), 3, [model(texts, 3)]))


def held_out(modulus):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == 2


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), ""]


@pytest.mark.parametrize("most", [{}, {"max_grams": 500, "max_words": 20}])
@pytest.mark.parametrize("name", ["documents", "odd_docs"])
def test_scores(request, name, most):
    docs = request.getfixturevalue(name).limit(60)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    train_rows = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train_rows for w in words(t))
    n, v = sum(c.values()), len(c)
    trie = train(train_rows, 3)
    want = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want.append((-1 if i is None else i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, round(base, 6), round(plain_log10(trie, t, 3), 6)))
    got = lm_score.score(docs, held_out(7), order=3, **most).collect()
    key = lambda x: (x[0], x[2], x[5])
    got = sorted(((-1 if r.id is None else r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5 and abs(a[6] - b[6]) < 1e-5


def test_large_models_are_neither_sent_nor_read_twice(documents, monkeypatch):
    """Beyond the limit, and with portions of a few documents, scores are those of a model that is sent."""
    key = lambda r: (r.id, round(r.score, 6))
    want = sorted(map(key, lm_score.score(documents, held_out(7)).collect()))
    monkeypatch.setattr(lm_score, "PORTION", 10_000)
    got = sorted(map(key, lm_score.score(documents, held_out(7), max_grams=20_000).collect()))
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want], atol=1e-5)


def test_no_training_text(spark):
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = lm_score.score(one, F.lit(True)).first()
    assert abs(r.score + 3 * math.log10(255)) < 1e-9 and r.n_known == 0 and abs(r.base_score) < 1e-9
    assert lm_score.score(one.limit(0), F.lit(False)).count() == 0
    p = lang_id.identify(one.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).first()
    assert (p.lang_pred, p.score) == ("und", 0.0)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.identify(docs, held_out(4), order=3)
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    assert got.where("score < 0 or score > 1").count() == 0


def test_languages_of_odd_rows(odd_docs, documents):
    got = lang_id.identify(documents.select(*documents.columns).unionByName(odd_docs.select(*documents.columns)), held_out(4)).collect()
    assert all((r.lang_pred == "und") == (not any(ch.isalpha() for ch in r.text or "")) for r in got)
    assert all(r._told == r.told == "clash" for r in lang_id.identify(odd_docs, F.lit(False)).collect())
    few = lang_id.train(documents, sample=5)
    small = lang_id.train(documents, max_grams=3000)
    assert sum(len(m.levels[3][0]) for m in small.values()) <= 3000
    assert sorted(few) == ["de", "en", "es", "fr"]
    assert lang_id.identify(odd_docs.limit(0), F.lit(False)).count() == 0


def test_prediction_ignores_label_source_and_id(spark, documents):
    models = lang_id.train(documents)
    other = documents.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"))
    a = lang_id.predict(documents, models).select("doc_id", "lang_pred", "score").collect()
    b = lang_id.predict(other, models).select(F.col("doc_id") - 7, "lang_pred", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
