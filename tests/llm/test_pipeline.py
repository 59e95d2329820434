import re
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tileframe.llm import secrets


def written(df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name))


def test_stages(spark, sf, documents, tmp_path):
    docs, before = documents, None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), tmp_path, name)
        if name != "packing":
            assert docs.columns == documents.columns
        if name == "quality":
            assert 0.6 * before.count() < docs.count() < before.count()
            assert docs.join(before, documents.columns, "left_anti").count() == 0
        if name == "lines":
            assert docs.count() == before.count() and docs.where("n_chars != char_length(text)").count() == 0
        if name == "near_duplicates":
            words = lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", t.lower()))
            assert len({words(r.text) for r in before.collect()}) >= docs.count() == len({words(r.text) for r in docs.collect()})
            assert docs.join(before, documents.columns, "left_anti").count() == 0
        if name == "secrets":
            automaton = secrets._automaton()
            assert docs.count() == before.count() and not any(secrets.spans(r.text or "", automaton) for r in docs.collect())
        if name == "packing":
            tokens = defaultdict(int)
            for r in docs.collect():
                tokens[r.doc_id] += r.length
            assert set(tokens) == {r.doc_id for r in before.collect()}
            assert {r.doc_id: r.doc_tokens for r in docs.collect()} == tokens


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).where("length > 0").count() > 100


def test_odd_rows(spark, sf, odd_docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd_docs.select(columns), odd_docs.select(columns).limit(0)):
        docs = written(docs, tmp_path, f"in{docs.count()}")
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf), tmp_path, f"{name}{n}")
        assert (docs.count() > 0) == (n > 0)


def test_columns_with_clashing_names_come_through(spark, sf, documents, tmp_path):
    names = ["kept", "chosen", "log_weight", "gumbel_key", "shun_log_odds", "n_removed", "row_number", "rest", "id", "fp", "root", "secret_spans"]
    docs = written(documents.where("doc_id < 120").select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names]), tmp_path, "clashing")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = written(stage(spark, docs, sf), tmp_path, f"clashing_{name}")
        assert docs.columns == columns
        assert docs.count() > 20 and docs.where(" or ".join(f"{n} != concat('{n} ', doc_id)" for n in names)).count() == 0
    assert stage is corpus_pipeline.secret_scan and corpus_pipeline.packed(spark, docs, sf).count() > 20
