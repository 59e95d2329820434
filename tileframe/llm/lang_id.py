"""Language identification by PPM code lengths: one byte-context tree a language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ppm
from .common import checkpoint, free

UNDETERMINED = "und"
#: Documents of a language that its model learns from, about: those whose hash falls below the share that gives so many.
SAMPLE = 2000
#: Longest paths of all models together, which are broadcast: where the sample has more, a smaller one is taken.
MAX_GRAMS = 4_000_000


def path_counts(docs: DataFrame, order: int) -> DataFrame:
    """(lang, key, n): occurrences of the longest PPM paths in columns lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, ppm.Counter] = {}
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                texts = b.column(1).filter(pc.equal(b.column(0), lang))
                ppm.count_batch(texts, order, found.setdefault(lang, ppm.Counter()))
        for lang, counter in found.items():
            keys, n = counter.merged()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

    return docs.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame, order: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_grams: int = MAX_GRAMS
) -> dict[str, ppm.Model]:
    """A model of each language of ``docs`` from whole texts of about ``sample`` documents (all, if there are fewer).

    Rows without language or text teach nothing. The paths of a sample are counted before
    they are gathered: with more than ``max_grams`` of them, for very long texts or very many
    languages, the sample is made smaller and counted again.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    scale = 1.0
    while True:
        share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, scale * min(1.0, sample / n))])
        picked = (F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 20)) / (1 << 20)) < F.element_at(share, F.col("lang"))
        found = checkpoint(path_counts(rows.where(picked).select("lang", "text"), order))
        if (total := found.count()) <= max_grams:
            break
        scale *= min(0.5, max_grams / total)
    counts = found.toArrow()
    models = {}
    for lang in sorted(sizes):
        own = counts.filter(pc.equal(counts["lang"], lang))
        models[lang] = ppm.Model(order, *ppm.summed(own["key"].to_numpy().view(np.uint64), own["n"].to_numpy().copy()))
    return models


def predict(docs: DataFrame, models: dict[str, ppm.Model], order: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the prediction's posterior for equal priors, 0 to 1).

    A text is of the language whose model gives it the shortest code; equal ones go to the
    first in order of their names. Null texts and texts without a letter are ``und`` with
    score 0, as all are if no language was learned. All other columns stay.
    """
    names = sorted(models)
    sent = docs.sparkSession.sparkContext.broadcast([models[n] for n in names])

    @F.pandas_udf("struct<lang:string,score:double>")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        letter = regex.compile(r"\p{L}")
        for texts in batches:
            array = pa.array(texts, pa.large_string(), from_pandas=True)
            scores = ppm.score_batch(array, order, sent.value) * np.log(10)
            out = pd.DataFrame({"lang": UNDETERMINED, "score": np.zeros(len(texts))})
            if names and len(texts):
                best = scores.argmax(axis=0)
                out["score"] = 1 / np.exp(scores - scores.max(axis=0)).sum(axis=0)
                out["lang"] = [names[k] for k in best]
                blank = np.array([t is None or letter.search(t) is None for t in texts])
                out.loc[blank, ["lang", "score"]] = UNDETERMINED, 0.0
            yield out

    both = free(docs, "told")
    return docs.withColumn(both, told(F.col(text_col).cast("string"))).withColumns({"lang_pred": F.col(f"{both}.lang"), "score": F.col(f"{both}.score")}).drop(both)


def identify(docs: DataFrame, held_out: Column, order: int = 3, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with held_out, lang_pred and score; models learn from rows that aren't held out."""
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return predict(docs, train(docs.where("not held_out"), order, sample), order)
