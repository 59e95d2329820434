"""A corpus from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileframe.llm import importance, jaccard, line_dedup, packing, secrets, simhash
from tileframe.llm.common import checkpoint, checkpoint_dir, drop_written, free, table
from tileframe.llm.prefix import numbered
from tileframe.llm.queries import good_ids, toxic_ids

#: Rows of whole texts that Python gets at once, where the session doesn't say: Spark's own 10,000 are too much memory for long texts.
BATCH_ROWS = 1000


def _bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python BATCH_ROWS at a time from now on, unless the session has a setting of its own. Results don't depend on it."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_ROWS))


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with n_chars as its texts now have them."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(columns)


def _apart(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``own`` in one, so that operators add theirs beside them; and what gives the columns back."""
    rest = free(docs, "rest")
    back = [F.col(c) if c in own else F.col(rest)[c].alias(c) for c in docs.columns]
    return docs.select(*own, F.struct(F.lit(0).alias(free(docs, "nothing")), *[F.col(c) for c in docs.columns if c not in own]).alias(rest)), back


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones chooses, without those like the labelled toxic ones.

    Null and empty texts weigh nothing and are judged like others; rows equal in id and text
    stay or go together; without labels all weights are 0. An empty table stays empty.
    """
    _bound_batches(spark)
    rows, back = _apart(docs, "doc_id", "text")
    return importance.resample(rows, good_ids(spark, sf_dir), shun_ids=toxic_ids(spark, sf_dir)).where("kept").select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites have in texts of their own; texts copied to many sites keep theirs.

    Null texts stay null, null sites don't count, repeated rows are treated alike and an empty
    table stays empty.
    """
    rows, back = _apart(docs, "doc_id", "source", "text")
    return _counted(line_dedup.drop_boilerplate(rows, spare_copies=True).select(*back), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that SimHash or a Jaccard similarity of 0.8 links, both over five words; rows count, so ids may be null or repeated.

    Rows are written with their numbers, which so stay the same in all jobs. Null and
    blank texts are one group, of which one row stays; an empty table stays empty.
    """
    _bound_batches(spark)
    row = free(docs, "row_number")
    rows = numbered(docs, row)
    found = checkpoint(simhash.near_duplicates(rows, id_col=row, shingle=5, bits=3).select("id", F.col("component").alias("root")))
    joined = jaccard.joined(rows, found, id_col=row, shingle=5, least=0.8)
    first = found.where("id = root").join(joined, F.col("id") == F.col("node"), "left_anti").select(F.col("id").alias(row))
    return rows.join(first, row, "left_semi").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret. Null texts stay null, other rows come one by one."""
    _bound_batches(spark)
    return _counted(secrets.redact(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. Null texts give their end alone, repeated rows are packed as often as given, an empty table gives no pieces."""
    import public_tokenizers

    _bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("packing", packed)]

#: SQL has no SimHash or tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written to the shared folder and read again, and what it wrote by the way is deleted then."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        drop_written(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
