"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, imatch, importance, lang_id, line_dedup, lm_score, mixing, packing, quality_rules, secrets, simhash, spm, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints differ in at most 3 bits.

    Null and blank texts have fingerprint 0 and link like others. Repeated rows come back as
    often as given, null ids never name a component, an empty table gives no rows.
    """
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return found.select(F.col("id").alias("doc_id"), simhash.hexed(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without the lines that at least 10 sites have.

    Null texts count as empty here and have nothing removed, null sites don't count, repeated
    rows come back as often as given, an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = line_dedup.drop_boilerplate(docs)
    kept = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_removed", F.char_length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


ORACLE_SQL["op2_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM documents
), marked AS (
    SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]')
        AND line IN (SELECT line FROM lines WHERE source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 10) AS gone
    FROM lines
), kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
    FROM marked GROUP BY doc_id
)
SELECT doc_id, n_removed, CAST(length(text) AS BIGINT) AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    Null texts are empty and give their end alone. Repeated rows and null ids are packed like
    others, an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all texts. Null and blank texts have no words, so ``base_failed`` holds; repeated rows count as often as given, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = quality_rules.judged(docs).withColumn("base_failed", failed)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return found.select("doc_id", *base, (~F.col("base_failed") & F.col("good")).alias("kept"), "p_good")


def _split(modulus: int):
    """Whether the remainder of the id's CRC32 is the held-out one, 2."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus == 2


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of all texts under word counts and a PPM model of those that aren't held out.

    Null texts are empty and have their end alone. Rows with a null id are trained on, repeated
    rows count as often as given, an empty table gives no rows.
    """
    return lm_score.score(table(spark, sf_dir, "documents"), _split(7), order=5).withColumnRenamed("id", "doc_id")


@query
def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text. Null texts and texts without a letter are ``und`` with score 0; rows without language teach nothing; repeated rows come back as often as given."""
    found = lang_id.identify(table(spark, sf_dir, "documents"), _split(4), order=3)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def good_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def toxic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled toxic, however well they are written."""
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of all documents that looks like those labelled good and not toxic.

    Null and empty texts weigh 0; rows equal in id and text are chosen alike; labels of
    unknown or null ids do nothing; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, good_ids(spark, sf_dir), keep_text=False, shun_ids=toxic_ids(spark, sf_dir))


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its half replaced form. Null texts are empty; ties of ids go by text; null ids come last; an empty table gives no rows."""
    found = imatch.fingerprints_with_edits(table(spark, sf_dir, "documents"))
    return found.withColumns({c: imatch.as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")}).withColumnRenamed("id", "doc_id")


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text, digested, and whether they give it back. Null texts are empty and have no ids; repeated rows come back as often as given."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spm.decode(spm.encode(docs, path), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each text. Null and empty texts have none; repeated rows come back as often as given."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), out_col="secret_spans").select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secret_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("checked"), F.sha2(told(base), 256).alias("base_sha256"), told("secret_spans").alias("spans")
    )


@query
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes of each document.

    Null and blank texts have size 0 and give nothing, a null source is the last source, null ids and repeated rows
    are mixed like others, an empty table gives no rows.
    """
    found = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE_SQL["op11_mixing"] = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS noise,
        coalesce(greatest(0.05, 1 - CAST(length(regexp_replace(text, '[\p{L}\x20\x09-\x0D]+', '', 'g')) AS DOUBLE) / nullif(length(text), 0)), 1.0) AS quality
    FROM documents
), s AS (
    SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), r AS (  -- the share of a unit of weight if the sources that reach their limit first are left out
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS unit, row_number() OVER (ORDER BY 3 * source_size / weight, source) AS place
    FROM s WINDOW before AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, CAST(least(3 * source_size, coalesce((SELECT unit FROM r WHERE 3 * source_size >= unit * weight ORDER BY place LIMIT 1) * weight, 3 * source_size)) AS DOUBLE) AS target FROM s
), k AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln((('0x' || substr(noise, 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656) / quality, noise ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken_before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size + 0.5) AS BIGINT) - taken_before)) AS BIGINT) AS taken FROM k
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of each embedding.

    Rows whose vector is null or has null or non-finite entries are left out, null ids and repeated rows are kept, components of no
    variance have no rows, an empty table gives no rows.
    """
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    rows = found.select(F.col("id").alias("vec_id"), "n", "deviation", "variances", "trace", "identity_error", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.get("variances", F.col("place")) / F.col("trace")
    return rows.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened", explained.alias("explained"), "identity_error")


@query
def op13_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of each benchmark item.

    Null texts have no terms, items without any have no rows, repeated documents are ranked one by one, null ids come after others of the
    same score, empty tables give no rows.
    """
    found = balltree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.select(F.col("query").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL["op13_balltree"] = rf"""
WITH q AS (SELECT item_id, unnest(list_distinct({_TERMS_SQL})) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS_SQL} AS terms FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) SEMI JOIN q USING (term) GROUP BY row, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, docs),
s AS (SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * docs) // total)))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN t USING (term) JOIN d USING (row), c GROUP BY item_id, row)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s JOIN d USING (row) WHERE score > 0) WHERE place <= 10
"""


# ---- what SQL can tell of operators that it can't express as a whole ----

#: Whether the remainder of the CRC32 of the id's digits by a number is 2.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
_WORDS_SQL = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))


def base(of: Query, *columns: str) -> None:
    """Register some columns of a query as one of its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = of(spark, sf_dir)
        if "base_rounded" in columns:  # sums of logarithms are told in another order by SQL
            found = found.withColumn("base_rounded", F.round("base_score", 4))
        return found.select(*columns)

    QUERIES[f"{of.__name__.split('_')[0]}_base"] = run


base(op4_quality_rules, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
ORACLE_SQL["op4_base"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS_SQL.format(text="coalesce(text, '')")} AS words FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
win AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(3) r(k) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM l LEFT JOIN cov USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
"""

base(op5_lm_score, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_rounded")
ORACLE_SQL["op5_base"] = rf"""
WITH t AS (SELECT doc_id, {_CRC_SQL} % 7 = 2 AS held_out, unnest(list_append({_WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, '')) AS token FROM documents),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token), s AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_rounded
FROM t LEFT JOIN c USING (token), s GROUP BY doc_id, held_out
"""

base(op8_fingerprints, "doc_id", "n_chars", "edited_sha256")
ORACLE_SQL["op8_base"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS after FROM d WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substr(text, 1, n - n // 2) || substr(after, 1, n // 2)) AS edited_sha256 FROM n
"""

base(op10_secrets, "doc_id", "n_assign", "n_access", "n_hex")
ORACLE_SQL["op10_base"] = rf"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
    CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access,
    CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex FROM documents
"""

base(op12_whitening, "vec_id", "component", "n", "deviation")
ORACLE_SQL["op12_base"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
f AS (SELECT DISTINCT x FROM e), n AS (SELECT count(*) AS n FROM f),
s AS (SELECT list(s ORDER BY i) AS sums FROM (SELECT i, CAST(sum(v) AS BIGINT) AS s FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM f) GROUP BY i))
SELECT vec_id, CAST(component AS INTEGER) AS component, n, CAST(list_sum(list_transform(list_zip(x, sums), lambda p: (n * p[1] - p[2]) * (n * p[1] - p[2]))) AS BIGINT) AS deviation
FROM e, n, s, range(1, 5) c(component)
"""
