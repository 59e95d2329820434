"""Line dedup by the spread of lines over sites.

Each distinct line gets a HyperLogLog sketch of the sites that have it, merged by
aggregation. Lines whose estimate lies clearly on one side of the threshold are settled;
those near it get exact counts of their distinct sites. Lines on at least ``min_sites``
sites are boilerplate and go, wherever they are. By that rule alone all lines of a text
that is itself copied to so many sites are boilerplate; with ``spare_copies`` only rows
whose text is mostly their own count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free

#: Sites that make a line boilerplate; log2 of a sketch's buckets; relative error within which counts are made exact.
MIN_SITES, LG_K, NEAR = 10, 12, 0.1
#: Share of a text's characters in lines of many sites above which it is taken for a copy: as near as near-duplicates are.
COPIED = 0.8
#: Boilerplate lines that are broadcast at most; more of them are joined with salt.
BROADCAST_LINES, SALTS = 1_000_000, 16


def _hashed_lines(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """A row for each line with a character other than white space, with its XXH64."""
    # columns are worked out once for each text, below the rows of its lines
    rows = docs.select(*columns, F.split(F.col(text_col).cast("string"), "\n").alias("own_lines"))
    rows = rows.select(*[c for c in rows.columns if c != "own_lines"], F.posexplode("own_lines").alias("place", "line"))
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[c for c in rows.columns if c != "line"], F.char_length("line").alias("n"), F.xxhash64("line").alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(h): hashes of the lines that at least ``min_sites`` distinct sites have. Null sites don't count."""
    lines = _hashed_lines(docs, text_col, F.col(site_col).cast("string").alias("site")).where("site is not null")
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    spread = checkpoint(spread.where(F.col("sites") >= min_sites * (1 - NEAR)))
    sure, near = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("h"), spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select("h")
    pairs = _matched(lines.select("site", "h"), near).groupBy("h", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h")
    return sure.union(exact)


def _on_own_texts(docs: DataFrame, found: DataFrame, min_sites: int, site_col: str, text_col: str, id_col: str) -> DataFrame:
    """(h): those of ``found`` that at least ``min_sites`` sites have in texts of which no more than COPIED is lines of ``found``.

    Copies and near copies of one text on many sites have nearly all their lines in common,
    so they say nothing of a line; boilerplate is also found among lines of other texts, be these mostly boilerplate.
    """
    text = F.col(text_col).cast("string")
    site = F.col(site_col).cast("string").alias("site")
    row = F.xxhash64(F.col(id_col), site, text).alias("_row")
    rows = _matched(_hashed_lines(docs, text_col, site, row, F.char_length(text).alias("_chars")).where("site is not null"), found)
    rows = rows.groupBy("_row", "site", "_chars").agg(F.collect_set(F.struct("place", "n", "h")).alias("_in"))
    common = F.aggregate("_in", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    pairs = rows.where(common <= COPIED * F.col("_chars")).select("site", F.explode("_in.h").alias("h")).distinct()
    return pairs.groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h")


def _matched(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """The lines whose hash is among ``hashes``: broadcast if there are few of them, else with each hash dealt to SALTS groups."""
    if hashes.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(hashes), "h", "left_semi")
    salted = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64(*lines.columns), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left_semi").drop("salt")


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", spare_copies: bool = False) -> DataFrame:
    """All rows of ``docs``, with the boilerplate lines of their texts left out, and n_removed, how many these were.

    Blank lines stay. A text of nothing but boilerplate becomes empty. Null texts stay null
    and have 0 removed. Rows with equal id and text are treated alike, null ids too. Other
    columns pass through; a column named n_removed is replaced. With ``spare_copies`` a line
    must be on ``min_sites`` sites in texts of which no more than COPIED is lines of many sites, so that texts copied to
    many sites keep theirs. Pages that have less than that of their own are taken for copies of each other.
    """
    found = checkpoint(boilerplate(docs, min_sites, site_col, text_col))
    if spare_copies:
        found = checkpoint(_on_own_texts(docs, found, min_sites, site_col, text_col, id_col))
    key, gone = free(docs, "row_key"), free(docs, "gone_places")
    own = F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias(key)
    places = _matched(_hashed_lines(docs, text_col, own), found).groupBy(key).agg(F.collect_set("place").alias(gone))
    rows = docs.withColumn(key, own).join(places, key, "left").drop(key)
    lines = F.split(F.col(text_col).cast("string"), "\n")
    # places go by hash and the text is split once: it may have a million lines and as many that go
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.transform(F.array(lines), lambda own: F.array_join(F.transform(places, lambda i: F.get(own, i)), "\n"))
    rows = rows.withColumns(
        {text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.get(kept, F.lit(0))), "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    )
    return rows.drop(gone)
