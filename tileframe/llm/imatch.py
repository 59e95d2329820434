"""Document fingerprints by I-Match, with DataFrame functions only.

A term is a word in lower case (as its XXH64). Terms whose inverse document frequency
lies in a band make the lexicon; each of several random subsets of the lexicon gives a
document one hash, that of its distinct lexicon terms in the subset, sorted. Large subsets
tell close copies from others, small ones still agree where much of a text was replaced.
A fingerprint is these hashes in order; a subset without a term of the document has hash
0. Two fingerprints are as alike as the share of equal hashes among the subsets of which
one of them has a term. A document without any is hashed by all its terms instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, words_of

#: Kinds of random subsets of the lexicon: place of the hash bits that are compared, one term in how many, and subsets of the kind.
#: A half replaced text keeps most hashes of subsets that have about one of its terms, so there are kinds for short and for long texts.
KINDS = [(0, 4, 4), (8, 16, 8), (16, 64, 18), (24, 256, 18), (36, 1024, 12)]
#: All subsets: place of the bits, one in, and the value that the bits must have.
SUBSETS = [(place, of, s) for place, of, n in KINDS for s in range(n)]
#: Likeness that more than nine of ten half replaced texts have with what they were, and one of fifty unlike texts.
ALIKE = 0.02
#: Band of idf = ln(documents / documents with the term).
IDF_BAND = (4.0, 7.0)
#: Lexicons of more terms are joined by a shuffle instead of being sent along.
SENT_TERMS, SENT_SLOTS = 100_000, 1 << 14


def term_hashes(text: Column) -> Column:
    """Distinct terms of a text, sorted."""
    return F.sort_array(F.array_distinct(F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND, text_col: str = "text") -> DataFrame:
    """(term): terms of ``docs`` whose inverse document frequency lies in the band.

    With an upper end h there are at most e^h times as many as a document has terms on
    average, however many documents there are.
    """
    total = docs.count()
    terms = docs.select(F.explode(term_hashes(F.col(text_col))).alias("term"))
    low, high = total * math.exp(-band[1]), total * math.exp(-band[0])
    return terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(low, high)).select("term")


def _range_part(ids: DataFrame, parts: int) -> Column:
    """The number of an id's range among about ``parts`` of even size; nulls are in the lowest. Found in two steps of about sqrt(parts) comparisons."""
    step = math.isqrt(max(parts - 1, 0)) + 1
    shares = [k / (step * step) for k in range(1, step * step)]
    bounds = (ids.agg(F.percentile_approx("id", shares, 10_000)).first()[0] or []) if shares else []
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0)
    of = F.array(*[F.lit(b).cast("long") for b in bounds])
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[step - 1 :: step]])
    at = F.size(F.filter(coarse, lambda b: b < F.col("id"))) * step
    return F.coalesce(at + F.size(F.filter(F.slice(of, at + 1, step), lambda b: b < F.col("id"))), F.lit(0))


def with_next(docs: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, rank, guest, id, text, next_text): documents by falling id, the last followed by the first.

    Ties go by text, falling; null ids come last. Documents are dealt to ranges of ids, and
    each range gets, as a guest, the first document of the next, so that one shuffle of the
    texts is enough; guests come after the others and have next_text null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    part = _range_part(rows.select("id"), parts)
    firsts = sorted(rows.select("id", part.alias("part")).groupBy("part").agg(F.max("id").alias("first")).collect(), reverse=True)
    lent = [(b["first"], a["part"]) for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    lent = docs.sparkSession.createDataFrame(lent, "first long, to int").groupBy("first").agg(F.collect_list("to").alias("to"))
    rows = rows.join(F.broadcast(lent), rows["id"].eqNullSafe(lent["first"]), "left").withColumn("own", part)
    homes = F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("guest")))
    guests = F.transform(F.coalesce("to", F.array()), lambda t: F.struct(t.cast("int").alias("part"), F.lit(True).alias("guest")))
    rows = rows.select("id", "text", F.inline(F.concat(homes, guests)))
    order = W.partitionBy("part").orderBy("guest", F.desc_nulls_last("id"), F.desc("text"))
    return rows.select(
        "part", "guest", "id", "text", F.row_number().over(order).alias("rank"), F.lead("text").over(order).alias("next_text")
    )


def _subset_hashes(terms: Column) -> Column:
    """The hash of each subset's share of sorted terms; 0 where it has none."""

    def kind(place: int, of: int, n: int) -> Column:
        """An array of the hashes of the subsets of one kind, in an array. Terms in none of them are left out first."""
        bits = lambda t: F.shiftrightunsigned(t, place).bitwiseAND(F.lit(of - 1))
        hashed = lambda kept: F.when(F.size(kept) > 0, F.xxhash64(kept)).otherwise(F.lit(0).cast("long"))
        some = F.filter(terms, lambda t: bits(t) < n) if n < of else terms
        return F.transform(F.array(some), lambda own: F.transform(F.array(*[F.lit(s) for s in range(n)]), lambda s: hashed(F.filter(own, lambda t: bits(t) == s))))

    return F.flatten(F.concat(*[kind(*k) for k in KINDS]))


def _filled(hashes: Column, terms: Column) -> Column:
    """The hashes, or where none is set that of all terms instead of each."""
    return F.when(F.exists(hashes, lambda h: h != 0), hashes).otherwise(F.array_repeat(F.xxhash64(terms), len(SUBSETS)))


def _slots(terms: DataFrame) -> Column:
    """A lexicon as one constant: its terms by slot, the remainder of a term by SENT_SLOTS."""
    slots = terms.sparkSession.range(SENT_SLOTS).select(F.col("id").alias("slot"))
    filled = slots.join(terms.withColumn("slot", F.pmod("term", F.lit(SENT_SLOTS))), "slot", "left")
    filled = filled.groupBy("slot").agg(F.collect_list("term").alias("terms"))
    told = filled.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("slot", "terms"))), lambda s: s["terms"])))
    return F.from_json(F.lit(told.first()[0]), "array<array<long>>")


def _listed_by_value(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with lexicon_own and lexicon_other: terms of own and other that the lexicon has."""
    slots = _slots(terms)
    inside = lambda t: F.array_contains(F.get(slots, F.pmod(t, F.lit(SENT_SLOTS)).cast("int")), t)
    return rows.withColumn("lexicon_own", F.filter("own", inside)).withColumn("lexicon_other", F.filter("other", inside))


def _listed_by_join(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The same for a lexicon of any size: terms meet it in a join and are gathered again by row."""
    tagged = lambda name, v: F.transform(name, lambda t: F.struct(F.lit(v).alias("v"), t.alias("term")))
    pairs = rows.select("part", "rank", F.inline(F.concat(tagged("own", 0), tagged("other", 1)))).join(terms, "term")
    listed = lambda v: F.sort_array(F.collect_list(F.when(F.col("v") == v, F.col("term"))))
    found = pairs.groupBy("part", "rank").agg(listed(0).alias("lexicon_own"), listed(1).alias("lexicon_other"))
    none = F.array().cast("array<long>")
    return rows.join(found, ["part", "rank"], "left").withColumns({c: F.coalesce(c, none) for c in ("lexicon_own", "lexicon_other")})


def likeness(a: Column, b: Column) -> Column:
    count = lambda test: F.size(F.filter(F.zip_with(a, b, test), lambda found: found))
    return count(lambda x, y: (x == y) & (x != 0)) / F.greatest(count(lambda x, y: (x != 0) | (y != 0)), F.lit(1))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "-")


def fingerprints_with_edits(docs: DataFrame, band: tuple[float, float] = IDF_BAND, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    In the edited text the last floor(n_chars / 2) code points are replaced by the first as
    many (or all) of the next document, in the order of ``with_next``. Returns id, n_chars,
    edited_sha256, fingerprint and edited_fingerprint (arrays of a long for each subset), near_edited
    and near_next. The lexicon is that of ``docs``. Null texts count as empty, repeated rows
    come back as often as given, an empty table gives an empty one and other columns are
    ignored.
    """
    spark = docs.sparkSession
    terms = checkpoint(lexicon(docs, band, text_col))
    listed = _listed_by_value if terms.count() <= SENT_TERMS else _listed_by_join
    rows = with_next(docs, parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), id_col, text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    kept = ("part", "rank", "guest", "id", "n_chars", "edited_sha256")
    rows = rows.select(*kept[:4], n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.select(*kept[:5], F.sha2("edited", 256).alias("edited_sha256"), term_hashes(F.col("text")).alias("own"), term_hashes(F.col("edited")).alias("other"))
    rows = listed(rows, terms)
    rows = rows.withColumns({"fp": _subset_hashes(F.col("lexicon_own")), "edited_fp": _subset_hashes(F.col("lexicon_other"))})
    rows = rows.select(*kept, _filled(F.col("fp"), F.col("own")).alias("fp"), _filled(F.col("edited_fp"), F.col("other")).alias("edited_fp"))
    rows = rows.withColumn("next_fp", F.lead("fp").over(W.partitionBy("part").orderBy("rank"))).where("not guest")
    return rows.select(
        "id",
        "n_chars",
        "edited_sha256",
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
