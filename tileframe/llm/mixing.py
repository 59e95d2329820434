"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of all words by its weight, but no more than EPOCHS times its own.
A source whose target is several times its size is taken whole as often as that goes; what is
left of the target is drawn without replacement: each document has an exponential key, a
noise that its id and text settle divided by its quality, and the documents with the least
keys of their source are taken until the budget is full. The last one is cut, so that
each source's words come within one of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, words_of, written
from .prefix import numbered, running_sum

#: Times that a document is taken at most, and the least quality.
EPOCHS, LEAST_QUALITY = 3, 0.05


def size_of(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.size(words_of(text)).cast("long")


def quality_of(text: Column) -> Column:
    """The share of a text's characters that are letters or space, LEAST_QUALITY at least; 1 for a text without characters."""
    others = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.coalesce(F.greatest(F.lit(LEAST_QUALITY), 1 - others / F.nullif(F.length(text), F.lit(0))), F.lit(1.0))


def key_of(noise: Column, quality: Column) -> Column:
    """An exponential key of rate ``quality`` for noise in hexadecimal digits."""
    uniform = (F.conv(F.substring(noise, 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))
    return -F.log(uniform) / quality


def cycle(rank: Column, weights: tuple[int, ...]) -> Column:
    """The weight of the source with a rank from 0 on: ``weights`` again and again."""
    return F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int"))


def shares(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(..., target): shares by weight of the total size of ``sources`` (..., size, weight), none above ``epochs`` times its size.

    What a source can't use is shared anew among the others by weight until none is above. Each
    round is one aggregate over the sources; only two sums come to the driver.
    """
    most = F.col("size") * epochs
    total, all_weight = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, weight = total, all_weight
    while weight:
        above = most < F.lit(left / weight) * F.col("weight")
        used, held = sources.agg(F.coalesce(F.sum(F.when(above, most)), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("weight"))), F.lit(0))).first()
        if (total - used, all_weight - held) == (left, weight):
            break
        left, weight = total - used, all_weight - held
    share = F.lit(left / weight) * F.col("weight") if weight else most
    return sources.withColumn("target", F.least(most.cast("double"), share.cast("double")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = (), quality: Column | None = None) -> DataFrame:
    """(id, *keep, size, source_size, target, quality, taken) for each row of ``docs``: the words that the mix takes of it, repeats counted.

    Sources by code point, a null source last, weigh ``weights`` again and again. A text's size
    is its number of words (null: 0), its ``quality`` a column of ``docs`` above 0 or else the share of letters
    and space. ``taken`` over ``size`` is how often the whole text is taken; the rest of
    the division is the number of its first words that are taken once more. Noise goes by id and text, so reruns agree;
    rows equal in both share one key and are taken one after another. An empty table
    gives no rows. Columns in ``keep`` come along and yield to results of the same name.
    """
    text = F.col(text_col).cast("string")
    known = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), F.struct(F.lit(0).alias("none"), *[F.col(c) for c in keep]).alias("kept"),
        source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("site"),
        size_of(text).alias("size"), (quality_of(text) if quality is None else quality.cast("double")).alias("quality"), known.alias("noise"),
    )
    site = ["no_source", "site"]
    rows = numbered(rows.withColumn("key", key_of(F.col("noise"), F.col("quality"))), "row")
    sources = written(rows.groupBy(*site).agg(F.sum("size").alias("size")).withColumn("one", F.lit(1).cast("long")))
    sources = running_sum(sources, "one", [], [F.col(c) for c in site], "rank").withColumn("weight", cycle(F.col("rank"), weights).cast("long"))
    sources = shares(written(sources)).select(*site, F.col("size").alias("source_size"), "target")
    ranked = running_sum(rows, "size", site, [F.col("key"), F.col("noise"), F.col("row")])
    # a hot source is a row of ``sources`` and many of ``ranked``: sent to all tasks where few, else dealt out by the adaptive skew join
    done = ranked.join(sources, site)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    budget = F.floor(F.col("target") - whole * F.col("source_size") + 0.5).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("before")))
    results = {"id": F.col("id"), "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "quality": F.col("quality"), "taken": (whole * F.col("size") + rest).cast("long")}
    own = [F.col("kept")[c].alias(c) for c in keep if c.lower() not in results]
    return done.select(*[c.alias(n) for n, c in results.items() if n == "id"], *own, *[c.alias(n) for n, c in results.items() if n != "id"])


def drawn(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts of a mix: rows of ``mix`` with the text kept, as often as they are taken whole, and once more cut to its first words, joined by spaces, where a rest is taken.

    Column ``copy`` numbers the repeats from 0. A row of which nothing is taken has no rows.
    """
    copy, words = free(mixed, "copy_"), free(mixed, "words_")
    size, taken = F.col("size"), F.col("taken")
    times = F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")
    rows = mixed.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), times - 1)))
    rest = taken - F.col(copy) * size
    first = F.array_join(F.slice(words_of(F.col(text_col)), F.lit(1), rest.cast("int")), " ")
    rows = rows.withColumn(words, F.when(rest < size, first))
    return rows.withColumns({text_col: F.coalesce(words, text_col), "copy": F.col(copy)}).drop(copy, words)
