"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes that a text is good (1) or bad (-1), or abstains (0). Expectation-maximisation
over the counts of vote patterns (3^rules at most, whatever the number of texts) estimates the
share of good texts and how often each rule votes which way on good and on bad ones; a text's
posterior probability of being good then decides, instead of a list of tests all to be passed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, free

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "as", "are",
    "le", "la", "les", "et", "des", "un", "une", "du", "que", "qui", "en", "pour",
    "der", "die", "und", "das", "den", "nicht", "von", "zu", "mit", "ein", "dem", "für",
    "el", "los", "del", "se", "por", "con", "para", "una", "su", "al", "no", "es",
]

ROUNDS, START_SHARE = 100, 0.8
#: Shares of votes for, of abstentions and of votes against that EM starts from, on good and on bad texts; and texts they count as.
START_GOOD, START_BAD, START_TEXTS = (0.6, 0.38, 0.02), (0.4, 0.3, 0.3), 20.0


def _kinds(text: Column, kind: str) -> Column:
    """The characters of a class in a text, as a text."""
    return F.regexp_replace(text, f"[^{kind}]+", "")


def _count(text: Column, kind: str) -> Column:
    return F.char_length(_kinds(text, kind)).cast("long")


def _windows(words: Column) -> Column:
    """Hashes of the windows of three words, in order."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) > 3, hashes).otherwise(F.array().cast("array<long>"))


def _placed(windows: Column) -> Column:
    """Hashes with their places, sorted, if any is there twice; else none."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:long,i:int>>")
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed).otherwise(none)


def _repeated(placed: Column) -> Column:
    """Places, in order, of hashes equal to a neighbour."""
    same = lambda w, k, by: F.coalesce(w["h"] == F.get(placed, k + by)["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(placed, lambda w, k: same(w, k, -1) | same(w, k, 1)), lambda w: w["i"]))


def _covered(at: Column) -> Column:
    """Words that windows of three at these places cover together."""
    fewer = F.greatest(F.size(at) - 1, F.lit(0))
    over = F.zip_with(F.slice(at, 2, fewer), F.slice(at, 1, fewer), lambda b, a: F.greatest(F.lit(3) - (b - a), F.lit(0)))
    return F.size(at) * 3 - F.aggregate(over, F.lit(0), lambda total, n: total + n)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of MEASURES, over whole texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = {name: free(docs, f"own_{name}") for name in ("words", "lines", "marks", "windows", "placed", "at")}
    c = {name: F.col(own[name]) for name in own}
    rows = docs.withColumns({own["words"]: F.array_remove(F.split(text, SPACE), ""), own["lines"]: lines, own["marks"]: _kinds(text, r"#*$%&|<>!?\p{Lu}")})
    rows = rows.withColumn(own["windows"], _windows(c["words"]))
    rows = rows.withColumn(own["placed"], _placed(c["windows"])).withColumn(own["at"], _repeated(c["placed"]))
    ended = F.filter(c["lines"], lambda x: F.right(F.rtrim(x), F.lit(1)).isin(*".!?\"'…"))
    rows = rows.withColumns(
        {
            "n_words": F.size(c["words"]).cast("long"),
            "word_chars": F.char_length(F.array_join(c["words"], "")).cast("long"),
            "n_symbols": _count(c["marks"], "#*$%&|<>"),
            "n_dup_lines": (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
            "n_repeat_words": _covered(c["at"]).cast("long"),
            "n_lines": F.size(c["lines"]).cast("long"),
            "n_ended": F.size(ended).cast("long"),
            "n_upper": _count(c["marks"], r"\p{Lu}"),
            "n_shouts": _count(c["marks"], "!?"),
            "n_function": F.size(F.array_intersect(c["words"], F.array(*[F.lit(w) for w in FUNCTION_WORDS]))).cast("long"),
        }
    )
    return rows.drop(*own.values())


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_shouts", "n_function"]


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, over columns of ``measured``; none votes on a text without words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    some = F.col("n_words") > 0
    mean = F.col("word_chars") / n
    rules = {
        "word_length": _vote(mean.between(3, 10), ~mean.between(2, 14)),
        "symbols": _vote(F.col("n_symbols") <= 0.01 * n, F.col("n_symbols") > 0.1 * n),
        "duplicate_lines": _vote((F.col("n_lines") > 4) & (F.col("n_dup_lines") == 0), F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "repeated_words": _vote((F.col("n_words") > 50) & (F.col("n_repeat_words") <= 0.1 * n), F.col("n_repeat_words") > 0.3 * n),
        "capitals": _vote(F.col("n_upper") <= 0.1 * F.col("word_chars"), F.col("n_upper") > 0.3 * F.col("word_chars")),
        "shouts": _vote(F.col("n_shouts") <= 0.05 * n, F.col("n_shouts") > 0.2 * n),
        "function_words": _vote((F.col("n_function") >= 8) | ((F.col("n_words") < 50) & (F.col("n_function") >= 2)), (F.col("n_words") >= 50) & (F.col("n_function") < 6) & (F.col("n_function") * 25 < n)),
        "line_ends": _vote(F.col("n_ended") > 0.7 * F.col("n_lines"), (F.col("n_lines") > 4) & (F.col("n_ended") < 0.3 * F.col("n_lines"))),
    }
    return {name: F.when(some, v).otherwise(0) for name, v in rules.items()}


Rates = tuple[float, float, float]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[Rates, Rates]]]:
    """The share of good texts, and each rule's rates of votes for, abstentions and votes against on good and on bad texts.

    ``patterns`` are votes and the number of texts that have them. Rules count as independent
    given the truth. A vote for is never taken as likelier on bad texts, nor one against on
    good ones, which also settles which class is good. Each rule starts as if START_TEXTS
    texts of either class had been seen, so one that never votes keeps to that.
    """
    width = len(patterns[0][0]) if patterns else 0
    share, rates = START_SHARE, [(START_GOOD, START_BAD)] * width
    for _ in range(rounds):
        total = good = 0.0
        sums = [([x * START_TEXTS for x in START_GOOD], [x * START_TEXTS for x in START_BAD]) for _ in range(width)]
        for pattern, n in patterns:
            p = posterior_of(pattern, share, rates)
            total, good = total + n, good + n * p
            for (yes, no), v in zip(sums, pattern, strict=True):
                yes[1 - v] += n * p
                no[1 - v] += n * (1 - p)
        share = min(0.99, max(0.01, (good + START_SHARE * START_TEXTS) / (total + START_TEXTS)))
        rates = [_ordered([x / sum(yes) for x in yes], [x / sum(no) for x in no]) for yes, no in sums]
    return share, rates


def _ordered(good: list[float], bad: list[float]) -> tuple[Rates, Rates]:
    """The rates, with those of votes that speak the wrong way made equal."""
    if good[0] < bad[0]:
        good[0] = bad[0] = (good[0] + bad[0]) / 2
    if good[2] > bad[2]:
        good[2] = bad[2] = (good[2] + bad[2]) / 2
    return tuple(good), tuple(bad)


def weights(share: float, rates: list[tuple[Rates, Rates]]) -> tuple[float, list[Rates]]:
    """Log odds of good: the prior's, and each rule's for a vote for, an abstention and a vote against."""
    return math.log(share / (1 - share)), [tuple(math.log(g / b) for g, b in zip(*both, strict=True)) for both in rates]


def posterior_of(pattern: tuple[int, ...], share: float, rates: list[tuple[Rates, Rates]]) -> float:
    odds, per_rule = weights(share, rates)
    odds += sum(w[1 - v] for v, w in zip(pattern, per_rule, strict=True))
    return 1 / (1 + math.exp(-odds))


def judged(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All rows with their measures, ``votes`` by rule, ``p_good`` and ``good`` (p_good at least ``threshold``).

    The texts themselves teach the estimates. Null texts have no words, so all rules abstain
    on them. Repeated rows count as often as
    given. Columns of ``docs`` named like a measure are replaced. ``docs`` comes without its
    text, as it is checkpointed.
    """
    rules = votes()
    rows = measured(docs, text_col).drop(text_col)
    rows = checkpoint(rows.withColumn("votes", F.array(*rules.values())))
    counts = rows.groupBy("votes").agg(F.count("*").alias("n")).collect()
    odds, per_rule = weights(*estimate(sorted((tuple(r.votes), r.n) for r in counts)))
    total = F.lit(odds)
    for j, (yes, none, no) in enumerate(per_rule):
        v = F.get("votes", F.lit(j))
        total = total + F.when(v > 0, yes).when(v < 0, no).otherwise(none)
    p = 1 / (1 + F.exp(-total))
    return rows.withColumn("p_good", p).withColumn("good", F.col("p_good") >= threshold)
