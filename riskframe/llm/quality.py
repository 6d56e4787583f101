"""Quality rules with risk-controlled thresholds: labelled holdouts and exact binomial bounds.

Every rule has a statistic, mapped to a fixed grid of bins. For each stratum (a column, here the language) a path of
joint cutoffs, one per rule, is laid down before any label is seen: at level j every rule cuts where a share of at most
`SHARES[j]` of the stratum's documents lies above, labelled or not. Levels go from the most lenient to the
strictest, and a document has a level, the first at which some rule rejects it. A level that
rejects k of n good labelled documents is certified when the exact binomial tail P(Bin(n, risk) <= k) is at most the
error level, so the rate of good documents that all rules together reject is below `risk` at that confidence. Along the
path the tests form a fixed sequence, which needs no correction; the error is divided by the number of strata (Bonferroni), those with too few good
labels ever to be certified left out beforehand, which depends on n alone. Among certified levels the one that gains
most (bad minus good documents rejected) is used, the more lenient on ties; without a gain, or with too few
labels to certify anything, the rules are off in that stratum. Every figure is a DataFrame expression:
one scan of the texts gives all statistics, and the labels only meet counts per level.

Defined results: a null or wordless text has no words and fails the base rules; a null stratum is a stratum of
its own; repeated rows are judged alike; contradicting labels of a document count as bad, null labels do
not count; with no labels only the base rules decide; extra columns are ignored. Windows of eight words are
compared by a 64-bit hash inside one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.llm.common import let, words
from riskframe.session import stage_table

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
BINS = 400
#: Rate of good documents of a stratum that all rules together may reject, and the chance of exceeding it.
RISK = 0.05
ERROR = 0.05
#: Share of a stratum's documents that a rule may leave above its cut, by level: from 1 in 10,000 to a half.
SHARES = [0.0001 * 5000 ** (j / 63) for j in range(64)]


def repeated_words(w: Column) -> Column:
    """Number of words that lie in an 8-word window found twice or more in the same text."""

    def covered(h):
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def count(e):
            near = lambda v, j: F.coalesce(F.get(e, j - 1)["h"] == v.h, F.lit(False)) | F.coalesce(F.get(e, j + 1)["h"] == v.h, F.lit(False))
            at = F.sort_array(F.transform(F.filter(e, near), lambda v: v.p))
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda a, p: F.struct((a.n + p + WINDOW - F.greatest(p, a.end)).alias("n"), (p + WINDOW).alias("end"))
            return F.aggregate(at, zero, step, lambda a: a.n)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(tagged, count))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) > WINDOW, let(hashes, covered)).otherwise(F.lit(0))


def _left(text: Column, kept: str) -> Column:
    """Number of characters of the class `kept`."""
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Per row: doc_id, stratum, the counts and whether the base rules fail."""
    text = F.coalesce("text", F.lit(""))
    by_word = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    by_line = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    t = docs.select(
        "doc_id", F.col(stratum).alias("stratum"), by_word.alias("w"), by_line.alias("l"),
        _left(text, SYMBOLS).alias("n_symbols"), _left(text, "\\p{Lu}").alias("n_capitals"), _left(text, "!?").alias("n_shouts"),
    )
    failed = (F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > REPEAT_PERCENT * F.col("w.n_words"))
    return t.select("doc_id", "stratum", "w.*", "l.*", "n_symbols", "n_capitals", "n_shouts", failed.alias("base_failed"))


#: Rule, its statistic (never negative, higher is worse), and the statistic's value at the top of the grid.
def rules() -> list[tuple[str, Column, float]]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        ("symbols", F.col("n_symbols") / n, 4.0),
        ("capitals", F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)), 1.0),
        ("shouts", F.col("n_shouts") / n, 4.0),
        ("repeats", F.col("n_repeat_words") / n, 1.0),
        ("dup_lines", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 1.0),
        ("word_length", F.col("word_chars") / n, 40.0),
    ]


def bins() -> list[Column]:
    """Grid bin of each rule's statistic, 0 to BINS, in the order of `rules`."""
    return [F.least(F.lit(BINS), F.ceil(value * (BINS / top))).cast("int") for _, value, top in rules()]


def most_rejected(n: Column, risk: float, level: Column) -> Column:
    """Largest k with P(Bin(n, risk) <= k) <= level, or -1: the exact one-sided binomial bound."""

    def step(a, j):
        total = a.sum + F.exp(a.logp)
        logp = a.logp + F.log((n - j) / (j + 1)) + math.log(risk / (1 - risk))
        return F.struct(total.alias("sum"), logp.alias("logp"), F.when(total <= level, j).otherwise(a.k).alias("k"))

    none = F.lit(-1).cast("long")
    start = F.struct(F.lit(0.0).alias("sum"), (n * math.log1p(-risk)).alias("logp"), none.alias("k"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * risk)), start, step, lambda a: a.k)


def paths(stats: DataFrame) -> DataFrame:
    """Per stratum the joint cutoffs of every level: `path`, an array by level of arrays by rule.

    A rule's cut is the lowest bin with at most the level's share of the documents above it; documents that fail the base rules
    do not count.
    """
    each = stats.filter(~F.col("base_failed")).select("stratum", F.posexplode(F.array(*bins())).alias("rule", "bin"))
    counts = each.groupBy("stratum", "rule", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("stratum", "rule")  # at most BINS + 1 rows
    later = group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    t = counts.select("stratum", "rule", "bin", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("above"), F.sum("n").over(group).alias("all"))
    lowest = [F.min(F.when(F.col("above") <= F.col("all") * share, F.col("bin"))) for share in SHARES]
    t = t.groupBy("stratum", "rule").agg(F.array(*lowest).alias("cuts"))
    t = t.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("rule", "cuts"))).alias("by_rule"))  # six
    levels = F.sequence(F.lit(0), F.lit(len(SHARES) - 1))
    return t.select("stratum", F.transform(levels, lambda j: F.transform("by_rule", lambda r: F.get(r["cuts"], j))).alias("path"))


def _rejected(cuts: Column) -> Column:
    """Whether some rule's bin is above its cut."""
    out = F.lit(False)
    for i, b in enumerate(bins()):
        out = out | (b > F.get(cuts, F.lit(i)))
    return out


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per stratum with a useful certified level: level, cuts (a bin per rule), n_good, good_rejected, bad_rejected.

    A document is rejected by a rule when its bin is above the rule's cut.
    """
    verdict = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").alias("quality"))
    held = stats.filter(~F.col("base_failed")).join(verdict, F.col("doc_id") == F.col("of"))
    path = stage_table(paths(stats).withColumnRenamed("stratum", "s"), "paths")
    held = held.join(path, F.col("stratum").eqNullSafe(F.col("s")))
    levels = F.sequence(F.lit(0), F.lit(len(SHARES) - 1))
    first = F.get(F.filter(levels, lambda j: _rejected(F.get("path", j))), F.lit(0))
    level = F.coalesce(first, F.lit(len(SHARES))).alias("level")
    counts = held.select("stratum", (F.col("quality") > 0).alias("good"), level).groupBy("stratum", "level")
    counts = counts.agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    group = Window.partitionBy("stratum")  # at most a row per level
    until = group.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    t = counts.select(
        "stratum", "level", F.sum("g").over(group).alias("n_good"), F.sum("g").over(until).alias("good_rejected"), F.sum("b").over(until).alias("bad_rejected")
    )
    t = stage_table(t, "levels")
    return _certified(t, risk, error).join(path, F.col("stratum").eqNullSafe(F.col("s"))).select(
        "stratum", "level", F.get("path", "level").alias("cuts"), "n_good", "good_rejected", "bad_rejected"
    )


def _certified(t: DataFrame, risk: float, error: float) -> DataFrame:
    """The chosen level of every stratum, from cumulated counts per level."""
    sizes = t.select("stratum", "n_good").distinct()
    # the smallest tail a stratum can reach, rejecting no good document, depends on its size alone: the strata that
    # take part are the largest ones, as many as can still pass when the error is divided among them
    least = F.exp(F.col("n_good") * math.log1p(-risk))
    order = Window.orderBy(F.desc("n_good"), "stratum")  # a row per stratum
    able = sizes.filter(least <= error).withColumn("at", F.row_number().over(order)).filter(least <= error / F.col("at"))
    tests = able.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("tests"))
    limits = able.join(F.broadcast(tests)).select(F.col("stratum").alias("s"), most_rejected(F.col("n_good"), risk, error / F.col("tests")).alias("most"))
    t = t.join(limits, F.col("stratum").eqNullSafe(F.col("s"))).drop("s").filter((F.col("good_rejected") <= F.col("most")) & (F.col("level") < len(SHARES)))
    gain = F.col("bad_rejected") - F.col("good_rejected")
    best = Window.partitionBy("stratum").orderBy(gain.desc(), "level")
    return t.filter(gain > 0).withColumn("at", F.row_number().over(best)).filter("at = 1").drop("at", "most")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per row of `docs`: the counts, base_failed, kept, and the rules that rejected it."""
    stats = stage_table(statistics(docs, stratum), "statistics")
    cuts = stage_table(cutoffs(stats, labels, risk, error).select(F.col("stratum").alias("s"), "cuts"), "cutoffs")
    t = stats.join(cuts, F.col("stratum").eqNullSafe(F.col("s")), "left")
    names = [name for name, _, _ in rules()]
    broken = [F.when(b > F.get("cuts", F.lit(i)), F.lit(name)) for i, (name, b) in enumerate(zip(names, bins()))]
    t = t.withColumn("rejected_by", F.array_compact(F.array(*broken)))
    return t.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("s", "cuts")
