"""Quality rules with risk-controlled thresholds.

Base rules fail a text outright.  What passes is scored by its worst sign of junk (symbols, shouting,
capitals or repetition, each as a share), and a stratum's cutoff on that score is chosen on labelled rows:
going from lenient to strict, each cutoff's false rejections among rows labelled good get an exact
binomial (Clopper-Pearson) upper bound; the walk ends at the first cutoff whose bound exceeds ``risk``
(fixed-sequence testing needs no correction along the walk; ``miss`` is divided by the number of strata,
so all strata hold together with probability 1 - miss).  Of the certified cutoffs the one that rejects
most bad rows net of good ones is taken.  A stratum that has too few labels to certify any cutoff
rejects nothing beyond the base rules.

Everything on the rows is DataFrame expressions; the driver sees counts by (stratum, score bin) alone.

Defined results: a null or empty text has no words and fails the base rules; null strata form one
stratum; labels that are null are ignored, and of several labels for one id the best counts; repeated
rows are judged alike; texts of any length are judged whole; an empty table gives an empty result.
Columns named as the results are replaced, others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, stored, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
RISK, MISS = 0.005, 0.05
#: Cutoffs on the score, lenient to strict.
CUTOFFS = tuple([2.0, 1.5, 1.0] + [x / 100 for x in range(95, 4, -5)])

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """Words within 3-word windows that occur twice or more.

    Windows, as (hash, place), are sorted by their whole hashes, so that equal ones are neighbours.
    """

    def of(t: Column) -> Column:
        same = lambda e, o: F.coalesce(e["h"] == o["h"], F.lit(False))
        found = F.filter(t, lambda e, k: same(e, F.get(t, k - 1)) | same(e, F.get(t, k + 1)))
        places = F.sort_array(F.transform(found, lambda e: e["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), of))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base measures, ``base_failed`` and ``junk_score``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(rf"[^{SPACE_CLASS}]"))
    of_words = let(
        words(F.col(text)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")),
    )
    share = lambda n: n / F.greatest(F.col("n_words"), F.lit(1))
    return (
        df.withColumns(
            {
                "_w": of_words,
                "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
                "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
                "_bangs": F.regexp_count(t, F.lit("!")),
                "_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")),
            }
        )
        .withColumns({c: F.col(f"_w.{c}") for c in ("n_words", "word_chars", "n_repeat_words")})
        .withColumns(
            {
                "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
                "junk_score": F.greatest(share(F.col("n_symbols")), share(F.col("_bangs")), share(F.col("n_repeat_words")), F.col("_capitals") / F.greatest(F.col("word_chars"), F.lit(1))),
            }
        )
        .drop("_w", "_bangs", "_capitals")
    )


def upper_bound(k: int, n: int, miss: float) -> float:
    """The largest rate that ``k`` of ``n`` doesn't refute at level ``miss`` (Clopper-Pearson, one-sided)."""
    if n == 0 or k >= n:
        return 1.0

    def at_most(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid <= 0 or mid >= 1 or at_most(mid) > miss:
            low = mid
        else:
            high = mid
    return high


def certified_cutoff(good: list[int], bad: list[int], miss: float, risk: float = RISK) -> float:
    """``good[i]``, ``bad[i]``: rows that the ith cutoff is the first to reject; the last entries are rejected by none."""
    n, k, caught, best, choice = sum(good), 0, 0, 0, math.inf
    for i, cutoff in enumerate(CUTOFFS):
        k, caught = k + good[i], caught + bad[i]
        if k > risk * n or upper_bound(k, n, miss) > risk:
            break
        if caught - k > best:
            best, choice = caught - k, cutoff
    return choice


def learn_cutoffs(scored: DataFrame, labels: DataFrame, key: str, stratum: str, label: str, risk: float = RISK, miss: float = MISS) -> dict[str | None, float]:
    """Each stratum's cutoff, from all labelled rows that pass the base rules."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_good"))
    place = F.lit(len(CUTOFFS))
    for i in reversed(range(len(CUTOFFS))):
        place = F.when(F.col("junk_score") > CUTOFFS[i], i).otherwise(place)
    tally: dict[str | None, tuple[list[int], list[int]]] = {}
    rows = scored.where(~F.col("base_failed")).select(F.col(key).alias("_key"), F.col(stratum).alias("s"), place.alias("i")).join(known, "_key").groupBy("s", "i").agg(F.sum((F.col("_good") > 0).cast("long")).alias("good"), F.count("*").alias("n")).collect()
    for r in rows:  # languages x cutoffs
        good, bad = tally.setdefault(r["s"], ([0] * (len(CUTOFFS) + 1), [0] * (len(CUTOFFS) + 1)))
        good[r["i"]], bad[r["i"]] = r["good"], r["n"] - r["good"]
    return {s: certified_cutoff(good, bad, miss / len(tally), risk) for s, (good, bad) in tally.items()}


def judged(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", label: str = "quality", risk: float = RISK, miss: float = MISS, carry: bool = True) -> DataFrame:
    """``df`` with measures, ``base_failed``, ``junk_score``, ``cutoff`` (null: none certified) and ``kept``.

    The measures are written once to the shared folder and read twice, to learn and to judge; without
    ``carry`` the text isn't written with them.
    """
    scored = stored(measured(df, text) if carry else measured(df, text).drop(text), "quality")
    cutoff = F.lit(None).cast("double")
    for s, c in learn_cutoffs(scored, labels, key, stratum, label, risk, miss).items():
        if c < math.inf:
            cutoff = F.when(F.col(stratum).eqNullSafe(F.lit(s)), c).otherwise(cutoff)
    return scored.withColumn("cutoff", cutoff).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("junk_score") <= F.col("cutoff"), F.lit(True)))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    got = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"), carry=False)
    return got.select("doc_id", *MEASURES, "base_failed", "junk_score", "cutoff", "kept")

