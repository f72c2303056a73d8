"""Mixing sources to target weights by soft membership.

Domains aren't read off a column: a classifier trained on the labelled table gives each document a
posterior over domains, and a document's tokens count for every domain in that proportion.  Document
rates r >= 0 (expected number of copies) are the nonnegative least-squares fit of the expected domain
totals, sum of r * tokens * posterior, to target totals, found by projected gradient descent from r = 1.
Steps are scaled by 1 / tokens for each document, so that the step in r depends on the posterior alone
and all documents of a domain move alike, and by the inverse of the scaled problem's curvature, the
(domains x domains) matrix of token-weighted posterior products of documents whose rate isn't held at 0, so that a
few rounds suffice.  The projection is lazy: the sum of all steps, one number a domain, is kept, and every round
projects 1 less that sum's product with the posterior anew.  So no rates are stored between rounds, a rate held at 0
is free to come back, and of all rates that fit the targets those nearest to 1 are found.

Each round is one aggregation to as many numbers as there are domains, and their squares; nothing else reaches the
driver, and no step joins or shuffles documents.  The targets share out the present total of tokens
in proportion to the weights: documents of a domain that is over its share get rates below 1, those of one
that is under it rates above 1, however much it has to grow.  Asked and reached totals are returned with the rates;
weights that no rates reach are missed by what the two show.

The classifier is a softmax regression on telling features.  A text's features are its different words (letters alone) and
its different runs of marks; of those that ``LEAST_DOCS`` training documents have, the ``MOST_FEATURES`` whose presence depends
most on the domain, by the likelihood ratio and from ``LEAST_RATIO`` on, are told by (so a rare rude word counts, and
ordinary words don't).  It is fitted on the driver, on the telling features of at most ``max_rows`` labelled documents.
The log-odds are divided by a heat, the one of ``HEATS`` with the least log loss on every ``HOLDOUT``th labelled document,
which are kept out of the training; an optimum at either end of ``HEATS`` is logged as a warning.

Defined results: a null or empty text has 0 tokens, the prior as posterior, and rate 1; with no labelled
row the posterior is uniform; of heats of equal loss the greatest is taken; a target for a domain that nothing
belongs to can't be met and is left over in the report; of several labels for one id the worst counts; repeated rows
get equal rates; texts are read whole; an empty table gives an empty result; columns of the results' names are
replaced.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, words

# Domains by the labelled table's (quality, toxic).
DOMAINS = ("good", "poor", "toxic")
#: Production weights of the domains' tokens.
WEIGHTS = (0.88, 0.08, 0.04)
#: The pipeline's, after quality rules have taken the poor documents.
PIPELINE_WEIGHTS = (0.89, 0.03, 0.08)
MOST_FEATURES, LEAST_DOCS, LEAST_RATIO = 512, 5, 25.0
STEPS, PENALTY = 400, 1.0
HEATS, HOLDOUT = (0.125, 0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.4, 1.7, 2.0, 2.8, 4.0, 8.0, 16.0, 32.0), 5
#: The fit's bound: labelled documents, those whose ids hash lowest.
MAX_TRAIN_ROWS = 4000
ROUNDS, TOLERANCE, RIDGE = 60, 1e-4, 1e-5


def domain_of(quality: Column, toxic: Column) -> Column:
    """The place in DOMAINS of a labelled document; null where its labels are null."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def features(text: Column) -> Column:
    """The different words of a text, lower-case letters alone, and its different runs of what is neither letter, digit nor
    space."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.array_union(F.split(lower, r"[^\p{L}]+"), F.split(lower, r"[\p{L}\p{N}\x20\x09-\x0D]+")), "")


@dataclass(frozen=True)
class Model:
    """Log-odds of the domains without any telling feature; what each telling feature adds to them; the heat, and its log loss
    on the holdout (null without one)."""

    prior: list[float]
    odds: dict[str, list[float]]
    heat: float = 1.0
    loss: float | None = None


def _odds(model: Model, found: Column) -> Column:
    """Each domain's undivided log-odds by the telling features among ``found``."""
    zero = F.array(*[F.lit(0.0)] * len(DOMAINS))
    if not model.odds:
        return zero
    table = F.from_json(F.lit(json.dumps(model.odds)), "map<string, array<double>>")  # a constant of MOST_FEATURES entries
    telling = F.array_intersect(F.array_sort(F.map_keys(table)), found)  # in the keys' order: sums are alike for every order of words
    return F.aggregate(telling, zero, lambda a, w: F.zip_with(a, F.element_at(table, w), lambda x, y: x + y))


def _softmax(model: Model, odds: Column, heat: float) -> Column:
    prior = F.array(*map(F.lit, model.prior))
    logits = F.zip_with(prior, odds, lambda p, o: (p + o) / heat)
    return let(logits, lambda z: let(F.transform(z, lambda x: F.exp(x - F.array_max(z))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))))


def fit_softmax(rows: list[list[int]], y: list[int], width: int, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """(bias, weights) of a softmax regression on ``rows``, the places of each one's features, by accelerated gradient
    descent; the weights' squares are held down by ``PENALTY``."""
    x = np.zeros((len(rows), width + 1))
    x[:, 0] = 1
    for i, found in enumerate(rows):
        x[i, [f + 1 for f in found]] = 1
    truth = np.eye(domains)[y]
    keep = np.full((width + 1, 1), PENALTY / len(rows))
    keep[0] = 1e-6
    v = np.ones(width + 1)
    for _ in range(30):  # the greatest curvature
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.5 * np.linalg.norm(x @ v) ** 2 / len(rows) + keep.max())
    w = ahead = np.zeros((width + 1, domains))
    for i in range(STEPS):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (x.T @ (p - truth) / len(rows) + keep * ahead)
        w, ahead = new, new + i / (i + 3) * (new - w)
    return w[0], w[1:]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """The classifier, from at most ``max_rows`` labelled documents."""
    known = labels.select(F.col(key), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where(F.col(key).isNotNull() & F.col("domain").isNotNull())
    known = known.groupBy(key).agg(F.max("domain").alias("domain")).orderBy(F.xxhash64(key), key).limit(max_rows)
    sample = docs.select(key, text).join(F.broadcast(known), key)  # max_rows rows
    sample = stored(sample.select("domain", features(F.col(text)).alias("f"), (F.pmod(F.xxhash64(key, F.lit(2)), F.lit(HOLDOUT)) == 0).alias("held")), "labelled")
    learnt, width = sample.where("not held"), range(len(DOMAINS))
    seen = [0] * len(DOMAINS)
    for r in learnt.groupBy("domain").count().collect():  # domains
        seen[r["domain"]] = r["count"]
    prior = [math.log((n + 1) / (sum(seen) + len(DOMAINS))) for n in seen]
    counts = learnt.select("domain", F.explode("f").alias("word")).groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"n{d}") for d in width])
    whole, every = sum((F.col(f"n{d}") for d in width), F.lit(0)), float(max(1, sum(seen)))
    part = lambda n, of, all_: F.when(n > 0, n * F.log(n / F.lit(float(max(1, of))) / (all_ / F.lit(every)))).otherwise(0.0)
    ratio = 2 * sum((part(F.col(f"n{d}"), seen[d], whole) + part(F.lit(seen[d]) - F.col(f"n{d}"), seen[d], F.lit(every) - whole) for d in width), F.lit(0.0))
    telling = counts.where(whole >= LEAST_DOCS).withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "word").limit(MOST_FEATURES).collect()
    model = Model(prior, {})
    if telling:
        names = sorted(r["word"] for r in telling)
        keys = F.from_json(F.lit(json.dumps(names)), "array<string>")  # a constant
        rows = learnt.select("domain", F.array_sort(F.transform(F.array_intersect(keys, "f"), lambda w: F.array_position(keys, w).cast("int") - 1)).alias("at")).orderBy("at", "domain").collect()  # max_rows
        bias, weights = fit_softmax([r["at"] for r in rows], [r["domain"] for r in rows], len(names), len(DOMAINS))
        model = Model(bias.tolist(), dict(zip(names, weights.tolist(), strict=True)))
    odds = sample.where("held").select("domain", _odds(model, F.col("f")).alias("odds"))
    losses = odds.agg(*[F.avg(-F.log(F.greatest(F.get(_softmax(model, F.col("odds"), h), F.col("domain")), F.lit(1e-12)))) for h in HEATS]).first()
    if losses[0] is None:
        return model
    loss, heat = min((x, -h) for x, h in zip(losses, HEATS, strict=True))
    log = logging.getLogger(__name__)
    (log.warning if -heat in HEATS[:: len(HEATS) - 1] and model.odds else log.info)("log loss %.4f on held-out documents at heat %g of %g to %g", loss, -heat, HEATS[0], HEATS[-1])
    return replace(model, heat=-heat, loss=loss)


def posteriors(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``tokens`` (words) and ``posterior`` (array over DOMAINS)."""
    return df.withColumns({"tokens": F.size(words(F.col(text))).cast("long"), "posterior": _softmax(model, _odds(model, features(F.col(text))), model.heat)})


def targets_of_total(totals: list[float], weights=WEIGHTS) -> list[float]:
    """Domain targets in proportion to ``weights``; their sum is that of ``totals``."""
    return [sum(totals) * w / sum(weights) for w in weights]


def _solve(m: list[list[float]], v: list[float]) -> list[float]:
    """x of m x = v for a small positive matrix, its diagonal raised a little so that empty domains don't matter."""
    n, lift = len(m), 1e-6 * max(1.0, max(m[i][i] for i in range(len(m))))
    rows = [[*row, y] for row, y in zip(m, v, strict=True)]
    for i in range(n):
        rows[i][i] += lift
    for i in range(n):
        top = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for r in range(n):
            if r != i:
                f = rows[r][i] / rows[i][i]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def fit_rates(df: DataFrame, targets: list[float] | None = None, weights=WEIGHTS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float], list[float]]:
    """``df`` (with tokens and posterior) with ``rate``; the targets (by default the ``weights`` of the present total);
    the expected totals that the rates give.

    ``df`` should be a stored table: each round reads its two columns.  A step is taken whole or halved until the
    objective falls: the squares of the totals' misses, plus ``RIDGE`` times the rates' token-weighted squares around
    1, which keeps the steps' sum finite where no rates meet the targets.
    """
    width = len(DOMAINS)
    p = [F.coalesce(F.get("posterior", F.lit(d)), F.lit(0.0)) for d in range(width)]
    tokens = F.coalesce(F.col("tokens"), F.lit(0)).cast("double")
    rate = lambda at: F.greatest(F.lit(0.0), F.lit(1.0) + sum((F.lit(x) * y for x, y in zip(at, p, strict=True)), F.lit(0.0)))

    def sums(at: list[float]) -> list[float]:
        r = rate(at)
        free = F.when(r > 0, tokens).otherwise(0.0)
        row = df.agg(F.sum(tokens * r * r), *[F.sum(r * tokens * x) for x in p], *[F.sum(free * x * y) for x in p for y in p]).first()
        return [float(x or 0) for x in row]

    at, got = [0.0] * width, sums([0.0] * width)
    targets = targets or targets_of_total(got[1 : 1 + width], weights)
    whole = max(1.0, sum(targets))
    value = lambda v, at: v[0] / whole / 2 - sum(t * x for t, x in zip(targets, at, strict=True)) / whole + RIDGE / 2 * sum(x * x for x in at)
    for _ in range(rounds):
        reached = got[1 : 1 + width]
        slope = [(r - t) / whole + RIDGE * x for r, t, x in zip(reached, targets, at, strict=True)]
        if max(abs(r - t) for r, t in zip(reached, targets, strict=True)) < tolerance * whole or max(map(abs, slope)) < tolerance / 10:
            break
        curvature = [[got[1 + width * (d + 1) + e] / whole + (RIDGE if d == e else 0.0) for e in range(width)] for d in range(width)]
        step, scale = _solve(curvature, slope), 1.0
        while True:
            new = [x - scale * s for x, s in zip(at, step, strict=True)]
            now = sums(new)
            if value(now, new) < value(got, at) or scale < 1e-3:
                break
            scale /= 2
        if value(now, new) >= value(got, at):
            break
        at, got = new, now
    return df.withColumn("rate", F.when(tokens > 0, rate(at)).otherwise(1.0)), targets, got[1 : 1 + width]


def copies(rate: Column, key: Column, seed: int = 11) -> Column:
    """How often a document is taken: the rate's whole part, and once more with the rest as probability, by a keyed
    hash."""
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights=WEIGHTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``tokens``, ``posterior`` and ``rate``."""
    model = train(docs, labels, key, text)
    scored = stored(posteriors(docs, model, text), "posteriors")
    return fit_rates(scored, weights=weights)[0]


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    scored = stored(posteriors(docs, model).drop("text"), "posteriors")
    rated, asked, reached = fit_rates(scored)
    mass = rated.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("rate")), F.sum(F.col("tokens") * F.col("rate") * F.col("rate"))).first()
    effective = float(mass[1]) ** 2 / float(mass[0] * mass[2]) if mass[0] and mass[2] else 1.0
    report = [F.array(*map(F.lit, x)).alias(n) for x, n in ((asked, "asked_tokens"), (reached, "reached_tokens"))]
    return rated.select("doc_id", "tokens", *[F.get("posterior", F.lit(d)).alias(f"p_{n}") for d, n in enumerate(DOMAINS)], "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"), *report, F.lit(effective).alias("effective_share"))
