"""URL filter: listed rules first, then gradient-boosted trees on lexical features.

Labels come from a rule list: the longest rule whose host (or a parent domain of it) and path prefix fit
a url decides it.  Urls that no rule decides get the verdict of boosted regression trees, trained on the
labelled ones.  Features are lexical: length, depth, digit ratio, entropy, parameter counts and
statistics of the host's suffix, each cut into fixed bins.  The suffix's share of blocked urls comes, for a training
row, from the hosts of the other ``FOLDS`` alone, so that the trees can't read a row's own label off it; for a url that
is to be judged it comes from all.

The trees grow by histograms: for each level one aggregation over the training rows gives gradients and
counts by (leaf, feature, bin), which is all that the driver needs to choose splits.  The hosts of fold 0 are kept
out of the growing: of the trees, as many are used as have the least log loss on those.  The model is an
expression of nested conditions on bins; predicting neither joins nor shuffles.

What the trees can learn is what the rules' urls show: where a suffix's labelled urls are all of one kind, the verdict
of its other urls follows it.

Defined results: a null url, or one without "://", has an empty host and path and is judged by the
trees; of rules of one length the earlier in the list wins; without labelled urls of both kinds every
undecided url gets the commoner kind, or "allow" when there is none; a score of exactly one half is "allow"; of splits
of equal gain the first feature's and lowest bin's is taken, of numbers of trees of equal loss the lowest; repeated rows
are judged alike; urls of any length are read whole; an empty table gives an empty result; columns of the results'
names are replaced.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

# The rule list, (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The fit's bound: labelled rows, those whose urls hash lowest.
MAX_TRAIN_ROWS = 20_000
TREES, LEVELS, RATE, LEAST_WEIGHT, SHRINK = 10, 3, 0.4, 5.0, 1.0
SUFFIX_BUCKETS = 64
#: Parts of the training hosts; the first is the holdout.
FOLDS = 5

# Upper edges of the features' bins.
BINS = {
    "length": (20, 30, 40, 50, 60, 80, 100, 150, 250),
    "host_length": (8, 12, 16, 20, 25, 30, 40, 60),
    "labels": (1, 2, 3, 4, 5, 6),
    "depth": (0, 1, 2, 3, 4, 6, 8),
    "last_length": (0, 2, 4, 6, 8, 12, 20, 40),
    "digit_ratio": (0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5),
    "entropy": (2.0, 2.5, 3.0, 3.3, 3.6, 3.8, 4.0, 4.2, 4.5),
    "hyphens": (0, 1, 2, 3, 5),
    "params": (0, 1, 2, 3, 5),
    "fragment": (0,),
    "secure": (0,),
    "suffix_rate": (0.02, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.98),
    "suffix_count": (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0),
}


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host`` and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    start = F.instr(u, "://")
    rest = F.when(start > 0, u.substr(start + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """``df`` (with host and path) with ``rule`` and its verdict ``listed``; both null where none fits."""
    rule, listed = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, r in sorted(reversed(rules), key=lambda x: len(x[1])):  # the longest is the outermost condition
        host, slash, path = r.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        if slash + path:
            fits = fits & F.col("path").startswith(slash + path)
        rule, listed = F.when(fits, r).otherwise(rule), F.when(fits, verdict).otherwise(listed)
    return df.withColumns({"rule": rule, "listed": listed})


def _suffix_bucket() -> Column:
    """The host's last two labels, hashed: their statistics are a table of fixed size."""
    return F.pmod(F.xxhash64(F.substring_index("host", ".", -2)), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical(df: DataFrame, suffixes: list[dict[int, tuple[float, float]]] | None = None, url: str = "url", fold: Column | None = None) -> DataFrame:
    """``df`` with one bin number (tinyint) a feature, named ``f_<feature>``; needs host and path.

    ``suffixes``: buckets' statistics, one table for each value of ``fold``, or one alone."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))

    def entropy(s: Column) -> Column:
        share = lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / n
        return F.aggregate(F.transform(F.array_distinct(F.split(s, "")), lambda c: F.when(c == "", 0.0).otherwise(let(share(c), lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)))), F.lit(0.0), lambda a, x: a + x)

    tables = suffixes or [{}]
    at = _suffix_bucket() + (fold * SUFFIX_BUCKETS if fold is not None else F.lit(0))
    look = lambda i: F.get(F.array(*[F.lit(float(t.get(b, (0.5, 0.0))[i])) for t in tables for b in range(SUFFIX_BUCKETS)]), at)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    value = {
        "length": F.length(u),
        "host_length": F.length("host"),
        "labels": F.regexp_count("host", F.lit(r"\.")),
        "depth": F.regexp_count("path", F.lit("/[^/]")),
        "last_length": F.length(F.substring_index("path", "/", -1)),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n,
        "entropy": let(u, entropy),
        "hyphens": F.regexp_count("host", F.lit("[-_]")),
        "params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "fragment": F.when(F.instr(u, "#") > 0, 1).otherwise(0),
        "secure": F.when(F.startswith(F.lower(u), F.lit("https://")), 1).otherwise(0),
        "suffix_rate": look(0),
        "suffix_count": look(1),
    }

    def bin_of(v: Column, edges: tuple[float, ...]) -> Column:
        return let(v, lambda x: sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0))).cast("tinyint")

    return df.withColumns({f"f_{k}": bin_of(v, BINS[k]) for k, v in value.items()})


@dataclass(frozen=True)
class Node:
    """A split (feature, greatest bin that goes left) or a leaf's weight."""

    feature: str = ""
    bin: int = 0
    left: Node | None = None
    right: Node | None = None
    weight: float = 0.0


def _expression(node: Node) -> Column:
    if not node.feature:
        return F.lit(node.weight)
    return F.when(F.col(f"f_{node.feature}") <= node.bin, _expression(node.left)).otherwise(_expression(node.right))


def margin(trees: list[Node], base: float) -> Column:
    """The log-odds of "block"."""
    return sum((_expression(t) for t in trees), F.lit(base))


def suffix_statistics(train: DataFrame) -> tuple[list[dict[int, tuple[float, float]]], dict[int, tuple[float, float]]]:
    """Bucket to (smoothed share of blocked urls, log of the number of urls): for each fold from the other folds' rows, and
    from all of them."""
    rows = train.groupBy("fold", _suffix_bucket().alias("b")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y")).collect()  # FOLDS * SUFFIX_BUCKETS rows

    def of(out: int | None) -> dict[int, tuple[float, float]]:
        sums: dict[int, list[float]] = {}
        for r in rows:
            if r["fold"] != out:
                s = sums.setdefault(r["b"], [0.0, 0.0])
                s[0], s[1] = s[0] + r["n"], s[1] + r["y"]
        return {b: ((y + 1) / (n + 2), math.log1p(n)) for b, (n, y) in sums.items()}

    return [of(f) for f in range(FOLDS)], of(None)


def holdout_losses(held: DataFrame, trees: list[Node], base: float) -> list[float]:
    """The log loss of the first 0, 1, ... trees on binned rows with ``y`` and ``n``; empty without rows."""
    m = [margin(trees[:i], base) for i in range(len(trees) + 1)]
    loss = lambda x: F.sum(F.col("n") * F.log1p(F.exp(x)) - F.col("y") * F.col("n") * x) / F.sum("n")
    row = held.agg(*[loss(x) for x in m]).first()
    return [float(x) for x in row if x is not None]


def fit(train: DataFrame) -> tuple[list[Node], float]:
    """Boosted trees for ``train``: binned rows with ``y`` (1: block) and ``n``, the number of urls that share the bins."""
    features = list(BINS)
    # rows of equal bins are one row; the number of rows doesn't matter to the driver
    train = cut(train.groupBy(*[f"f_{f}" for f in features]).agg(F.sum(F.col("n") * F.col("y")).alias("y"), F.sum("n").alias("n")))
    total = train.agg(F.sum("y"), F.sum("n")).first()
    y, n = float(total[0] or 0), float(total[1] or 0)
    if not n:
        return [], -1.0
    base = math.log((y + 0.5) / (n - y + 0.5))
    if y == 0 or y == n:
        return [], base
    trees: list[Node] = []
    entries = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"f_{f}").alias("b")) for i, f in enumerate(features)])
    for _ in range(TREES):
        leaf: dict[int, dict] = {0: {}}
        place = F.lit(0)
        p = 1 / (1 + F.exp(-margin(trees, base)))
        for level in range(LEVELS):
            rows = (
                train.select(place.alias("leaf"), (F.col("n") * p - F.col("y")).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), F.explode(entries).alias("e"))
                .groupBy("leaf", "e.f", "e.b")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .collect()
            )  # leaves x features x bins
            hist: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in rows:
                hist.setdefault(r["leaf"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
            for at, by in hist.items():
                if at not in leaf:
                    continue
                g, h = (sum(x[i] for x in by[0].values()) for i in (0, 1))
                best = (1e-6, None)
                for f, bins in sorted(by.items()):
                    gl = hl = 0.0
                    for b in sorted(bins)[:-1]:
                        gl, hl = gl + bins[b][0], hl + bins[b][1]
                        if min(hl, h - hl) < LEAST_WEIGHT / 20:
                            continue
                        gain = gl**2 / (hl + SHRINK) + (g - gl) ** 2 / (h - hl + SHRINK) - g**2 / (h + SHRINK)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, b, -RATE * gl / (hl + SHRINK), -RATE * (g - gl) / (h - hl + SHRINK)))
                leaf[at] = {"split": best[1], "weight": -RATE * g / (h + SHRINK)}
                if best[1]:
                    for side in (0, 1):
                        leaf[2 * at + 1 + side] = {"weight": best[1][2 + side]}
            for at in [a for a, v in leaf.items() if v.get("split") and 2 ** level - 1 <= a < 2 ** (level + 1) - 1]:
                f, b, *_ = leaf[at]["split"]
                place = F.when((place == at), F.when(F.col(f"f_{features[f]}") <= b, 2 * at + 1).otherwise(2 * at + 2)).otherwise(place)
            if not any(v.get("split") for a, v in leaf.items() if a >= 2**level - 1):
                break

        def grown(at: int, leaf=leaf) -> Node:
            v = leaf[at]
            if not v.get("split"):
                return Node(weight=v.get("weight", 0.0))
            f, b, *_ = v["split"]
            return Node(features[f], b, grown(2 * at + 1), grown(2 * at + 2))

        tree = grown(0)
        if not tree.feature:
            break
        trees.append(tree)
    return trees, base


def judge_urls(df: DataFrame, rules=RULES, url: str = "url", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``df`` with host, path, rule, ``score`` (probability of "block") and verdict."""
    urls = ruled(parts(df, url), rules)
    trees, base, suffixes, _ = learnt(urls, url, max_rows)
    judged = lexical(urls, [suffixes], url).withColumn("score", 1 / (1 + F.exp(-margin(trees, base))))
    verdict = F.coalesce("listed", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).drop("listed", *[f"f_{f}" for f in BINS])


def learnt(urls: DataFrame, url: str = "url", max_rows: int = MAX_TRAIN_ROWS) -> tuple[list[Node], float, dict[int, tuple[float, float]], list[float]]:
    """Trees, base, suffix statistics and held-out losses, from the urls (with host, path and listed) that a rule decides:
    counted, up to ``max_rows`` different ones."""
    labelled = urls.where("listed is not null").select(F.col(url).alias("url"), "host", "path", (F.col("listed") == "block").cast("double").alias("y"))
    sample = labelled.groupBy("url", "host", "path", "y").agg(F.count("*").alias("n")).orderBy(F.xxhash64("url"), "url").limit(max_rows)
    train = cut(sample.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")))
    by_fold, suffixes = suffix_statistics(train)
    binned = cut(lexical(train, by_fold, "url", F.col("fold")))
    grown = binned.where("fold > 0")
    if grown.limit(1).count() == 0:  # the only hosts are the holdout's
        return *fit(binned), suffixes, []
    trees, base = fit(grown)
    losses = holdout_losses(binned.where("fold = 0"), trees, base)
    use = losses.index(min(losses)) if losses else len(trees)
    logging.getLogger(__name__).info("log loss on held-out hosts by number of trees: %s", losses)
    return trees[:use], base, suffixes, losses


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
