"""Connected components of a link table, wholly in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import stored


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: each linked value with the least one of its component, itself left out."""
    if not len(a):
        return a, b
    values, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = places[: len(a)], places[len(a) :]
    label = np.arange(len(values))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    return values[label != np.arange(len(values))], values[label[label != np.arange(len(values))]]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's links as stars: each of its nodes with the least one that it reaches inside the partition."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above.setdefault(up, up)
            x = up
        return x

    for pdf in batches:
        for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True):
            x, y = top(x), top(y)
            above[max(x, y)] = min(x, y)
    nodes = list(above)
    for s in range(0, len(nodes), 100_000):
        part = nodes[s : s + 100_000]
        stars = pd.DataFrame({"x": part, "y": [top(x) for x in part]}, dtype="int64")
        yield stars[stars.x != stars.y]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``links``; label is the least node reachable.

    Each partition's links are first replaced by stars, which takes no shuffle and leaves short paths.  A round then
    takes the least label among a node's neighbours, and that label's own label (pointer jumping), until nothing
    changes; every round is a table in the shared folder.  Joins on a popular label are plain joins, broadcast by
    size or split by adaptive execution.
    """
    ship(links.sparkSession)
    pairs = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x is not null and y is not null and x <> y")
    stars = pairs.mapInPandas(_forest, "x long, y long")
    both = stored(stars.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*").distinct(), "edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        old = labels.select(F.col("node").alias("o"), F.col("label").alias("ol"))
        near = both.join(old, F.col("y") == F.col("o")).groupBy("x").agg(F.min("ol").alias("near"))
        step = labels.select("node", "label").join(near, F.col("node") == F.col("x")).select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        labels = stored(step.join(old, F.col("next") == F.col("o")).select("node", F.least("next", "ol").alias("label"), (F.least("next", "ol") < F.col("was")).alias("moved")), "labels")
        if labels.where("moved").limit(1).count() == 0:
            return labels.select("node", "label")
