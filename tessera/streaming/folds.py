"""Folds over the rows of each key in order, with no key's rows held in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from tessera.ship import ship


def folded(rows: DataFrame, key: str, order: list[str], values: list[str], start: Any, step: Callable[..., Any], end: Callable[[Any], tuple], schema: str) -> DataFrame:
    """One row a key: (key, end(state)...), where ``state = step(state, *values)`` over the key's rows by ``order``.

    A key's rows are sorted on disk where they have to be, and pass through one task batch by batch; a null key is a key.
    """
    ship(rows.sparkSession)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, own, state = False, None, start
        for pdf in batches:
            out = []
            keys = pdf[key].astype(object).where(pdf[key].notna(), None).tolist()
            for k, *given in zip(keys, *(pdf[v].astype(object).where(pdf[v].notna(), None).tolist() for v in values)):
                if open_ and k != own:
                    out.append((own, *end(state)))
                if not open_ or k != own:
                    open_, own, state = True, k, start
                state = step(state, *given)
            yield pd.DataFrame(out, columns=names)
        if open_:
            yield pd.DataFrame([(own, *end(state))], columns=names)

    wanted = list(dict.fromkeys([key, *order, *values]))
    return rows.select(*wanted).repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)
