"""Ordered and grouped passes over sorted partitions.

``applyInPandas`` pays a fixed price per group and holds each group whole. These
passes shuffle and sort once and then walk the Arrow batches of a partition, so
millions of small groups are cheap and an ordered pass never holds a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(",")]


def ordered_pass(
    df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str
) -> DataFrame:
    """Rows of each key in order through ``step(state, row)``; its tuples are the output."""
    names = _names(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                if now != key:
                    key, state = now, start()
                made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)


def grouped_map(df: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    """``fn`` on the rows of each key, for groups that are small by construction."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            first, last = batch[key].iloc[0], batch[key].iloc[-1]
            if held and held[0][key].iloc[0] != first:
                yield fn(pd.concat(held))
                held = []
            if first != last:
                whole = batch[batch[key] != last]
                groups = [g for _, g in whole.groupby(key, sort=False)]
                if held:
                    groups[0] = pd.concat([*held, groups[0]])
                made = [x for x in map(fn, groups) if len(x)]
                if made:
                    yield pd.concat(made)
                held = [batch[batch[key] == last]]
            else:
                held.append(batch)
        if held:
            yield fn(pd.concat(held))

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)
