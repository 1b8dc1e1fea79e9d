"""Values that are worked out once, where Spark's rules would copy their expressions into all that reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: in plain form it is again for each mention, and for each element where a
    lambda holds one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """keep and values as columns that no filter or projection above takes apart and works out again."""
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(name) for name, v in values.items()]))))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key, rows without one left out. All that reads it reads one shuffle: the other columns travel as one
    value, so that no reader's selection makes a shuffle of its own; and the key comes out of an array, so that a deal by
    it further down doesn't take this one's place, to be made again for each reader."""
    held = F.array(F.struct(*[c for c in df.columns if c != key]))
    row = F.inline(F.array(F.struct(F.col(key), held.alias("_held"))))
    return df.select(row).filter(F.col(key).isNotNull()).repartition(key).select(key, F.inline("_held"))
