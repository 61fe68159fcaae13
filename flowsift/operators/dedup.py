"""Keep-first deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import NumericType


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per distinct ``keys``: the first by ``order``, with its other columns.

    All three plans drop copies inside each task before the shuffle, so a group holding a large
    share of the rows reaches its reducer as at most one row per task.

    * nothing outside the key: plain distinct, a hash aggregate;
    * one numeric order column and nothing else outside the key: hash aggregate with ``min``;
    * otherwise ``row_number() = 1``, which Spark limits per task ahead of the exchange. The key hash
      leads the sort, so wide keys are mostly ordered by comparing one long.
    """
    names = df.columns
    carried = [c for c in names if c not in keys and c not in order]
    if not carried and not order:
        return df.dropDuplicates(list(keys))
    if not carried and len(order) == 1 and isinstance(df.schema[order[0]].dataType, NumericType):
        return df.groupBy(*keys).agg(F.min(order[0]).alias(order[0])).select(*names)
    if not order:
        raise ValueError(f"columns {carried} lie outside the key, so 'first' needs an order")
    first = Window.partitionBy("_key_hash", *keys).orderBy(*order)
    return (
        df.withColumn("_key_hash", F.xxhash64(*keys))
        .withColumn("_place", F.row_number().over(first))
        .filter("_place = 1")
        .select(*names)
    )
