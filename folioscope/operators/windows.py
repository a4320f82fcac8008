"""Ordered-neighbour helpers that never put a whole hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_k(df: DataFrame, group: list[str], order: list[Column], k, rank: str = "rank") -> DataFrame:
    """The ``k`` first rows of each group; Spark drops the rest before the shuffle (WindowGroupLimit)."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def with_neighbours(df: DataFrame, group: list[str], order: str, columns: list[str], width: int = 4096) -> DataFrame:
    """Adds prev_<c> and next_<c> for the row before and after within ``group`` by the integer ``order``.

    Windows run over slices of ``width`` order values. The first and last row of each slice, a small
    table, give the neighbours across slice borders.
    """
    slot = "_slot"
    sliced = df.withColumn(slot, F.floor(F.col(order) / width))
    inner = W.partitionBy(*group, slot).orderBy(order)
    row = F.struct(*columns)
    local = sliced.withColumn("_p", F.lag(row).over(inner)).withColumn("_n", F.lead(row).over(inner))
    edge = sliced.groupBy(*group, slot).agg(
        F.min_by(row, order).alias("_first"), F.max_by(row, order).alias("_last"))
    outer = W.partitionBy(*group).orderBy(slot)
    edge = edge.select(*group, slot, F.lag("_last").over(outer).alias("_before"),
                       F.lead("_first").over(outer).alias("_behind"))
    on = [sliced_col_eq(local, edge, c) for c in (*group, slot)]
    joined = local.join(edge, on, "left").select(local["*"], edge["_before"], edge["_behind"])
    prev, nxt = F.coalesce("_p", "_before"), F.coalesce("_n", "_behind")
    return joined.select(
        *df.columns, *[prev[c].alias(f"prev_{c}") for c in columns], *[nxt[c].alias(f"next_{c}") for c in columns])


def sliced_col_eq(a: DataFrame, b: DataFrame, name: str) -> Column:
    return a[name].eqNullSafe(b[name])
