"""Operators on ordered items: segmentation, nearest neighbours, slot sizes, running offsets, winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upto(keys: list[str], order: list):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def segment(df: DataFrame, opener: Column, keys: list[str], order: list, name: str = "segment") -> DataFrame:
    """Numbers the groups that an opener starts. The first opener does not close a prefix without one."""
    seen = F.sum(F.when(opener, 1).otherwise(0)).over(upto(keys, order))
    return df.withColumn(name, F.greatest(seen, F.lit(1)).cast("long"))


def carry_forward(value: Column, keys: list[str], order: list) -> Column:
    """The last value so far, nulls skipped."""
    return F.last(value, ignorenulls=True).over(upto(keys, order))


def borrow_next(value: Column, keys: list[str], order: list) -> Column:
    """The own value or else the next one that is not null."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.first(value, ignorenulls=True).over(frame)


def slot_size(offset: Column, end: Column, keys: list[str], order: list) -> Column:
    """The room up to the next offset, or to `end` for the last."""
    return F.coalesce(F.lead(offset).over(Window.partitionBy(*keys).orderBy(*order)), end) - offset


def aligned_offset(size: Column, align: int, keys: list[str], order: list) -> Column:
    """Where each entry begins when each is padded to a multiple of `align`."""
    padded = F.ceil(size / align) * align
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(padded).over(frame), F.lit(0)).cast("long")


def monotone(df: DataFrame, value: Column, keys: list[str], order: list) -> DataFrame:
    """Whether `value` never falls, by group."""
    step = df.withColumn("__back", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    return step.groupBy(*keys).agg(F.bool_and(F.col("__back").isNull() | (value >= F.col("__back"))).alias("monotone"), F.count(F.lit(1)).alias("n"))


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int")).where(F.col(rank) <= n)


def winner(df: DataFrame, keys: list[str], score: str, order: list) -> DataFrame:
    """The least score of each group with its confidence: 1 when alone or when the runner-up's score is not positive."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumns({"__rank": F.row_number().over(w), "runner_up": F.lead(score).over(w)}).where("__rank = 1").drop("__rank")
    ratio = (F.col("runner_up") - F.col(score)) / F.col("runner_up")
    sure = F.when(F.col("runner_up").isNull() | (F.col("runner_up") <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))
    return ranked.withColumn("confidence", sure)
