"""Running aggregates over the rows of a group in order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a group that one task takes as a block. Groups within one block cost one exchange and one sort.
BLOCK = 65_536


def spans_blocks(df: DataFrame, order: str, block: int = BLOCK) -> bool:
    """Whether any row lies beyond the first block: one aggregate over one column, answered from file statistics where the source has them."""
    top = df.agg(F.max(order)).first()[0]
    return top is not None and top >= block


def running(
    df: DataFrame,
    key: str,
    order: str,
    sums: dict[str, Column] = {},
    mins: dict[str, Column] = {},
    lasts: dict[str, Column] = {},
    blocked: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """Add running sums, minima and last non-null values over the rows of `key` by `order` (an integer), the row itself included.

    A group is cut into blocks of `block` positions. Each block is scanned by itself; then the blocks' totals are scanned, a row a
    block, and carried into the blocks. So a group that holds a third of all rows is spread over many tasks. Where no group goes
    beyond its first block (`blocked=False`, see `spans_blocks`) the carrying is left out: one exchange and one sort do for all.
    """
    if not blocked:
        w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        done = {k: F.sum(c).over(w) for k, c in sums.items()} | {k: F.min(c).over(w) for k, c in mins.items()}
        return df.withColumns(done | {k: F.last(c, ignorenulls=True).over(w) for k, c in lasts.items()})
    part = "__part"
    df = df.withColumn(part, F.floor(F.coalesce(order, F.lit(0)) / F.lit(block)).cast("long"))
    w = Window.partitionBy(key, part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = {k: F.sum(c).over(w) for k, c in sums.items()} | {k: F.min(c).over(w) for k, c in mins.items()}
    local |= {k: F.last(c, ignorenulls=True).over(w) for k, c in lasts.items()}
    df = df.withColumns(local)
    aggs = [F.max_by(k, order).alias(f"__{k}") for k in local]  # the last row of a block holds its totals
    totals = df.groupBy(key, part).agg(*aggs)
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col(key).alias("__key"),
        F.col(part).alias("__at"),
        *[F.sum(f"__{k}").over(before).alias(f"__{k}") for k in sums],
        *[F.min(f"__{k}").over(before).alias(f"__{k}") for k in mins],
        *[F.last(f"__{k}", ignorenulls=True).over(before).alias(f"__{k}") for k in lasts],
    ).where(F.col("__at") > 0)
    df = df.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col(part) == F.col("__at")), "left")
    final = {k: F.col(k) + F.coalesce(f"__{k}", F.lit(0)) for k in sums} | {k: F.least(k, f"__{k}") for k in mins} | {k: F.coalesce(k, f"__{k}") for k in lasts}
    return df.withColumns(final).drop(part, "__key", "__at", *[f"__{k}" for k in local])
