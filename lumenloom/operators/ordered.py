"""Ordered operators that stay distributed when one key holds most rows.

A plain window sorts a whole group in one task. Each operator here first
measures the largest group. While it is within ``max_rows`` a plain window is
used; beyond that the rows are range-partitioned by (keys, order), the window
runs per (keys, range) and small per-range summaries carry state across ranges.
Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenloom.runtime import cut_lineage, largest_group

WINDOW_ROWS = 1_000_000


def _ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-partition and freeze, so every reader sees the same ranges."""
    cols = [F.col(k) for k in keys] + order
    return cut_lineage(df.repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()))


def _join_key(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    cond = [df[k].eqNullSafe(other[k]) for k in keys]
    right = other
    joined = df.join(right, cond, how)
    for k in keys:
        joined = joined.drop(right[k])
    return joined


def row_number(df: DataFrame, keys: list[str], order: list[Column], out: str, max_rows: int = WINDOW_ROWS) -> DataFrame:
    """1-based position inside each group."""
    if keys and largest_group(df, keys) <= max_rows:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    frozen = _ranges(df, keys, order)
    carried, inside = f"_carried_{out}", f"_inside_{out}"  # ``out`` may be any name
    scope = [*keys, "_range"]
    sizes = frozen.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    # one row per (key, range): a key spans at most as many rows as there are ranges
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*scope, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(carried))
    local = frozen.withColumn(inside, F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
    return (
        _join_key(local, offsets, scope)
        .withColumn(out, (F.col(inside) + F.col(carried)).cast("bigint"))
        .drop(inside, carried, "_range")
    )


def ordinal(df: DataFrame, order: list[Column], out: str, start: int = 0) -> DataFrame:
    """Dense global position without an unpartitioned window."""
    return row_number(df, [], order, out).withColumn(out, F.col(out) - 1 + start)


def neighbour(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, str], ahead: bool = False, max_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Previous (or next) row's columns inside each group; ``cols`` maps source to new name."""
    step = F.lead if ahead else F.lag
    if largest_group(df, keys) <= max_rows:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumns({new: step(src).over(w) for src, new in cols.items()})
    frozen = _ranges(df, keys, [F.col(order)])
    scope = [*keys, "_range"]
    pick = F.struct(*[F.col(src).alias(new) for src, new in cols.items()])
    edge = frozen.groupBy(*scope).agg((F.min_by if ahead else F.max_by)(pick, F.col(order)).alias("_edge"))
    carried = edge.select(*scope, step("_edge").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carry"))
    w = Window.partitionBy(*scope).orderBy(order)
    local = frozen.withColumns(
        {"_at_edge": step(F.lit(1)).over(w).isNull(), **{new: step(src).over(w) for src, new in cols.items()}}
    )
    joined = _join_key(local, carried, scope)
    filled = {
        new: F.when(F.col("_at_edge"), F.col("_carry")[new]).otherwise(F.col(new)) for new in cols.values()
    }
    return joined.withColumns(filled).drop("_at_edge", "_carry", "_range")


def running_sum(df: DataFrame, keys: list[str], order: str, col: str, out: str, max_rows: int = WINDOW_ROWS) -> DataFrame:
    """Inclusive running total inside each group."""
    def upto(parts: list[str]):
        return Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    if keys and largest_group(df, keys) <= max_rows:
        return df.withColumn(out, F.sum(col).over(upto(keys)))
    frozen = _ranges(df, keys, [F.col(order)])
    scope, carried = [*keys, "_range"], f"_carried_{out}"  # ``out`` may be any name
    totals = frozen.groupBy(*scope).agg(F.sum(col).alias("_t"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*scope, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias(carried))
    local = frozen.withColumn(out, F.sum(col).over(upto(scope)))
    return _join_key(local, offsets, scope).withColumn(out, F.col(out) + F.col(carried)).drop(carried, "_range")


def upcoming_min(df: DataFrame, order: str, col: str, out: str) -> DataFrame:
    """Smallest ``col`` of all rows that come later, without a group or a join by value."""
    frozen = _ranges(df, [], [F.col(order)])
    lows = frozen.groupBy("_range").agg(F.min(col).alias("_low"))
    # from the end: a frame that begins at the first row is extended, one that ends at the last row is recomputed for every row
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = lows.select("_range", F.min("_low").over(later).alias("_carry"))
    rest = Window.partitionBy("_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    local = frozen.withColumn(out, F.min(col).over(rest))
    # ``col`` may hold any value, so the nearer rows do not always hold the smaller one
    return local.join(carried, "_range").withColumn(out, F.least(out, "_carry")).drop("_carry", "_range")


def latest(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Latest row per key by aggregation, so partial results combine before the shuffle."""
    packed = F.max(F.struct(F.col(order), *[F.col(c) for c in cols])).alias("_last")
    return df.groupBy(*keys).agg(packed).select(*keys, F.col(f"_last.{order}").alias(order), *[F.col(f"_last.{c}").alias(c) for c in cols])
