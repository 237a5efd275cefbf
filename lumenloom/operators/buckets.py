"""Bucket assignment for queued crops: counts, viability, orphan merging, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenloom.functions.geometry import nearest_bucket
from lumenloom.params import Target


def crop_kind() -> Column:
    return F.coalesce(F.col("kind"), F.lit("full"))


def full_crops(crops: DataFrame) -> DataFrame:
    return crops.where(crop_kind() != "texture")


def texture_crops(crops: DataFrame) -> DataFrame:
    return crops.where(crop_kind() == "texture")


def is_degenerate() -> Column:
    return (F.coalesce(F.col("w"), F.lit(0)) <= 0) | (F.coalesce(F.col("h"), F.lit(0)) <= 0)


def bucket_counts(assigned: DataFrame, min_size: int, order: str | None = None) -> DataFrame:
    """Rows per bucket and whether the bucket is viable.

    When none reaches ``min_size`` the largest one is viable; equal counts go to
    the bucket seen first when ``order`` names the queue position (a number keeps
    the aggregation hash-based), else to the smallest (bw, bh). The result has one row per bucket of the family, so the
    closing window is a few hundred rows at most.
    """
    n = F.count(F.lit(1)).alias("n")
    if order:
        counts = assigned.groupBy("bw", "bh").agg(n, F.min(order).alias("first_seen"))
    else:
        counts = assigned.groupBy("bw", "bh").agg(n).withColumn("first_seen", F.struct("bw", "bh"))
    everything = Window.partitionBy(F.lit(0))
    ranked = F.row_number().over(everything.orderBy(F.col("n").desc(), F.col("first_seen")))
    return (
        counts.withColumns({"_most": F.max("n").over(everything), "_rank": ranked})
        .withColumn("viable", F.when(F.col("_most") >= max(1, min_size), F.col("n") >= max(1, min_size)).otherwise(F.col("_rank") == 1))
        .select("bw", "bh", "n", "first_seen", "viable")
    )


def orphan_targets(counts: DataFrame) -> DataFrame:
    """Target bucket of every bucket: itself when viable, else the viable one nearest in ratio.

    Works on the per-bucket counts only. The viable buckets are gathered into
    one array, whose length the bucket family bounds.
    """
    viable = F.collect_list(F.when(F.col("viable"), F.struct("bw", "bh"))).over(Window.partitionBy(F.lit(0)))
    nearest = F.array_min(
        F.transform(
            F.col("_viable"),
            lambda v: F.struct(
                F.abs(v["bw"] / v["bh"] - F.col("bw") / F.col("bh")).alias("d"), v["bw"].alias("bw"), v["bh"].alias("bh")
            ),
        )
    )
    return (
        counts.withColumn("_viable", viable)
        .withColumn("_t", F.when(F.col("viable"), F.struct(F.lit(0.0).alias("d"), F.col("bw"), F.col("bh"))).otherwise(nearest))
        .select(
            "bw", "bh", "n", "first_seen", "viable", F.col("_t.bw").alias("target_w"), F.col("_t.bh").alias("target_h")
        )
    )


def assign_crops(crops: DataFrame, target: Target, min_size: int = 1, order: str | None = None) -> DataFrame:
    """Every full crop with its first bucket and its bucket after orphan merging.

    Degenerate boxes still count under (step, step) here and are dropped later.
    """
    assigned = nearest_bucket(full_crops(crops), "w", "h", target)
    targets = orphan_targets(bucket_counts(assigned, min_size, order))
    # one row per bucket of the family (at most 127, plus the fallback cell)
    small = targets.select("bw", "bh", "first_seen", "viable", "target_w", "target_h")
    return assigned.join(F.broadcast(small), ["bw", "bh"])


def size_histogram(planned: DataFrame, w: str, h: str) -> DataFrame:
    return planned.groupBy(F.col(w).alias("out_w"), F.col(h).alias("out_h")).agg(F.count(F.lit(1)).alias("n"))


def action_counts(planned: DataFrame, action: str = "action") -> DataFrame:
    return planned.groupBy(F.col(action).alias("action")).agg(F.count(F.lit(1)).alias("n"))
