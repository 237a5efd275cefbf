"""From queued crops to an export plan: one row per file to write, no pixels touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.geometry import aspect_crop, fit_box_to_ratio, nearest_bucket, plan_export, snap_texture
from lumenloom.operators.buckets import assign_crops, is_degenerate, texture_crops
from lumenloom.params import RESIZE_STRATEGIES, ExportOptions


def _rendered(df: DataFrame, crop: str, target_w: str, target_h: str, o: ExportOptions) -> DataFrame:
    """Adds bucket, final crop, output size and action for a first crop and its target."""
    if o.strategy.lower() in RESIZE_STRATEGIES:
        return df.withColumns(
            {
                "bucket_w": F.col(target_w),
                "bucket_h": F.col(target_h),
                "cut": F.col(crop),
                "out_w": F.col(target_w),
                "out_h": F.col(target_h),
                "action": F.lit("resize"),
                "needs_resize": F.lit(True),
            }
        )
    df = df.withColumns({"_first_w": F.col(f"{crop}.w"), "_first_h": F.col(f"{crop}.h")})
    df = plan_export(df, "_first_w", "_first_h", o.arb, "_plan")
    inner = F.col("_plan.crop")
    return df.withColumns(
        {
            "bucket_w": F.col("_plan.bucket.w"),
            "bucket_h": F.col("_plan.bucket.h"),
            "cut": F.struct(
                (F.col(f"{crop}.x") + inner["x"]).alias("x"),
                (F.col(f"{crop}.y") + inner["y"]).alias("y"),
                inner["w"].alias("w"),
                inner["h"].alias("h"),
            ),
            "out_w": F.col("_plan.out.w"),
            "out_h": F.col("_plan.out.h"),
            "action": F.col("_plan.action"),
            "needs_resize": F.col("_plan.needs_resize"),
        }
    ).drop("_first_w", "_first_h", "_plan")


def plan_full_crops(crops: DataFrame, o: ExportOptions, order: str | None = None) -> DataFrame:
    """Plan of the ordinary crops. ``crops`` carries the image's width and height.

    ``status`` is ``ok``, ``degenerate`` (an empty drawn box) or ``empty`` (the
    fitted box kept no pixels, which cannot be exported).
    """
    assigned = assign_crops(crops, o.target, o.min_bucket_size, order)
    fitted = fit_box_to_ratio(assigned, ("x", "y", "w", "h"), ("target_w", "target_h"), ("width", "height"), "fitted")
    planned = _rendered(fitted, "fitted", "target_w", "target_h", o)
    status = (
        F.when(is_degenerate(), "degenerate")
        .when((F.col("fitted.w") <= 0) | (F.col("fitted.h") <= 0) | F.col("fitted").isNull(), "empty")
        .otherwise("ok")
    )
    return planned.withColumns({"merged": ~F.col("viable"), "status": status})


def plan_texture_crops(crops: DataFrame, o: ExportOptions) -> DataFrame:
    """Plan of the texture crops: native pixels of one bucket, or ``skipped``."""
    snapped = snap_texture(
        texture_crops(crops), ("x", "y", "w", "h"), ("width", "height"), o.target, o.texture_max_ar
    )
    return snapped.withColumn("status", F.when(F.col("snap").isNull(), "skipped").otherwise("ok"))


def plan_whole_images(images: DataFrame, o: ExportOptions) -> DataFrame:
    """Plan for exporting every image as a whole: nearest bucket, centred crop."""
    df = nearest_bucket(images, "width", "height", o.target, "target_w", "target_h")
    df = aspect_crop(df, "width", "height", "target_w", "target_h", "fitted")
    return _rendered(df, "fitted", "target_w", "target_h", o)


def run_totals(full_plan: DataFrame, texture_plan: DataFrame) -> DataFrame:
    """One-row summary of a planned run; each plan is read once."""
    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(name)

    full = full_plan.agg(
        n(F.col("status") == "ok", "processed"),
        n(F.col("merged"), "merged"),
        n(F.col("status") == "degenerate", "degenerate_skipped"),
        F.countDistinct(F.when(F.col("viable"), F.struct("bw", "bh"))).alias("bucket_count"),
    )
    texture = texture_plan.agg(
        F.struct(n(F.col("status") == "ok", "ok"), n(F.col("status") == "skipped", "skipped")).alias("t")
    ).scalar()
    return full.withColumn("_t", texture).select("*", F.col("_t.ok").alias("texture_processed"), F.col("_t.skipped").alias("texture_skipped")).drop("_t")
