"""Scene type and suggested crop from subject boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.numeric import let, staged
from lumenloom.params import AutoCropOptions

BLOCK = 512


def adaptive_padding(w: Column, h: Column, o: AutoCropOptions) -> Column:
    share = ((w + h) / 2 * F.lit(o.padding_ratio)).cast("int")
    return F.greatest(F.lit(o.min_padding), F.least(F.lit(o.max_padding), share))


def large_subjects(subjects: DataFrame, o: AutoCropOptions) -> DataFrame:
    """Subjects (with their image's size) that cover enough of the image."""
    area = F.col("w").cast("bigint") * F.col("h")
    floor = F.col("img_w").cast("bigint") * F.col("img_h") * F.lit(o.min_subject_area_ratio)
    return subjects.withColumn("area", area).where(F.col("area") >= floor)


def mean_pair_distance(subjects: DataFrame) -> DataFrame:
    """Mean distance between subject centres over all pairs of an image.

    Centres are packed into blocks of at most ``BLOCK`` by their number inside
    the image. Blocks are summed on their own and then block against block, so
    pairs are never rows and a crowded image spreads over many tasks.
    """
    centre = F.struct((F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    blocks = subjects.groupBy("image_id", F.floor(F.col("ord") / BLOCK).alias("block")).agg(F.collect_list(centre).alias("pts"))

    def between(p: Column, q: Column) -> Column:
        return F.aggregate(
            p,
            F.lit(0.0),
            lambda acc, a: acc + F.aggregate(q, F.lit(0.0), lambda s, b: s + F.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"])),
        )

    inside = blocks.select("image_id", F.size("pts").cast("bigint").alias("n"), (let(F.col("pts"), lambda p: between(p, p)) / 2).alias("d"))
    many = blocks.where("block > 0").select("image_id").distinct()
    multi = blocks.join(many, "image_id", "left_semi")
    a, b = multi.alias("a"), multi.alias("b")
    across = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.block") < F.col("b.block"))).select(
        F.col("a.image_id").alias("image_id"), F.lit(0).cast("bigint").alias("n"), between(F.col("a.pts"), F.col("b.pts")).alias("d")
    )
    total = inside.unionByName(across).groupBy("image_id").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return total.select("image_id", F.coalesce(F.try_divide(F.col("d"), pairs), F.lit(0.0)).alias("mean_distance"))


def scene_summary(subjects: DataFrame, o: AutoCropOptions) -> DataFrame:
    """One row per image with subjects: centroid, union box, density, spacing, largest subject."""
    big = large_subjects(subjects, o)
    cy = F.col("y") + F.col("h") / 2
    facts = big.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cy * F.col("area")).alias("weighted_y"),
        F.sum("area").alias("total_area"),
        F.min("x").alias("min_x"),
        F.min("y").alias("min_y"),
        F.max(F.col("x") + F.col("w")).alias("max_x"),
        F.max(F.col("y") + F.col("h")).alias("max_y"),
        F.min(F.struct((-F.col("area")).alias("a"), "ord", "x", "y", "w", "h")).alias("top"),
    )
    return facts.join(mean_pair_distance(big), "image_id").withColumns(
        {
            "density": F.coalesce(F.try_divide(F.col("total_area"), (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))), F.lit(0.0)),
            "spacing": F.coalesce(F.try_divide(F.col("mean_distance"), F.sqrt(F.col("total_area") / F.col("n"))), F.lit(0.0)),
        }
    )


def scenes(images: DataFrame, subjects: DataFrame, o: AutoCropOptions = AutoCropOptions()) -> DataFrame:
    """Scene type, focus box and vertical focus of every image (image_id, width, height)."""
    sized = subjects.join(images.select("image_id", F.col("width").alias("img_w"), F.col("height").alias("img_h")), "image_id")
    df = images.join(scene_summary(sized, o), "image_id", "left")
    at = F.when(F.col("total_area") > 0, F.col("weighted_y") / F.col("total_area") / F.col("height")).otherwise(F.lit(0.5))
    focus = F.when(at > o.vertical_focus_threshold, "bottom").when(at < 1 - o.vertical_focus_threshold, "top").otherwise("center")
    kind = (
        F.when(F.col("n").isNull(), "empty")
        .when(F.col("n") == 1, "single")
        .when((F.col("density") > o.compact_density) & (F.col("spacing") < o.compact_spacing), "compact_group")
        .otherwise("scattered")
    )

    def box(x: Column, y: Column, w: Column, h: Column) -> Column:
        return F.struct(*[c.cast("bigint").alias(n) for n, c in (("x", x), ("y", y), ("w", w), ("h", h))])

    whole = box(F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    union = box(F.col("min_x"), F.col("min_y"), F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    top = box(F.col("top.x"), F.col("top.y"), F.col("top.w"), F.col("top.h"))
    return df.withColumns({"scene": kind, "vertical_focus": F.when(F.col("n").isNull(), "center").otherwise(focus)}).withColumns(
        {
            "focus_box": F.when(F.col("scene") == "empty", whole).when(F.col("scene") == "compact_group", union).otherwise(top),
            "confidence": F.when(F.col("scene").isin("empty", "single"), F.lit(1.0))
            .when(F.col("scene") == "compact_group", F.col("density"))
            .otherwise(-F.col("top.a") / F.col("total_area")),
        }
    )


def auto_crop(scened: DataFrame, target_ratio: Column, o: AutoCropOptions = AutoCropOptions(), out: str = "suggested") -> DataFrame:
    """Pad the focus box, bring it near the target ratio, keep it in the image."""
    iw, ih = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    zero = F.lit(0).cast("bigint")
    bias = F.when(F.col("vertical_focus") == "bottom", F.lit(0.0)).when(F.col("vertical_focus") == "top", F.lit(1.0)).otherwise(F.lit(o.preserve_top_bias))
    return staged(
        scened,
        {"_pad": adaptive_padding(iw, ih, o).cast("bigint"), "_t": target_ratio},
        {"_fx": F.greatest(zero, F.col("focus_box.x") - F.col("_pad")), "_fy": F.greatest(zero, F.col("focus_box.y") - F.col("_pad"))},
        {
            "_fw": F.least(iw - F.col("_fx"), F.col("focus_box.w") + F.col("_pad") * 2),
            "_fh": F.least(ih - F.col("_fy"), F.col("focus_box.h") + F.col("_pad") * 2),
        },
        {"_far": F.when(F.col("_fh") > 0, F.try_divide(F.col("_fw"), F.col("_fh"))).otherwise(F.lit(1.0))},
        {"_near": F.abs(F.col("_far") - F.col("_t")) < o.ar_slack, "_wide": F.col("_far") > F.col("_t")},
        {
            "_w": F.when(F.col("_wide"), (F.col("_fh") * F.col("_t")).cast("bigint")).otherwise(F.col("_fw")),
            "_h": F.when(F.col("_wide"), F.col("_fh")).otherwise(
                F.least((F.col("_fw") / F.col("_t")).cast("bigint"), (F.col("_fh") * F.lit(o.vertical_safety_margin)).cast("bigint"))
            ),
        },
        {
            "_x": F.when(F.col("_wide"), F.col("_fx") + ((F.col("_fw") - F.col("_w")) * F.lit(o.horizontal_center_bias) / 2).cast("bigint")).otherwise(F.col("_fx")),
            "_y": F.when(F.col("_wide"), F.col("_fy")).otherwise(F.col("_fy") + ((F.col("_fh") - F.col("_h")) * (F.lit(1.0) - bias)).cast("bigint")),
        },
        {
            "_rx": F.greatest(zero, F.least(F.col("_x"), iw - o.min_side)),
            "_ry": F.greatest(zero, F.least(F.col("_y"), ih - o.min_side)),
        },
        {
            out: F.when(
                F.col("_near"), F.struct(F.col("_fx").alias("x"), F.col("_fy").alias("y"), F.col("_fw").alias("w"), F.col("_fh").alias("h"))
            ).otherwise(
                F.struct(
                    F.col("_rx").alias("x"),
                    F.col("_ry").alias("y"),
                    F.greatest(F.lit(o.min_side), F.least(F.col("_w"), iw - F.col("_rx"))).alias("w"),
                    F.greatest(F.lit(o.min_side), F.least(F.col("_h"), ih - F.col("_ry"))).alias("h"),
                )
            )
        },
    )
