"""Crop geometry as staged column expressions; no joins, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.bucketing import (
    arb_family,
    family_literal,
    nearest_packed,
    ratio_groups_literal,
    equal_area_family,
    texture_family,
    unpack_height,
    unpack_width,
)
from lumenloom.functions.numeric import clamp, half_even, half_up, halve, let, staged, toward_zero
from lumenloom.params import DEFAULT_AREA, SNAP_LOSS, ArbOptions, Target


def aspect_ratio(w: Column, h: Column) -> Column:
    return w / F.greatest(F.lit(1), h)


def round_boxes(df: DataFrame) -> DataFrame:
    """Box edges rounded half-up, empty boxes dropped, before they are queued."""
    rounded = {c: half_up(F.col(c)).cast("bigint") for c in ("x", "y", "w", "h")}
    return df.withColumns(rounded).where((F.col("w") > 0) & (F.col("h") > 0))


def megapixels_of_side(px: Column) -> Column:
    side = F.greatest(F.lit(64.0), half_up(px.cast("double")))
    return side * side / F.lit(1048576.0)


def side_of_megapixels(mp: Column, step: Column) -> Column:
    side = F.sqrt(F.greatest(F.lit(0.0025), mp) * 1048576.0)
    return F.greatest(step, (half_up(side / step) * step).cast("bigint"))


def centre_crop(df: DataFrame, src_w: str, src_h: str, want_w: str, want_h: str, out: str) -> DataFrame:
    """Centred crop of a fixed size, never larger than the source."""
    sw, sh = F.col(src_w).cast("bigint"), F.col(src_h).cast("bigint")
    return staged(
        df,
        {
            "_cw": F.greatest(F.lit(1), F.least(F.col(want_w).cast("bigint"), sw)),
            "_ch": F.greatest(F.lit(1), F.least(F.col(want_h).cast("bigint"), sh)),
        },
        {
            out: F.struct(
                halve(F.greatest(F.lit(0), sw - F.col("_cw"))).alias("x"),
                halve(F.greatest(F.lit(0), sh - F.col("_ch"))).alias("y"),
                F.col("_cw").alias("w"),
                F.col("_ch").alias("h"),
            )
        },
    )


def aspect_crop(df: DataFrame, src_w: str, src_h: str, want_w: str, want_h: str, out: str) -> DataFrame:
    """Largest centred crop with the wanted aspect ratio."""
    sw, sh = F.col(src_w).cast("bigint"), F.col(src_h).cast("bigint")
    usable = (sw > 0) & (sh > 0) & (F.col(want_w) > 0) & (F.col(want_h) > 0)
    return staged(
        df,
        {"_ok": usable},
        {"_ar": F.when(F.col("_ok"), F.try_divide(F.col(want_w), F.col(want_h)))},
        {"_trim_sides": F.when(F.col("_ok"), F.try_divide(sw, sh) > F.col("_ar"))},
        {
            "_cw": F.when(F.col("_trim_sides"), F.least(half_even(sh * F.col("_ar")).cast("bigint"), sw)).otherwise(sw),
            "_ch": F.when(~F.col("_trim_sides"), F.least(half_even(sw / F.col("_ar")).cast("bigint"), sh)).otherwise(sh),
        },
        {
            out: F.struct(
                F.when(F.col("_ok"), halve(F.greatest(F.lit(0), sw - F.col("_cw")))).otherwise(F.lit(0)).cast("bigint").alias("x"),
                F.when(F.col("_ok"), halve(F.greatest(F.lit(0), sh - F.col("_ch")))).otherwise(F.lit(0)).cast("bigint").alias("y"),
                F.col("_cw").alias("w"),
                F.col("_ch").alias("h"),
            )
        },
    )


def pixel_crop(df: DataFrame, src_w: str, src_h: str, bucket_w: str, bucket_h: str, out: str) -> DataFrame:
    """Native centre crop where the bucket fits, aspect crop elsewhere."""
    df = centre_crop(df, src_w, src_h, bucket_w, bucket_h, "_centre")
    df = aspect_crop(df, src_w, src_h, bucket_w, bucket_h, "_aspect")
    fits = (F.col(bucket_w) <= F.col(src_w)) & (F.col(bucket_h) <= F.col(src_h))
    return df.withColumn(out, F.when(fits, F.col("_centre")).otherwise(F.col("_aspect"))).drop("_centre", "_aspect")


def bucket_crop(
    df: DataFrame, src_w: str, src_h: str, bucket_w: str, bucket_h: str, out: str, snap_loss: float = SNAP_LOSS
) -> DataFrame:
    """Aspect crop, snapped to the bucket's own pixels when that loses little area."""
    df = centre_crop(df, src_w, src_h, bucket_w, bucket_h, "_centre")
    df = aspect_crop(df, src_w, src_h, bucket_w, bucket_h, "_aspect")
    area = F.col("_aspect.w") * F.col("_aspect.h")
    loss = F.lit(1.0) - F.col(bucket_w) * F.col(bucket_h) / F.greatest(F.lit(1), area)
    snap = (
        (F.col(bucket_w) <= F.col(src_w))
        & (F.col(bucket_h) <= F.col(src_h))
        & (loss <= F.lit(max(0.0, float(snap_loss))))
    )
    return df.withColumn(out, F.when(snap, F.col("_centre")).otherwise(F.col("_aspect"))).drop("_centre", "_aspect")


def fit_box_to_ratio(
    df: DataFrame, box: tuple[str, str, str, str], target: tuple[str, str], image: tuple[str, str], out: str
) -> DataFrame:
    """Grow a drawn box to the target ratio about its centre, keep it inside the image, then floor.

    Boxes without a positive height have no ratio and give NULL.
    """
    x, y, w, h = (F.col(c).cast("double") for c in box)
    iw, ih = F.col(image[0]).cast("double"), F.col(image[1]).cast("double")
    return staged(
        df,
        {"_ar": F.col(target[0]) / F.col(target[1])},
        {"_wide": F.try_divide(w, h) > F.col("_ar")},
        {
            "_gw": F.when(F.col("_wide"), w).otherwise(h * F.col("_ar")),
            "_gh": F.when(F.col("_wide"), w / F.col("_ar")).otherwise(h),
        },
        {
            "_fw": F.when(F.col("_wide") & (F.col("_gh") > ih), ih * F.col("_ar"))
            .when(~F.col("_wide") & (F.col("_gw") > iw), iw)
            .otherwise(F.col("_gw")),
            "_fh": F.when(F.col("_wide") & (F.col("_gh") > ih), ih)
            .when(~F.col("_wide") & (F.col("_gw") > iw), iw / F.col("_ar"))
            .otherwise(F.col("_gh")),
        },
        {
            "_px": F.greatest(F.lit(0.0), x + w / 2 - F.col("_fw") / 2),
            "_py": F.greatest(F.lit(0.0), y + h / 2 - F.col("_fh") / 2),
        },
        {
            "_ix": F.greatest(
                F.lit(0), toward_zero(F.when(F.col("_px") + F.col("_fw") > iw, iw - F.col("_fw")).otherwise(F.col("_px")))
            ),
            "_iy": F.greatest(
                F.lit(0), toward_zero(F.when(F.col("_py") + F.col("_fh") > ih, ih - F.col("_fh")).otherwise(F.col("_py")))
            ),
        },
        {
            out: F.when(
                F.col("_wide").isNotNull(),
                F.struct(
                    F.col("_ix").alias("x"),
                    F.col("_iy").alias("y"),
                    clamp(toward_zero(F.col("_fw")), F.lit(0), iw.cast("bigint") - F.col("_ix")).alias("w"),
                    clamp(toward_zero(F.col("_fh")), F.lit(0), ih.cast("bigint") - F.col("_iy")).alias("h"),
                ),
            )
        },
    )


def fit_box_to_ratio_floor_first(
    df: DataFrame, box: tuple[str, str, str, str], target: tuple[str, str], image: tuple[str, str], out: str
) -> DataFrame:
    """Older variant: the size is floored before it is centred, and a side that
    cannot grow to the ratio grows to the image edge and shrinks its partner."""
    x, y, w, h = (F.col(c).cast("double") for c in box)
    iw, ih = F.col(image[0]).cast("double"), F.col(image[1]).cast("double")
    return staged(
        df,
        {"_ar": F.col(target[0]) / F.col(target[1])},
        {"_wide": F.try_divide(w, h) > F.col("_ar")},
        {
            "_gh": F.when(w / F.col("_ar") <= ih, w / F.col("_ar")).otherwise(F.greatest(h, ih)),
            "_gw": F.when(h * F.col("_ar") <= iw, h * F.col("_ar")).otherwise(F.greatest(w, iw)),
        },
        {
            "_tw": F.when(F.col("_wide"), F.when(w / F.col("_ar") <= ih, w).otherwise(F.col("_gh") * F.col("_ar"))).otherwise(F.col("_gw")),
            "_th": F.when(F.col("_wide"), F.col("_gh")).otherwise(
                F.when(h * F.col("_ar") <= iw, h).otherwise(F.col("_gw") / F.col("_ar"))
            ),
        },
        {
            "_over_w": F.col("_wide") & (w / F.col("_ar") > ih) & (F.col("_tw") > iw),
            "_over_h": ~F.col("_wide") & (h * F.col("_ar") > iw) & (F.col("_th") > ih),
        },
        {
            "_sw": F.when(F.col("_over_w"), iw).when(F.col("_over_h"), ih * F.col("_ar")).otherwise(F.col("_tw")).cast("bigint"),
            "_sh": F.when(F.col("_over_w"), iw / F.col("_ar")).when(F.col("_over_h"), ih).otherwise(F.col("_th")).cast("bigint"),
        },
        {
            "_px": F.greatest(F.lit(0), toward_zero(x + w / 2 - F.col("_sw") / 2)),
            "_py": F.greatest(F.lit(0), toward_zero(y + h / 2 - F.col("_sh") / 2)),
        },
        {
            out: F.struct(
                F.least(F.col("_px"), iw.cast("bigint") - F.col("_sw")).alias("x"),
                F.least(F.col("_py"), ih.cast("bigint") - F.col("_sh")).alias("y"),
                F.col("_sw").alias("w"),
                F.col("_sh").alias("h"),
            )
        },
    )


def nearest_bucket(df: DataFrame, w: str, h: str, target: Target, out_w: str = "bw", out_h: str = "bh") -> DataFrame:
    """Bucket with the nearest aspect ratio; boxes without a size fall to one grid cell."""
    ratio = F.try_divide(F.col(w), F.col(h))
    cell = (target.step << 20) + target.step
    packed = F.when((F.coalesce(w, F.lit(0)) <= 0) | (F.coalesce(h, F.lit(0)) <= 0), F.lit(cell).cast("bigint")).otherwise(
        nearest_packed(ratio, equal_area_family(target))
    )
    return staged(df, {"_b": packed}, {out_w: unpack_width(F.col("_b")), out_h: unpack_height(F.col("_b"))})


def choose_arb_bucket(df: DataFrame, w: str, h: str, o: ArbOptions, out_w: str = "bw", out_h: str = "bh") -> DataFrame:
    """Best ARB bucket by (ratio difference, |ln scale|, relative area difference).

    Buckets that would need upscaling are left out unless nothing else exists.
    """
    family = arb_family(o)
    if not family:
        return nearest_bucket(df, w, h, Target(DEFAULT_AREA, o.step), out_w, out_h)
    every = ratio_groups_literal(family)

    def score(z: Column, b: Column) -> Column:
        scale = F.greatest(b["bw"] / z["w"], b["bh"] / z["h"])
        return F.struct(
            F.abs(z["ar"] - b["bw"] / b["bh"]).alias("d"),
            F.abs(F.log(F.greatest(scale, F.lit(1e-8)))).alias("s"),
            (F.abs(b["bw"] * b["bh"] - z["area"]) / F.greatest(F.lit(1), z["area"])).alias("a"),
            b["ord"].alias("ord"),
            b["bw"].alias("bw"),
            b["bh"].alias("bh"),
        )

    def nearest(z: Column, pool: Column, must_fit: Column) -> Column:
        def members(gap: Column) -> Column:
            near = F.flatten(F.transform(F.filter(pool, lambda g: F.abs(z["ar"] - g["ar"]) <= gap), lambda g: g["b"]))
            usable = F.filter(near, lambda b: ~must_fit | ((b["bw"] <= z["w"]) & (b["bh"] <= z["h"])))
            return F.array_min(F.transform(usable, lambda b: score(z, b)))

        return let(F.array_min(F.transform(pool, lambda g: F.abs(z["ar"] - g["ar"]))), members)

    def best(z: Column) -> Column:
        if not o.no_upscale:
            return nearest(z, every, F.lit(False))
        fitting = F.filter(every, lambda g: (g["w"] <= z["w"]) & (g["h"] <= z["h"]))
        return let(
            fitting, lambda some: F.when(F.size(some) > 0, nearest(z, some, F.lit(True))).otherwise(nearest(z, every, F.lit(False)))
        )

    cw, ch = F.col(w), F.col(h)
    size = F.struct(
        F.greatest(F.lit(1), cw).alias("w"), F.greatest(F.lit(1), ch).alias("h"), F.try_divide(cw, ch).alias("ar"), (cw * ch).alias("area")
    )
    return staged(df, {"_best": let(size, best)}, {out_w: F.col("_best.bw"), out_h: F.col("_best.bh")})


def limit_output(df: DataFrame, w: str, h: str, max_base: int, min_reso: int, step: int, out: str) -> DataFrame:
    """Shrink a size to ``max_base`` squared pixels on the grid, ratio kept."""
    if max_base <= 0:
        return df.withColumn(out, F.struct(F.col(w).cast("bigint").alias("w"), F.col(h).cast("bigint").alias("h")))
    step = max(1, int(step or 64))
    cap, grid, least = F.lit(float(max_base * max_base)), F.lit(float(step)), F.lit(int(min_reso)).cast("bigint")
    cw, ch = F.col(w).cast("bigint"), F.col(h).cast("bigint")
    small = F.sqrt(F.greatest(F.lit(1), cw * ch)) <= F.lit(float(max_base))
    return staged(
        df,
        {"_ar": F.try_divide(cw, ch)},
        {"_tw": F.sqrt(cap * F.col("_ar"))},
        {
            "_ow": F.greatest(least, (half_even(F.col("_tw") / grid) * grid).cast("bigint")),
            "_oh": F.greatest(least, (half_even(F.col("_tw") / F.col("_ar") / grid) * grid).cast("bigint")),
        },
        {"_over": F.col("_ow") * F.col("_oh") > cap * 1.1, "_scale": F.sqrt(cap / (F.col("_ow") * F.col("_oh")))},
        {
            "_sw": F.greatest(least, (F.floor(F.col("_ow") * F.col("_scale") / grid) * step).cast("bigint")),
            "_sh": F.greatest(least, (F.floor(F.col("_oh") * F.col("_scale") / grid) * step).cast("bigint")),
        },
        {
            out: F.struct(
                F.when(small, cw).otherwise(F.greatest(F.lit(1), F.when(F.col("_over"), F.col("_sw")).otherwise(F.col("_ow")))).cast("bigint").alias("w"),
                F.when(small, ch).otherwise(F.greatest(F.lit(1), F.when(F.col("_over"), F.col("_sh")).otherwise(F.col("_oh")))).cast("bigint").alias("h"),
            )
        },
    )


def plan_export(df: DataFrame, src_w: str, src_h: str, o: ArbOptions, out: str = "plan") -> DataFrame:
    """Bucket, crop, output size and action for every source size, as one struct."""
    df = choose_arb_bucket(df, src_w, src_h, o, "_bw", "_bh")
    df = bucket_crop(df, src_w, src_h, "_bw", "_bh", "_crop")
    df = df.withColumns({"_pw": F.col("_crop.w"), "_ph": F.col("_crop.h")})
    df = limit_output(df, "_pw", "_ph", o.output_max_base_reso, o.min_reso, o.step, "_out")
    keep = F.lit(False)
    if o.no_upscale:
        keep = (F.col("_bw") > F.col(src_w)) | (F.col("_bh") > F.col(src_h))
    size = F.struct(F.col("_pw").alias("w"), F.col("_ph").alias("h"))
    resized = ~keep & ((F.col("_out.w") != F.col("_pw")) | (F.col("_out.h") != F.col("_ph")))
    return df.withColumn(
        out,
        F.struct(
            F.struct(F.col("_bw").alias("w"), F.col("_bh").alias("h")).alias("bucket"),
            F.col("_crop").alias("crop"),
            F.when(keep, size).otherwise(F.col("_out")).alias("out"),
            F.when(keep, F.lit("keep")).when(resized, F.lit("downsample")).otherwise(F.lit("crop")).alias("action"),
            resized.alias("needs_resize"),
        ),
    ).drop("_bw", "_bh", "_crop", "_pw", "_ph", "_out")


def snap_texture(
    df: DataFrame, box: tuple[str, str, str, str], image: tuple[str, str], target: Target, max_ar: float, out: str = "snap"
) -> DataFrame:
    """Native-resolution bucket inside a drawn box, or NULL when none fits.

    Of the buckets that fit box and source, those within 2 % of the largest
    area compete on aspect ratio; the winner is centred on the box and clamped
    into the source.
    """
    x, y, w, h = (F.col(c).cast("double") for c in box)
    iw, ih = F.col(image[0]).cast("bigint"), F.col(image[1]).cast("bigint")
    usable = (w > 0) & (h > 0) & (iw > 0) & (ih > 0)

    def best(d: Column) -> Column:
        fit = F.filter(
            family_literal(texture_family(target, max_ar)),
            lambda b: (b["bw"] <= d["w"]) & (b["bh"] <= d["h"]) & (b["bw"] <= d["iw"]) & (b["bh"] <= d["ih"]),
        )

        def nearest(pool: Column, top: Column) -> Column:
            near = F.filter(pool, lambda b: b["bw"] * b["bh"] >= top * 0.98)
            return F.array_min(
                F.transform(
                    near,
                    lambda b: F.struct(
                        F.abs(b["bw"] / b["bh"] - F.try_divide(d["w"], d["h"])).alias("d"), b["ord"].alias("ord"), b["bw"].alias("bw"), b["bh"].alias("bh")
                    ),
                )
            )

        return let(fit, lambda pool: let(F.array_max(F.transform(pool, lambda b: b["bw"] * b["bh"])), lambda top: nearest(pool, top)))

    drawn = F.struct(w.alias("w"), h.alias("h"), iw.alias("iw"), ih.alias("ih"))
    return staged(
        df,
        {"_best": F.when(usable, let(drawn, best))},
        {"_bw": F.col("_best.bw"), "_bh": F.col("_best.bh")},
        {
            "_nx": clamp(half_even(x + w / 2 - F.col("_bw") / 2).cast("bigint"), F.lit(0), iw - F.col("_bw")),
            "_ny": clamp(half_even(y + h / 2 - F.col("_bh") / 2).cast("bigint"), F.lit(0), ih - F.col("_bh")),
        },
        {
            out: F.when(
                F.col("_bw").isNotNull(),
                F.struct(
                    F.col("_nx").alias("x"), F.col("_ny").alias("y"), F.col("_bw").alias("w"), F.col("_bh").alias("h")
                ),
            )
        },
    )


def corner_box(x: str, y: str, w: str, h: str) -> Column:
    """(x, y, w, h) as corners (x1, y1, x2, y2)."""
    return F.struct(
        F.col(x).cast("bigint").alias("x1"),
        F.col(y).cast("bigint").alias("y1"),
        (F.col(x) + F.col(w)).cast("bigint").alias("x2"),
        (F.col(y) + F.col(h)).cast("bigint").alias("y2"),
    )
