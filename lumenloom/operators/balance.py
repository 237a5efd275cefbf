"""Learned target resolutions, batch balancing and crop preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenloom.functions.bucketing import nearest_packed, unpack_height, unpack_width
from lumenloom.functions.numeric import half_even, let, staged
from lumenloom.params import Target
from lumenloom.runtime import broadcast_if_small, cut_lineage


def learn_resolutions(images: DataFrame, target: Target = Target(), k: int = 8, steps: int = 20) -> list[tuple[int, int]]:
    """At most k training resolutions from clusters of the aspect ratios.

    Ratios are counted to four places and clustered by Lloyd's steps from a fixed
    start, k ratios in even logarithmic distance. Only the k centres reach the
    driver; a centre that attracts nothing stays where it is.
    """
    counts = images.select(F.round(F.try_divide("width", "height").cast("double"), 4).alias("ar")).where("ar > 0").groupBy("ar").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    low, high, kinds = counts.agg(F.min("ar"), F.max("ar"), F.count(F.lit(1))).first()
    if not kinds:
        return []
    k = min(k, kinds)
    centres = [low * (high / low) ** ((i + 0.5) / k) for i in range(k)]
    for _ in range(steps):
        gaps = F.array(*[F.struct(F.abs(F.col("ar") - F.lit(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
        own = counts.withColumn("i", F.array_min(gaps)["i"]).groupBy("i").agg((F.sum(F.col("ar") * F.col("n")) / F.sum("n")).alias("c"))
        moved = {r["i"]: r["c"] for r in own.collect()}  # at most k rows
        fresh = [moved.get(i, c) for i, c in enumerate(centres)]
        if fresh == centres:
            break
        centres = fresh
    sizes = []
    for ar in sorted(centres):
        h = (target.area / ar) ** 0.5
        sizes.append((round(h * ar / target.step) * target.step, round(h / target.step) * target.step))
    return sizes


def nearest_learned(df: DataFrame, w: str, h: str, resolutions: list[tuple[int, int]], out_w: str = "bw", out_h: str = "bh") -> DataFrame:
    """Nearest learned resolution by aspect ratio."""
    packed = nearest_packed(F.try_divide(F.col(w), F.col(h)), sorted(set(resolutions), key=lambda b: b[0] / b[1]))
    return staged(df, {"_b": packed}, {out_w: unpack_width(F.col("_b")), out_h: unpack_height(F.col("_b"))})


def surplus_rows(rows: DataFrame, order: Column, batch: int = 8, prefer_duplicates: bool = False) -> DataFrame:
    """Rows that keep a bucket from filling whole batches.

    Of each bucket's n rows, n % batch are candidates: rows alone in their
    duplicate group first, smaller crops first (``prefer_duplicates`` turns the
    first rule round). Candidates with a twin in the bucket are dropped, the
    others are left for a decision. ``rows`` has bw, bh, group_id, crop_w, crop_h.

    Fewer than ``batch`` rows per bucket can be needed, so ranks are cut at a
    constant, which Spark applies before the shuffle.
    """
    twins = rows.groupBy("bw", "bh", "group_id").agg(F.count(F.lit(1)).alias("twins"))
    sizes = twins.groupBy("bw", "bh").agg(F.sum("twins").alias("n"))
    marked = rows.join(twins, ["bw", "bh", "group_id"]).withColumn("has_twin", F.col("twins") > 1)
    first = F.col("has_twin").desc() if prefer_duplicates else F.col("has_twin").asc()
    w = Window.partitionBy("bw", "bh").orderBy(first, F.col("crop_w") * F.col("crop_h"), order)
    smallest = marked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= batch - 1)
    return (
        smallest.join(broadcast_if_small(sizes), ["bw", "bh"])  # one row per bucket
        .where(F.col("rank") <= F.col("n") % batch)
        .withColumn("verdict", F.when(F.col("has_twin"), "drop").otherwise("decide"))
    )


def gap_bucket(boxes: DataFrame, counts: DataFrame, batch: int = 8) -> DataFrame:
    """Nearest bucket that one more row would fill to a whole batch, else NULL.

    ``counts`` (bw, bh, n) has one row per bucket and enters as one scalar value.
    """
    open_ = counts.where((F.col("n") + 1) % batch == 0).agg(F.collect_list(F.struct("bw", "bh")).alias("b")).scalar()
    size = F.struct(F.try_divide(F.col("w"), F.col("h")).alias("ratio"), F.col("_open").alias("open"))

    def nearest(z: Column) -> Column:
        gap = F.transform(z["open"], lambda b: F.struct(F.abs(b["bw"] / b["bh"] - z["ratio"]).alias("d"), b["bw"].alias("bw"), b["bh"].alias("bh")))
        return F.array_min(gap)

    return staged(boxes, {"_open": open_}, {"_best": let(size, nearest)}, {"fill_w": F.col("_best.bw"), "fill_h": F.col("_best.bh")})


def crop_preferences(crops: DataFrame, session: str) -> DataFrame:
    """Mean padding share, mean ratio and number of crops per session."""
    pad = F.greatest(F.lit(0.0), ((F.col("width") - F.col("w")) / 2 + (F.col("height") - F.col("h")) / 2) / 2 / ((F.col("width") + F.col("height")) / 2))
    return crops.groupBy(session).agg(F.avg(pad).alias("avg_padding"), F.avg(F.try_divide(F.col("w"), F.col("h"))).alias("avg_ar"), F.count(F.lit(1)).alias("n"))


def blended_padding(history: DataFrame, session: str, base: float = 0.10, last: int = 10) -> DataFrame:
    """Padding share for the next session: base averaged with the mean of the last ten."""
    recent = history.orderBy(F.col(session).desc()).limit(last)
    return recent.agg((F.coalesce((F.lit(base) + F.avg("avg_padding")) / 2, F.lit(base))).alias("padding_ratio"), F.count(F.lit(1)).alias("sessions"))


def round_to_step(c: Column, step: int) -> Column:
    return (half_even(c / step) * step).cast("bigint")
