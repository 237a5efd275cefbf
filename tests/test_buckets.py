"""Golden values of bucket choice, crops and export plans."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import bucketing, geometry
from lumenloom.operators import buckets, catalog, naming
from lumenloom.params import ArbOptions, ExportOptions, Target
from lumenloom.plans import export

AREA = Target(1024 * 1024, 64)


def plan_one(spark, w, h, **kw):
    df = spark.createDataFrame([(w, h)], "w bigint, h bigint")
    return geometry.plan_export(df, "w", "h", ArbOptions(**kw)).first()["plan"].asDict(recursive=True)


def test_equal_area_family_spans_the_known_range():
    fam = bucketing.equal_area_family(AREA)
    assert len(fam) == 39 and fam[0] == (448, 2240) and fam[-1] == (2240, 448)
    assert fam == sorted(fam, key=lambda b: b[0] / b[1])


def test_texture_family_is_capped_and_keeps_the_square():
    fam = bucketing.texture_family(AREA, 2.0)
    assert (1024, 1024) in fam
    assert all(max(w / h, h / w) <= 2.0 + 1e-9 for w, h in fam)


@pytest.mark.parametrize(
    "size,options,bucket,crop,out,action",
    [
        ((1053, 1053), dict(base_resos=(512, 768, 1024), output_max_base_reso=1024), (1024, 1024), (14, 14, 1024, 1024), (1024, 1024), "crop"),
        ((400, 400), dict(base_resos=(512, 768, 1024), output_max_base_reso=1024), None, None, (400, 400), "keep"),
        ((624, 603), dict(base_resos=(512, 768, 1024, 1280, 1536, 1792, 2048), max_reso=3072, max_base_reso=2048, output_max_base_reso=1024), (512, 512), (10, 0, 603, 603), (603, 603), "crop"),
        ((2048, 2048), dict(base_resos=(512, 768, 1024, 1536), output_max_base_reso=1024), (1600, 1600), (0, 0, 2048, 2048), (1024, 1024), "downsample"),
    ],
)
def test_export_plans(spark, size, options, bucket, crop, out, action):
    p = plan_one(spark, *size, **options)
    assert (p["out"]["w"], p["out"]["h"]) == out and p["action"] == action
    assert p["needs_resize"] == (action == "downsample")
    if bucket:
        assert (p["bucket"]["w"], p["bucket"]["h"]) == bucket
        assert tuple(p["crop"][k] for k in "xywh") == crop


def test_no_upscaling_takes_a_smaller_bucket(spark):
    df = spark.createDataFrame([(900, 900)], "w bigint, h bigint")
    r = geometry.choose_arb_bucket(df, "w", "h", ArbOptions(base_resos=(512, 768, 1024))).first()
    assert (r["bw"], r["bh"]) == (768, 768)


def snap(spark, x, y, w, h, iw, ih):
    df = spark.createDataFrame([(x, y, w, h, iw, ih)], "x bigint, y bigint, w bigint, h bigint, iw bigint, ih bigint")
    s = geometry.snap_texture(df, ("x", "y", "w", "h"), ("iw", "ih"), AREA, 2.0).first()["snap"]
    return None if s is None else (s["x"], s["y"], s["w"], s["h"])


def test_texture_snap(spark):
    assert snap(spark, 0, 0, 1100, 1100, 4000, 4000)[2:] == (1024, 1024)
    wide = snap(spark, 100, 100, 1400, 800, 4000, 4000)
    assert wide[2] > wide[3] and wide[2] <= 1400 and wide[3] <= 800
    x, y, w, h = snap(spark, 1450, 1450, 1100, 1100, 4000, 4000)
    assert abs(x + w / 2 - 2000) <= 1 and abs(y + h / 2 - 2000) <= 1
    x, y, w, h = snap(spark, 0, 0, 1200, 1200, 2000, 2000)
    assert x >= 0 and y >= 0 and x + w <= 2000 and y + h <= 2000
    assert snap(spark, 0, 0, 700, 700, 4000, 4000) is None
    assert snap(spark, 0, 0, 600, 4000, 600, 4000) is None


def test_nearest_bucket_equals_plain_argmin(spark):
    fam = bucketing.equal_area_family(AREA)
    mids = [(a[0] / a[1] + b[0] / b[1]) / 2 for a, b in zip(fam, fam[1:])]
    rows = [(i, float(int(m * 100000)), 100000.0) for i, m in enumerate(mids)] + [(100 + i, float(w), float(7 + i)) for i, w in enumerate(range(1, 4000, 37))]
    df = spark.createDataFrame(rows, "id bigint, w double, h double")
    got = {r["id"]: (r["bw"], r["bh"]) for r in geometry.nearest_bucket(df, "w", "h", AREA).collect()}
    for i, w, h in rows:
        assert got[i] == min(fam, key=lambda b: abs(b[0] / b[1] - w / h)), (w, h)


CROPS = "image_id bigint, x double, y double, w double, h double, kind string, width bigint, height bigint, pos bigint"


def test_degenerate_box_counts_but_is_not_exported(spark):
    rows = [(1, 50.0, 50.0, 1000.0, 1000.0, "full", 1200, 1200, 0), (2, 800.0, 50.0, -200.0, 600.0, None, 1200, 1200, 1)]
    plan = export.plan_full_crops(spark.createDataFrame(rows, CROPS), ExportOptions(), "pos")
    assert {r["image_id"]: r["status"] for r in plan.collect()} == {1: "ok", 2: "degenerate"}
    assert {(r["bw"], r["bh"]) for r in plan.collect()} == {(1024, 1024), (64, 64)}


def test_orphans_merge_and_one_bucket_survives(spark):
    rows = [(i, 0.0, 0.0, 1000.0, 1000.0 + 10 * (i == 9), "full", 3000, 3000, i) for i in range(5)]
    rows += [(10, 0.0, 0.0, 2000.0, 900.0, "full", 3000, 3000, 10)]
    df = spark.createDataFrame(rows, CROPS)
    merged = buckets.assign_crops(df, AREA, 2, "pos")
    assert {(r["target_w"], r["target_h"]) for r in merged.collect()} == {(1024, 1024)}
    assert merged.where("not viable").count() == 1
    none_viable = buckets.assign_crops(df, AREA, 100, "pos")
    assert {(r["target_w"], r["target_h"]) for r in none_viable.collect()} == {(1024, 1024)}


def test_crops_stay_inside_images(spark):
    df = spark.range(5000).select(
        (F.col("id") * 37 % 900 - 100).alias("x"), (F.col("id") * 53 % 900 - 100).alias("y"), (F.col("id") * 13 % 1500 + 1).alias("w"),
        (F.col("id") * 31 % 1500 + 1).alias("h"), (F.col("id") % 700 + 64).alias("iw"), (F.col("id") * 7 % 700 + 64).alias("ih"), F.lit(832).alias("tw"), F.lit(1216).alias("th"),
    )
    out = geometry.fit_box_to_ratio(df, ("x", "y", "w", "h"), ("tw", "th"), ("iw", "ih"), "c")
    assert out.where("c.x < 0 or c.y < 0 or c.w < 0 or c.h < 0 or c.x + c.w > iw or c.y + c.h > ih").count() == 0


def test_numbering_is_dense_and_collisions_are_resolved(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", F.col("id") * 7919 % 1000)
    names = [r["file_name"] for r in naming.number_files(df, [F.col("k")]).orderBy("k").collect()]
    assert names == [f"{i:04d}.png" for i in range(1000)]
    wanted = spark.createDataFrame([(1, "a.png"), (2, "a.png"), (3, "b.png"), (4, "a.png")], "i int, name string")
    taken = spark.createDataFrame([("a.png",), ("a_3.png",)], "name string")
    free = naming.resolve_collisions(wanted, "name", [F.col("i")], taken)
    assert {r["i"]: r["unique_name"] for r in free.collect()} == {1: "a_2.png", 2: "a_4.png", 3: "b.png", 4: "a_5.png"}


def one_by_one(rows, taken):
    """The plain rule: in order, the first free of name, name_2, name_3, ..."""
    used, out = set(taken), {}
    for i, wanted in rows:
        given, k = wanted, 1
        stem, dot, ext = wanted.rpartition(".")
        stem, ext = (stem, dot + ext) if dot and "/" not in ext else (wanted, "")
        while given in used:
            k += 1
            given = f"{stem}_{k}{ext}"
        used.add(given)
        out[i] = given
    return out


@pytest.mark.parametrize("seed", range(6))
def test_collisions_as_one_by_one(spark, seed):
    rnd = random.Random(seed)
    pool = ["a.png", "a_2.png", "a_3.png", "a_5.png", "a_2_2.png", "a_2_3.png", "a_2_2_2.png", "a_02.png", "a_1.png", "b", "b_2", "b.c/d", "b.c/d_4", "", "_2.png", ".png"]
    pool = rnd.sample(pool, rnd.randint(3, len(pool)))
    rows = [(i, rnd.choice(pool)) for i in range(rnd.choice((12, 60, 150)))]
    taken = rnd.sample([*pool, "a_4.png", "a_2_4.png", "b_3", "x.png"], rnd.randint(0, 3))
    shuffled = rnd.sample(rows, len(rows))
    df = spark.createDataFrame([(i, n, "x") for i, n in shuffled], "i int, name string, unique string")
    used = spark.createDataFrame([(t,) for t in taken], "name string") if taken else None
    got = naming.resolve_collisions(df, "name", [F.col("i")], used)
    assert got.columns == ["i", "name", "unique", "unique_name"]
    got = {r["i"]: r["unique_name"] for r in got.collect()}
    assert got == one_by_one(rows, taken)


def test_a_numbered_series_is_not_gathered(spark):
    """Unique numbered names, null names and a hot one: nothing but numbers that meet goes through a group."""
    rows = spark.range(0, 20000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, "img.png").when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.format_string("img_%d.png", F.col("id") + 2)).alias("name"))
    got = naming.resolve_collisions(rows, "name", [F.col("id")]).collect()
    names = [r["unique_name"] for r in got if r["name"] is not None]
    want = one_by_one([(r["id"], r["name"]) for r in rows.collect() if r["name"] is not None], [])
    assert len(got) == 20000 and len(set(names)) == len(names)
    assert {r["id"]: r["unique_name"] for r in got if r["name"] is not None} == want
    assert naming.resolve_collisions(rows.limit(0), "name", [F.col("id")]).count() == 0


def test_next_pending_is_linear(spark):
    n = 60000
    rows = spark.range(0, n, 1, 4).select(F.col("id").alias("idx"), F.when(F.col("id") % 7 == 3, "pending").otherwise("cropped").alias("status"))
    start = time.time()
    got = {r["idx"]: r["next_idx"] for r in catalog.next_pending(rows).collect()}
    assert time.time() - start < 20  # one frame per row took over a minute
    pending = [i for i in range(n) if i % 7 == 3]
    assert all(got[i] == next((p for p in pending[max(0, i // 7) :] if p > i), None) for i in range(n))


def test_families_are_distinct_and_no_aggregation_holds_buckets(spark):
    from lumenloom.functions import bucketing

    rows = [(1, [512, 1024], 512, 1024, 64), (1, [1024, 512], 512, 1536, 128), (2, [640], 512, 1024, 64), (3, [64], 512, 1024, 64)]
    arb = bucketing.explode_arb(spark.createDataFrame(rows, "k long, bases array<int>, lo int, hi int, step int"), "bases", "lo", "hi", "step", ["k"])
    want = {
        (k, w, h)
        for k, bases, lo, hi, step in rows
        for w in range(lo, hi + 1, step)
        for h in range(lo, hi + 1, step)
        if max(w / h, h / w) <= 2.0 and any(abs(w * h - b * b) / (b * b) <= 0.1 for b in bases)
    }
    got = [tuple(r) for r in arb.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    areas = spark.createDataFrame([(1, 1048576, 64), (1, 1048576, 64), (1, 300000, 32)], "k long, a long, s long")
    equal = bucketing.explode_equal_area(areas, "a", "s", ["k"])
    assert equal.count() == equal.distinct().count()
    for fam in (arb, equal):
        plan = fam._jdf.queryExecution().optimizedPlan().toString()
        assert not any("bw#" in line.split("],")[0] for line in plan.splitlines() if "Aggregate" in line)
