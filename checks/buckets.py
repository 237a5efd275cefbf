"""Queries about buckets, crops and export plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import ASSIGNED, CROPS, IMAGES, arb_sql, crops, family_sql, images, table
from lumenloom.functions import bucketing, geometry
from lumenloom.operators import buckets, naming
from lumenloom.runtime import cut_lineage
from lumenloom.params import ArbOptions, ExportOptions, Target
from lumenloom.plans import export

TARGET = Target()
ARB = ArbOptions(base_resos=(512, 768, 1024), output_max_base_reso=1024)
MIN_SIZE = 600


def q_target_clamp(spark, sf):
    t = table(spark, sf, "part").select(
        F.col("p_partkey").alias("image_id"), (F.col("p_retailprice") / 200).alias("mp"), (F.col("p_size") * 13).alias("step")
    )
    return bucketing.clamp_target(t, "mp", "step").select("image_id", F.round("target_mp", 6).alias("target_mp"), "target_step", "target_area")


S_TARGET = """SELECT p_partkey AS image_id, round(greatest(0.05, least(9.0, p_retailprice/200)),6) AS target_mp,
  greatest(8, least(512, CASE WHEN (p_size*13)//8*8=0 THEN 8 ELSE (p_size*13)//8*8 END))::BIGINT AS target_step,
  trunc(greatest(0.05, least(9.0, p_retailprice/200))*1048576)::BIGINT AS target_area FROM part"""


def _settings(spark, sf):
    t = table(spark, sf, "part").select(
        F.col("p_partkey").alias("image_id"), (F.col("p_retailprice") / 1000).alias("mp"), (F.lit(32) + (F.col("p_size") % 4) * 32).alias("step")
    )
    return bucketing.clamp_target(t, "mp", "step")


def q_equal_area_family(spark, sf):
    fam = bucketing.explode_equal_area(_settings(spark, sf), "target_area", "target_step", ["image_id"])
    return fam.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_buckets"),
        F.min("bw").alias("narrowest"),
        F.max("bw").alias("widest"),
        F.sum(F.col("bw") * F.col("bh")).alias("total_area"),
    )


S_FAMILY = """WITH st AS (
  SELECT p_partkey AS image_id, trunc(greatest(0.05, least(9.0, p_retailprice/1000))*1048576)::BIGINT AS area,
         (32 + (p_size%4)*32)::BIGINT AS step FROM part),
side AS (SELECT *, round_even(floor(sqrt(area))/step,0)*step AS s FROM st),
wide AS (SELECT image_id, i, s+i*step AS w, CASE WHEN i=0 THEN s ELSE round_even(area/(s+i*step)/step,0)*step END AS h
         FROM side, range(0,64) t(i)),
kept AS (SELECT a.* FROM wide a LEFT JOIN wide b ON a.image_id=b.image_id AND b.i=a.i-1
         WHERE a.h>0 AND (a.i<=1 OR b.w/greatest(1,b.h) <= 4.5)),
fam AS (SELECT image_id, w AS bw, h AS bh FROM kept UNION SELECT image_id, h, w FROM kept)
SELECT image_id, count(*) AS n_buckets, min(bw)::BIGINT AS narrowest, max(bw)::BIGINT AS widest, sum(bw*bh)::BIGINT AS total_area
FROM fam GROUP BY image_id"""


def q_arb_family(spark, sf):
    """ARB family of every customer-defined base resolution."""
    t = table(spark, sf, "part").select(
        F.col("p_partkey").alias("image_id"),
        F.array((F.lit(512) + (F.col("p_partkey") % 9) * 64).cast("int"), F.lit(1024)).alias("bases"),
        F.lit(512).alias("lo"),
        (F.lit(1024) + (F.col("p_partkey") % 5) * 256).cast("int").alias("hi"),
        (F.lit(64) + (F.col("p_partkey") % 2) * 64).cast("int").alias("step"),
    )
    fam = bucketing.explode_arb(t, "bases", "lo", "hi", "step", ["image_id"])
    return fam.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_buckets"), F.sum(F.col("bw") * F.col("bh")).alias("total_area"), F.max("bw").alias("widest"))


S_ARB_FAMILY = """WITH st AS (SELECT p_partkey AS image_id, [512+(p_partkey%9)*64, 1024] AS bases, 1024+(p_partkey%5)*256 AS hi, 64+(p_partkey%2)*64 AS step FROM part),
b AS (SELECT image_id, hi, step, unnest(bases) AS base FROM st),
g AS (SELECT *, unnest(range(512,hi+1,step)) AS bw FROM b),
f AS (SELECT DISTINCT image_id, bw, bh FROM (SELECT *, unnest(range(512,hi+1,step)) AS bh FROM g)
      WHERE abs(bw*bh-base*base)/(base*base) <= 0.1 AND greatest(bw/bh,bh/bw) <= 2.0)
SELECT image_id, count(*) AS n_buckets, sum(bw*bh)::BIGINT AS total_area, max(bw)::BIGINT AS widest FROM f GROUP BY image_id"""


def q_base_resolutions(spark, sf):
    k = F.col("p_partkey")
    t = table(spark, sf, "part").select(
        k.alias("image_id"),
        F.when(k % 4 == 0, F.concat_ws(", ", (512 + k % 7 * 64).cast("string"), F.lit(""), F.lit("768"), F.lit("-5"))).alias("csv"),
        (k % 3 * 300).cast("int").alias("min_base"),
        F.when(k % 5 == 0, F.lit(0)).otherwise(500 + k % 11 * 100).cast("int").alias("max_base"),
        (128 + k % 3 * 64).cast("int").alias("base_step"),
        F.lit(512).alias("min_reso"),
    )
    bases = bucketing.base_resolution_list(F.col("csv"), F.col("min_base"), F.col("max_base"), F.col("base_step"), F.col("min_reso"))
    return t.select("image_id", F.array_join(bases.cast("array<string>"), "/").alias("bases"))


S_BASES = """WITH t AS (SELECT p_partkey AS image_id,
  CASE WHEN p_partkey%4=0 THEN (512+p_partkey%7*64) || ', , 768, -5' END AS csv,
  p_partkey%3*300 AS min_base, CASE WHEN p_partkey%5=0 THEN 0 ELSE 500+p_partkey%11*100 END AS max_base, 128+p_partkey%3*64 AS base_step FROM part),
u AS (SELECT *, CASE WHEN min_base>0 THEN min_base ELSE 512 END AS first FROM t),
v AS (SELECT *, least(first,max_base) AS lo, greatest(first,max_base) AS hi FROM u)
SELECT image_id, array_to_string(CASE
  WHEN csv IS NOT NULL THEN list_sort(list_distinct(list_filter(list_transform(string_split(csv,','), lambda s: try_cast(trim(s) AS BIGINT)), lambda b: b>0)))
  WHEN max_base>0 THEN list_sort(list_distinct(list_append(range(lo,hi+1,base_step), hi)))
  ELSE [1024::BIGINT] END, '/') AS bases FROM v"""


def q_nearest_bucket(spark, sf):
    """Every 23rd box lacks its width, every 29th its height."""
    c = crops(spark, sf)
    c = c.withColumn("w", F.when(F.col("op") % 23 != 0, F.col("w"))).withColumn("h", F.when(F.col("op") % 29 != 0, F.col("h")))
    df = geometry.nearest_bucket(c, "w", "h", TARGET)
    return df.select("op", "crop_id", "image_id", "kind", "bw", "bh")


S_NEAREST = f"""WITH {CROPS},{family_sql()}
SELECT op, crop_id, image_id, kind, CASE WHEN w<=0 OR h<=0 OR op%23=0 OR op%29=0 THEN 64 ELSE b.bw END::BIGINT AS bw, CASE WHEN w<=0 OR h<=0 OR op%23=0 OR op%29=0 THEN 64 ELSE b.bh END::BIGINT AS bh
FROM crops c, LATERAL (SELECT arg_min(f.bw,(abs(f.bw/f.bh-c.w/c.h),f.ord)) AS bw, arg_min(f.bh,(abs(f.bw/f.bh-c.w/c.h),f.ord)) AS bh FROM fam f) b"""


def q_crop_buckets(spark, sf):
    """Flagship: bucket of every crop after orphan merging, and how many land in each."""
    assigned = buckets.assign_crops(crops(spark, sf), TARGET, MIN_SIZE)
    return assigned.groupBy("target_w", "target_h").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("viable")).alias("merged"), F.count_if(buckets.is_degenerate()).alias("degenerate")
    )


MERGED = (
    ASSIGNED
    + f""",
counts AS (SELECT bw, bh, count(*) AS n FROM assigned GROUP BY 1,2),
viable AS (
  SELECT bw, bh FROM counts WHERE n>={MIN_SIZE}
  UNION ALL
  (SELECT bw, bh FROM counts WHERE (SELECT max(n) FROM counts)<{MIN_SIZE} ORDER BY n DESC, bw, bh LIMIT 1)),
targets AS (
  SELECT c.bw, c.bh, c.n, v.bw IS NOT NULL AS viable, CASE WHEN v.bw IS NOT NULL THEN c.bw ELSE t.tw END AS target_w, CASE WHEN v.bw IS NOT NULL THEN c.bh ELSE t.th END AS target_h
  FROM counts c LEFT JOIN viable v ON v.bw=c.bw AND v.bh=c.bh,
       LATERAL (SELECT arg_min(q.bw,(abs(q.bw/q.bh-c.bw/c.bh),q.bw,q.bh)) AS tw, arg_min(q.bh,(abs(q.bw/q.bh-c.bw/c.bh),q.bw,q.bh)) AS th FROM viable q) t),
merged AS (SELECT a.*, t.viable, t.target_w, t.target_h FROM assigned a JOIN targets t ON a.bw=t.bw AND a.bh=t.bh)"""
)
S_CROP_BUCKETS = f"""WITH {MERGED}
SELECT target_w::BIGINT AS target_w, target_h::BIGINT AS target_h, count(*) AS n, count(*) FILTER (NOT viable) AS merged, count(*) FILTER (w<=0 OR h<=0) AS degenerate
FROM merged GROUP BY 1,2"""


def q_bucket_viability(spark, sf):
    assigned = geometry.nearest_bucket(buckets.full_crops(crops(spark, sf)), "w", "h", TARGET)
    targets = buckets.orphan_targets(buckets.bucket_counts(assigned, MIN_SIZE))
    return targets.select("bw", "bh", "n", "viable", "target_w", "target_h")


S_VIABILITY = f"""WITH {MERGED} SELECT bw::BIGINT AS bw, bh::BIGINT AS bh, n, viable, target_w::BIGINT AS target_w, target_h::BIGINT AS target_h FROM targets"""


def q_degenerate(spark, sf):
    return crops(spark, sf).groupBy("kind").agg(F.count_if(buckets.is_degenerate()).alias("degenerate"), F.count(F.lit(1)).alias("n"))


S_DEGENERATE = f"WITH {CROPS} SELECT kind, count(*) FILTER (w<=0 OR h<=0) AS degenerate, count(*) AS n FROM crops GROUP BY kind"


def q_round_boxes(spark, sf):
    c = crops(spark, sf).select("op", "crop_id", "image_id", "kind", *[(F.col(k) / 8 + 0.25).alias(k) for k in ("x", "y", "w", "h")])
    return geometry.round_boxes(c)


S_ROUND = f"""WITH {CROPS}, r AS (SELECT op, crop_id, image_id, kind, floor(x/8+0.25+0.5)::BIGINT AS x, floor(y/8+0.25+0.5)::BIGINT AS y, floor(w/8+0.25+0.5)::BIGINT AS w, floor(h/8+0.25+0.5)::BIGINT AS h FROM crops)
SELECT * FROM r WHERE w>0 AND h>0"""


def _flat(df, col, names=("x", "y", "w", "h"), prefix=""):
    return [F.col(f"{col}.{n}").cast("bigint").alias(prefix + n) for n in names]


def q_smart_crop(spark, sf):
    df = geometry.nearest_bucket(images(spark, sf), "width", "height", TARGET)
    df = geometry.aspect_crop(df, "width", "height", "bw", "bh", "c")
    return df.select("image_id", "bw", "bh", *_flat(df, "c"))


SMART = """CASE WHEN {sw}/{sh} > {bw}/{bh} THEN least(round_even({sh}*({bw}/{bh}),0)::BIGINT,{sw}) ELSE {sw} END"""
SMARTH = """CASE WHEN {sw}/{sh} > {bw}/{bh} THEN {sh} ELSE least(round_even({sw}/({bw}/{bh}),0)::BIGINT,{sh}) END"""


def _smart(sw, sh, bw, bh):
    k = dict(sw=sw, sh=sh, bw=bw, bh=bh)
    return SMART.format(**k), SMARTH.format(**k)


_W, _H = _smart("width", "height", "bw", "bh")
IMG_BUCKET = f"""{IMAGES},{family_sql()},
ib AS (SELECT c.*, b.* FROM images c, LATERAL (SELECT arg_min(f.bw,(abs(f.bw/f.bh-c.width/c.height),f.ord)) AS bw, arg_min(f.bh,(abs(f.bw/f.bh-c.width/c.height),f.ord)) AS bh FROM fam f) b)"""
S_SMART = f"""WITH {IMG_BUCKET}, z AS (SELECT *, {_W} AS w, {_H} AS h FROM ib)
SELECT image_id, bw, bh, (width-w)//2 AS x, (height-h)//2 AS y, w, h FROM z"""


def q_box_adjust(spark, sf):
    df = buckets.assign_crops(crops(spark, sf), TARGET, MIN_SIZE).where(~buckets.is_degenerate())
    df = geometry.fit_box_to_ratio(df, ("x", "y", "w", "h"), ("target_w", "target_h"), ("width", "height"), "c")
    return df.select("op", "crop_id", "image_id", *_flat(df, "c"))


ADJUST = """adj0 AS (SELECT *, target_w/target_h AS ar, (w/h > target_w/target_h) AS wide FROM merged WHERE w>0 AND h>0),
adj1 AS (SELECT *, CASE WHEN wide THEN w ELSE h*ar END AS gw, CASE WHEN wide THEN w/ar ELSE h END AS gh FROM adj0),
adj2 AS (SELECT *, CASE WHEN wide AND gh>height THEN height*ar WHEN NOT wide AND gw>width THEN width ELSE gw END AS fw,
                   CASE WHEN wide AND gh>height THEN height WHEN NOT wide AND gw>width THEN width/ar ELSE gh END AS fh FROM adj1),
adj3 AS (SELECT *, greatest(0.0::DOUBLE, x+w/2-fw/2) AS px, greatest(0.0::DOUBLE, y+h/2-fh/2) AS py FROM adj2),
adj4 AS (SELECT *, greatest(0, trunc(CASE WHEN px+fw>width THEN width-fw ELSE px END)::BIGINT) AS ix,
                   greatest(0, trunc(CASE WHEN py+fh>height THEN height-fh ELSE py END)::BIGINT) AS iy FROM adj3),
adj AS (SELECT *, greatest(0, least(trunc(fw)::BIGINT, width-ix)) AS iw, greatest(0, least(trunc(fh)::BIGINT, height-iy)) AS ih FROM adj4)"""
S_ADJUST = f"WITH {MERGED},{ADJUST} SELECT op, crop_id, image_id, ix AS x, iy AS y, iw AS w, ih AS h FROM adj"


def q_box_adjust_floor_first(spark, sf):
    df = buckets.assign_crops(crops(spark, sf), TARGET, MIN_SIZE).where(~buckets.is_degenerate())
    df = geometry.fit_box_to_ratio_floor_first(df, ("x", "y", "w", "h"), ("target_w", "target_h"), ("width", "height"), "c")
    return df.select("op", "crop_id", "image_id", *_flat(df, "c"))


S_ADJUST_OLD = f"""WITH {MERGED},
a0 AS (SELECT *, target_w/target_h AS ar, (w/h > target_w/target_h) AS wide FROM merged WHERE w>0 AND h>0),
a1 AS (SELECT *, CASE WHEN wide THEN (CASE WHEN w/ar<=height THEN w/ar WHEN h<height THEN height ELSE h END) END AS hh,
                 CASE WHEN NOT wide THEN (CASE WHEN h*ar<=width THEN h*ar WHEN w<width THEN width ELSE w END) END AS ww FROM a0),
a2 AS (SELECT *, CASE WHEN wide THEN (CASE WHEN w/ar<=height THEN w ELSE hh*ar END) ELSE ww END AS w1,
                 CASE WHEN wide THEN hh ELSE (CASE WHEN h*ar<=width THEN h ELSE ww/ar END) END AS h1 FROM a1),
a3 AS (SELECT *, CASE WHEN wide AND w/ar>height AND w1>width THEN width WHEN NOT wide AND h*ar>width AND h1>height THEN height*ar ELSE w1 END AS w2,
                 CASE WHEN wide AND w/ar>height AND w1>width THEN width/ar WHEN NOT wide AND h*ar>width AND h1>height THEN height ELSE h1 END AS h2 FROM a2),
a4 AS (SELECT *, trunc(w2)::BIGINT AS fw, trunc(h2)::BIGINT AS fh FROM a3),
a5 AS (SELECT *, greatest(0,trunc(x+w/2-fw/2)::BIGINT) AS px, greatest(0,trunc(y+h/2-fh/2)::BIGINT) AS py FROM a4)
SELECT op, crop_id, image_id, least(px,width-fw) AS x, least(py,height-fh) AS y, fw AS w, fh AS h FROM a5"""


def q_pixel_crop(spark, sf):
    df = geometry.nearest_bucket(images(spark, sf), "width", "height", TARGET)
    df = geometry.pixel_crop(df, "width", "height", "bw", "bh", "c")
    return df.select("image_id", *_flat(df, "c"))


S_PIXEL = f"""WITH {IMG_BUCKET}, z AS (SELECT *, CASE WHEN bw<=width AND bh<=height THEN bw ELSE {_W} END AS w, CASE WHEN bw<=width AND bh<=height THEN bh ELSE {_H} END AS h FROM ib)
SELECT image_id, (width-w)//2 AS x, (height-h)//2 AS y, w, h FROM z"""


def q_arb_bucket(spark, sf):
    return geometry.choose_arb_bucket(images(spark, sf), "width", "height", ARB).select("image_id", "bw", "bh")


ARB_CHOICE = f"""{IMAGES},{arb_sql([512, 768, 1024])},
scored AS (SELECT i.image_id, i.width, i.height, a.bw, a.bh, a.ord, (a.bw<=greatest(1,i.width) AND a.bh<=greatest(1,i.height)) AS fits,
  abs(i.width/i.height - a.bw/a.bh) AS d, abs(ln(greatest(greatest(a.bw/i.width, a.bh/i.height),1e-8))) AS s, abs(a.bw*a.bh-i.width*i.height)/(i.width*i.height) AS r
  FROM images i, arb a),
pool AS (SELECT *, max(fits::INT) OVER (PARTITION BY image_id) AS anyfit FROM scored),
chosen AS (SELECT image_id, any_value(width) AS width, any_value(height) AS height, arg_min(bw,(d,s,r,ord)) AS bw, arg_min(bh,(d,s,r,ord)) AS bh
  FROM pool WHERE fits OR anyfit=0 GROUP BY image_id)"""
S_ARB_BUCKET = f"WITH {ARB_CHOICE} SELECT image_id, bw::BIGINT AS bw, bh::BIGINT AS bh FROM chosen"


def q_export_plan(spark, sf):
    df = geometry.plan_export(images(spark, sf), "width", "height", ARB)
    return df.select(
        "image_id", F.col("plan.bucket.w").alias("bw"), F.col("plan.bucket.h").alias("bh"),
        *_flat(df, "plan.crop"), F.col("plan.out.w").alias("out_w"), F.col("plan.out.h").alias("out_h"),
        F.col("plan.action").alias("action"), F.col("plan.needs_resize").alias("needs_resize"),
    )


ARB_PLAN = f"""p0 AS (SELECT *, {_W} AS aw, {_H} AS ah FROM chosen),
p1 AS (SELECT *, (bw<=width AND bh<=height AND 1.0-bw*bh/greatest(1,aw*ah) <= 0.12) AS snap FROM p0),
p2 AS (SELECT *, CASE WHEN snap THEN bw ELSE aw END AS cw, CASE WHEN snap THEN bh ELSE ah END AS ch FROM p1),
p3 AS (SELECT *, (bw>width OR bh>height) AS keep, (sqrt(greatest(1,cw*ch)) > 1024) AS big, cw/ch AS ar, sqrt(1048576.0::DOUBLE*(cw/ch)) AS tw FROM p2),
p4 AS (SELECT *, greatest(512, (round_even(tw/64,0)*64)::BIGINT) AS ow, greatest(512, (round_even(tw/ar/64,0)*64)::BIGINT) AS oh FROM p3),
p5 AS (SELECT *, ow*oh > 1048576.0::DOUBLE*1.1 AS over, sqrt(1048576.0::DOUBLE/(ow*oh)) AS sc FROM p4),
p6 AS (SELECT *, CASE WHEN over THEN greatest(512,(floor(ow*sc/64)*64)::BIGINT) ELSE ow END AS lw, CASE WHEN over THEN greatest(512,(floor(oh*sc/64)*64)::BIGINT) ELSE oh END AS lh FROM p5),
p7 AS (SELECT *, CASE WHEN keep OR NOT big THEN cw ELSE lw END AS out_w, CASE WHEN keep OR NOT big THEN ch ELSE lh END AS out_h FROM p6)"""
S_EXPORT_PLAN = f"""WITH {ARB_CHOICE},{ARB_PLAN}
SELECT image_id, bw::BIGINT AS bw, bh::BIGINT AS bh, ((width-cw)//2)::BIGINT AS x, ((height-ch)//2)::BIGINT AS y, cw::BIGINT AS w, ch::BIGINT AS h, out_w::BIGINT AS out_w, out_h::BIGINT AS out_h,
  CASE WHEN keep THEN 'keep' WHEN out_w<>cw OR out_h<>ch THEN 'downsample' ELSE 'crop' END AS action, (NOT keep AND (out_w<>cw OR out_h<>ch)) AS needs_resize FROM p7"""


def q_texture_snap(spark, sf):
    df = geometry.snap_texture(buckets.texture_crops(crops(spark, sf)), ("x", "y", "w", "h"), ("width", "height"), TARGET, 2.0)
    return df.where("snap is not null").select("op", "crop_id", "image_id", *_flat(df, "snap"))


TEXTURE = f"""{CROPS},{family_sql()},
tex AS (SELECT *, row_number() OVER () AS rid FROM crops WHERE kind='texture'),
feas AS (SELECT t.*, f.bw, f.bh, f.ord, f.bw*f.bh AS area, max(f.bw*f.bh) OVER (PARTITION BY rid) AS top
  FROM tex t JOIN fam f ON greatest(f.bw/f.bh,f.bh/f.bw)<=2.0+1e-9 AND f.bw<=t.w AND f.bh<=t.h AND f.bw<=t.width AND f.bh<=t.height AND t.w>0 AND t.h>0),
pick AS (SELECT rid, any_value(op) AS op, any_value(crop_id) AS crop_id, any_value(image_id) AS image_id, any_value(x) AS x, any_value(y) AS y, any_value(w) AS w, any_value(h) AS h,
  any_value(width) AS width, any_value(height) AS height, arg_min(bw,(abs(bw/bh-w/h),ord)) AS bw, arg_min(bh,(abs(bw/bh-w/h),ord)) AS bh FROM feas WHERE area>=top*0.98 GROUP BY rid)"""
S_TEXTURE = f"""WITH {TEXTURE} SELECT op, crop_id, image_id,
 greatest(0,least(round_even(x+w/2-bw/2,0)::BIGINT, width-bw)) AS x, greatest(0,least(round_even(y+h/2-bh/2,0)::BIGINT, height-bh)) AS y, bw AS w, bh AS h FROM pick"""

RESIZE = ExportOptions(min_bucket_size=MIN_SIZE)
ARB_CROP = ExportOptions(min_bucket_size=MIN_SIZE, strategy="arb_crop", arb=ARB)


def q_output_sizes(spark, sf):
    plan = export.plan_full_crops(crops(spark, sf), ARB_CROP).where("status = 'ok'")
    return plan.groupBy("out_w", "out_h", "action").agg(F.count(F.lit(1)).alias("n"))


S_OUTPUT_SIZES = f"""WITH {MERGED},{ADJUST},{arb_sql([512, 768, 1024])},
src AS (SELECT row_number() OVER () AS image_id, iw AS width, ih AS height FROM adj WHERE iw>0 AND ih>0),
sizes AS (SELECT width, height, count(*) AS n FROM src GROUP BY 1,2),
scored AS (SELECT i.*, a.bw, a.bh, a.ord, (a.bw<=i.width AND a.bh<=i.height) AS fits,
  abs(i.width/i.height - a.bw/a.bh) AS d, abs(ln(greatest(greatest(a.bw/i.width, a.bh/i.height),1e-8))) AS s, abs(a.bw*a.bh-i.width*i.height)/(i.width*i.height) AS r
  FROM sizes i, arb a),
pool AS (SELECT *, max(fits::INT) OVER (PARTITION BY width,height) AS anyfit FROM scored),
chosen AS (SELECT width, height, any_value(n) AS n, arg_min(bw,(d,s,r,ord)) AS bw, arg_min(bh,(d,s,r,ord)) AS bh FROM pool WHERE fits OR anyfit=0 GROUP BY 1,2),
{ARB_PLAN}
SELECT out_w::BIGINT AS out_w, out_h::BIGINT AS out_h, CASE WHEN keep THEN 'keep' WHEN out_w<>cw OR out_h<>ch THEN 'downsample' ELSE 'crop' END AS action, sum(n)::BIGINT AS n FROM p7 GROUP BY 1,2,3"""


def q_run_totals(spark, sf):
    c = crops(spark, sf)
    return export.run_totals(export.plan_full_crops(c, RESIZE), export.plan_texture_crops(c, RESIZE))


S_RUN_TOTALS = f"""WITH {MERGED},{ADJUST},
tex AS (SELECT *, row_number() OVER () AS rid FROM crops WHERE kind='texture'),
feas AS (SELECT DISTINCT rid FROM tex t JOIN fam f ON greatest(f.bw/f.bh,f.bh/f.bw)<=2.0+1e-9 AND f.bw<=t.w AND f.bh<=t.h AND f.bw<=t.width AND f.bh<=t.height AND t.w>0 AND t.h>0)
SELECT (SELECT count(*) FROM adj WHERE iw>0 AND ih>0) AS processed, (SELECT count(*) FROM merged WHERE NOT viable) AS merged,
 (SELECT count(*) FROM merged WHERE w<=0 OR h<=0) AS degenerate_skipped, (SELECT count(*) FROM viable) AS bucket_count,
 (SELECT count(*) FROM feas) AS texture_processed, (SELECT count(*) FROM tex)-(SELECT count(*) FROM feas) AS texture_skipped"""


def q_action_counts(spark, sf):
    plan = export.plan_whole_images(images(spark, sf), ARB_CROP)
    return buckets.action_counts(plan)


S_ACTIONS = f"""WITH {IMG_BUCKET}, whole AS (SELECT image_id, {_W} AS width, {_H} AS height FROM ib),
{arb_sql([512, 768, 1024])},
scored AS (SELECT i.image_id, i.width, i.height, a.bw, a.bh, a.ord, (a.bw<=i.width AND a.bh<=i.height) AS fits,
  abs(i.width/i.height - a.bw/a.bh) AS d, abs(ln(greatest(greatest(a.bw/i.width, a.bh/i.height),1e-8))) AS s, abs(a.bw*a.bh-i.width*i.height)/(i.width*i.height) AS r FROM whole i, arb a),
pool AS (SELECT *, max(fits::INT) OVER (PARTITION BY image_id) AS anyfit FROM scored),
chosen AS (SELECT image_id, any_value(width) AS width, any_value(height) AS height, arg_min(bw,(d,s,r,ord)) AS bw, arg_min(bh,(d,s,r,ord)) AS bh FROM pool WHERE fits OR anyfit=0 GROUP BY image_id),
{ARB_PLAN}
SELECT CASE WHEN keep THEN 'keep' WHEN out_w<>cw OR out_h<>ch THEN 'downsample' ELSE 'crop' END AS action, count(*) AS n FROM p7 GROUP BY 1"""


def q_export_numbers(spark, sf):
    """File numbers in plan order: first-seen bucket, then queue order."""
    c = crops(spark, sf).withColumn("queue_pos", (F.col("op") * 10 + F.col("crop_id")) * 100_000_000 + F.col("image_id"))
    plan = export.plan_full_crops(c, RESIZE, order="queue_pos")
    narrow = cut_lineage(plan.select("op", "crop_id", "image_id", "first_seen", "target_w", "target_h", "status"))
    rows = narrow.where("status = 'ok'").drop("status")
    named = naming.number_files(rows, [F.col("first_seen"), F.col("op"), F.col("crop_id"), F.col("image_id")], total=narrow.count())
    return named.select("op", "crop_id", "image_id", "target_w", "target_h", "ordinal", "file_name")


S_NUMBERS = f"""WITH {MERGED},{ADJUST},
fs AS (SELECT bw, bh, min((op,crop_id,image_id)) AS first_seen FROM assigned GROUP BY 1,2),
n AS (SELECT a.op, a.crop_id, a.image_id, a.target_w, a.target_h, row_number() OVER (ORDER BY f.first_seen, a.op, a.crop_id, a.image_id) - 1 AS ordinal, (SELECT count(*) FROM adj) AS total
 FROM adj a JOIN fs f ON a.bw=f.bw AND a.bh=f.bh WHERE a.iw>0 AND a.ih>0)
SELECT op, crop_id, image_id, target_w::BIGINT AS target_w, target_h::BIGINT AS target_h, ordinal, lpad(ordinal::VARCHAR, greatest(4,length(total::VARCHAR))::INT, '0') || '.png' AS file_name FROM n"""


def q_template_names(spark, sf):
    plan = export.plan_whole_images(images(spark, sf), RESIZE)
    base = F.concat(F.lit("img"), (F.col("image_id") % 50).cast("string"))
    named = plan.withColumn(
        "name", naming.template_names(plan, "{basename}_{w}x{h}.png", {"basename": base, "w": F.col("out_w"), "h": F.col("out_h")})
    )
    # some templates already end in a number, which a resolved name may meet
    wanted = F.when(F.col("image_id") % 17 == 0, F.regexp_replace("name", "[.]png$", "_2.png")).otherwise(F.col("name"))
    return naming.resolve_collisions(named.withColumn("name", wanted), "name", [F.col("image_id")]).select("image_id", "name", "unique_name")


# a stem s and s_2 are wanted: the k-th use of s takes s, s_2 (if no earlier row wanted s_2 itself), s_3, ...; uses of s_2 take s_2 (if still free), s_2_2, ...
S_TEMPLATE = f"""WITH {IMG_BUCKET}, z AS (SELECT image_id, 'img' || (image_id%50) || '_' || bw || 'x' || bh AS root, image_id%17=0 AS two FROM ib),
k AS (SELECT *, row_number() OVER (PARTITION BY root, two ORDER BY image_id) AS k FROM z),
f AS (SELECT root, min(image_id) FILTER (two) AS first_two, min(image_id) FILTER (NOT two AND k=2) AS second_plain FROM k GROUP BY 1),
n AS (SELECT k.*, f.first_two IS NOT NULL AND (f.second_plain IS NULL OR f.first_two < f.second_plain) AS kept_two FROM k JOIN f USING (root))
SELECT image_id, root || CASE WHEN two THEN '_2' ELSE '' END || '.png' AS name,
 CASE WHEN NOT two THEN CASE WHEN k=1 THEN root ELSE root || '_' || (k + CASE WHEN kept_two THEN 1 ELSE 0 END) END
      ELSE CASE WHEN kept_two THEN CASE WHEN k=1 THEN root || '_2' ELSE root || '_2_' || k END ELSE root || '_2_' || (k+1) END END || '.png' AS unique_name FROM n"""


def q_numbered_names(spark, sf):
    """A numbered series, a name wanted by a tenth of the rows, and rows that want its numbers themselves."""
    k = F.col("image_id")
    wanted = F.when(k % 10 == 0, "img.png").when(k % 10 == 1, F.concat(F.lit("img_"), (F.floor(k / 10) + 2).cast("string"), F.lit(".png"))).otherwise(F.format_string("img_%05d.png", k))
    rows = images(spark, sf).select("image_id", wanted.alias("name"))
    return naming.resolve_collisions(rows, "name", [k * 7919 % 10007, k])


# uses of img.png take 1, then each the next number that no earlier row wanted itself; a row whose number was given away becomes its second use
S_NUMBERED = f"""WITH {IMAGES}, z AS (
  SELECT image_id, row_number() OVER (ORDER BY image_id*7919%10007, image_id) AS t, image_id%10 AS d, image_id//10 + 2 AS b,
    CASE image_id%10 WHEN 0 THEN 'img.png' WHEN 1 THEN 'img_' || (image_id//10 + 2) || '.png' ELSE 'img_' || lpad(image_id::VARCHAR, 5, '0') || '.png' END AS name FROM images),
s AS (SELECT list(coalesce(t, 0) ORDER BY n) AS s FROM (SELECT unnest(range(1, (SELECT max(b) + 1 FROM z WHERE d = 1))) AS n) LEFT JOIN (SELECT b, t FROM z WHERE d = 1) ON n = b),
us AS (SELECT list([t] ORDER BY t) AS us FROM z WHERE d = 0),
ks AS (SELECT list_reduce(list_concat([[1::BIGINT]], us[2:]), lambda acc, x: list_append(acc, list_min(list_filter(range(acc[-1] + 1, acc[-1] + len(s) + 2), lambda n: n > len(s) OR s[n] = 0 OR s[n] > x[1])))) AS ks FROM us, s),
u AS (SELECT image_id, row_number() OVER (ORDER BY t) AS i FROM z WHERE d = 0)
SELECT z.image_id, name, CASE WHEN d = 0 THEN CASE WHEN i = 1 THEN name ELSE 'img_' || ks[i] || '.png' END WHEN d = 1 AND list_contains(ks, b) THEN 'img_' || b || '_2.png' ELSE name END AS unique_name
FROM z LEFT JOIN u USING (image_id), ks"""


def q_side_length(spark, sf):
    i = images(spark, sf)
    return i.select(
        "image_id",
        F.round(geometry.megapixels_of_side(F.col("width") / 7), 9).alias("mp"),
        geometry.side_of_megapixels(F.col("width") * F.col("height") / 1048576, F.lit(64)).alias("px"),
        F.round(geometry.aspect_ratio(F.col("width"), F.col("height")), 9).alias("aspect"),
    )


S_SIDE = f"""WITH {IMAGES} SELECT image_id, round(power(greatest(64, floor(width/7+0.5)),2)/1048576,9) AS mp,
 greatest(64, (floor(sqrt(greatest(0.0025,(width*height)/1048576)*1048576)/64+0.5)*64)::BIGINT) AS px, round(width/greatest(1,height),9) AS aspect FROM images"""

QUERIES = {
    "target_clamp": (q_target_clamp, S_TARGET),
    "equal_area_family": (q_equal_area_family, S_FAMILY),
    "arb_family": (q_arb_family, S_ARB_FAMILY),
    "base_resolutions": (q_base_resolutions, S_BASES),
    "nearest_bucket": (q_nearest_bucket, S_NEAREST),
    "crop_buckets": (q_crop_buckets, S_CROP_BUCKETS),
    "bucket_viability": (q_bucket_viability, S_VIABILITY),
    "degenerate_crops": (q_degenerate, S_DEGENERATE),
    "round_boxes": (q_round_boxes, S_ROUND),
    "smart_crop": (q_smart_crop, S_SMART),
    "pixel_crop": (q_pixel_crop, S_PIXEL),
    "box_adjust": (q_box_adjust, S_ADJUST),
    "box_adjust_floor_first": (q_box_adjust_floor_first, S_ADJUST_OLD),
    "arb_bucket": (q_arb_bucket, S_ARB_BUCKET),
    "export_plan": (q_export_plan, S_EXPORT_PLAN),
    "texture_snap": (q_texture_snap, S_TEXTURE),
    "output_sizes": (q_output_sizes, S_OUTPUT_SIZES),
    "run_totals": (q_run_totals, S_RUN_TOTALS),
    "action_counts": (q_action_counts, S_ACTIONS),
    "export_numbers": (q_export_numbers, S_NUMBERS),
    "template_names": (q_template_names, S_TEMPLATE),
    "numbered_names": (q_numbered_names, S_NUMBERED),
    "side_length": (q_side_length, S_SIDE),
}
