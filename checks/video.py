"""Queries about frame series, subjects and suggested crops."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks.fixtures import FRAMES, frames, table
from lumenloom.operators import autocrop as A
from lumenloom.operators import keyframes as K
from lumenloom.params import KeyframeOptions

CUT = 0.0
OPTIONS = KeyframeOptions(scene_threshold=CUT)


def q_sampled(spark, sf):
    return K.sampled_frames(frames(spark, sf), 1.5).select("video_id", "frame_idx", K.timestamp(F.col("frame_idx"), F.col("fps")).alias("ts"))


S_SAMPLED = f"WITH {FRAMES} SELECT video_id, frame_idx, frame_idx/fps AS ts FROM frames WHERE frame_idx % greatest(1, trunc(fps/1.5)::BIGINT) = 0"


def q_correlation(spark, sf):
    return K.frame_correlations(frames(spark, sf)).select("video_id", "frame_idx", F.round("corr", 6).alias("corr"))


CORR = """lagged AS (SELECT *, lag(hist) OVER (PARTITION BY video_id ORDER BY frame_idx) AS prev FROM frames),
mom AS (SELECT *, list_avg(hist) AS mh, list_avg(prev) AS mp FROM lagged),
cor AS (SELECT video_id, frame_idx, fps, total_frames, CASE WHEN prev IS NULL THEN NULL ELSE
  list_sum(list_transform(list_zip(hist,prev), lambda z: (z[1]-mh)*(z[2]-mp))) / sqrt(list_sum(list_transform(hist, lambda x: (x-mh)*(x-mh)))*list_sum(list_transform(prev, lambda x: (x-mp)*(x-mp)))) END AS corr FROM mom)"""
S_CORR = f"WITH {FRAMES},{CORR} SELECT video_id, frame_idx, round(corr,6) AS corr FROM cor"


def q_scenes(spark, sf):
    return K.scene_segments(frames(spark, sf), CUT).select("video_id", "frame_idx", "scene")


S_SCENES = f"WITH {FRAMES},{CORR} SELECT video_id, frame_idx, (sum(CASE WHEN corr<0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx))::BIGINT AS scene FROM cor"


def q_midpoints(spark, sf):
    return K.scene_midpoints(frames(spark, sf), CUT).select("video_id", "frame_idx")


MID = """starts AS (SELECT video_id, frame_idx, total_frames FROM cor WHERE corr<0 UNION SELECT video_id, 0, total_frames FROM cor),
ends AS (SELECT *, coalesce(lead(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx), total_frames-1) AS e FROM starts),
mids AS (SELECT DISTINCT video_id, frame_idx+(e-frame_idx)//2 AS frame_idx FROM ends)"""
S_MID = f"WITH {FRAMES},{CORR},{MID} SELECT video_id, frame_idx FROM mids"


def q_candidates(spark, sf):
    return K.candidates(frames(spark, sf), OPTIONS).select("video_id", "frame_idx", "ts")


S_CAND = f"WITH {FRAMES},{CORR},{MID} SELECT video_id, frame_idx, frame_idx/4.0::DOUBLE AS ts FROM mids"


def q_uniform(spark, sf):
    """Videos by order: one short series per order, sampled evenly."""
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.lit(0.0).alias("fps"), (F.col("o_custkey") % 97 + 1).alias("total_frames"))
    a = K.uniform_frames(v, K.short_video_step(F.col("total_frames"), 0)).withColumn("rule", F.lit("short"))
    b = K.uniform_frames(v, K.fixed_count_step(F.col("total_frames"), 4)).withColumn("rule", F.lit("count"))
    return a.unionByName(b).groupBy("video_id", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_idx").alias("total"))


S_UNIFORM = """WITH v AS (SELECT o_orderkey AS video_id, o_custkey%97+1 AS n FROM orders),
s AS (SELECT video_id, n, 'short' AS rule, greatest(1, n//12) AS step FROM v UNION ALL SELECT video_id, n, 'count', CASE WHEN n<4 THEN 1 ELSE greatest(1, n//20) END FROM v)
SELECT video_id, rule, len(range(0,n,step))::BIGINT AS n, coalesce(list_sum(range(0,n,step)),0)::BIGINT AS total FROM s"""


def q_every_third(spark, sf):
    c = K.scene_midpoints(frames(spark, sf), CUT)
    return K.keyframe_names(K.every_nth(c, 3), F.concat(F.lit("clip"), F.col("video_id").cast("string"))).select("video_id", "frame_idx", "file_name")


S_THIRD = f"""WITH {FRAMES},{CORR},{MID}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn FROM mids),
s AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS j FROM k WHERE (rn-1)%3=0)
SELECT video_id, frame_idx, 'clip' || video_id || '_' || lpad(j::VARCHAR,4,'0') || '.png' AS file_name FROM s"""


def q_diverse(spark, sf):
    c = K.candidates(frames(spark, sf), OPTIONS)
    return K.diverse_frames(c, 4).select("video_id", "frame_idx")


def _diverse_sql(k: int) -> str:
    """k greedy steps: each adds the candidate farthest from those chosen, the earliest on ties."""
    steps = ["c0 AS (SELECT m.video_id, m.frame_idx, v.b FROM mids m JOIN hashed v USING (video_id, frame_idx))", "n0 AS (SELECT video_id, count(*) AS n FROM c0 GROUP BY 1)"]
    steps.append("p1 AS (SELECT video_id, min(frame_idx) AS frame_idx FROM c0 GROUP BY 1)")
    for i in range(2, k + 1):
        steps.append(
            f"""p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT video_id, arg_min(frame_idx, (-gap, frame_idx)) FROM (
  SELECT c.video_id, c.frame_idx, min(bit_count(xor(c.b::BIT, d.b::BIT))) AS gap FROM c0 c JOIN p{i - 1} q ON q.video_id=c.video_id JOIN c0 d ON d.video_id=q.video_id AND d.frame_idx=q.frame_idx
  WHERE (c.video_id, c.frame_idx) NOT IN (SELECT (video_id, frame_idx) FROM p{i - 1}) GROUP BY 1,2) GROUP BY 1)"""
        )
    return f"""WITH {FRAMES},{CORR},{MID},
hashed AS (SELECT video_id, frame_idx, array_to_string(list_transform(hist, lambda x: CASE WHEN x > list_sum(hist)/64 THEN '1' ELSE '0' END),'') AS b FROM frames),
{",".join(steps)}
SELECT video_id, frame_idx FROM p{k} WHERE video_id IN (SELECT video_id FROM n0 WHERE n > {k})
UNION ALL SELECT video_id, frame_idx FROM c0 WHERE video_id IN (SELECT video_id FROM n0 WHERE n <= {k})"""


def subjects(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        k.alias("image_id"),
        (F.row_number().over(w) - 1).cast("bigint").alias("ord"),
        ((k * 37 + n * 211 + p * 3) % 1400).alias("x"),
        ((k * 53 + n * 307 + p * 7) % 1400).alias("y"),
        (160 + (k * 13 + p * 17) % 480).alias("w"),
        (160 + (k * 31 + p * 11) % 480).alias("h"),
    )


SUBJECTS = """subj AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)-1 AS ord,
  (l_orderkey*37+l_linenumber*211+l_partkey*3)%1400 AS x, (l_orderkey*53+l_linenumber*307+l_partkey*7)%1400 AS y,
  160+(l_orderkey*13+l_partkey*17)%480 AS w, 160+(l_orderkey*31+l_partkey*11)%480 AS h FROM lineitem),
big AS (SELECT *, w*h AS area FROM subj WHERE w*h >= 2048*2048*0.03::DOUBLE),
dist AS (SELECT a.image_id, avg(sqrt(power((a.x+a.w/2)-(b.x+b.w/2),2)+power((a.y+a.h/2)-(b.y+b.h/2),2))) AS d FROM big a JOIN big b ON a.image_id=b.image_id AND a.ord<b.ord GROUP BY 1),
agg AS (SELECT image_id, count(*) AS n, sum((y+h/2)*area) AS wy, sum(area)::BIGINT AS ta, min(x) AS mx, min(y) AS my, max(x+w) AS xx, max(y+h) AS xy,
  arg_min(x,(-area,ord)) AS tx, arg_min(y,(-area,ord)) AS ty, arg_min(w,(-area,ord)) AS tw, arg_min(h,(-area,ord)) AS th FROM big GROUP BY 1),
ids AS (SELECT o_orderkey AS image_id FROM orders),
sc0 AS (SELECT i.image_id, a.* EXCLUDE image_id, ta/((xx-mx)*(xy-my)) AS density, coalesce(d,0)/sqrt(ta/n) AS spacing, wy/ta/2048 AS cy FROM ids i LEFT JOIN agg a USING (image_id) LEFT JOIN dist USING (image_id)),
sc AS (SELECT *, CASE WHEN n IS NULL THEN 'empty' WHEN n=1 THEN 'single' WHEN density>0.3 AND spacing<2.8 THEN 'compact_group' ELSE 'scattered' END AS scene,
  CASE WHEN n IS NULL THEN 'center' WHEN cy>0.6 THEN 'bottom' WHEN cy<1-0.6::DOUBLE THEN 'top' ELSE 'center' END AS vf FROM sc0),
fb AS (SELECT *, CASE scene WHEN 'empty' THEN 0 WHEN 'compact_group' THEN mx ELSE tx END AS bx, CASE scene WHEN 'empty' THEN 0 WHEN 'compact_group' THEN my ELSE ty END AS by_,
  CASE scene WHEN 'empty' THEN 2048 WHEN 'compact_group' THEN xx-mx ELSE tw END AS bw, CASE scene WHEN 'empty' THEN 2048 WHEN 'compact_group' THEN xy-my ELSE th END AS bh,
  CASE scene WHEN 'scattered' THEN (tw*th)/ta WHEN 'compact_group' THEN density ELSE 1.0 END AS conf FROM sc)"""


def _scenes(spark, sf):
    imgs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(2048).cast("bigint").alias("width"), F.lit(2048).cast("bigint").alias("height"))
    return A.scenes(imgs, subjects(spark, sf))


def q_scene_types(spark, sf):
    return _scenes(spark, sf).select(
        "image_id", "scene", "vertical_focus", F.round("confidence", 6).alias("confidence"), F.round(F.coalesce("spacing", F.lit(0.0)), 6).alias("spacing"),
        *[F.col(f"focus_box.{c}").alias(c) for c in "xywh"],
    )


S_SCENE = f"WITH {SUBJECTS} SELECT image_id, scene, vf AS vertical_focus, round(conf,6) AS confidence, round(coalesce(spacing,0),6) AS spacing, bx AS x, by_ AS y, bw AS w, bh AS h FROM fb"


def q_auto_crop(spark, sf):
    ratio = F.element_at(F.array(F.lit(1.0), F.lit(0.75), F.lit(1.5)), (F.col("image_id") % 3 + 1).cast("int"))
    df = A.auto_crop(_scenes(spark, sf), ratio)
    return df.select("image_id", *[F.col(f"suggested.{c}").alias(c) for c in "xywh"])


S_AUTO = f"""WITH {SUBJECTS},
p0 AS (SELECT *, [1.0,0.75,1.5][image_id%3+1]::DOUBLE AS t, greatest(40,least(200,trunc(2048*0.10::DOUBLE)::BIGINT)) AS pad FROM fb),
p1 AS (SELECT *, greatest(0,bx-pad) AS fx, greatest(0,by_-pad) AS fy FROM p0),
p2 AS (SELECT *, least(2048-fx,bw+2*pad) AS fw, least(2048-fy,bh+2*pad) AS fh FROM p1),
p3 AS (SELECT *, fw/fh AS far FROM p2),
p4 AS (SELECT *, CASE WHEN far>t THEN trunc(fh*t)::BIGINT ELSE fw END AS w1, CASE WHEN far>t THEN fh ELSE least(trunc(fw/t)::BIGINT, trunc(fh*0.97::DOUBLE)::BIGINT) END AS h1 FROM p3),
p5 AS (SELECT *, CASE WHEN far>t THEN fx+trunc((fw-w1)/2)::BIGINT ELSE fx END AS x1, CASE WHEN far>t THEN fy ELSE fy+trunc((fh-h1)*(CASE vf WHEN 'bottom' THEN 1 ELSE 0 END))::BIGINT END AS y1 FROM p4),
p6 AS (SELECT *, greatest(0,least(x1,2038)) AS rx, greatest(0,least(y1,2038)) AS ry FROM p5)
SELECT image_id, (CASE WHEN abs(far-t)<0.1 THEN fx ELSE rx END)::BIGINT AS x, (CASE WHEN abs(far-t)<0.1 THEN fy ELSE ry END)::BIGINT AS y,
 (CASE WHEN abs(far-t)<0.1 THEN fw ELSE greatest(10,least(w1,2048-rx)) END)::BIGINT AS w, (CASE WHEN abs(far-t)<0.1 THEN fh ELSE greatest(10,least(h1,2048-ry)) END)::BIGINT AS h FROM p6"""

QUERIES = {
    "sampled_frames": (q_sampled, S_SAMPLED),
    "frame_correlation": (q_correlation, S_CORR),
    "scene_segments": (q_scenes, S_SCENES),
    "scene_midpoints": (q_midpoints, S_MID),
    "keyframe_candidates": (q_candidates, S_CAND),
    "uniform_frames": (q_uniform, S_UNIFORM),
    "every_third_keyframe": (q_every_third, S_THIRD),
    "diverse_keyframes": (q_diverse, _diverse_sql(4)),
    "scene_types": (q_scene_types, S_SCENE),
    "auto_crop": (q_auto_crop, S_AUTO),
}
