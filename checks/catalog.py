"""Queries about working-set state, manifests, summaries and batch balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import ASSIGNED, CROPS, IMAGES, crops, images, table
from lumenloom.functions import geometry
from lumenloom.operators import balance, catalog
from lumenloom.params import Target

TARGET = Target()


def decisions(spark, sf):
    e = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("image_id"), F.col("event_id").alias("op_seq"), "ts", F.when(e == "purchase", "cropped").when(e == "error", "skipped").otherwise("pending").alias("status")
    )


DECISIONS = "decisions AS (SELECT user_id AS image_id, event_id AS op_seq, ts, CASE event_type WHEN 'purchase' THEN 'cropped' WHEN 'error' THEN 'skipped' ELSE 'pending' END AS status FROM events)"
LATEST = DECISIONS + ", latest AS (SELECT image_id, max(op_seq) AS op_seq, arg_max(ts,op_seq) AS ts, arg_max(status,op_seq) AS status FROM decisions GROUP BY 1)"


def q_latest(spark, sf):
    return catalog.latest_decisions(decisions(spark, sf)).select("image_id", "op_seq", "status")


def _state(spark, sf):
    return catalog.with_status(images(spark, sf), catalog.latest_decisions(decisions(spark, sf)))


STATE = f"{IMAGES},{LATEST}, state AS (SELECT i.*, coalesce(l.status,'pending') AS status FROM images i LEFT JOIN latest l USING (image_id))"


def q_pending(spark, sf):
    return catalog.still_pending(_state(spark, sf)).select("image_id", "uri", "status")


def q_progress(spark, sf):
    return catalog.progress(_state(spark, sf), crops(spark, sf))


def q_next_pending(spark, sf):
    s = _state(spark, sf).withColumn("idx", F.col("image_id"))
    return catalog.next_pending(s).select("idx", "status", "next_idx")


S_NEXT = f"WITH {STATE} SELECT image_id AS idx, status, min(CASE WHEN status='pending' THEN image_id END) OVER (ORDER BY image_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_idx FROM state"


def ignored(spark, sf):
    return images(spark, sf).where(F.col("image_id") % 13 == 0).select("uri")


def q_not_ignored(spark, sf):
    return catalog.without_ignored(images(spark, sf), ignored(spark, sf)).select("image_id", "uri")


def q_manifest(spark, sf):
    """Every image is asked for; half are known, one root is allowed, some are gone or archived."""
    i = images(spark, sf)
    k = F.col("image_id")
    asked = i.select("image_id", F.when(k % 17 == 0, F.concat(F.lit("zip://a.zip::"), F.col("uri"))).otherwise(F.col("uri")).alias("uri"))
    m = catalog.removal_manifest(asked, i.where(k % 4 < 2), ["root/3"], i.where(k % 5 != 0))
    return m.select("image_id", "uri", "verdict", "sidecar_uri")


S_MANIFEST = f"""WITH {IMAGES}, m AS (SELECT image_id, CASE WHEN image_id%17=0 THEN 'zip://a.zip::' || uri ELSE uri END AS uri,
 CASE WHEN image_id%17=0 THEN 'ignore' WHEN NOT (image_id%4<2 OR image_id%10=3) THEN 'refuse' WHEN image_id%5<>0 THEN 'delete' ELSE 'ignore' END AS verdict FROM images)
SELECT *, CASE WHEN verdict='delete' THEN replace(uri,'.png','.txt') END AS sidecar_uri FROM m"""


def snapshots(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("snap"), (F.col("o_custkey") % 40).cast("string")).alias("snap_id"),
        F.col("o_orderkey").alias("idx"),
        F.concat(F.lit("root/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("uri"),
        F.lit("source").alias("kind"),
        F.col("o_orderdate").alias("created_at"),
    )


def q_snapshots(spark, sf):
    return catalog.recent_snapshots(snapshots(spark, sf)).select("snap_id", "idx", "uri")


SNAPS = "snaps AS (SELECT 'snap' || (o_custkey%40) AS snap_id, o_orderkey AS idx, 'root/' || o_orderkey || '.png' AS uri, o_orderdate AS created_at FROM orders)"
S_SNAPS = f"WITH {SNAPS} SELECT snap_id, idx, uri FROM snaps WHERE snap_id IN (SELECT snap_id FROM snaps GROUP BY 1 ORDER BY max(created_at) DESC, snap_id DESC LIMIT 12)"


def q_snapshot_lookup(spark, sf):
    wanted = table(spark, sf, "lineitem").select(F.concat(F.lit("snap"), (F.col("l_suppkey") % 40).cast("string")).alias("snap_id"), F.col("l_orderkey").alias("idx")).distinct()
    return catalog.snapshot_lookup(snapshots(spark, sf), wanted).groupBy("snap_id").agg(F.count(F.lit(1)).alias("asked"), F.count("uri").alias("found"))


S_LOOKUP = f"""WITH {SNAPS}, w AS (SELECT DISTINCT 'snap' || (l_suppkey%40) AS snap_id, l_orderkey AS idx FROM lineitem)
SELECT w.snap_id, count(*) AS asked, count(s.uri) AS found FROM w LEFT JOIN snaps s ON s.snap_id=w.snap_id AND s.idx=w.idx GROUP BY 1"""


def queue_events(spark, sf):
    e = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", "ts", F.concat(F.lit("img/"), F.col("user_id").cast("string")).alias("uri"), F.when(e.isin("purchase", "error"), "finish").otherwise("enqueue").alias("op"),
        F.when(e == "error", "failed").when(e == "purchase", "done").when(e == "click", "skipped").otherwise("pending").alias("status"),
        F.when(e == "error", F.concat(F.lit("open: "), F.col("event_id").cast("string"))).alias("error"),
    )


def q_queue(spark, sf):
    return catalog.dedupe_queue(queue_events(spark, sf)).select("event_id", "uri")


QUEUE = """qe AS (SELECT event_id, ts, 'img/' || user_id AS uri, CASE WHEN event_type IN ('purchase','error') THEN 'finish' ELSE 'enqueue' END AS op,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN event_type='error' THEN 'open: ' || event_id END AS error FROM events)"""
S_QUEUE = f"WITH {QUEUE}, s AS (SELECT *, lag(op) OVER (PARTITION BY uri ORDER BY event_id) AS b FROM qe) SELECT event_id, uri FROM s WHERE op='enqueue' AND coalesce(b,'finish')='finish'"


def q_status_counts(spark, sf):
    return catalog.status_counts(queue_events(spark, sf))


def q_recent(spark, sf):
    return catalog.most_recent(queue_events(spark, sf), 50).select("event_id", "uri", "status")


def q_errors(spark, sf):
    return catalog.first_errors(queue_events(spark, sf), "event_id", 20).select("event_id", "uri", "error")


def q_batch_summary(spark, sf):
    return catalog.batch_summary(queue_events(spark, sf).withColumn("skipped", F.col("status") == "skipped"))


def _rows(spark, sf):
    c = crops(spark, sf).where("kind = 'full'")
    return geometry.nearest_bucket(c, "w", "h", TARGET).select(
        "bw", "bh", (F.col("op") % 500).alias("group_id"), F.col("w").alias("crop_w"), F.col("h").alias("crop_h"), "op", "crop_id", "image_id"
    )


def q_surplus(spark, sf):
    s = balance.surplus_rows(_rows(spark, sf), F.struct("op", "crop_id", "image_id"))
    return s.select("bw", "bh", "op", "crop_id", "image_id", F.col("rank").cast("bigint").alias("rank"), "verdict")


S_SURPLUS = f"""WITH {ASSIGNED},
r AS (SELECT *, op%500 AS group_id FROM assigned),
m AS (SELECT *, count(*) OVER (PARTITION BY bw,bh,group_id) > 1 AS twin, count(*) OVER (PARTITION BY bw,bh) AS n FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY bw,bh ORDER BY twin, w*h, op, crop_id, image_id) AS rank FROM m)
SELECT bw::BIGINT AS bw, bh::BIGINT AS bh, op, crop_id, image_id, rank, CASE WHEN twin THEN 'drop' ELSE 'decide' END AS verdict FROM k WHERE rank <= n%8"""


def q_gap(spark, sf):
    rows = _rows(spark, sf)
    counts = rows.groupBy("bw", "bh").agg(F.count(F.lit(1)).alias("n"))
    return balance.gap_bucket(images(spark, sf).select("image_id", F.col("width").alias("w"), F.col("height").alias("h")), counts).select("image_id", "fill_w", "fill_h")


S_GAP = f"""WITH {ASSIGNED}, {IMAGES}, c AS (SELECT bw, bh, count(*) AS n FROM assigned GROUP BY 1,2), o AS (SELECT * FROM c WHERE (n+1)%8=0)
SELECT i.image_id, (SELECT arg_min(o.bw,(abs(o.bw/o.bh-i.width/i.height),o.bw,o.bh)) FROM o)::BIGINT AS fill_w, (SELECT arg_min(o.bh,(abs(o.bw/o.bh-i.width/i.height),o.bw,o.bh)) FROM o)::BIGINT AS fill_h FROM images i"""


def q_preferences(spark, sf):
    c = crops(spark, sf).withColumn("session", F.col("op") % 30)
    return balance.crop_preferences(c, "session").select("session", F.round("avg_padding", 6).alias("avg_padding"), F.round("avg_ar", 6).alias("avg_ar"), "n")


PREFS = f"""{CROPS}, prefs AS (SELECT op%30 AS session, avg(greatest(0.0::DOUBLE,((width-w)/2+(height-h)/2)/2/((width+height)/2))) AS avg_padding, avg(w/h) AS avg_ar, count(*) AS n FROM crops GROUP BY 1)"""


def q_blended(spark, sf):
    c = crops(spark, sf).withColumn("session", F.col("op") % 30)
    return balance.blended_padding(balance.crop_preferences(c, "session"), "session").select(F.round("padding_ratio", 6).alias("padding_ratio"), "sessions")


def q_learned(spark, sf):
    """Nearest learned resolution of every image, counted."""
    i = images(spark, sf)
    learned = balance.nearest_learned(i, "width", "height", balance.learn_resolutions(i))
    return learned.groupBy("bw", "bh").agg(F.count(F.lit(1)).alias("n"))


def _learned_sql(k: int = 8, steps: int = 20, area: int = 1048576, step: int = 64) -> str:
    """The cluster steps written out one after another."""
    parts = [
        "hist AS (SELECT round(width/height, 4) AS ar, count(*) AS n FROM images GROUP BY 1)",
        f"ends AS (SELECT min(ar) AS lo, max(ar) AS hi, least({k}, count(*)) AS k FROM hist)",
        "c0 AS MATERIALIZED (SELECT i, lo * power(hi/lo, (i+0.5::DOUBLE)/k) AS c FROM ends, LATERAL (SELECT unnest(range(0, k)) AS i))",
    ]
    for j in range(steps):
        parts.append(
            f"""c{j + 1} AS MATERIALIZED (SELECT c.i, coalesce(m.c, c.c) AS c FROM c{j} c LEFT JOIN (SELECT i, sum(ar*n)/sum(n) AS c FROM (
  SELECT h.ar, h.n, arg_min(x.i, (abs(h.ar-x.c), x.i)) AS i FROM hist h, c{j} x GROUP BY h.ar, h.n) GROUP BY i) m USING (i))"""
        )
    side = f"sqrt({area}::DOUBLE/c)"
    parts.append(f"sizes AS (SELECT DISTINCT (round_even({side}*c/{step}, 0)*{step})::BIGINT AS bw, (round_even({side}/{step}, 0)*{step})::BIGINT AS bh FROM c{steps})")
    return f"""WITH {IMAGES}, {", ".join(parts)},
best AS (SELECT image_id, arg_min(bw, (abs(width/height-bw/bh), bw/bh)) AS bw, arg_min(bh, (abs(width/height-bw/bh), bw/bh)) AS bh FROM images, sizes GROUP BY 1)
SELECT bw, bh, count(*) AS n FROM best GROUP BY 1,2"""


def q_corners(spark, sf):
    c = crops(spark, sf)
    return c.select("op", "crop_id", "image_id", "kind", geometry.corner_box("x", "y", "w", "h").alias("b")).select("op", "crop_id", "image_id", "kind", "b.*")


QUERIES = {
    "latest_decisions": (q_latest, f"WITH {LATEST} SELECT image_id, op_seq, status FROM latest"),
    "pending_images": (q_pending, f"WITH {STATE} SELECT image_id, uri, status FROM state WHERE status NOT IN ('cropped','skipped')"),
    "session_progress": (q_progress, f"WITH {STATE} SELECT count(*) AS total, count(*) FILTER (status IN ('cropped','skipped')) AS processed, count(*) FILTER (status='pending') AS pending, (SELECT count(*) FROM lineitem) AS queue_len FROM state"),
    "next_pending": (q_next_pending, S_NEXT),
    "not_ignored": (q_not_ignored, f"WITH {IMAGES} SELECT image_id, uri FROM images WHERE image_id%13<>0"),
    "removal_manifest": (q_manifest, S_MANIFEST),
    "recent_snapshots": (q_snapshots, S_SNAPS),
    "snapshot_lookup": (q_snapshot_lookup, S_LOOKUP),
    "queue_dedupe": (q_queue, S_QUEUE),
    "queue_counts": (q_status_counts, f"WITH {QUEUE} SELECT status, count(*) AS n FROM qe GROUP BY 1"),
    "recent_events": (q_recent, f"WITH {QUEUE} SELECT event_id, uri, status FROM qe ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "first_errors": (q_errors, f"WITH {QUEUE} SELECT event_id, uri, error FROM qe WHERE error IS NOT NULL ORDER BY event_id LIMIT 20"),
    "batch_summary": (q_batch_summary, f"WITH {QUEUE} SELECT count(*) AS total_count, count(*) FILTER (error IS NULL) AS success_count, count(error) AS error_count, count(*) FILTER (status='skipped') AS skipped_count FROM qe"),
    "batch_surplus": (q_surplus, S_SURPLUS),
    "gap_bucket": (q_gap, S_GAP),
    "crop_preferences": (q_preferences, f"WITH {PREFS} SELECT session, round(avg_padding,6) AS avg_padding, round(avg_ar,6) AS avg_ar, n FROM prefs"),
    "blended_padding": (q_blended, f"WITH {PREFS} SELECT round((0.1::DOUBLE+avg(avg_padding))/2,6) AS padding_ratio, count(*) AS sessions FROM (SELECT * FROM prefs ORDER BY session DESC LIMIT 10)"),
    "learned_resolutions": (q_learned, _learned_sql()),
    "corner_boxes": (q_corners, f"WITH {CROPS} SELECT op, crop_id, image_id, kind, x AS x1, y AS y1, x+w AS x2, y+h AS y2 FROM crops"),
}
