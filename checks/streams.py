"""The event table replayed as a stream."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from checks.catalog import QUEUE
from checks.fixtures import table
from lumenloom.runtime import ensure_checkpoint_dir
from lumenloom.streaming import captioning as S


def _scratch(spark, name):
    """A fresh folder beside the session's checkpoints, which all executors share."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _events(spark, sf, batches=6):
    """All events, replayed in the order of their times as ``batches`` micro-batches."""
    events = table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = events.select(at.cast("double").alias("t")).approxQuantile("t", [i / batches for i in range(1, batches)], 0.01)
    place = F.coalesce(sum(F.when(at >= e, 1).otherwise(0) for e in edges), F.lit(0))
    folder = _scratch(spark, "replay")
    for i in range(batches):
        events.where(place == i).coalesce(1).write.mode("append").parquet(folder)
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    e = F.col("event_type")
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("img/"), F.col("user_id").cast("string")).alias("uri"),
        F.when(e == "error", "failed").when(e == "purchase", "done").when(e == "click", "skipped").otherwise("pending").alias("status"),
    )


BATCHES = 6
_LATE = "CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END"


def _requests(events, place):
    """Queue events with the number of the micro-batch in which they arrive."""
    e = F.col("event_type")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("img/"), F.col("user_id").cast("string")).alias("uri"),
        F.when(e == "error", "failed").when(e == "purchase", "done").when(e == "click", "skipped").otherwise("pending").alias("status"),
        place.alias("arrives"),
    )


def _numbered(spark, sf, late=False):
    """Events dealt to ``BATCHES`` arrivals by their ids; ``late`` holds some of them back by one or two."""
    events = table(spark, sf, "events")
    top = events.agg(F.max("event_id").alias("m")).first()["m"]
    place = F.floor(F.col("event_id") * BATCHES / F.lit((top or 0) + 1)).cast("int")
    return _requests(events, place + F.expr(_LATE) if late else place)


def _arrive(rows, folder, batches):
    """Write the arrivals as one file each, in order."""
    for i in batches:
        rows.where(F.col("arrives") == i).coalesce(1).write.mode("append").parquet(folder)


def _stream(rows, folder):
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(df, spark, mode):
    """Drain a stream into a table written batch by batch and return the last state."""
    out, ckpt = _scratch(spark, "out"), _scratch(spark, "ckpt")

    def put(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def q_running(spark, sf):
    return _run(S.running_counts(_events(spark, sf)), spark, "update").groupBy("status").agg(F.max_by("n", "batch_id").alias("n"))


def q_windowed(spark, sf):
    w = _run(S.windowed_counts(_events(spark, sf), "1 hour"), spark, "update")
    return w.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "status").agg(F.max_by("n", "batch_id").alias("n"))


def q_recent(spark, sf):
    path, ckpt = _scratch(spark, "recent"), _scratch(spark, "ckpt")

    def put(batch, batch_id):
        S.keep_recent(batch, batch_id, path)

    _events(spark, sf).writeStream.foreachBatch(put).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    return S.recent(spark, path).select("event_id", "uri", "status")


def q_first_requests(spark, sf):
    """Every path once: the delay covers the whole replay."""
    return _run(S.first_requests(_events(spark, sf).select("uri", "ts"), "4000 days"), spark, "append").select("uri")


def q_accepted(spark, sf):
    """Requests taken while their path is not waiting; a finished path may come back."""
    return _run(S.accepted_requests(_events(spark, sf)), spark, "append").select("event_id", "uri")


def q_skip(spark, sf):
    """Each request, and whether an earlier micro-batch had captioned its path."""
    rows, folder, out, ledger = _numbered(spark, sf), _scratch(spark, "replay"), _scratch(spark, "out"), _scratch(spark, "captions")
    _arrive(rows, folder, range(BATCHES))

    def step(batch, batch_id):
        keyed = batch.withColumn("uri_stem", F.col("uri"))
        S.with_captioned(keyed.where("status = 'pending'"), ledger, batch_id).select("event_id", "uri", F.col("captioned").alias("skipped")).write.mode("append").parquet(out)
        made = keyed.where("status = 'done'").groupBy("uri_stem").agg(F.max("event_id").cast("string").alias("caption"))
        S.record_captions(made.withColumn("n_tags", F.lit(1)), ledger, batch_id)

    _stream(rows, folder).writeStream.foreachBatch(step).option("checkpointLocation", _scratch(spark, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def q_resumed(spark, sf):
    """Captions of requested paths by a stream that dies in its third batch, between its two writes, and is started anew.

    Two arrivals come after the first run has ended and are taken by another.
    """
    rows, folder, ledger, events, ckpt = _numbered(spark, sf), *(_scratch(spark, n) for n in ("replay", "captions", "events", "ckpt"))
    died = _scratch(spark, "died")

    def step(batch, batch_id):
        asked = batch.where("status = 'pending'").groupBy("uri").agg(F.min("event_id").alias("event_id")).withColumn("uri_stem", F.col("uri"))
        seen = S.with_captioned(asked, ledger, batch_id)
        S.record_captions(seen.where("not captioned").select("uri_stem", F.concat(F.lit("caption of "), "uri").alias("caption"), F.lit(1).alias("n_tags")), ledger, batch_id)
        if batch_id == 2 and S._existing(spark.read, died) is None:
            spark.range(1).write.parquet(died)
            raise RuntimeError("stopped on purpose, in the middle of a batch")
        status = F.when(F.col("captioned"), "skipped").otherwise("done")
        done = seen.select("event_id", "uri", status.alias("status"), F.lit(batch_id).alias("batch_id"))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(events)

    def start():
        return _stream(rows, folder).writeStream.foreachBatch(step).option("checkpointLocation", ckpt).trigger(availableNow=True).start()

    _arrive(rows, folder, range(4))
    S.run_to_end(start)
    _arrive(rows, folder, range(4, BATCHES))
    S.run_to_end(start)
    captions = spark.read.parquet(ledger).select(F.col("uri_stem").alias("uri"), "caption")
    return spark.read.parquet(events).select("event_id", "uri", "status").join(captions, "uri", "left")


def _late(spark, sf):
    """Hourly counts, with ten minutes' patience, of events of which some arrive late; and how many rows were read."""
    rows, folder, out = _numbered(spark, sf, late=True), _scratch(spark, "replay"), _scratch(spark, "out")
    _arrive(rows, folder, range(BATCHES + 2))
    counted = S.windowed_counts(_stream(rows, folder).observe("arrived", F.count(F.lit(1)).alias("n")), "1 hour", "10 minutes")

    def put(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = counted.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", _scratch(spark, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(out).groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "status").agg(F.max_by("n", "batch_id").alias("n"))
    return last, S.observed_total(q, "arrived", "n")


def q_late(spark, sf):
    return _late(spark, sf)[0]


def q_dropped(spark, sf):
    counts, arrived = _late(spark, sf)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
    return total.select(F.lit(arrived).cast("bigint").alias("arrived"), "counted", (F.lit(arrived) - F.col("counted")).cast("bigint").alias("dropped"))


_ARRIVAL = f"event_id * {BATCHES} // (SELECT max(event_id) + 1 FROM events)"
_SQL_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'skipped' ELSE 'pending' END"
_SQL_ARRIVED = f"arrived AS (SELECT event_id, ts, 'img/' || user_id AS uri, {_SQL_STATUS} AS status, {_ARRIVAL} AS b FROM events)"
# late rows are judged by the watermark of the batch before: all batches but the last one, less the delay
_SQL_LATE = f"""held AS (SELECT ts, {_SQL_STATUS} AS status, {_ARRIVAL} + {_LATE} AS b FROM events),
  tops AS (SELECT b, max(ts) AS t FROM held GROUP BY b),
  marks AS (SELECT b, (SELECT max(t) FROM tops o WHERE o.b <= x.b - 2) - INTERVAL 10 MINUTE AS mark FROM tops x),
  kept AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, status FROM held JOIN marks USING (b) WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark)"""

QUERIES = {
    "stream_skip_captioned": (q_skip, f"WITH {_SQL_ARRIVED}, made AS (SELECT uri, min(b) AS b FROM arrived WHERE status = 'done' GROUP BY 1) SELECT event_id, uri, coalesce(m.b < a.b, false) AS skipped FROM arrived a LEFT JOIN made m USING (uri) WHERE status = 'pending'"),
    "stream_resumed_captions": (q_resumed, f"WITH {_SQL_ARRIVED}, asked AS (SELECT uri, b, min(event_id) AS event_id FROM arrived WHERE status = 'pending' GROUP BY ALL) SELECT event_id, uri, CASE WHEN b > min(b) OVER (PARTITION BY uri) THEN 'skipped' ELSE 'done' END AS status, 'caption of ' || uri AS caption FROM asked"),
    "stream_late_counts": (q_late, f"WITH {_SQL_LATE} SELECT start, status, count(*) AS n FROM kept GROUP BY ALL"),
    "stream_dropped_rows": (q_dropped, f"WITH {_SQL_LATE}, c AS (SELECT count(*) AS counted FROM kept) SELECT (SELECT count(*) FROM events) AS arrived, counted, (SELECT count(*) FROM events) - counted AS dropped FROM c"),
    "stream_accepted_requests": (q_accepted, f"WITH {QUEUE}, o AS (SELECT *, lag(status) OVER (PARTITION BY uri ORDER BY ts, event_id) AS before FROM qe) SELECT event_id, uri FROM o WHERE status='pending' AND (before IS NULL OR before<>'pending')"),
    "stream_status_counts": (q_running, f"WITH {QUEUE} SELECT status, count(*) AS n FROM qe GROUP BY 1"),
    "stream_windowed_counts": (q_windowed, f"WITH {QUEUE} SELECT date_trunc('hour', ts)::TIMESTAMP AS start, status, count(*) AS n FROM qe GROUP BY 1,2"),
    "stream_recent_events": (q_recent, f"WITH {QUEUE} SELECT event_id, uri, status FROM qe ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "stream_first_requests": (q_first_requests, f"WITH {QUEUE} SELECT DISTINCT uri FROM qe"),
}
