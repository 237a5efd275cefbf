"""Captions kept up to date as images arrive.

The file source remembers what it has seen in the checkpoint, so a killed run
resumes where it stopped. Every micro-batch writes its own partitions of the
caption table and replaces them when the batch is replayed, which makes the sink
idempotent.

The caption table is laid out by a hash of the stem (``slot``) and the batch.
What is captioned already is looked up in the slots of a batch's stems alone,
by value, so that row groups without them are passed over: a batch reads about
as many rows when the table is large as when it is small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, StreamingQueryException
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from lumenloom.params import CaptionOptions
from lumenloom.plans.captioning import Scorer, caption_images
from lumenloom.functions.tags import stem
from lumenloom.runtime import cut_lineage
from lumenloom.sources.scan import is_image, origin_path

Listener = Callable[[DataFrame, int], None]
IMAGE_SCHEMA = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
EVENT_COLUMNS = ("uri", "status", "reason", "ts")


@dataclass(frozen=True)
class CaptionStream:
    """Where a stream writes: captions, events and its checkpoint, all on shared storage."""

    captions: str
    events: str
    checkpoint: str
    batch_files: int = 8
    overwrite: bool = False


def image_stream(spark: SparkSession, folder: str, batch_files: int = 8) -> DataFrame:
    """New images of a folder, a few per micro-batch: (uri, image)."""
    raw = (
        spark.readStream.format("image")
        .schema(IMAGE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", batch_files)
        .load(folder)
    )
    uri = origin_path(F.col("image.origin"))
    return raw.select(uri.alias("uri"), "image").where(is_image(F.col("uri")))


SLOTS = 256
#: stems of a batch that are looked up by value; a larger batch reads its slots whole
LOOKUP_STEMS = 2000
CAPTION_SCHEMA = "uri_stem string, caption string, n_tags int, slot int, batch_id bigint"


def _existing(read: DataFrameReader, path: str) -> DataFrame | None:
    """A Parquet table, None while nothing was written to the path; any other fault is raised."""
    try:
        return read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _written(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Earlier batches of a table, None when there are none."""
    table = _existing(spark.read, path)
    return None if table is None else table.where(F.col("batch_id") < before)


def slot_of(uri_stem: Column) -> Column:
    return F.pmod(F.xxhash64(uri_stem), F.lit(SLOTS)).cast("int")


def record_captions(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write (uri_stem, caption, n_tags) as the batch's part of the caption table; a replay replaces it."""
    placed = rows.select("uri_stem", "caption", "n_tags", slot_of(F.col("uri_stem")).alias("slot"), F.lit(batch_id).cast("bigint").alias("batch_id"))
    placed.repartition("slot").write.mode("overwrite").options(
        **{"partitionOverwriteMode": "dynamic", "parquet.bloom.filter.enabled#uri_stem": "true"}
    ).partitionBy("slot", "batch_id").parquet(path)


def recorded_captions(batch: DataFrame, path: str, before: int) -> DataFrame | None:
    """(uri_stem, caption) of a batch's stems from earlier batches, None when there are none.

    Only the slots of these stems are listed and opened (at most ``SLOTS``).
    """
    spark = batch.sparkSession
    wanted = batch.select("uri_stem", slot_of(F.col("uri_stem")).alias("slot")).distinct()
    slots = [r["slot"] for r in wanted.select("slot").distinct().collect()]
    if not slots:
        return None
    stems = [r["uri_stem"] for r in wanted.limit(LOOKUP_STEMS + 1).collect()]
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LOOKUP_STEMS))
    folders = f"{path}/slot={{{','.join(map(str, sorted(slots)))}}}"
    table = _existing(spark.read.schema(CAPTION_SCHEMA).option("basePath", path), folders)
    if table is None:
        return None
    if len(stems) <= LOOKUP_STEMS:
        table = table.where(F.col("uri_stem").isin(stems))
    found = table.where(F.col("batch_id") < before).select("uri_stem", "caption")
    return found.join(wanted.select("uri_stem"), "uri_stem", "left_semi") if len(stems) > LOOKUP_STEMS else found


def with_captioned(batch: DataFrame, path: str, before: int) -> DataFrame:
    """Add ``captioned``: does an earlier batch hold a caption that is not empty for the row's ``uri_stem``?"""
    found = recorded_captions(batch, path, before)
    if found is None:
        return batch.withColumn("captioned", F.lit(False))
    known = found.where(F.col("caption") != "").select("uri_stem", F.lit(True).alias("captioned")).distinct()
    return batch.join(known, "uri_stem", "left").withColumn("captioned", F.coalesce("captioned", F.lit(False)))


def caption_batch(
    batch: DataFrame,
    batch_id: int,
    scorer: Scorer,
    tag_dict: DataFrame,
    options: CaptionOptions,
    out: CaptionStream,
    family: str = "camie",
    listener: Listener | None = None,
) -> None:
    """Caption one micro-batch and record what happened to each image."""
    spark = batch.sparkSession
    # a batch has at most `batch_files` rows, so numbering it in one window is bounded
    number = F.row_number().over(Window.orderBy("uri"))
    images = batch.withColumn("image_id", number.cast("bigint")).withColumn("uri_stem", stem(F.col("uri")))
    existing = recorded_captions(images, out.captions, batch_id)
    done = cut_lineage(
        caption_images(images, scorer, tag_dict, options, existing, family, skip_captioned=True, overwrite=out.overwrite)
    )
    fresh = done.where("error is null")
    record_captions(fresh, out.captions, batch_id)
    seen = images.select("uri", "uri_stem").join(done.select("uri_stem", "error", "n_tags", F.lit(True).alias("tried")), "uri_stem", "left")
    status = F.when(F.col("tried").isNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("done")
    reason = (
        F.when(F.col("tried").isNull(), F.lit("caption already exists"))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("n_tags") > 0, F.concat(F.col("n_tags").cast("string"), F.lit(" tags")))
        .otherwise(F.lit("ok"))
    )
    events = seen.select("uri", status.alias("status"), reason.alias("reason"), F.current_timestamp().alias("ts"))
    events.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out.events)
    if listener:
        listener(fresh, batch_id)


def start_captioning(
    stream: DataFrame,
    scorer: Scorer,
    tag_dict: DataFrame,
    options: CaptionOptions,
    out: CaptionStream,
    backfill: bool = False,
    known: DataFrame | None = None,
    **more,
) -> StreamingQuery:
    """Run continuously, or once over everything there is (``backfill``).

    ``known`` holds captions from outside the stream (uri_stem, caption); they
    are taken into the caption table once, ahead of the first batch.
    """
    if known is not None:
        record_captions(known.withColumn("n_tags", F.lit(None).cast("int")), out.captions, -1)

    def step(batch: DataFrame, batch_id: int) -> None:
        caption_batch(batch, batch_id, scorer, tag_dict, options, out, **more)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", out.checkpoint)
    return (writer.trigger(availableNow=True) if backfill else writer).start()


def run_to_end(start: Callable[[], StreamingQuery], attempts: int = 3) -> int:
    """Run a stream to its end, starting it anew from its checkpoint when it dies; returns how often it died.

    A batch that was under way is replayed with the same rows and number, so
    sinks that replace a batch's part hold every row once. The last failure is
    raised when ``attempts`` starts were not enough.
    """
    for died in range(attempts):
        try:
            start().awaitTermination()
            return died
        except StreamingQueryException:
            if died + 1 == attempts:
                raise
    return attempts


def first_requests(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One request per path while it waits: repeats within the delay are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["uri"])


def accepted_requests(events: DataFrame, waiting: str = "pending") -> DataFrame:
    """Requests that enter the queue, from (event_id, ts, uri, status) in the order of their times.

    A path is refused while it waits. Any other status finishes it, after which it
    may be queued again. Paths are dealt out to ``SLOTS`` groups by a hash; the state
    of a group names its waiting paths only.
    """

    def step(key, frames, state):
        queued = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(frames)).sort_values(["uri", "ts", "event_id"])
        uri, asks = rows["uri"].to_numpy(dtype=object), (rows["status"] == waiting).to_numpy(dtype=bool)
        first = np.append(True, uri[1:] != uri[:-1])
        last = np.append(first[1:], True)
        before = np.append(False, asks[:-1])
        before[first] = [u in queued for u in uri[first]]
        queued.difference_update(uri[last])
        queued.update(uri[last & asks])
        if queued:
            state.update((list(queued),))
        elif state.exists:
            state.remove()
        taken = rows[asks & ~before]
        if len(taken):
            yield taken[["event_id", "ts", "uri"]]

    rows = events.select("event_id", "ts", "uri", "status", slot_of(F.col("uri")).alias("slot"))
    return rows.groupBy("slot").applyInPandasWithState(step, "event_id bigint, ts timestamp, uri string", "queued array<string>", "append", GroupStateTimeout.NoTimeout)


def running_counts(events: DataFrame) -> DataFrame:
    """Count per status so far."""
    return events.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count per status and time window; late events within the delay still count.

    In a micro-batch an event is dropped when its window ends at or before the
    latest time of all batches but the one just before it, less the delay: the
    watermark moves between batches, and a batch's late rows are judged by the
    one its predecessor had.
    """
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "status")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def observed_total(query: StreamingQuery, name: str, metric: str) -> int:
    """Sum of a metric that ``observe`` reported over a query's micro-batches (as far back as Spark keeps progress)."""
    seen = (p["observedMetrics"].get(name) for p in query.recentProgress)
    return sum(row[metric] or 0 for row in seen if row)


def keep_recent(batch: DataFrame, batch_id: int, path: str, n: int = 50, tie: str = "event_id") -> None:
    """Merge a batch into the n most recent events; each batch writes its own version.

    Events without an own id are ordered by path within a timestamp.
    """
    versions = _written(batch.sparkSession, path, batch_id)
    if versions is not None:
        last = versions.agg(F.max("batch_id").alias("b")).first()["b"]
        if last is not None:
            batch = versions.where(F.col("batch_id") == last).drop("batch_id").select(*batch.columns).unionByName(batch)
    top = batch.orderBy(F.col("ts").desc(), F.col(tie).desc()).limit(n)
    cut_lineage(top).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def recent(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest version."""
    table = spark.read.parquet(path)
    newest = table.agg(F.max("batch_id").alias("_b"))
    return table.join(F.broadcast(newest), table["batch_id"] == newest["_b"], "left_semi").drop("batch_id")
