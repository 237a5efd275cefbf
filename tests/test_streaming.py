"""The caption stream: backfill, restart, replay, skips and failures."""

from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lumenloom.params import CaptionOptions
from lumenloom.plans.pixels import onnx_scorer
from lumenloom.sources import scan, sinks
from lumenloom.streaming import captioning as S
from tests.helpers import pooling_model, spotted, write_png


@pytest.fixture()
def setup(spark, tmp_path):
    inbox = tmp_path / "in"
    for i in range(5):
        write_png(inbox / f"i{i}.png", spotted(40 + i, 40))
    tags = spark.createDataFrame([(0, "red", "general"), (1, "green", "general"), (2, "blue", "general")], "tag_idx int, name string, category string")
    out = S.CaptionStream(str(tmp_path / "captions"), str(tmp_path / "events"), str(tmp_path / "ckpt"), batch_files=2)
    return inbox, tags, out


def backfill(spark, inbox, tags, out, **more):
    q = S.start_captioning(
        S.image_stream(spark, str(inbox), out.batch_files), onnx_scorer(pooling_model(), "letterbox", 32), tags, CaptionOptions(threshold=0.01), out, backfill=True, **more
    )
    q.awaitTermination()


def test_backfill_restart_and_replay(spark, setup, tmp_path):
    inbox, tags, out = setup
    seen = []
    backfill(spark, inbox, tags, out, listener=lambda df, b: seen.append((b, df.count())))
    first = spark.read.parquet(out.captions)
    assert first.count() == 5 and first.select("uri_stem").distinct().count() == 5
    assert len(seen) == 3 and sum(n for _, n in seen) == 5
    write_png(inbox / "late one.png", spotted(50, 50))
    (inbox / "bad.png").write_bytes(b"no")
    backfill(spark, inbox, tags, out)
    spark.catalog.refreshByPath(out.captions)
    after = spark.read.parquet(out.captions)
    assert after.count() == 6 and after.select("uri_stem").distinct().count() == 6
    status = {r["status"]: r["n"] for r in spark.read.parquet(out.events).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert status == {"done": 6, "failed": 1}
    # a second stream without memory of the first finds every caption written already
    again = S.CaptionStream(out.captions, str(tmp_path / "events2"), str(tmp_path / "ckpt2"), batch_files=100)
    known = spark.createDataFrame(after.select("uri_stem", "caption").collect())
    backfill(spark, inbox, tags, again, known=known)
    status = {r["status"]: r["n"] for r in spark.read.parquet(again.events).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert status == {"skipped": 6, "failed": 1}


def test_replayed_batch_changes_nothing(spark, setup):
    inbox, tags, out = setup
    batch = scan.read_pixels(spark, str(inbox))
    args = (onnx_scorer(pooling_model(), "letterbox", 32), tags, CaptionOptions(threshold=0.01), out)
    S.caption_batch(batch, 0, *args)
    S.caption_batch(batch, 0, *args)
    assert spark.read.parquet(out.captions).count() == 5
    assert spark.read.parquet(out.events).where("status = 'done'").count() == 5
    rows = spark.read.parquet(out.captions)
    sinks.write_caption_files(rows)
    assert (inbox / "i0.txt").read_text() == rows.where(F.col("uri_stem") == str(inbox / "i0")).first()["caption"]


def test_recent_events_keep_the_newest(spark, tmp_path):
    path = str(tmp_path / "recent")
    for b in range(3):
        df = spark.range(b * 40, b * 40 + 40).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"))
        S.keep_recent(df, b, path)
    S.keep_recent(df, 2, path)
    assert sorted(r["event_id"] for r in S.recent(spark, path).collect()) == list(range(70, 120))


def test_lookup_opens_only_the_slots_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "captions")
    stems = F.concat(F.lit("img/"), F.col("id").cast("string"))
    for b in range(3):
        rows = spark.range(b * 400, b * 400 + 400).select(stems.alias("uri_stem"), F.when(F.col("id") % 100 == 7, "").otherwise(F.concat(F.lit("c"), "id")).alias("caption"), F.lit(1).alias("n_tags"))
        S.record_captions(rows, path, b)
    S.record_captions(rows, path, 2)  # replayed
    table = spark.read.parquet(path)
    assert table.count() == 1200 and table.select("uri_stem").distinct().count() == 1200
    batch = spark.createDataFrame([(s,) for s in ("img/3", "img/900", "img/900", "img/107", "img/new")], "uri_stem string")
    found = S.recorded_captions(batch, path, 3)
    assert {tuple(r) for r in found.collect()} == {("img/3", "c3"), ("img/900", "c900"), ("img/107", "")}
    assert len(found.inputFiles()) <= 4 * 3 < len(table.inputFiles()) / 20
    assert {r["uri_stem"]: r["captioned"] for r in S.with_captioned(batch, path, 2).collect()} == {"img/3": True, "img/900": False, "img/107": False, "img/new": False}
    assert S.recorded_captions(batch, path, 0).count() == 0
    assert S.recorded_captions(batch, str(tmp_path / "none"), 3) is None
    assert S.recorded_captions(batch.limit(0), path, 3) is None
    many = spark.range(5000).select(stems.alias("uri_stem"))
    assert S.recorded_captions(many, path, 3).count() == 1200  # more stems than are looked up by value


def test_a_broken_table_is_not_taken_for_none(spark, tmp_path):
    path = tmp_path / "captions"
    batch = spark.createDataFrame([("img/1",)], "uri_stem string")
    slot = batch.select(S.slot_of(F.col("uri_stem")).alias("s")).first()["s"]
    (path / f"slot={slot}" / "batch_id=0").mkdir(parents=True)
    (path / f"slot={slot}" / "batch_id=0" / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):
        S.with_captioned(batch, str(path), 1).collect()


def test_restarts_are_counted_and_end(spark, tmp_path):
    inbox = tmp_path / "in"
    spark.range(10).write.parquet(str(inbox))
    falls = []

    def start(most):
        def step(batch, batch_id):
            if len(falls) < most:
                falls.append(batch_id)
                raise RuntimeError("stopped on purpose")
            batch.write.mode("overwrite").parquet(str(tmp_path / f"out{batch_id}"))

        rows = spark.readStream.schema("id bigint").parquet(str(inbox))
        return lambda: rows.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()

    with pytest.raises(StreamingQueryException):
        S.run_to_end(start(2), attempts=2)
    assert S.run_to_end(start(3), attempts=2) == 1
    assert falls == [0, 0, 0] and spark.read.parquet(str(tmp_path / "out0")).count() == 10


def test_requests_are_dealt_to_bounded_groups(spark):
    """Many paths share a group and its state; one call per path is not made."""
    rows = spark.readStream.format("rate").load().selectExpr("value AS event_id", "timestamp AS ts", "CAST(value AS string) AS uri", "'pending' AS status")
    plan = S.accepted_requests(rows)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "slot" in plan
