"""State of a working set: ignored files, decisions, snapshots, removal manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.tags import stem
from lumenloom.operators.ordered import latest, upcoming_min
from lumenloom.params import SNAPSHOTS_KEPT

DONE = ("cropped", "skipped")


def without_ignored(images: DataFrame, ignored: DataFrame) -> DataFrame:
    return images.join(ignored.select("uri").distinct(), "uri", "left_anti")


def restore_ignored(ignored: DataFrame, restored: DataFrame) -> DataFrame:
    return ignored.join(restored.select("uri").distinct(), "uri", "left_anti")


def latest_decisions(decisions: DataFrame, *extra: str) -> DataFrame:
    """Current state per image: the last operation wins, whole."""
    return latest(decisions, ["image_id"], "op_seq", ["ts", "status", *extra])


def with_status(images: DataFrame, state: DataFrame, *extra: str) -> DataFrame:
    """Every image with its status, ``pending`` where nothing was decided."""
    joined = images.join(state.select("image_id", "status", *extra), "image_id", "left")
    return joined.withColumn("status", F.coalesce(F.col("status"), F.lit("pending")))


def still_pending(with_state: DataFrame, include_processed: bool = False) -> DataFrame:
    return with_state if include_processed else with_state.where(~F.col("status").isin(*DONE))


def progress(with_state: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """Totals of a session; a queue adds its length."""
    done = F.col("status").isin(*DONE)
    totals = with_state.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("processed"), F.count_if(~done).alias("pending"))
    if queued is None:
        return totals
    return totals.withColumn("queue_len", queued.agg(F.count(F.lit(1)).alias("n")).scalar())


def next_pending(with_state: DataFrame, idx: str = "idx") -> DataFrame:
    """For every position the next pending position after it (NULL at the end).

    A running minimum from the end: inside each range of positions by a window,
    across ranges by one carried value per range.
    """
    flagged = with_state.withColumn("_p", F.when(F.col("status") == "pending", F.col(idx)))
    return upcoming_min(flagged, idx, "_p", "next_idx").drop("_p")


def next_pending_after(with_state: DataFrame, cursor: int, idx: str = "idx") -> DataFrame:
    hit = F.when((F.col(idx) > cursor) & (F.col("status") == "pending"), F.col(idx))
    return with_state.agg(F.coalesce(F.min(hit), F.count(F.lit(1))).alias("next_idx"))


def under_root(uri: Column, root: Column) -> Column:
    """Component-wise prefix test."""
    base = F.regexp_replace(root, "/+$", "")
    return (uri == base) | uri.startswith(F.concat(base, F.lit("/")))


def recent_snapshots(snapshots: DataFrame, keep: int = SNAPSHOTS_KEPT) -> DataFrame:
    """Entries of the most recent snapshots (snap_id, idx, uri, kind, created_at).

    Recency is decided on one row per snapshot.
    """
    ids = snapshots.groupBy("snap_id").agg(F.max("created_at").alias("_at"))
    kept = ids.orderBy(F.col("_at").desc(), F.col("snap_id").desc()).limit(keep).select("snap_id")
    return snapshots.join(F.broadcast(kept), "snap_id", "left_semi")  # at most `keep` rows


def snapshot_lookup(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """URI of each wanted (snap_id, idx); unknown ones come back NULL."""
    return wanted.join(snapshots.select("snap_id", "idx", "uri"), ["snap_id", "idx"], "left")


def removal_manifest(
    requested: DataFrame,
    known: DataFrame,
    roots: list[str] | None = None,
    existing: DataFrame | None = None,
    from_snapshot: bool = False,
) -> DataFrame:
    """Verdict per requested URI: ``delete``, ``ignore`` or ``refuse``.

    Archive entries can only be ignored. Other files must be known: with a
    snapshot by membership alone, otherwise by list or by lying under a root.
    Files that are gone are ignored. Deleting itself is left to the caller, with
    the caption beside the image named in ``sidecar_uri``.
    """
    allowed = requested.join(known.select("uri").distinct().withColumn("_known", F.lit(True)), "uri", "left")
    ok = F.coalesce(F.col("_known"), F.lit(False))
    if not from_snapshot:
        for r in roots or []:
            ok = ok | under_root(F.col("uri"), F.lit(r))
    if existing is None:
        checked = allowed.withColumn("_there", F.lit(True))
    else:
        checked = allowed.join(existing.select("uri").distinct().withColumn("_there", F.lit(True)), "uri", "left")
    zipped = F.col("uri").startswith("zip://")
    verdict = F.when(zipped, "ignore").when(~ok, "refuse").when(F.coalesce(F.col("_there"), F.lit(False)), "delete").otherwise("ignore")
    return checked.withColumn("verdict", verdict).withColumn(
        "sidecar_uri", F.when(F.col("verdict") == "delete", F.concat(stem(F.col("uri")), F.lit(".txt")))
    ).drop("_known", "_there")


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def most_recent(events: DataFrame, n: int = 50, order: str = "ts", tie: str = "event_id") -> DataFrame:
    return events.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(n)


def first_errors(results: DataFrame, order: str, n: int = 20) -> DataFrame:
    return results.where(F.col("error").isNotNull()).orderBy(order).limit(n)


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals of a captioning run (error, skipped)."""
    return results.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("error").isNull()).alias("success_count"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"),
        F.count_if(F.coalesce(F.col("skipped"), F.lit(False))).alias("skipped_count"),
    )


def dedupe_queue(events: DataFrame, key: str = "uri", order: str = "event_id") -> DataFrame:
    """A path is queued once while it waits; a finished path may be queued again.

    ``events`` holds ``enqueue`` and ``finish`` operations in ``order``. An
    enqueue counts when the last operation on its path before it was not an
    enqueue, which a previous-row lookup decides.
    """
    from lumenloom.operators.ordered import neighbour

    seen = neighbour(events, [key], order, {"op": "_before"})
    return seen.where((F.col("op") == "enqueue") & (F.coalesce(F.col("_before"), F.lit("finish")) == "finish")).drop("_before")


