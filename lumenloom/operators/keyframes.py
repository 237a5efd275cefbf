"""Keyframe candidates of frame series and their reduction to diverse subsets."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.hashing import hamming, histogram_correlation
from lumenloom.operators.ordered import WINDOW_ROWS, neighbour, row_number, running_sum
from lumenloom.params import KeyframeOptions
from lumenloom.runtime import broadcast_if_small, cut_lineage


def frame_skip(fps: Column, rate_hz: float) -> Column:
    return F.greatest(F.lit(1), (fps / F.lit(max(0.5, rate_hz))).cast("int"))


def sampled_frames(frames: DataFrame, rate_hz: float) -> DataFrame:
    return frames.where(F.col("frame_idx") % frame_skip(F.col("fps"), rate_hz) == 0)


def timestamp(idx: Column, fps: Column) -> Column:
    return F.when(fps > 0, idx / fps).otherwise(F.lit(0.0))


def frame_correlations(frames: DataFrame, max_rows: int = WINDOW_ROWS) -> DataFrame:
    """Adds ``corr`` with the frame before in the same video (NULL on the first).

    Frames whose histogram is missing could not be read and are left out.
    """
    readable = frames.where(F.col("hist").isNotNull())
    paired = neighbour(readable, ["video_id"], "frame_idx", {"hist": "prev_hist"}, max_rows=max_rows)
    return paired.withColumn("corr", histogram_correlation(F.col("prev_hist"), F.col("hist"))).drop("prev_hist")


def scene_segments(frames: DataFrame, threshold: float, max_rows: int = WINDOW_ROWS) -> DataFrame:
    """Scene number of every readable frame, from 0."""
    cut = frame_correlations(frames, max_rows).withColumn("cut", F.coalesce(F.col("corr") < threshold, F.lit(False)).cast("bigint"))
    return running_sum(cut, ["video_id"], "frame_idx", "cut", "scene", max_rows)


def scene_midpoints(frames: DataFrame, threshold: float, max_rows: int = WINDOW_ROWS) -> DataFrame:
    """Middle frame of every scene; a scene ends at the next cut or the last frame."""
    cuts = frame_correlations(frames, max_rows).where(F.col("corr") < threshold).select("video_id", "frame_idx")
    videos = frames.groupBy("video_id").agg(F.max("fps").alias("fps"), F.max("total_frames").alias("total_frames"))
    starts = cuts.unionByName(videos.select("video_id", F.lit(0).cast("bigint").alias("frame_idx"))).distinct()
    ends = neighbour(starts, ["video_id"], "frame_idx", {"frame_idx": "next_start"}, ahead=True, max_rows=max_rows)
    end = F.coalesce(F.col("next_start"), F.col("total_frames") - 1)
    mid = F.col("frame_idx") + F.shiftright(end - F.col("frame_idx"), 1)
    return (
        ends.join(videos, "video_id")
        .select("video_id", "fps", "total_frames", mid.alias("frame_idx"))
        .where((F.col("frame_idx") >= 0) & (F.col("frame_idx") < F.col("total_frames")))
        .distinct()
    )


def uniform_frames(videos: DataFrame, step: Column) -> DataFrame:
    """Every step-th frame of each video (video_id, fps, total_frames)."""
    known = videos.where(F.col("total_frames") > 0)
    return known.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total_frames").cast("bigint") - 1, step.cast("bigint"))))


def short_video_step(total: Column, max_candidates: int) -> Column:
    slots = max(1, max(3, max_candidates or 6) * 2)
    return F.greatest(F.lit(1), F.floor(total / slots))


def fixed_count_step(total: Column, wanted: int) -> Column:
    """All frames of a video shorter than the wanted count, else about five per wanted frame."""
    return F.when(total < wanted, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(total / (wanted * 5))))


def candidates(frames: DataFrame, o: KeyframeOptions, max_rows: int = WINDOW_ROWS) -> DataFrame:
    """Scene midpoints of long videos, uniform samples of short ones.

    The hash of a candidate, where its frame is in ``frames``, comes along.
    """
    long = (F.col("fps") > 0) & (F.col("total_frames") / F.col("fps") >= o.min_scene_seconds)
    scenes = scene_midpoints(sampled_frames(frames.where(long), o.sample_rate_hz), o.scene_threshold, max_rows)
    short = frames.where(~F.coalesce(long, F.lit(False))).groupBy("video_id").agg(F.max("fps").alias("fps"), F.max("total_frames").alias("total_frames"))
    uniform = uniform_frames(short, short_video_step(F.col("total_frames"), o.max_candidates))
    picked = scenes.unionByName(uniform.select(*scenes.columns))
    hashes = frames.select("video_id", "frame_idx", "h1")
    return picked.join(hashes, ["video_id", "frame_idx"], "left").withColumn("ts", timestamp(F.col("frame_idx"), F.col("fps")))


def _distances(h: np.ndarray) -> np.ndarray:
    return np.bitwise_count(h[:, None] ^ h[None, :]).astype(np.int64)


def _leave_one_out(h: np.ndarray) -> int:
    """Index whose removal leaves the largest minimum distance; the last one on ties."""
    n = len(h)
    best, shared = 65, None  # frames that every closest pair so far has in common
    for a in range(0, n, 512):
        d = np.bitwise_count(h[a : a + 512, None] ^ h[None, :]).astype(np.int64)
        d[np.arange(n)[None, :] <= np.arange(a, min(a + 512, n))[:, None]] = 65
        low = int(d.min())
        if low < best:
            best, shared = low, None
        if low == best:
            i, j = np.nonzero(d == best)
            for pair in zip((i + a).tolist(), j.tolist()):
                shared = set(pair) if shared is None else shared & set(pair)
                if not shared:
                    break
    if not shared:
        return n - 1

    def left(i: int) -> int:
        rest = np.delete(h, i)
        low = 65
        for a in range(0, n - 1, 512):
            d = np.bitwise_count(rest[a : a + 512, None] ^ rest[None, :]).astype(np.int64)
            d[np.arange(n - 1)[None, :] <= np.arange(a, min(a + 512, n - 1))[:, None]] = 65
            low = min(low, int(d.min()))
        return low

    scored = {i: left(i) for i in shared}
    options = {**scored, max(i for i in range(n) if i not in shared): best} if n > len(shared) else scored
    return max(options, key=lambda i: (options[i], i))


def best_subset(h: np.ndarray, k: int) -> list[int]:
    """First k-subset in index order with the largest minimum pairwise distance.

    Depth-first in index order; a branch whose minimum is no better than the
    best complete subset cannot win and is cut.
    """
    n = len(h)
    if k >= n:
        return list(range(n))
    if n - k == 1 and n > 3:
        gone = _leave_one_out(h)
        return [i for i in range(n) if i != gone]
    dist = _distances(h)
    best: list[int] = []
    best_value = -1

    def grow(chosen: list[int], value: int) -> None:
        nonlocal best, best_value
        if len(chosen) == k:
            best, best_value = list(chosen), value
            return
        start = chosen[-1] + 1 if chosen else 0
        for i in range(start, n - (k - len(chosen)) + 1):
            reach = min(value, int(dist[i, chosen].min())) if chosen else value
            if reach > best_value:
                grow([*chosen, i], reach)

    grow([], 65)
    return best


def _spread_rounds(cands: DataFrame, k: int) -> DataFrame:
    """Farthest-point selection (Gonzalez 1985), all videos side by side.

    Each round picks one frame per video by aggregation; no video is gathered.
    """
    state = cut_lineage(cands.select("video_id", "frame_idx", "h1").withColumn("gap", F.lit(65)))
    chosen = None
    for i in range(k):
        rank = F.min(F.struct((-F.col("gap")).alias("g"), F.col("frame_idx").alias("f"), F.col("h1").alias("h")))
        pick = state.groupBy("video_id").agg(rank.alias("p")).select("video_id", F.col("p.f").alias("pick"), F.col("p.h").alias("pick_h"))
        pick = cut_lineage(pick)
        one = pick.select("video_id", F.col("pick").alias("frame_idx"))
        chosen = one if chosen is None else chosen.unionByName(one)
        state = (
            state.join(broadcast_if_small(pick), "video_id")  # one row per video
            .where("frame_idx <> pick")
            .withColumn("gap", F.least(F.col("gap"), hamming(F.col("h1"), F.col("pick_h"))))
            .drop("pick", "pick_h")
        )
        if i % 4 == 3:
            state = cut_lineage(state)
    return chosen


def diverse_frames(cands: DataFrame, k: int, method: str = "spread") -> DataFrame:
    """At most k frames per video, as different from each other as possible.

    Videos within k are untouched. Above that, frames without a hash go first.
    ``spread`` selects by farthest point, side by side for all videos; ``exact``
    finds the first best subset of each video in one task, for short series.
    """
    if method not in ("spread", "exact"):
        raise ValueError(f"unknown method: {method}")
    if k <= 0:
        return cands.select("video_id", "frame_idx")
    counted = cands.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_all"), F.count("h1").alias("n"))
    joined = cands.join(counted, "video_id")
    base = joined.where((F.col("n_all") <= k) | (F.col("n") == 0)).select("video_id", "frame_idx")
    usable = joined.where((F.col("n_all") > k) & (F.col("n") > 0) & F.col("h1").isNotNull())
    parts = [base, usable.where(F.col("n") <= k).select("video_id", "frame_idx")]
    over = usable.where(F.col("n") > k)
    if k == 1:
        parts.append(over.groupBy("video_id").agg(F.min("frame_idx").alias("frame_idx")))
    elif method == "exact":

        def exact(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("frame_idx")
            return pdf.iloc[best_subset(pdf["h1"].to_numpy().astype(np.int64).view(np.uint64), k)][["video_id", "frame_idx"]]

        schema = over.select("video_id", "frame_idx").schema
        parts.append(over.select("video_id", "frame_idx", "h1").groupBy("video_id").applyInPandas(exact, schema))
    else:
        parts.append(_spread_rounds(over, k))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def every_nth(cands: DataFrame, n: int) -> DataFrame:
    return row_number(cands, ["video_id"], [F.col("frame_idx")], "_k").where((F.col("_k") - 1) % n == 0).drop("_k")


def keyframe_names(selected: DataFrame, prefix: Column, start: int = 1, pad: int = 4) -> DataFrame:
    """``<prefix>_0001.png`` per video, in frame order; wider numbers keep all digits."""
    numbered = row_number(selected, ["video_id"], [F.col("frame_idx")], "_k")
    number = (F.col("_k") + (start - 1)).cast("string")
    padded = F.when(F.length(number) >= pad, number).otherwise(F.lpad(number, pad, "0"))
    return numbered.withColumn("file_name", F.concat(prefix, F.lit("_"), padded, F.lit(".png"))).drop("_k")
