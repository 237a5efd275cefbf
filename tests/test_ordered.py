"""Both ways of every ordered operator agree, with one key holding a third of the rows."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenloom.operators import autocrop, keyframes, ordered


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randint(1, 20), i * 7919 % 5003, rng.randint(0, 1)) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, at bigint, v bigint").repartition(5).cache()


def same(a, b):
    assert sorted(map(tuple, a.select(sorted(a.columns)).collect()), key=str) == sorted(map(tuple, b.select(sorted(b.columns)).collect()), key=str)


def test_row_number(events):
    same(ordered.row_number(events, ["k"], [F.col("at")], "n"), ordered.row_number(events, ["k"], [F.col("at")], "n", max_rows=10))


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbour(events, ahead):
    args = (["k"], "at", {"v": "other", "at": "when"})
    same(ordered.neighbour(events, *args, ahead=ahead), ordered.neighbour(events, *args, ahead=ahead, max_rows=10))


def test_running_sum(events):
    same(ordered.running_sum(events, ["k"], "at", "v", "s"), ordered.running_sum(events, ["k"], "at", "v", "s", max_rows=10))


@pytest.mark.parametrize("out", ["_before", "_local", "_t"])
def test_sums_and_numbers_may_have_any_name(events, out):
    """numbered_names sums into ``_before``, which failed once a group passed the limit."""
    same(ordered.running_sum(events, ["k"], "at", "v", out), ordered.running_sum(events, ["k"], "at", "v", out, max_rows=10))
    same(ordered.row_number(events, ["k"], [F.col("at")], out), ordered.row_number(events, ["k"], [F.col("at")], out, max_rows=10))


def test_ordinal_is_dense(events):
    got = [r["o"] for r in ordered.ordinal(events, [F.col("at"), F.col("k")], "o").orderBy("at", "k").collect()]
    assert got == list(range(3000))


def brute(h, k):
    best, value = None, -1
    for s in itertools.combinations(range(len(h)), k):
        d = min(int(h[a] ^ h[b]).bit_count() for a, b in itertools.combinations(s, 2))
        if d > value:
            best, value = list(s), d
    return best


@pytest.mark.parametrize("n,k", [(6, 2), (8, 3), (9, 5), (7, 6), (12, 11), (5, 4), (10, 8)])
def test_best_subset_is_the_first_optimum(n, k):
    for seed in range(12):
        rng = random.Random(seed)
        h = np.array([rng.choice([rng.getrandbits(64), rng.getrandbits(3)]) for _ in range(n)], dtype=np.uint64)
        assert keyframes.best_subset(h, k) == brute([int(v) for v in h], k)


@pytest.mark.parametrize("method", ["exact", "spread"])
def test_diverse_frames(spark, method):
    rng = random.Random(5)
    rows = [(v, i, rng.getrandbits(62)) for v, n in ((1, 3), (2, 9), (3, 24)) for i in range(n)] + [(4, i, None) for i in range(9)] + [(5, i, rng.getrandbits(62) if i > 4 else None) for i in range(8)]
    df = spark.createDataFrame(rows, "video_id int, frame_idx bigint, h1 bigint")
    got = {}
    for r in keyframes.diverse_frames(df, 4, method).collect():
        got.setdefault(r["video_id"], []).append(r["frame_idx"])
    assert sorted(got[1]) == [0, 1, 2]
    for v in (2, 3):
        h = [r[2] for r in rows if r[0] == v]
        if method == "exact":
            assert sorted(got[v]) == brute(h, 4)
        else:
            chosen = [0]
            while len(chosen) < 4:
                rest = [i for i in range(len(h)) if i not in chosen]
                chosen.append(max(rest, key=lambda i: (min((h[i] ^ h[j]).bit_count() for j in chosen), -i)))
            assert sorted(got[v]) == sorted(chosen)
    assert len(got[4]) == 9  # nothing could be hashed: left as they are
    assert sorted(got[5]) == [5, 6, 7]


def test_crowded_images_sum_pairs_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(autocrop, "BLOCK", 8)
    rng = random.Random(1)
    rows = [(img, o, rng.randint(0, 900), rng.randint(0, 900), 10, 20) for img, n in ((1, 50), (2, 5), (3, 1)) for o in range(n)]
    df = spark.createDataFrame(rows, "image_id bigint, ord bigint, x int, y int, w int, h int")
    got = {r["image_id"]: r["mean_distance"] for r in autocrop.mean_pair_distance(df).collect()}
    for img in (1, 2, 3):
        c = [(r[2] + 5, r[3] + 10) for r in rows if r[0] == img]
        d = [np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in itertools.combinations(c, 2)]
        assert got[img] == pytest.approx(float(np.mean(d)) if d else 0.0)
