"""Pairs against the cross product, groups against a sequential greedy run."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from lumenloom.operators import clustering, similarity
from lumenloom.params import SimilarityOptions
from lumenloom.plans import dedup

SCHEMA = "image_id bigint, h1 bigint, h2 bigint, color array<double>, aspect double"


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def noisy(rng, base, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << b
    return base


def fingerprints(seed, n=300, centres=12, flips=6):
    rng = random.Random(seed)
    seeds = [(rng.getrandbits(64), rng.getrandbits(64), rng.choice([0.5, 1.0, 1.5])) for _ in range(centres)]
    rows = []
    for i in range(n):
        h1, h2, ar = seeds[0] if i % 3 == 0 else rng.choice(seeds)
        color = [0.0] * 64
        color[rng.choice([0, 1])] = 0.7
        color[63] = 0.3
        rows.append((i, signed(noisy(rng, h1, flips)), signed(noisy(rng, h2, flips)), color, ar * rng.choice([1.0, 1.02, 1.1, 1.2])))
    return rows


def pairs_by_hand(rows, o):
    found = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x, y = rows[a], rows[b]
            if abs(x[4] - y[4]) / max(x[4], y[4]) > o.ar_tolerance:
                continue
            d1 = ((x[1] ^ y[1]) & (1 << 64) - 1).bit_count()
            if d1 > o.threshold:
                continue
            if o.require_dual_hash and ((x[2] ^ y[2]) & (1 << 64) - 1).bit_count() > o.threshold + 4:
                continue
            if o.color_distance_max is not None and sum(abs(p - q) for p, q in zip(x[3], y[3])) > o.color_distance_max:
                continue
            found.add((x[0], y[0], d1))
    return found


@pytest.mark.parametrize("hot", [10**9, 4])
@pytest.mark.parametrize(
    "o",
    [
        SimilarityOptions(4, 0.05, True),
        SimilarityOptions(6, 0.15, True),
        SimilarityOptions(10, 0.25, False),
        SimilarityOptions(12, 0.0, False, None),
        SimilarityOptions(3, 1.0, True, None),
    ],
)
def test_pairs_equal_cross_product(spark, o, hot):
    rows = fingerprints(o.threshold)
    got = [tuple(r) for r in similarity.similar_pairs(spark.createDataFrame(rows, SCHEMA), o, hot_rows=hot).collect()]
    assert len(got) == len(set(got)), "a pair came twice"
    assert set(got) == pairs_by_hand(rows, o)


def test_single_precision_leaves_only_close_colors_to_double(monkeypatch):
    """Sums within rounding of the limit, or that do not fit, are taken in double; no others."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    colors = rng.random((300, 64)) / 64
    colors[200:250] = colors[150:200]
    colors[200:250, 5] += 0.25 + np.arange(-25, 25) * 2.0**-40  # about the limit from their twins
    colors[250, 3], colors[251, 3], colors[252:254, 3] = np.nan, np.inf, 1e300
    o = SimilarityOptions(64, 1.0, False, 0.25)

    def side(rows):
        known = pa.array([r if k % 7 else None for k, r in enumerate(rows.tolist())], pa.list_(pa.float64()))
        return similarity._Side(pa.table({"aspect": np.ones(len(rows)), "h1": np.zeros(len(rows), np.int64), "color": known}), np.arange(len(rows)), o, 64)

    seen = []
    exactly = similarity._exactly_near
    monkeypatch.setattr(similarity, "_exactly_near", lambda a, b, most: seen.append(len(a)) or exactly(a, b, most))
    for n in (250, 300):  # without and with values that do not fit
        low = side(colors[:n])
        i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(n), np.arange(n)))
        with np.errstate(invalid="ignore", over="ignore"):
            want = [a % 7 == 0 or b % 7 == 0 or np.add.accumulate(np.abs(colors[a] - colors[b]))[-1] <= 0.25 for a, b in zip(i, j)]
            assert similarity._color_near(low, low, i, j, 0.25).tolist() == want
        if n == 250:
            assert 50 < sum(seen) < 2000 < sum(want) < len(want) - 2000


def test_pairs_of_copies_need_no_join(spark, monkeypatch):
    """Copies written out in the tiles are those that joins of classes and members gave, and no pair is shuffled."""
    import checks.similarity as queries

    rows = fingerprints(5, n=80)
    rows += [(100 + i, *rows[i % 7][1:]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(queries, "fingerprints", lambda spark, sf: df)
    got = queries.q_pairs_expanded(spark, "")
    joined = similarity.expand_pairs(*similarity.similar_classes(df, queries.BALANCED))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joined.collect()))
    assert {tuple(r) for r in got.collect()} == pairs_by_hand(rows, queries.BALANCED)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan[: plan.index("MapInArrow")]


@pytest.mark.parametrize("rows", [1_000, 10**6, 10**9])
def test_wide_groups_on_large_tables_stay_exact(spark, monkeypatch, rows):
    groups, radius = similarity.banding(6, rows)
    assert radius == 6 // groups
    monkeypatch.setattr(similarity, "banding", lambda t, n: (groups, radius))
    data = fingerprints(77)
    o = SimilarityOptions(6, 0.15, True)
    got = {tuple(r) for r in similarity.similar_pairs(spark.createDataFrame(data, SCHEMA), o, hot_rows=10).collect()}
    assert got == pairs_by_hand(data, o)


def sequential_groups(ids, edges, threshold):
    near = {i: {} for i in ids}
    for a, b, d in edges:
        near[a][b] = d
        near[b][a] = d
    free, groups = set(ids), []
    for s in sorted(ids, key=lambda i: (-len(near[i]), i)):
        if s not in free or not near[s]:
            continue
        cluster = [s]
        free.discard(s)
        while True:
            options = [(max(near[c][m] for m in cluster), c) for c in free if all(m in near[c] for m in cluster)]
            if not options:
                break
            _, c = min(options)
            cluster.append(c)
            free.discard(c)
        if len(cluster) > 1:
            groups.append(frozenset(cluster))
    return groups


@pytest.mark.parametrize("component_edges", [10**9, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_sequential_greedy(spark, seed, component_edges):
    rows = fingerprints(seed, n=70, centres=6, flips=3)
    rows += [(100 + i, *rows[i % 5][1:]) for i in range(20)]  # exact copies
    o = SimilarityOptions(4, 0.15, True)
    want = sequential_groups([r[0] for r in rows], pairs_by_hand(rows, o), o.threshold)
    df = spark.createDataFrame([(*r, f"n{r[0]:04d}", 10, 10) for r in rows], SCHEMA + ", name string, width int, height int")
    got = dedup.duplicate_groups(df, o, component_edges=component_edges).collect()
    members = {}
    for r in got:
        members.setdefault(r["group_id"], set()).add(r["image_id"])
        assert r["group_size"] > 1
    assert {frozenset(m) for m in members.values()} == set(want)
    for g in members:
        mine = sorted((r["member_rank"], r["name"]) for r in got if r["group_id"] == g)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1] for m in mine] == sorted(m[1] for m in mine)
    ranks = sorted({(r["group_rank"], -r["group_size"]) for r in got})
    assert [s for _, s in ranks] == sorted(s for _, s in ranks)


def test_components_of_a_hub_a_chain_and_a_ring(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    got = {r["image_id"]: r["component"] for r in clustering.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert len(got) == 200 + 101 + 50
    assert all(got[i] == 0 for i in range(200)) and all(got[i] == 1000 for i in range(1000, 1101)) and all(got[2000 + i] == 2000 for i in range(50))


def test_largest_stays_and_zero_areas_keep_the_first(spark):
    rows = [(1, 7, "b", 10, 10), (2, 7, "a", 10, 10), (3, 7, "c", 20, 20), (4, 8, "z", None, None), (5, 8, "y", None, None)]
    df = spark.createDataFrame(rows, "image_id bigint, group_id bigint, name string, width int, height int")
    kept = {r["image_id"] for r in clustering.mark_all_but_largest(df, "name").where("retained").collect()}
    assert kept == {3, 5}


def test_no_cartesian_product_in_the_pair_plan(spark):
    df = spark.createDataFrame(fingerprints(5, n=50), SCHEMA)
    plan = similarity.similar_pairs(df, SimilarityOptions())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_grid_bounds_both_sides_and_meets_once(spark):
    """A third of all highs and a quarter of all lows share one key; every pair still meets in one cell."""
    low = spark.range(900).select("id", F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id")).alias("key"))
    high = spark.range(1000, 2500).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, 9999).otherwise(F.col("id") - 999).alias("key"))
    busy = similarity._busy(low, high, ["key"], 40)
    assert {(r["key"], r["lows"], r["highs"]) for r in busy.collect()} == {(0, 225, 500)}
    a, b = similarity.grid(low, high, ["key"], busy, 40)
    cells = ["key", "row_stripe", "column_stripe"]
    for side in (a, b):
        assert side.groupBy(*cells).count().agg(F.max("count")).first()[0] < 80
    met = a.select(F.col("id").alias("x"), *cells).join(b.select(F.col("id").alias("y"), *cells), cells).select("x", "y")
    want = low.join(high.withColumnRenamed("id", "y"), "key").select(F.col("id").alias("x"), "y")
    assert met.count() == want.count() == met.distinct().count() and met.exceptAll(want).isEmpty()


def test_candidates_are_not_shuffled(spark):
    """A loose test makes thousands of candidates of a row; what is shuffled is rows in tiles, not probes or pairs."""
    o = SimilarityOptions(10, 0.25, False)
    df = spark.createDataFrame(fingerprints(9, n=400), SCHEMA)
    plan = similarity.similar_pairs(df, o)._jdf.queryExecution().optimizedPlan().toString()
    assert " Join " not in plan.replace("Join LeftOuter", "").replace("Join Left", "") and "posexplode" not in plan


def test_bit_groups_and_scans_find_the_same_pairs():
    """Both ways of a tile, with ties in the aspect ratio and keys shared by several rows."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(300)]
    rows = [(i, signed(noisy(rng, rng.choice(centres), 3)), None, None, rng.choice([0.5, 1.5])) for i in range(3000)]
    table = pa.table({"image_id": [r[0] for r in rows] * 2, "h1": [r[1] for r in rows] * 2, "aspect": [rng.choice([1.0, r[4]]) for r in rows] * 2, "low": [True] * 3000 + [False] * 3000})
    o = SimilarityOptions(4, 1.0, False, None)
    masks = similarity._bit_groups(list(range(64)), 5)
    sides = [similarity._Side(table.slice(3000 * k, 3000), np.arange(3000), o, 64) for k in (0, 1)]
    assert similarity._by_groups(*sides, o, masks) is not None
    found = []
    for way in (masks, None):
        got = [r for b in similarity._tile_pairs(table, "image_id", o, way, 64) for r in zip(*b.to_pydict().values())]
        assert len(got) == len(set(got))
        found.append(set(got))
    assert found[0] == found[1] and len(found[0]) > 3000


@pytest.mark.parametrize("group_edges", [12, 50])
def test_rounds_of_seeds_in_order_equal_one_greedy_run(spark, group_edges):
    """One large component; the first seeds need more links than a round may hold, or several rounds are needed."""
    import pandas as pd

    rng = random.Random(8)
    edges = sorted({tuple(sorted(rng.sample(range(20), 2))) for _ in range(110)})
    edges = [(a, b, rng.randint(0, 4)) for a, b in edges]
    degree = {i: sum(i in e[:2] for e in edges) for i in range(20)}
    whole = pd.DataFrame([(*e, degree[e[0]], degree[e[1]]) for e in edges], columns=["src", "dst", "d1", "src_degree", "dst_degree"])
    want = set(clustering._greedy_component(whole).itertuples(index=False, name=None))
    nodes = spark.createDataFrame([(i, degree[i]) for i in range(20)], "image_id bigint, degree bigint")
    got = clustering._cliques_by_rounds(nodes, spark.createDataFrame(edges, "src bigint, dst bigint, d1 int"), group_edges).collect()
    assert len(got) == 20 and {tuple(r) for r in got} == want


def test_large_components_need_no_rounds(spark, monkeypatch):
    """319 600 links in one component, where a round would serve few seeds of a dense core."""
    monkeypatch.setattr(clustering, "_cliques_by_rounds", None)
    ids = spark.range(800)
    edges = ids.toDF("src").join(ids.toDF("dst")).where("src < dst").selectExpr("src", "dst", "cast((src + dst) % 7 as int) as d1")
    got = clustering.clique_clusters(ids.selectExpr("id as image_id", "1L as copies"), edges)
    assert got.count() == 800 and got.select("seed", "seed_degree").distinct().collect() == [(0, 799)]


def chained_by_hand(rows, threshold):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in rows:
        for b, y in rows:
            if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() <= threshold:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in root if sum(find(i) == find(j) for j in root) > 1}


@pytest.mark.parametrize("threshold", [0, 4, 9])
@pytest.mark.parametrize("hot", [10**9, 7])
def test_chaining_links_join_what_pairs_join(spark, threshold, hot):
    rng = random.Random(threshold)
    bases = [rng.getrandbits(64) for _ in range(6)]
    rows = [(i * 3 - 50, signed(noisy(rng, rng.choice(bases), threshold + 3))) for i in range(150)] + [(1000, signed(bases[0])), (1001, signed(bases[0]))]
    df = spark.createDataFrame([*rows, (5000, None)], "image_id bigint, h1 bigint")
    links = similarity.chaining_links(df, threshold, hot_rows=hot)
    got = {r["image_id"]: r["component"] for r in clustering.connected_components(links).collect()}
    assert got == chained_by_hand(rows, threshold)


def test_transitive_groups_write_no_pairs(spark, monkeypatch):
    bits = [0, *(1 << i for i in range(34)), *(1 << i | 1 << j for i in range(34) for j in range(i))]  # 596 hashes, all within 4 of each other
    rows = [(i, h, 0, None, 1.0, f"{i}.png") for i, h in enumerate(bits)]
    df = spark.createDataFrame(rows, "image_id bigint, h1 bigint, h2 bigint, color array<double>, aspect double, name string")
    written = []
    monkeypatch.setattr(dedup, "connected_components", lambda e: written.append(e.count()) or clustering.connected_components(e))
    groups = dedup.transitive_groups(df, 4)
    assert groups.count() == len(bits) and groups.select("component").distinct().count() == 1
    assert written[0] < 5 * len(bits)
