"""Groups from similar pairs: transitive components and strict greedy cliques."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.operators.ordered import ordinal
from lumenloom.runtime import cut_lineage

#: links that one task solves at a time; it holds some 30 bytes of each, so about 1 GB
COMPONENT_EDGES = 32_000_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def connected_components(edges: DataFrame) -> DataFrame:
    """(image_id, component) of every node on an edge; component = smallest id.

    Alternating large-star / small-star rounds (Kiveris et al. 2014). Minima are
    aggregated map-side and joined back, so a node with most of the edges never
    has its neighbours gathered in one place.
    """
    current = cut_lineage(edges.select("src", "dst").where("src <> dst").distinct())
    while True:
        before = current
        both = _both_ways(current)
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        floor = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(floor, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        current = cut_lineage(
            small.unionByName(floor.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
        )
        # edges are distinct: equal tables have equally many rows and none that the other lacks
        if current.count() == before.count() and current.join(before, ["src", "dst"], "left_anti").isEmpty():
            break
    roots = current.select("dst").distinct().select(F.col("dst").alias("image_id"), F.col("dst").alias("component"))
    return current.select(F.col("src").alias("image_id"), F.col("dst").alias("component")).unionByName(roots)


def _degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree in the graph before copies were collapsed: neighbours' copies plus own twins."""
    reach = (
        _both_ways(edges.select("src", "dst"))
        .join(nodes.select(F.col("image_id").alias("dst"), "copies"), "dst")
        .groupBy(F.col("src").alias("image_id"))
        .agg(F.sum("copies").alias("reach"))
    )
    return nodes.join(reach, "image_id", "left").select(
        "image_id", "copies", (F.coalesce(F.col("reach"), F.lit(0)) + F.col("copies") - 1).alias("degree")
    )


def _greedy_component(pdf: pd.DataFrame, lowest: int | None = None) -> pd.DataFrame:
    """Greedy cliques of one bounded component, seeds by falling degree then id, down to degree ``lowest``."""
    ids = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
    degree = np.zeros(len(ids), np.int64)
    a, b = np.searchsorted(ids, pdf["src"].to_numpy()), np.searchsorted(ids, pdf["dst"].to_numpy())
    degree[a], degree[b] = pdf["src_degree"].to_numpy(), pdf["dst_degree"].to_numpy()
    order = np.lexsort((ids, -degree))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    last = len(ids) - 1 if lowest is None else int((degree >= lowest).sum()) - 1
    nodes, seeds = _greedy_cliques(place[a], place[b], pdf["d1"].to_numpy(), ids[order], last)
    return pd.DataFrame({"image_id": ids[order][nodes], "seed": ids[order][seeds], "seed_degree": degree[order][seeds]})


class _Links:
    """Links of one end, sorted by it; 5 bytes a link."""

    def __init__(self, own: np.ndarray, other: np.ndarray, d1: np.ndarray, n: int):
        order = np.argsort(own, kind="stable")
        self.other, self.d1 = other[order], d1[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])


def _greedy_cliques(a: np.ndarray, b: np.ndarray, d1: np.ndarray, ids: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, their seeds) of the greedy run over links (a, b, d1) between places, seeds from place 0 to ``last``.

    ``ids`` names the node of every place. A node is picked once and its links are read
    then, so the run takes time in proportion to the links.
    """
    n = len(ids)
    a, b, d1 = a.astype(np.int32, copy=False), b.astype(np.int32, copy=False), d1.astype(np.int8, copy=False)
    ends = [_Links(a, b, d1, n), _Links(b, a, d1, n)]
    free = np.zeros(n, bool)
    free[a] = free[b] = True
    rank = np.empty(n, np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(n)
    far_from = np.full(n, -1, np.int8)

    def links(v: int) -> tuple[np.ndarray, np.ndarray]:
        cuts = [(e, e.start[v], e.start[v + 1]) for e in ends]
        return np.concatenate([e.other[s:t] for e, s, t in cuts]), np.concatenate([e.d1[s:t] for e, s, t in cuts])

    members, seeds = [], []
    for seed in np.flatnonzero(free[: last + 1]).tolist():
        if not free[seed]:
            continue
        free[seed] = False
        members.append(seed)
        seeds.append(seed)
        # farthest member so far, for every free node adjacent to all members
        near, far = links(seed)
        ok = free[near]
        near, far = near[ok], far[ok]
        while len(near):
            first = near[far == far.min()]
            pick = int(first[np.argmin(rank[first])])
            free[pick] = False
            members.append(pick)
            seeds.append(seed)
            next_to, d = links(pick)
            far_from[next_to] = d
            gap = far_from[near]
            far_from[next_to] = -1
            ok = gap >= 0
            near, far = near[ok], np.maximum(far[ok], gap[ok])
    return np.array(members, np.int64), np.array(seeds, np.int64)


def _greedy_groups(links: DataFrame, last: int | None = None) -> DataFrame:
    """The greedy run over each ``_group`` of links (src, dst, d1, src_place, dst_place); groups share no node.

    Seeds go up to place ``last``; (image_id, seed) of the nodes served. A task reads 9 bytes
    a link and holds some 30 while it sorts them.
    """
    packed = links.select("_group", "src", "dst", F.col("d1").cast("byte").alias("d1"), F.col("src_place").cast("int").alias("a"), F.col("dst_place").cast("int").alias("b"))

    def solve(held: list[tuple[np.ndarray, ...]], ids: np.ndarray) -> pa.RecordBatch:
        a, b, d1 = (np.concatenate(x) for x in zip(*held))
        held.clear()
        met = np.zeros(len(ids), bool)
        met[a] = met[b] = True
        at = np.cumsum(met, dtype=np.int32) - np.int32(1)
        bound = len(ids) if last is None else last + 1
        nodes, seeds = _greedy_cliques(at[a], at[b], d1, ids[met], int(met[:bound].sum()) - 1)
        names = ids[met]
        return pa.record_batch([pa.array(names[nodes]), pa.array(names[seeds])], names=["image_id", "seed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, ids = [], None, np.zeros(0, np.int64)
        for batch in batches:
            groups = batch["_group"].to_numpy()
            src, dst, a, b, d1 = (batch[c].to_numpy() for c in ("src", "dst", "a", "b", "d1"))
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if held and groups[s] != group:
                    yield solve(held, ids)
                group = groups[s]
                top = int(max(a[s:e].max(), b[s:e].max()))
                if top >= len(ids):
                    ids = np.concatenate([ids, np.zeros(max(top + 1, 2 * len(ids)) - len(ids), np.int64)])
                ids[a[s:e]], ids[b[s:e]] = src[s:e], dst[s:e]
                held.append((a[s:e].copy(), b[s:e].copy(), d1[s:e].copy()))
        if held:
            yield solve(held, ids)

    return packed.repartition("_group").sortWithinPartitions("_group").mapInArrow(run, "image_id bigint, seed bigint")


def _grow(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """All seeds grow side by side, one member per step, by aggregation and joins."""
    members = [seeds.select(F.col("seed").alias("image_id"), "seed", "seed_degree")]
    open_ = cut_lineage(seeds.join(links, seeds["seed"] == links["src"]).select("seed", "seed_degree", F.col("dst").alias("cand"), F.col("d1").alias("far")))
    while not open_.isEmpty():
        pick = open_.groupBy("seed", "seed_degree").agg(F.min(F.struct("far", "cand")).alias("p")).select("seed", "seed_degree", F.col("p.cand").alias("pick"))
        pick = cut_lineage(pick)
        members.append(pick.select(F.col("pick").alias("image_id"), "seed", "seed_degree"))
        step = open_.join(pick.select("seed", "pick"), "seed").where("cand <> pick")
        open_ = cut_lineage(
            step.join(links, (step["pick"] == links["src"]) & (step["cand"] == links["dst"]))
            .select("seed", "seed_degree", "cand", F.greatest("far", "d1").alias("far"))
        )
        if len(members) >= 16:
            members = [cut_lineage(_union(members))]
    return cut_lineage(_union(members))


def _apart(free: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that come first among all free nodes within two steps: no two of them share a neighbour."""

    def spread(best: DataFrame) -> DataFrame:
        """Smallest place among a node and its neighbours."""
        from_links = links.join(best, "dst").groupBy("src").agg(F.min("place").alias("near"))
        own = best.select(F.col("dst").alias("src"), "place")
        return own.join(from_links, "src", "left").select(F.col("src").alias("dst"), F.least(F.col("place"), F.coalesce("near", "place")).alias("place"))

    within_two = spread(spread(free.select(F.col("image_id").alias("dst"), "place"))).toDF("image_id", "best")
    return cut_lineage(free.join(within_two, "image_id").where("place = best").select(F.col("image_id").alias("seed"), F.col("degree").alias("seed_degree")))


def _next_seeds(links: DataFrame, group_edges: int) -> tuple[DataFrame, int] | None:
    """The links that the next seeds in order need, and the place of the last of them.

    The seeds up to place p need the links between nodes that each are such a
    seed or next to one. A link is needed from the larger of its ends' smallest
    such places on, so the places are cut where about ``group_edges`` links are needed.
    """
    first = links.groupBy("src").agg(F.least(F.min("dst_place"), F.first("src_place")).alias("_from"))
    one_way = links.where("src < dst").join(first.toDF("src", "_a"), "src").join(first.toDF("dst", "_b"), "dst")
    needed = cut_lineage(one_way.withColumn("_from", F.greatest("_a", "_b")).drop("_a", "_b"))
    total = needed.count()
    share = min(1.0, group_edges / total)
    last = needed.agg(F.percentile_approx("_from", share, 10_000).alias("p") if share < 1 else F.max("_from").alias("p")).first()["p"]
    for p in (last, last - 1):
        n = needed.where(F.col("_from") <= p).count()
        if 0 < n <= 1.5 * group_edges:
            return needed.where(F.col("_from") <= p), p
    return None


def _cliques_by_rounds(nodes: DataFrame, edges: DataFrame, group_edges: int) -> DataFrame:
    """The same greedy clustering without gathering a component anywhere.

    A round serves the next seeds in order, as many as need about
    ``group_edges`` links, in one task. If the first of them alone needs more,
    the round serves all nodes that come first among the free nodes within two
    steps: no earlier seed can touch their neighbourhoods, so they grow side by side by joins.
    """
    places = cut_lineage(ordinal(nodes.select("image_id", "degree"), [F.col("degree").desc(), F.col("image_id")], "place"))
    ends = places.select("image_id", "place")
    links = _both_ways(edges.select("src", "dst", "d1")).join(ends.toDF("src", "src_place"), "src").join(ends.toDF("dst", "dst_place"), "dst")
    free, links = places, cut_lineage(links)
    served: list[DataFrame] = []
    while not links.isEmpty():
        batch = _next_seeds(links, group_edges) if group_edges else None
        if batch:
            needed, last = batch
            grown = _greedy_groups(needed.withColumn("_group", F.lit(0)), last)
            done = cut_lineage(_with_degree(grown, places))
        else:
            done = _grow(_apart(free, links), links.select("src", "dst", "d1"))
        served.append(done)
        if len(served) >= 16:
            served = [cut_lineage(_union(served))]
        free = cut_lineage(free.join(done, "image_id", "left_anti"))
        gone = done.select("image_id")
        links = cut_lineage(
            links.join(gone, links["src"] == gone["image_id"], "left_anti").join(gone, links["dst"] == gone["image_id"], "left_anti")
        )
    alone = free.select("image_id", F.col("image_id").alias("seed"), F.col("degree").alias("seed_degree"))
    return _union([*served, alone])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clique_clusters(nodes: DataFrame, edges: DataFrame, component_edges: int = COMPONENT_EDGES) -> DataFrame:
    """Strict greedy clusters (image_id, seed, seed_degree) of representatives.

    ``nodes`` has image_id and copies. Every node gets a cluster, possibly of
    its own. Components of at most ``component_edges`` edges are solved whole in
    one task; larger ones by distributed rounds. Both give the same clusters.
    """
    nodes = cut_lineage(_degrees(nodes.select("image_id", "copies"), edges))
    comp = cut_lineage(connected_components(edges))
    placed = ordinal(nodes.join(comp, "image_id").select("image_id", "component", "degree"), [F.col("degree").desc(), F.col("image_id")], "place")
    ends = cut_lineage(placed.select("image_id", "component", "place"))
    keyed = cut_lineage(edges.join(ends.toDF("src", "component", "src_place"), "src").join(ends.drop("component").toDF("dst", "dst_place"), "dst"))
    sizes = cut_lineage(keyed.groupBy("component").agg(F.count(F.lit(1)).alias("n_edges")))
    small, large = sizes.where(F.col("n_edges") <= component_edges), sizes.where(F.col("n_edges") > component_edges)
    packs = _packs(small, component_edges)
    grown = _greedy_groups(keyed.join(packs, "component"))
    parts = [cut_lineage(_with_degree(grown, nodes))]
    if not large.isEmpty():
        on_large = comp.join(large, "component", "left_semi")
        wide = keyed.join(large, "component", "left_semi")
        parts.append(_cliques_by_rounds(nodes.join(on_large, "image_id", "left_semi"), wide, component_edges))
    alone = nodes.join(comp, "image_id", "left_anti").select("image_id", F.col("image_id").alias("seed"), F.col("degree").alias("seed_degree"))
    return _union([*parts, alone])


def _packs(sizes: DataFrame, links: int) -> DataFrame:
    """(component, _group): components dealt out to groups of at most about ``links`` links."""
    total = sizes.agg(F.sum("n_edges").alias("n")).first()["n"] or 0
    groups = max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * math.ceil(total / max(1, links)))
    return sizes.select("component", F.pmod(F.xxhash64("component"), F.lit(groups)).cast("int").alias("_group"))


def _with_degree(grown: DataFrame, nodes: DataFrame) -> DataFrame:
    degrees = nodes.select(F.col("image_id").alias("seed"), F.col("degree").alias("seed_degree"))
    return grown.join(degrees, "seed").select("image_id", "seed", "seed_degree")


def expand_groups(clusters: DataFrame, membership: DataFrame, min_size: int = 2) -> DataFrame:
    """Clusters of representatives back to all images; groups below ``min_size`` go."""
    rep = clusters.select(F.col("image_id").alias("rep_id"), F.col("seed").alias("group_id"), "seed_degree")
    members = membership.join(rep, "rep_id").drop("rep_id")
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") >= min_size)
    return members.join(sizes, "group_id")


def rank_groups(groups: DataFrame, name: str) -> DataFrame:
    """Group order (size falling, then seed order) and member order by name.

    One global ordinal gives both: a member's rank is its position minus the
    first position of its group, so no group is sorted in one task.
    """
    order = [F.col("group_size").desc(), F.col("seed_degree").desc(), F.col("group_id"), F.col(name), F.col("image_id")]
    placed = cut_lineage(ordinal(groups, order, "_at"))
    starts = placed.groupBy("group_id").agg(F.min("_at").alias("_start"))
    ranks = ordinal(starts, [F.col("_start")], "group_rank").select("group_id", "_start", "group_rank")
    return placed.join(ranks, "group_id").withColumn("member_rank", F.col("_at") - F.col("_start")).drop("_at", "_start")


def mark_all_but_largest(groups: DataFrame, name: str) -> DataFrame:
    """``retained`` is true for each group's first member of the largest area."""
    area = F.greatest(F.lit(0), F.coalesce(F.col("width"), F.lit(0)).cast("bigint") * F.coalesce(F.col("height"), F.lit(0)))
    best = groups.groupBy("group_id").agg(F.min(F.struct((-area).alias("a"), F.col(name).alias("n"), F.col("image_id").alias("i"))).alias("b"))
    return groups.join(best.select("group_id", F.col("b.i").alias("_keep")), "group_id").withColumn("retained", F.col("image_id") == F.col("_keep")).drop("_keep")
