"""Duplicate groups end to end: fingerprints, pairs, strict groups, retained set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.operators.clustering import (
    clique_clusters,
    connected_components,
    expand_groups,
    mark_all_but_largest,
    rank_groups,
)
from lumenloom.operators.similarity import chaining_links, collapse_copies, similar_pairs
from lumenloom.params import SimilarityOptions
from lumenloom.runtime import cut_lineage

FingerprintProvider = Callable[[DataFrame], DataFrame]


def duplicate_groups(
    images: DataFrame, o: SimilarityOptions, provider: FingerprintProvider | None = None, **limits: int
) -> DataFrame:
    """Strict groups: every two members pass the pair test.

    ``images`` holds fingerprints, or anything a ``provider`` turns into them
    (image_id, name, h1, h2, color, aspect, width, height). Returns one row per
    member: group_id (its seed), group_size, group_rank, member_rank.
    """
    fp = provider(images) if provider else images
    fp = cut_lineage(fp)
    reps, membership = collapse_copies(fp.where(F.col("aspect") > 0))
    reps = cut_lineage(reps)
    pairs = cut_lineage(similar_pairs(reps, o, frozen=True, **{k: v for k, v in limits.items() if k == "hot_rows"}))
    clusters = clique_clusters(reps, pairs, **{k: v for k, v in limits.items() if k == "component_edges"})
    groups = expand_groups(clusters, membership)
    return rank_groups(groups.join(fp.select("image_id", "name", "width", "height"), "image_id"), "name")


def transitive_groups(fingerprints: DataFrame, threshold: int = 15) -> DataFrame:
    """Groups linked by chains of near hashes alone: (image_id, component), singles left out."""
    fp = fingerprints.select("image_id", "h1", F.lit(None).cast("bigint").alias("h2"), F.lit(None).cast("array<double>").alias("color"), F.lit(1.0).alias("aspect"))
    reps, membership = collapse_copies(cut_lineage(fp))
    reps = cut_lineage(reps)
    comp = connected_components(chaining_links(reps.select("image_id", "h1"), threshold))
    linked = membership.join(comp.withColumnRenamed("image_id", "rep_id"), "rep_id", "left")
    placed = linked.select("image_id", F.coalesce(F.col("component"), F.col("rep_id")).alias("component"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return placed.join(sizes, "component")


def retained_images(fingerprints: DataFrame, groups: DataFrame) -> DataFrame:
    """All images but those a group marks for removal."""
    marked = mark_all_but_largest(groups, "name").where(~F.col("retained")).select("image_id")
    return fingerprints.join(marked, "image_id", "left_anti")
