"""Plans keep the shape they were designed for."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from checks import buckets, captions, catalog
from lumenloom.operators import balance, ordered
from lumenloom.runtime import broadcast_if_small, largest_group

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [buckets.q_nearest_bucket, buckets.q_export_plan, buckets.q_texture_snap, buckets.q_smart_crop])
def test_bucket_choice_has_no_exchange(spark, query):
    assert "Exchange" not in plan(query(spark, SF))


def test_only_needed_columns_are_read(spark):
    text = plan(buckets.q_nearest_bucket(spark, SF))
    read = text.split("ReadSchema: ")[1].split(">")[0]
    assert "l_comment" not in read and "l_extendedprice" not in read and "l_orderkey" in read


def test_no_query_needs_a_cartesian_product(spark):
    for query in (buckets.q_crop_buckets, buckets.q_run_totals, captions.q_preset_captions, catalog.q_progress, catalog.q_gap):
        text = plan(query(spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_surplus_ranks_are_cut_before_the_shuffle(spark):
    rows = spark.range(1000).select(
        (F.col("id") % 5).alias("bw"), (F.col("id") % 2).alias("bh"), (F.col("id") % 9).alias("group_id"), F.col("id").alias("crop_w"), (F.col("id") % 3).alias("crop_h"), "id"
    )
    assert "WindowGroupLimit" in plan(balance.surplus_rows(rows, F.col("id")))


def test_broadcast_needs_a_checked_size(spark):
    df = spark.range(100)
    assert "BROADCAST" in broadcast_if_small(df, 100)._jdf.queryExecution().analyzed().toString().upper()
    assert "BROADCAST" not in broadcast_if_small(df, 99)._jdf.queryExecution().analyzed().toString().upper()
    assert largest_group(df.withColumn("k", F.col("id") % 3), ["k"]) == 34


def test_hot_group_is_spread_over_ranges(spark):
    df = spark.range(2000).withColumn("k", F.lit(1))
    out = ordered.row_number(df, ["k"], [F.col("id")], "n", max_rows=100)
    assert out.agg(F.countDistinct("n"), F.max("n")).first()[:] == (2000, 2000)
