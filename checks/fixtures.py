"""Inputs of the registered queries, derived from the given tables on Spark,
and the same derivations as DuckDB common table expressions."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenloom.runtime import tune


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(os.path.join(sf, f"{name}.parquet"))


# ---- images and crops -----------------------------------------------------
def images(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("image_id"),
        (256 + (k * 7919) % 3841).alias("width"),
        (256 + (k * 104729) % 3841).alias("height"),
        F.concat(F.lit("root/"), (k % 10).cast("string"), F.lit("/"), k.cast("string"), F.lit(".png")).alias("uri"),
    )


IMAGES = """images AS (
  SELECT p_partkey AS image_id, 256 + (p_partkey*7919)%3841 AS width, 256 + (p_partkey*104729)%3841 AS height,
         'root/' || (p_partkey%10) || '/' || p_partkey || '.png' AS uri
  FROM part)"""


def crops(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn boxes, with the size of their image. Image sizes follow from the key,
    so the rows carry them without a join, as an ingest job would denormalise them."""
    o, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    return (
        table(spark, sf, "lineitem")
        .select(
            p.alias("image_id"),
            o.alias("op"),
            n.cast("bigint").alias("crop_id"),
            (256 + (p * 7919) % 3841).alias("width"),
            (256 + (p * 104729) % 3841).alias("height"),
            F.when(F.col("l_returnflag") == "R", "texture").otherwise("full").alias("kind"),
        )
        .withColumns(
            {
                "x": (F.col("op") * 37 + F.col("crop_id") * 11) % F.col("width"),
                "y": (F.col("op") * 53 + F.col("crop_id") * 17) % F.col("height"),
                "w": F.when((F.col("op") * 7 + F.col("crop_id")) % 101 == 0, F.lit(-64)).otherwise(
                    64 + (F.col("op") * 13 + F.col("crop_id") * 29) % F.col("width")
                ),
                "h": 64 + (F.col("op") * 31 + F.col("crop_id") * 19) % F.col("height"),
            }
        )
    )


CROPS = """crop0 AS (
  SELECT l_partkey AS image_id, l_orderkey AS op, l_linenumber::BIGINT AS crop_id,
         256 + (l_partkey*7919)%3841 AS width, 256 + (l_partkey*104729)%3841 AS height,
         CASE WHEN l_returnflag='R' THEN 'texture' ELSE 'full' END AS kind
  FROM lineitem),
crops AS (
  SELECT *, (op*37+crop_id*11)%width AS x, (op*53+crop_id*17)%height AS y,
         CASE WHEN (op*7+crop_id)%101=0 THEN -64 ELSE 64+(op*13+crop_id*29)%width END AS w,
         64+(op*31+crop_id*19)%height AS h
  FROM crop0)"""


def family_sql(area: int = 1048576, step: int = 64, name: str = "fam") -> str:
    return f"""{name}_side AS (SELECT round_even(floor(sqrt({area}))/{step},0)*{step} AS s),
{name}_wide AS (
  SELECT i, s+i*{step} AS w, CASE WHEN i=0 THEN s ELSE round_even({area}/(s+i*{step})/{step},0)*{step} END AS h
  FROM {name}_side, range(0,64) t(i)),
{name}_kept AS (
  SELECT a.* FROM {name}_wide a LEFT JOIN {name}_wide b ON b.i=a.i-1
  WHERE a.h > 0 AND (a.i<=1 OR b.w/greatest(1,b.h) <= 4.5)),
{name} AS (
  SELECT bw::BIGINT AS bw, bh::BIGINT AS bh, row_number() OVER (ORDER BY bw/bh, bw) - 1 AS ord
  FROM (SELECT w AS bw, h AS bh FROM {name}_kept UNION SELECT h, w FROM {name}_kept))"""


def arb_sql(bases: list[int], lo: int = 512, hi: int = 2048, step: int = 64, name: str = "arb") -> str:
    values = ",".join(f"({b})" for b in bases)
    return f"""{name} AS (
  SELECT bw, bh, row_number() OVER (ORDER BY bw*bh, bw, bh) - 1 AS ord FROM (
    SELECT DISTINCT bw, bh FROM range({lo},{hi}+1,{step}) a(bw), range({lo},{hi}+1,{step}) b(bh), (VALUES {values}) c(base)
    WHERE abs(bw*bh-base*base)/greatest(1,base*base) <= 0.1 AND greatest(bw/bh, bh/bw) <= 2.0))"""


ASSIGNED = (
    CROPS
    + ","
    + family_sql()
    + """,
assigned AS (
  SELECT c.*, CASE WHEN w<=0 OR h<=0 THEN 64 ELSE b.bw END AS bw, CASE WHEN w<=0 OR h<=0 THEN 64 ELSE b.bh END AS bh
  FROM (SELECT *, row_number() OVER () AS rid FROM crops WHERE kind<>'texture') c,
       LATERAL (SELECT arg_min(f.bw,(abs(f.bw/f.bh - c.w/c.h), f.ord)) AS bw, arg_min(f.bh,(abs(f.bw/f.bh - c.w/c.h), f.ord)) AS bh FROM fam f) b)"""
)


# ---- planes and fingerprints of documents -----------------------------------
def _character_planes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All code points of whole texts, counted in 64 cells by their number modulo 64."""
    for pdf in batches:
        counts = [np.bincount(np.frombuffer((t or "").encode("utf-32-le"), np.uint32) % 64, minlength=64) for t in pdf["text"]]
        yield pdf[["doc_id", "source", "n_chars"]].assign(plane=[(c * 37 % 64).astype(np.float64) for c in counts])


def planes(spark: SparkSession, sf: str) -> DataFrame:
    """An 8x8 plane per document: how many code points of the whole text fall into each
    of 64 cells, spread over 0..63 so that unrelated texts give unrelated planes."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text")
    counted = docs.mapInPandas(_character_planes, "doc_id bigint, source string, n_chars bigint, plane array<double>")
    return counted.select(
        F.col("doc_id").alias("image_id"),
        F.concat(F.lit("doc/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("uri"),
        (512 + F.col("n_chars") % 512).alias("width"),
        F.lit(768).cast("bigint").alias("height"),
        "plane",
    )


PLANES = """letters AS (SELECT doc_id, unicode(c)%64 AS cell, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) GROUP BY 1,2),
cells AS (SELECT d.doc_id, list(((coalesce(l.n,0)*37)%64)::DOUBLE ORDER BY k.k) AS plane FROM documents d CROSS JOIN range(0,64) k(k) LEFT JOIN letters l ON l.doc_id=d.doc_id AND l.cell=k.k GROUP BY 1),
planes AS (
  SELECT doc_id AS image_id, 'doc/' || source || '/' || doc_id || '.png' AS uri, 512 + n_chars%512 AS width, 768 AS height, plane
  FROM documents JOIN cells USING (doc_id))"""


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Mean hash, difference hash and normalised counts of every document's plane."""
    from lumenloom.functions import hashing as H
    from lumenloom.functions.numeric import let

    def share_of(plane):
        return let(plane, lambda p: let(F.greatest(F.lit(1.0), H.mean_of(p) * 64), lambda n: F.transform(p, lambda v: v / n)))

    p = planes(spark, sf)
    return p.select(
        "image_id",
        "uri",
        F.substring_index("uri", "/", -1).alias("name"),
        H.pack_bits(H.average_bits(F.col("plane"))).alias("h1"),
        H.pack_bits(H.difference_bits(F.col("plane"), 8, 8)).alias("h2"),
        share_of(F.col("plane")).alias("color"),
        (F.col("width") / F.col("height")).alias("aspect"),
        "width",
        "height",
    )


FINGERPRINTS = (
    PLANES
    + """,
fp0 AS (SELECT *, list_sum(plane)/64 AS m FROM planes),
fp AS (SELECT image_id, uri, width, height, width/height AS aspect,
  array_to_string(list_transform(plane, lambda v: CASE WHEN v>m THEN '1' ELSE '0' END),'') AS b1,
  array_to_string(list_transform(range(1,64), lambda i: CASE WHEN i%8=0 THEN '' WHEN plane[i+1]>plane[i] THEN '1' ELSE '0' END),'') AS b2,
  list_transform(plane, lambda v: v/greatest(1.0,m*64)) AS color FROM fp0)"""
)


# ---- embeddings as planes and frames ------------------------------------------
def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("e"), "label"
    )


VECTORS = "vectors AS (SELECT vec_id AS image_id, embedding::DOUBLE[] AS e, label FROM embeddings)"


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One video per label, its vectors as frames."""
    from lumenloom.functions import hashing as H

    w = Window.partitionBy("label").orderBy("image_id")
    v = vectors(spark, sf).withColumn("frame_idx", F.row_number().over(w).cast("bigint") - 1)
    return v.select(
        F.col("label").alias("video_id"),
        "frame_idx",
        F.lit(4.0).alias("fps"),
        F.count(F.lit(1)).over(Window.partitionBy("label")).alias("total_frames"),
        F.col("e").alias("hist"),
        H.pack_bits(H.average_bits(F.col("e"))).alias("h1"),
    )


FRAMES = (
    VECTORS
    + """,
frames AS (SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY image_id) - 1 AS frame_idx, 4.0::DOUBLE AS fps,
  count(*) OVER (PARTITION BY label) AS total_frames, e AS hist FROM vectors)"""
)


# ---- model scores and captions -----------------------------------------------
def tag_dict(spark: SparkSession, sf: str) -> DataFrame:
    """One tag per vector dimension."""
    i = F.col("tag_idx")
    cats = F.array(*[F.lit(c) for c in ("general", "character", "copyright", "artist", "meta", "model", "quality", "year", "rating")])
    dims = table(spark, sf, "embeddings").select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("tag_idx")).distinct()
    return dims.select(
        "tag_idx",
        F.when(i % 16 == 15, F.concat(F.lit("rating:r"), i.cast("string")))
        .when(i % 7 == 0, F.concat(F.lit("tag_"), i.cast("string"), F.lit("_(x)")))
        .otherwise(F.concat(F.lit("tag_"), i.cast("string")))
        .alias("name"),
        F.element_at(cats, i % 9 + 1).alias("category"),
    )


def logits(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("image_id", F.transform("e", lambda v: v * 24.0 - 2.0).alias("logits"))


DICT = """dict AS (SELECT i AS tag_idx, CASE WHEN i%16=15 THEN 'rating:r' || i WHEN i%7=0 THEN 'tag_' || i || '_(x)' ELSE 'tag_' || i END AS name,
  ['general','character','copyright','artist','meta','model','quality','year','rating'][i%9+1] AS category FROM range(0,64) t(i))"""
SCORES = (
    VECTORS
    + ","
    + DICT
    + """,
allscores AS (SELECT image_id, tag_idx::INTEGER AS tag_idx, name, category, round(1/(1+exp(-greatest(-80.0::DOUBLE,least(80.0::DOUBLE, e[tag_idx+1]*24.0::DOUBLE-2.0::DOUBLE)))),6) AS conf FROM vectors, dict),
scores AS (SELECT *, CASE WHEN category='rating' THEN 'rating' WHEN category IN ('meta','year') THEN 'meta' ELSE 'tags' END AS route FROM allscores WHERE conf>0.05)"""
)


def captions(spark: SparkSession, sf: str) -> DataFrame:
    """Existing captions: every third image, every ninth of them empty."""
    i = F.col("image_id")
    return (
        images(spark, sf)
        .where(i % 3 == 0)
        .select(
            F.regexp_replace("uri", r"\.png$", "").alias("uri_stem"),
            F.when(i % 9 == 0, F.lit("")).otherwise(F.concat(F.lit(" old_"), i.cast("string"), F.lit(" "))).alias("caption"),
        )
    )


CAPTIONS = IMAGES + """,
captions AS (SELECT replace(uri,'.png','') AS uri_stem, CASE WHEN image_id%9=0 THEN '' ELSE ' old_' || image_id || ' ' END AS caption FROM images WHERE image_id%3=0)"""
