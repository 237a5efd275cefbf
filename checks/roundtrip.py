"""Queries over files that the library wrote from the tables and reads back."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import functions as F

from checks.files import CATALOGUE, catalogue, pictures
from checks.fixtures import PLANES, table

from lumenloom.plans import pixels
from lumenloom.runtime import ensure_checkpoint_dir
from lumenloom.sources import dictionaries, scan, sinks


def _folder(spark, name):
    """A fresh folder beside the session's checkpoints, which all tasks share, as a plain path."""
    return re.sub("^file:/+", "/", os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}"))


def _body(text):
    return F.encode(text, "UTF-8")


# --- scanning a real tree ---------------------------------------------------------
def q_scan_scopes(spark, sf):
    """A tree written from the part table, scanned with each scope; archives in it cannot be read."""
    base = _folder(spark, "tree")
    files = catalogue(spark, sf).select("uri")
    caches = files.where(F.col("uri").rlike(r"^root/d4/.*\.png$")).select(F.regexp_replace("uri", r"^root/d4/s\d+/", "root/d4/.thumb_cache/").alias("uri"))
    path = F.concat(F.lit(base + "/"), "uri")
    sinks.write_named_files(files.unionByName(caches).select(path.alias("path"), _body(F.lit("x")).alias("body")))
    ignored = table(spark, sf, "part").where(F.col("p_partkey") % 13 == 0)
    k = F.col("p_partkey")
    ignored = ignored.select(F.concat(F.lit(f"{base}/root/d"), (k % 20).cast("string"), F.lit("/s"), (k % 3).cast("string"), F.lit("/"), k.cast("string"), F.lit(".png")).alias("uri"))
    found = None
    for scope in ("source", "custom", "output"):
        one = scan.scan_images(spark, f"{base}/root", scope, f"{base}/root/d3", ignored if scope == "source" else None)
        one = one.select(F.lit(scope).alias("scope"), F.replace("uri", F.lit(base + "/"), F.lit("")).alias("uri"), F.col("error").isNotNull().alias("failed"))
        found = one if found is None else found.unionByName(one)
    return found


S_SCOPES = f"""WITH {CATALOGUE}, marked AS (SELECT *, k%20=7 OR (k%20=11 AND k%3=1) AS earlier FROM files)
SELECT 'source' AS scope, CASE WHEN k%6=5 THEN 'zip://' ELSE '' END || uri AS uri, k%6=5 AS failed FROM marked WHERE NOT earlier AND k%20 NOT IN (3, 4) AND k%6 IN (0,1,4,5) AND NOT (k%6=0 AND k%13=0)
UNION ALL SELECT 'custom', uri, false FROM marked WHERE NOT earlier AND k%6 IN (0,1,4)
UNION ALL SELECT 'output', uri, false FROM marked WHERE k%6 IN (0,1,4)"""


# --- images and captions ---------------------------------------------------------------
def q_written_images(spark, sf):
    """Pictures rendered, written as files with some captions beside them, scanned, decoded and read back."""
    base = _folder(spark, "export")
    pics = pictures(spark, sf)
    whole = F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in (("x", 0), ("y", 0), ("w", 8), ("h", 8))])
    plan = pics.select("image_id").withColumns({"cut": whole, "out_w": F.lit(8), "out_h": F.lit(8), "action": F.lit("crop")})
    k = F.col("image_id")
    done = pixels.render(pics, plan, []).where("error is null")
    named = done.withColumns(
        {
            "file_name": F.concat((k % 10).cast("string"), F.lit("/"), k.cast("string"), F.lit(".png")),
            "caption": F.when(k % 3 == 0, F.concat(F.lit("été "), k.cast("string"))),
        }
    )
    sinks.write_image_files(named, base, "final")
    files = scan.with_sidecar(scan.scan_images(spark, base, "output"), scan.sidecar_captions(spark, base))
    decoded = scan.read_pixels(spark, base)

    def total(batches):
        for pdf in batches:
            pdf["total"] = [sum(image["data"]) // 3 if image["nChannels"] == 3 else -1 for image in pdf["image"]]
            yield pdf[["uri", "total"]]

    sums = decoded.select("uri", "image").mapInPandas(total, "uri string, total bigint")
    met = files.join(sums, "uri")
    return met.select(F.regexp_extract("uri", r"(\d+)[.]png$", 1).cast("bigint").alias("image_id"), F.replace("uri", F.lit(base), F.lit("")).alias("place"), "caption", "total")


S_WRITTEN = f"""WITH {PLANES} SELECT image_id, '/final/' || image_id%10 || '/' || image_id || '.png' AS place, CASE WHEN image_id%3=0 THEN 'été ' || image_id END AS caption, list_sum(plane)::BIGINT AS total FROM planes"""


def q_written_captions(spark, sf):
    """Caption files of every document; those of even ids replace older ones."""
    base = _folder(spark, "captions")
    k = F.col("doc_id")
    docs = table(spark, sf, "documents")
    at = F.concat(F.lit(base + "/"), (k % 10).cast("string"), F.lit("/"), k.cast("string")).alias("uri_stem")
    sinks.write_caption_files(docs.where(k % 2 == 0).select(at, F.lit("old").alias("caption")))
    sinks.write_caption_files(docs.select(at, F.concat(F.col("source"), F.lit(", "), F.coalesce(F.col("lang"), F.lit("?")), F.lit(", "), F.col("n_chars").cast("string")).alias("caption")))
    read = scan.sidecar_captions(spark, base)
    return read.select(F.substring_index("uri_stem", "/", -1).cast("bigint").alias("doc_id"), "caption")


S_CAPTIONS = "SELECT doc_id, source || ', ' || coalesce(lang, '?') || ', ' || n_chars AS caption FROM documents"


def q_written_summary(spark, sf):
    """Counts per source, written as a JSON summary and read back."""
    path = _folder(spark, "summary")
    docs = table(spark, sf, "documents")
    sinks.write_summary(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")), path)
    return spark.read.schema("source string, n bigint, chars bigint").json(path)


S_SUMMARY = "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1"


# --- dictionaries, metadata, presets ------------------------------------------------------
_CATEGORIES = ("general", "character", "artist")


def _tags(spark, sf):
    """Forty parts each make a dictionary file (f), numbered by their keys (i)."""
    k = F.col("p_partkey")
    category = F.element_at(F.array(*[F.lit(c) for c in _CATEGORIES]), (k % 3 + 1).cast("int"))
    return table(spark, sf, "part").select(F.floor(k / 40).alias("f"), (k % 40).cast("int").alias("i"), F.col("p_name").alias("name"), category.alias("category"))


def _joined(entries, order):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), entries.alias("e")))), lambda s: s["e"]), "\n")


def _quoted(text):
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def q_tag_files(spark, sf):
    """Dictionaries in all five forms, read back with their tags' places."""
    base = _folder(spark, "tags")
    kind = F.col("f") % 5
    entry = (
        F.when(kind == 0, _quoted(F.col("name")))
        .when(kind == 1, F.to_json(F.struct("name", "category")))
        .when(kind == 2, F.concat(F.lit('"'), F.col("i").cast("string"), F.lit('":'), F.to_json(F.struct(F.col("name").alias("tag"), "category"))))
        .when(kind == 3, F.to_csv(F.struct("i", "category", "name")))
        .otherwise(F.to_csv(F.struct("name")))
    )
    # objects are written backwards: their keys give the order
    lines = _tags(spark, sf).groupBy("f").agg(_joined(entry, F.when(kind == 2, -F.col("i")).otherwise(F.col("i"))).alias("lines"))
    listed = F.replace("lines", F.lit("\n"), F.lit(",\n"))
    text = (
        F.when(kind <= 1, F.concat(F.lit("["), listed, F.lit("]")))
        .when(kind == 2, F.concat(F.lit("{"), listed, F.lit(',"none":"x"}')))
        .when(kind == 3, F.concat(F.lit("﻿id,category,name\r\n"), F.replace("lines", F.lit("\n"), F.lit("\r\n")), F.lit("\r\n")))
        .otherwise(F.concat("lines", F.lit("\n\n")))
    )
    ending = F.when(kind <= 2, ".json").otherwise(".csv")
    sinks.write_named_files(lines.select(F.concat(F.lit(base + "/"), F.col("f").cast("string"), ending).alias("path"), _body(text).alias("body")))
    found = dictionaries.read_tag_dictionaries(spark, base)
    return found.select(F.regexp_extract("file", r"(\d+)[.]\w+$", 1).cast("bigint").alias("f"), "tag_idx", "name", "category")


_SQL_TAGS = f"tags AS (SELECT p_partkey // 40 AS f, p_partkey % 40 AS i, p_name AS name, {list(_CATEGORIES)}[p_partkey%3+1] AS category FROM part)"
S_TAG_FILES = f"WITH {_SQL_TAGS} SELECT f, (row_number() OVER (PARTITION BY f ORDER BY i) - 1)::INT AS tag_idx, name, CASE WHEN f%5 IN (0,4) THEN 'unknown' ELSE category END AS category FROM tags"


def q_metadata_files(spark, sf):
    """Model metadata with nested or flat tables and categories by name or by place."""
    base = _folder(spark, "meta")
    kind = F.col("f") % 3
    shown = F.concat("name", F.lit(" #"), F.col("i").cast("string"))  # unique in its file
    names = F.when(kind == 2, _quoted(shown)).otherwise(F.concat(F.lit('"'), F.col("i").cast("string"), F.lit('":'), _quoted(shown)))
    cats = F.when(kind == 2, _quoted(F.col("category"))).otherwise(F.when(F.col("i") % 4 > 0, F.concat(_quoted(shown), F.lit(":"), _quoted(F.col("category")))))
    packed = _tags(spark, sf).groupBy("f").agg(_joined(names, F.col("i")).alias("n"), _joined(cats, F.col("i")).alias("c"))
    n, c = (F.replace(x, F.lit("\n"), F.lit(",")) for x in ("n", "c"))
    nested = F.concat(F.lit('{"dataset_info":{"tag_mapping":{"idx_to_tag":{'), n, F.lit('},"tag_to_category":{'), c, F.lit('}},"categories":["a"]}}'))
    flat = F.concat(F.lit('{"tag_mapping":{"id_to_tag":{'), n, F.lit('},"tag2category":{'), c, F.lit("}}}"))
    lists = F.concat(F.lit('{"tags":['), n, F.lit('],"categories":['), c, F.lit("]}"))
    text = F.when(kind == 0, nested).when(kind == 1, flat).otherwise(lists)
    sinks.write_named_files(packed.select(F.concat(F.lit(base + "/"), F.col("f").cast("string"), F.lit(".json")).alias("path"), _body(text).alias("body")))
    found = dictionaries.read_model_metadata_files(spark, base)
    return found.select(F.regexp_extract("file", r"(\d+)[.]json$", 1).cast("bigint").alias("f"), "tag_idx", "name", "category")


S_METADATA = f"""WITH {_SQL_TAGS} SELECT f, (row_number() OVER (PARTITION BY f ORDER BY i) - 1)::INT AS tag_idx, name || ' #' || i AS name,
  CASE WHEN f%3=2 OR i%4>0 THEN category ELSE 'general' END AS category FROM tags"""


def q_preset_files(spark, sf):
    """Stored presets with some settings each, unknown ones among them."""
    base = _folder(spark, "presets")
    k = F.col("p_partkey")
    text = F.to_json(
        F.struct(
            (F.col("p_size") / 100).alias("threshold"),
            F.when(k % 2 == 0, F.col("p_size")).alias("max_tags"),
            F.when(k % 3 == 0, F.col("p_brand")).alias("exclude_tags"),
            F.when(k % 5 == 0, False).alias("replace_underscore"),
            F.lit("x").alias("colour"),
        )
    )
    sinks.write_named_files(table(spark, sf, "part").select(F.concat(F.lit(base + "/"), k.cast("string"), F.lit(".json")).alias("path"), _body(text).alias("body")))
    return dictionaries.read_presets(spark, base).select("threshold", "max_tags", "exclude_tags", "replace_underscore", "token_limit")


S_PRESETS = """SELECT p_size / 100 AS threshold, CASE WHEN p_partkey%2=0 THEN p_size ELSE 0 END AS max_tags, CASE WHEN p_partkey%3=0 THEN p_brand ELSE '' END AS exclude_tags,
  p_partkey%5<>0 AS replace_underscore, 75 AS token_limit FROM part"""

QUERIES = {
    "scan_scopes": (q_scan_scopes, S_SCOPES),
    "written_images": (q_written_images, S_WRITTEN),
    "written_captions": (q_written_captions, S_CAPTIONS),
    "written_summary": (q_written_summary, S_SUMMARY),
    "tag_files": (q_tag_files, S_TAG_FILES),
    "metadata_files": (q_metadata_files, S_METADATA),
    "preset_files": (q_preset_files, S_PRESETS),
}
