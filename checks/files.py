"""Queries about catalogues, archives and pixel jobs, on files and images made from the tables inside Spark."""

from __future__ import annotations

import io
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks.fixtures import FINGERPRINTS, IMAGES, PLANES, images, planes, table
from lumenloom.functions import pixels as P
from lumenloom.params import SimilarityOptions
from lumenloom.plans import pixels
from lumenloom.sources import scan


def catalogue(spark, sf):
    """Image and other files in nested folders, two of them left by earlier runs."""
    k = F.col("p_partkey")
    folder = F.concat(F.lit("root/d"), (k % 20).cast("string"), F.lit("/s"), (k % 3).cast("string"))
    ext = F.element_at(F.array(*[F.lit(e) for e in ("png", "JPG", "txt", "mp4", "webp", "zip")]), (k % 6 + 1).cast("int"))
    parts = table(spark, sf, "part")
    files = parts.select(F.concat(folder, F.lit("/"), k.cast("string"), F.lit("."), ext).alias("uri"))
    marks = parts.where((k % 20 == 7) | ((k % 20 == 11) & (k % 3 == 1)))
    at = F.when(k % 20 == 7, F.lit("root/d7")).otherwise(folder)
    return files.unionByName(marks.select(F.concat(at, F.lit("/session_state.json")).alias("uri")).distinct())


CATALOGUE = """files AS (SELECT p_partkey AS k, 'root/d' || (p_partkey%20) || '/s' || (p_partkey%3) AS folder,
  'root/d' || (p_partkey%20) || '/s' || (p_partkey%3) || '/' || p_partkey || '.' || ['png','JPG','txt','mp4','webp','zip'][p_partkey%6+1] AS uri FROM part),
kept AS (SELECT * FROM files WHERE k%20<>7 AND NOT (k%20=11 AND k%3=1) AND k%20<>3)"""


def q_pruned(spark, sf):
    kept = scan.pruned(catalogue(spark, sf), "root", output_dir="root/d3")
    return kept.where(scan.is_image(F.col("uri"))).select("uri")


S_PRUNED = f"WITH {CATALOGUE} SELECT uri FROM kept WHERE k%6 IN (0,1,4)"


def q_media_split(spark, sf):
    uri = F.col("uri")
    kind = F.when(scan.is_image(uri), "image").when(scan.is_video(uri), "video").otherwise("other")
    return catalogue(spark, sf).where(~uri.endswith(".json")).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


S_MEDIA = f"WITH {CATALOGUE} SELECT CASE WHEN k%6 IN (0,1,4) THEN 'image' WHEN k%6=3 THEN 'video' ELSE 'other' END AS kind, count(*) AS n FROM files GROUP BY 1"


def _archives(batches):
    for pdf in batches:
        bodies = []
        for k in pdf["image_id"]:
            if k % 11 == 0:
                bodies.append(b"not an archive")
                continue
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("readme.txt", "x")
                for i in range(k % 4):
                    z.writestr(f"in/{i}.{'PNG' if i % 2 else 'jpg'}", "x")
            bodies.append(out.getvalue())
        yield pd.DataFrame({"uri": pdf["uri"], "content": bodies})


def q_zip_entries(spark, sf):
    zips = images(spark, sf).select("image_id", F.concat("uri", F.lit(".zip")).alias("uri")).mapInPandas(_archives, "uri string, content binary")
    return scan.zip_entries(zips).select("uri", F.col("error").isNotNull().alias("failed"))


S_ZIP = f"""WITH {IMAGES}, z AS (SELECT image_id, unnest(range(0,image_id%4)) AS i, uri FROM images WHERE image_id%11<>0)
SELECT 'zip://' || uri || '.zip::in/' || i || CASE WHEN i%2=1 THEN '.PNG' ELSE '.jpg' END AS uri, false AS failed FROM z
UNION ALL SELECT 'zip://' || uri || '.zip', true FROM images WHERE image_id%11=0"""


def plain_png(data: bytes) -> np.ndarray:
    """Channels of an 8-bit PNG whose rows are stored as they are, which is how the library writes them."""
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    w, h, n = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), {0: 1, 2: 3, 4: 2, 6: 4}[head[9]]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(h, w, n)


def pictures(spark, sf):
    """Every document's plane as an 8x8 grey image in the layout of Spark's image source."""
    p = planes(spark, sf).select("image_id", "uri", "plane")

    def paint(batches):
        for pdf in batches:
            grey = [np.asarray(v).astype(np.uint8).tobytes() for v in pdf["plane"]]
            yield pd.DataFrame({"image_id": pdf["image_id"], "uri": pdf["uri"], "data": grey})

    drawn = p.mapInPandas(paint, "image_id bigint, uri string, data binary")
    side = F.lit(8)
    return drawn.select("image_id", "uri", F.struct(side.alias("height"), side.alias("width"), F.lit(1).alias("nChannels"), F.col("data")).alias("image"))


def q_image_fingerprints(spark, sf):
    """The pixel job's mean hash equals the expression's on images that need no resizing."""
    fp = pixels.fingerprints(pictures(spark, sf), SimilarityOptions(method="average"))
    bits = F.lpad(F.bin("h1"), 64, "0")
    return fp.select("image_id", bits.alias("bits"), F.col("width").cast("bigint").alias("width"), "aspect", "name")


S_IMAGE_FP = f"WITH {FINGERPRINTS} SELECT image_id, b1 AS bits, 8::BIGINT AS width, 1.0::DOUBLE AS aspect, image_id || '.png' AS name FROM fp"


def q_native_pixels(spark, sf):
    """Native crops through the export job, read back from their PNG bytes."""
    pics = pictures(spark, sf)
    k = F.col("image_id")
    cut = F.struct((k % 4).alias("x"), (k % 3).alias("y"), F.lit(4).cast("bigint").alias("w"), F.lit(5).cast("bigint").alias("h"))
    size = {"out_w": F.lit(4).cast("bigint"), "out_h": F.lit(5).cast("bigint"), "action": F.lit("crop"), "cut": cut}
    plan = table(spark, sf, "documents").select(F.col("doc_id").alias("image_id")).withColumns(size)

    def total(batches):
        for pdf in batches:
            sums = [int(plain_png(b)[:, :, 0].astype(np.int64).sum()) for b in pdf["png"]]
            yield pd.DataFrame({"image_id": pdf["image_id"], "total": sums})

    done = pixels.render(pics, plan, ["out_w"]).where("error is null")
    return done.select("image_id", "png").mapInPandas(total, "image_id bigint, total bigint")


S_NATIVE = f"""WITH {PLANES} SELECT image_id, list_sum(list_transform(range(0,20), lambda i: plane[(image_id%3+i//4)*8+(image_id%4+i%4)+1]))::BIGINT AS total FROM planes"""


def q_model_inputs(spark, sf):
    """Letterboxed inputs of every picture, brought back to the sum of its pixels per channel."""
    t = pixels.model_inputs(pictures(spark, sf), "letterbox", 8)

    def total(c):
        back = F.aggregate(F.slice("tensor", 64 * c + 1, 64), F.lit(0.0), lambda acc, v: acc + (v * P.IMAGENET_STD[c] + P.IMAGENET_MEAN[c]) * 255.0)
        return F.round(back).cast("bigint").alias(f"c{c}")

    return t.select("image_id", *[total(c) for c in range(3)])


def q_area_thumbnails(spark, sf):
    """Every picture as a frame, shrunk to 4x4 by averaging, read back from its PNG bytes."""
    frames = pictures(spark, sf).select((F.col("image_id") % 5).alias("video_id"), F.col("image_id").alias("frame_idx"), "image")

    def total(batches):
        for pdf in batches:
            sums = [int(plain_png(b)[:, :, 0].astype(np.int64).sum()) for b in pdf["png"]]
            yield pd.DataFrame({"image_id": pdf["frame_idx"], "total": sums})

    return pixels.frame_thumbnails(frames, 4).select("frame_idx", "png").mapInPandas(total, "image_id bigint, total bigint")


def q_square_inputs(spark, sf):
    """Square inputs of half the pictures' side, summed per channel."""
    t = pixels.model_inputs(pictures(spark, sf), "square", 4)
    back = [F.aggregate(F.slice(F.transform("tensor", lambda v: v.cast("double")), 1, 48), F.lit(0.0), lambda acc, v: acc + v).cast("bigint").alias("total")]
    return t.select("image_id", *back)


_QUARTERS = "list_sum(list_transform(range(0,16), lambda i: round_even((plane[(i//4)*16+(i%4)*2+1]+plane[(i//4)*16+(i%4)*2+2]+plane[(i//4)*16+(i%4)*2+9]+plane[(i//4)*16+(i%4)*2+10])/4, 0)))::BIGINT"
S_THUMBS = f"WITH {PLANES} SELECT image_id, {_QUARTERS} AS total FROM planes"
S_SQUARE = f"WITH {PLANES} SELECT image_id, 3*{_QUARTERS} AS total FROM planes"

S_INPUTS = f"WITH {PLANES}, m AS (SELECT image_id, list_sum(plane)::BIGINT AS v FROM planes) SELECT image_id, v AS c0, v AS c1, v AS c2 FROM m"

QUERIES = {
    "pruned_catalogue": (q_pruned, S_PRUNED),
    "media_split": (q_media_split, S_MEDIA),
    "zip_entries": (q_zip_entries, S_ZIP),
    "image_fingerprints": (q_image_fingerprints, S_IMAGE_FP),
    "native_pixels": (q_native_pixels, S_NATIVE),
    "area_thumbnails": (q_area_thumbnails, S_THUMBS),
    "square_inputs": (q_square_inputs, S_SQUARE),
    "model_inputs": (q_model_inputs, S_INPUTS),
}
