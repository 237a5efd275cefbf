"""Queries about pictures that change size, have alpha or are padded, checked pixel by pixel in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks.files import pictures, plain_png
from checks.fixtures import PLANES, planes
from lumenloom.functions import pixels as P
from lumenloom.operators.resample import resample
from lumenloom.params import SimilarityOptions
from lumenloom.plans import pixels

_PX = "px AS (SELECT image_id, r.i%8 AS x, r.i//8 AS y, plane[r.i+1] AS v FROM planes, range(64) r(i))"
_X = "((i + 0.5 - (o + 0.5) * {n} / {m}) / greatest(1.0, {n} / {m}))"
_KERNEL = {
    "lanczos": (3, "CASE WHEN x = 0 THEN 1 WHEN abs(x) < 3 THEN sin(pi()*x)/(pi()*x) * sin(pi()*x/3)/(pi()*x/3) ELSE 0 END"),
    "bilinear": (1, "greatest(0.0, 1 - abs(x))"),
}


def weights(pairs, kernel="lanczos", steps=4194304, name="wt"):
    """SQL of a weight table (n_in, n_out, o, i, w) for the given sizes."""
    reach, shape = _KERNEL[kernel]
    parts = []
    for n, m in pairs:
        span = f"{reach} * greatest(1.0, {n} / {m})"
        centre = f"(o + 0.5) * {n} / {m}"
        inside = f"i >= greatest(0, floor({centre} - {span} + 0.5)) AND i < least({n}, floor({centre} + {span} + 0.5))"
        parts.append(f"SELECT {n} AS n_in, {m} AS n_out, o, i, {_X.format(n=n, m=m)} AS x FROM range({m}) a(o), range({n}) b(i) WHERE {inside}")
    rounded = f"round_even(raw / total * {steps}, 0) / {steps}" if steps else "raw / total"
    return f"""{name} AS (SELECT n_in, n_out, o, i, {rounded} AS w FROM (SELECT *, sum(raw) OVER (PARTITION BY n_in, n_out, o) AS total FROM (SELECT *, {shape} AS raw FROM ({' UNION ALL '.join(parts)}))))"""


_BYTE = "greatest(0, least(255, floor(sum(v * w) + 0.5)))"


def passes(out_w, out_h, value=_BYTE, source="px", wt="wt", w=8, h=8):
    """SQL of both passes of ``source`` (w x h) to (out_w, out_h): tables ``wide`` and ``small``."""
    return f"""wide AS (SELECT image_id, y, o AS x, {value} AS v FROM {source} JOIN {wt} ON n_in = {w} AND n_out = {out_w} AND i = x GROUP BY ALL),
small AS (SELECT image_id, o AS y, x, {value} AS v FROM wide JOIN {wt} ON n_in = {h} AND n_out = {out_h} AND i = y GROUP BY ALL)"""


_SUMS = "count(*) AS n, sum(v)::BIGINT AS total, sum(v * (y * {w} + x + 1))::BIGINT AS placed"


def _png_sums(done, channels=1):
    """(image_id, n, total, placed) of PNG bytes: number of values, their sum, and their sum by place."""

    def sums(batches):
        for pdf in batches:
            rows = []
            for image_id, png in zip(pdf["image_id"], pdf["png"]):
                v = plain_png(png)[:, :, :channels].astype(np.int64)
                rows.append((image_id, v.size, int(v.sum()), int((v.ravel() * np.arange(1, v.size + 1)).sum())))
            yield pd.DataFrame(rows, columns=["image_id", "n", "total", "placed"])

    return done.select("image_id", "png").mapInPandas(sums, "image_id bigint, n bigint, total bigint, placed bigint")


def _rendered(spark, sf, out_w, out_h, action):
    pics = pictures(spark, sf)
    whole = F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in (("x", 0), ("y", 0), ("w", 8), ("h", 8))])
    plan = pics.select("image_id").withColumns({"cut": whole, "out_w": out_w, "out_h": out_h, "action": F.lit(action)})
    return _png_sums(pixels.render(pics, plan, []).where("error is null"))


def _by_parity(even, odd):
    return F.when(F.col("image_id") % 2 == 0, even).otherwise(odd)


def q_lanczos(spark, sf):
    """Pictures resized by the export job, smaller and larger, read back from their PNG bytes."""
    return _rendered(spark, sf, _by_parity(5, 11), _by_parity(6, 10), "resize")


_LANCZOS = f"""WITH {PLANES}, {_PX}, {weights([(8, 5), (8, 6), (8, 11), (8, 10)])},
{passes("CASE WHEN image_id%2=0 THEN 5 ELSE 11 END", "CASE WHEN image_id%2=0 THEN 6 ELSE 10 END")}"""
S_LANCZOS = f"{_LANCZOS} SELECT image_id, {_SUMS.format(w='(CASE WHEN image_id%2=0 THEN 5 ELSE 11 END)')} FROM small GROUP BY 1"


def q_resampled_table(spark, sf):
    """The same as a table of pixels, resampled by joins with weights."""
    p = planes(spark, sf)
    px = p.select("image_id", F.posexplode("plane").alias("k", "v")).select("image_id", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), "v")
    sizes = p.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), _by_parity(5, 11).alias("out_w"), _by_parity(6, 10).alias("out_h"))
    return resample(px, sizes).select("image_id", "x", "y", F.col("v").cast("bigint").alias("v"))


S_RESAMPLED = f"{_LANCZOS} SELECT image_id, x::INT AS x, y::INT AS y, v::BIGINT AS v FROM small"


def q_linear_light(spark, sf):
    """Pictures shrunk by the export job in linear light."""
    return _rendered(spark, sf, F.lit(5), F.lit(6), "downsample")


_LIGHT = "(CASE WHEN {b}/255.0::DOUBLE <= 0.04045 THEN {b}/255.0::DOUBLE/12.92 ELSE pow(({b}/255.0::DOUBLE+0.055)/1.055, 2.4) END)"
S_LIGHT = f"""WITH {PLANES}, px AS (SELECT image_id, r.i%8 AS x, r.i//8 AS y, {_LIGHT.format(b='plane[r.i+1]')} AS v FROM planes, range(64) r(i)),
{weights([(8, 5), (8, 6)], steps=0)}, {passes(5, 6, 'sum(v * w)')},
begins AS (SELECT list({_LIGHT.format(b='(k-0.5)')} ORDER BY k) AS b FROM range(1, 256) t(k)),
bytes AS (SELECT image_id, x, y, len(list_filter(b, lambda s: s <= v)) AS v FROM small, begins)
SELECT image_id, {_SUMS.format(w=5)} FROM bytes GROUP BY 1"""


def _mixed_channels(spark, sf):
    """Pictures with colour and alpha, grey and alpha, and plain grey, in the layout of Spark's image source (BGRA)."""
    p = planes(spark, sf).select("image_id", "plane")

    def paint(batches):
        for pdf in batches:
            rows = []
            for k, plane in zip(pdf["image_id"], pdf["plane"]):
                v = np.asarray(plane).astype(np.int64)
                kinds = {0: [v, v + 85, v * 3, v * 7 + k], 1: [v, v * 5], 2: [v]}
                parts = kinds[k % 3]
                rows.append((k, len(parts), (np.stack(parts, axis=1) % 256).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "n", "data"])

    drawn = p.mapInPandas(paint, "image_id bigint, n int, data binary")
    return drawn.select("image_id", F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("n").alias("nChannels"), "data").alias("image"))


def q_alpha(spark, sf):
    """Transparent pictures come out on white."""
    pics = _mixed_channels(spark, sf)
    whole = F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in (("x", 0), ("y", 0), ("w", 8), ("h", 8))])
    plan = pics.select("image_id").withColumns({"cut": whole, "out_w": F.lit(8), "out_h": F.lit(8), "action": F.lit("crop")})
    return _png_sums(pixels.render(pics, plan, []).where("error is null"), 3)


def _on_white(c, a):
    return f"((((({c})*({a})+255*(255-({a}))+128)>>8) + (({c})*({a})+255*(255-({a}))+128))>>8)"


S_ALPHA = f"""WITH {PLANES}, p AS (SELECT image_id, r.i AS i, plane[r.i+1]::BIGINT AS v FROM planes, range(64) r(i)),
c AS (SELECT image_id, i, CASE image_id%3 WHEN 0 THEN [(v*3)%256, (v+85)%256, v%256] ELSE [v%256, v%256, v%256] END AS c,
  CASE image_id%3 WHEN 0 THEN (v*7+image_id)%256 WHEN 1 THEN (v*5)%256 ELSE 255 END AS a FROM p),
w AS (SELECT image_id, i*3 + k AS place, {_on_white('c[k]', 'a')} AS v FROM c, range(1, 4) t(k))
SELECT image_id, count(*) AS n, sum(v)::BIGINT AS total, sum(v*place)::BIGINT AS placed FROM w GROUP BY 1"""


def _bright(spark, sf):
    """The planes as grey pictures four times as bright, which fills all levels of a colour signature."""

    def paint(batches):
        for pdf in batches:
            data = [(np.asarray(v) * 4).astype(np.uint8).tobytes() for v in pdf["plane"]]
            yield pd.DataFrame({"image_id": pdf["image_id"], "uri": pdf["uri"], "data": data})

    drawn = planes(spark, sf).select("image_id", "uri", "plane").mapInPandas(paint, "image_id bigint, uri string, data binary")
    return drawn.select("image_id", "uri", F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), "data").alias("image"))


def q_resized_fingerprints(spark, sf):
    """Difference hash and colour signature of pictures that must be enlarged for them."""
    o = SimilarityOptions(method="dhash", require_dual_hash=False, color_distance_max=1.0)
    fp = pixels.fingerprints(_bright(spark, sf), o)
    return fp.select("image_id", F.lpad(F.bin("h1"), 64, "0").alias("bits"), F.transform("color", lambda v: F.round(v * 1024).cast("bigint")).alias("bins").cast("string").alias("bins"))


S_RESIZED_FP = f"""WITH {PLANES}, px AS (SELECT image_id, r.i%8 AS x, r.i//8 AS y, plane[r.i+1]*4 AS v FROM planes, range(64) r(i)), {weights([(8, 9)])}, {weights([(8, 32)], "bilinear", name="wb")},
grey AS (SELECT image_id, x, y, (v*65536 + 32768)::BIGINT >> 16 AS v FROM px),
nine AS (SELECT image_id, y, o AS x, {_BYTE} AS v FROM grey JOIN wt ON i = x GROUP BY ALL),
hash AS (SELECT a.image_id, string_agg(CASE WHEN b.v > a.v THEN '1' ELSE '0' END, '' ORDER BY a.y, a.x) AS bits FROM nine a JOIN nine b ON a.image_id = b.image_id AND a.y = b.y AND b.x = a.x + 1 GROUP BY 1),
{passes(32, 32, wt="wb")}, level AS (SELECT image_id, least(3, floor(v / 64))::INT AS l, count(*) AS n FROM small GROUP BY ALL),
bins AS (SELECT image_id, '[' || (SELECT string_agg(coalesce(n, 0)::VARCHAR, ', ' ORDER BY k) FROM range(64) t(k) LEFT JOIN level l ON l.image_id = p.image_id AND l.l * 21 = k) || ']' AS bins FROM planes p)
SELECT image_id, bits, bins FROM hash JOIN bins USING (image_id)"""


def _flat_pictures(spark, sf):
    """The upper half of each plane: eight wide, four tall."""
    pics = pictures(spark, sf)
    return pics.select("image_id", F.struct(F.lit(4).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.expr("substring(image.data, 1, 32)").alias("data")).alias("image"))


def _tensor_sums(t, back):
    """Total and sum by place of each channel's 64 values, after ``back`` undid the scaling of channel c."""

    def sums(c):
        values = F.transform(F.slice("tensor", 64 * c + 1, 64), lambda v, i: F.struct(back(v.cast("double"), c).alias("v"), (i + 1).alias("n")))
        yield F.round(F.aggregate(values, F.lit(0.0), lambda acc, s: acc + s["v"])).cast("bigint").alias(f"t{c}")
        yield F.round(F.aggregate(values, F.lit(0.0), lambda acc, s: acc + s["v"] * s["n"])).cast("bigint").alias(f"p{c}")

    return t.select("image_id", *[column for c in range(3) for column in sums(c)])


def q_padded_inputs(spark, sf):
    """Letterboxed inputs of flat pictures: two black rows above and below."""
    t = pixels.model_inputs(_flat_pictures(spark, sf), "letterbox", 8)
    return _tensor_sums(t, lambda v, c: (v * P.IMAGENET_STD[c] + P.IMAGENET_MEAN[c]) * 255.0)


def q_channels_first_inputs(spark, sf):
    """Square inputs of flat pictures, channels first and between 0 and 1: two white rows above and below."""
    return _tensor_sums(pixels.model_inputs(_flat_pictures(spark, sf), "square_nchw", 8), lambda v, c: v * 255.0)


_PADDED = f"""WITH {PLANES}, v AS (SELECT image_id, list_sum(list_transform(range(32), lambda i: plane[i+1]))::BIGINT AS t,
  list_sum(list_transform(range(32), lambda i: plane[i+1] * (i + 17)))::BIGINT AS p FROM planes)"""
S_PADDED = f"{_PADDED} SELECT image_id, t AS t0, p AS p0, t AS t1, p AS p1, t AS t2, p AS p2 FROM v"
_WHITE = 255 * sum(i + 1 for i in range(64) if not 16 <= i < 48)
S_FIRST = f"{_PADDED} SELECT image_id, t + {255 * 32} AS t0, p + {_WHITE} AS p0, t + {255 * 32} AS t1, p + {_WHITE} AS p1, t + {255 * 32} AS t2, p + {_WHITE} AS p2 FROM v"


def q_missing_thumbnails(spark, sf):
    """Thumbnails of pictures that have none under their key yet."""
    pics = pictures(spark, sf).withColumn("mtime", F.timestamp_seconds("image_id"))
    have = pixels.thumbnails(pics.where(F.col("image_id") % 4 == 0), side=5).select("thumb_key")
    made = pixels.thumbnails(pics, have, side=5)
    ids = F.regexp_extract("uri", r"(\d+)[.]png$", 1).cast("bigint")
    return _png_sums(made.select(ids.alias("image_id"), "png"))


S_MISSING = f"WITH {PLANES}, {_PX}, {weights([(8, 5)])}, {passes(5, 5)} SELECT image_id, {_SUMS.format(w=5)} FROM small WHERE image_id%4<>0 GROUP BY 1"


def q_texture_pixels(spark, sf):
    """Native pixels of snapped texture crops; crops without status ok and crops over the edge give none."""
    pics = pictures(spark, sf)
    k = F.col("image_id")
    snap = F.struct((k % 3).alias("x"), (k % 2).alias("y"), F.lit(4).cast("bigint").alias("w"), F.when(k % 7 == 0, 9).otherwise(4).cast("bigint").alias("h"))
    plan = pics.select("image_id").withColumns({"snap": snap, "status": F.when(k % 5 == 0, "failed").otherwise("ok")})
    return _png_sums(pixels.render_textures(pics, plan, []).where("error is null"))


S_TEXTURES = f"""WITH {PLANES}, {_PX} SELECT image_id, count(*) AS n, sum(v)::BIGINT AS total, sum(v * ((y - image_id%2) * 4 + x - image_id%3 + 1))::BIGINT AS placed
FROM px WHERE image_id%5<>0 AND image_id%7<>0 AND x - image_id%3 BETWEEN 0 AND 3 AND y - image_id%2 BETWEEN 0 AND 3 GROUP BY 1"""

QUERIES = {
    "lanczos_pixels": (q_lanczos, S_LANCZOS),
    "resampled_table": (q_resampled_table, S_RESAMPLED),
    "linear_light_shrink": (q_linear_light, S_LIGHT),
    "alpha_pixels": (q_alpha, S_ALPHA),
    "resized_fingerprints": (q_resized_fingerprints, S_RESIZED_FP),
    "padded_inputs": (q_padded_inputs, S_PADDED),
    "channels_first_inputs": (q_channels_first_inputs, S_FIRST),
    "missing_thumbnails": (q_missing_thumbnails, S_MISSING),
    "texture_pixels": (q_texture_pixels, S_TEXTURES),
}
