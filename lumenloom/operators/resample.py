"""Resampling of pixel tables: sparse filter weights joined to pixels.

For pictures that live as rows (image_id, x, y, v), for instance after other
relational steps. Each of the two passes is one equi-join with a weight table
(the same for all pictures of a size) and one sum per output pixel, so a huge
picture is spread over tasks like many small ones. Values equal those of
``functions.pixels.resize`` for bytes: weights in steps of 2^-22, half up after
each pass.

Defined cases: pixels of pictures without a row in ``sizes`` are left out;
equal sizes copy; sizes below 1 give no pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lumenloom.runtime import broadcast_if_small, cut_lineage

_STEPS = 1 << 22
TASK_VALUES = 250_000


def _lanczos(x: Column) -> Column:
    angle = x * math.pi
    wave = F.sin(angle) / angle * F.sin(angle / 3) / (angle / 3)
    return F.when(x == 0, F.lit(1.0)).when(F.abs(x) < 3, wave).otherwise(0.0)


def _triangle(x: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(x))


KERNELS = {"lanczos": (_lanczos, 3.0), "bilinear": (_triangle, 1.0)}


def filter_weights(sizes: DataFrame, kernel: str = "lanczos", steps: int | None = _STEPS) -> DataFrame:
    """(n_in, n_out, o, i, weight): the inputs of every output position for each distinct (n_in, n_out)."""
    shape, reach = KERNELS[kernel]
    ratio = F.col("n_in") / F.col("n_out")
    stretch = F.greatest(F.lit(1.0), ratio)
    centre = (F.col("o") + 0.5) * ratio
    pairs = sizes.select("n_in", "n_out").distinct().where("n_in > 0 and n_out > 0")
    spots = pairs.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n_out").cast("int") - 1))).withColumns({"_s": stretch, "_c": centre})
    first = F.greatest(F.lit(0), F.floor(F.col("_c") - reach * F.col("_s") + 0.5).cast("int"))
    last = F.least(F.col("n_in").cast("int"), F.floor(F.col("_c") + reach * F.col("_s") + 0.5).cast("int"))
    near = spots.withColumn("_i", F.sequence(first, last - 1))
    raw = F.transform("_i", lambda i: F.struct(i.alias("i"), shape((i + 0.5 - F.col("_c")) / F.col("_s")).alias("v")))
    summed = near.withColumn("_raw", raw).withColumn("_sum", F.aggregate("_raw", F.lit(0.0), lambda acc, r: acc + r["v"]))
    each = summed.select("n_in", "n_out", "o", "_sum", F.explode("_raw").alias("r"))
    weight = F.col("r.v") / F.col("_sum")
    if steps:
        weight = F.rint(weight * steps) / steps
    return each.select("n_in", "n_out", "o", F.col("r.i").alias("i"), weight.alias("weight")).where("weight <> 0")


def _pass(pixels: DataFrame, sizes: DataFrame, along: str, across: str, n_in: str, n_out: str, lines: str, kernel: str) -> DataFrame:
    """One pass, line by line: values of a line meet in one task, which holds about ``TASK_VALUES`` of them."""
    lengths = sizes.select("image_id", F.col(n_in).cast("int").alias("n_in"), F.col(n_out).cast("int").alias("n_out"), F.col(lines).cast("int").alias("_lines"))
    weights = broadcast_if_small(filter_weights(lengths, kernel))
    values = lengths.agg(F.sum(F.greatest("n_in", "n_out").cast("bigint") * F.col("_lines")).alias("n")).first()["n"] or 0
    tasks = max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(values / TASK_VALUES))
    line = F.explode(F.sequence(F.lit(0), F.col("_lines") - 1).cast(ArrayType(pixels.schema[across].dataType)))
    each = lengths.where("_lines > 0").select("image_id", "n_in", "n_out", line.alias(across)).repartition(tasks, "image_id", across)
    met = pixels.repartition(tasks, "image_id", across).join(each, ["image_id", across]).withColumnRenamed(along, "i").join(weights, ["n_in", "n_out", "i"])
    mixed = met.groupBy("image_id", across, F.col("o").alias(along)).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
    return mixed.withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(F.col("v") + 0.5).cast("double"))))


def resample(pixels: DataFrame, sizes: DataFrame, kernel: str = "lanczos") -> DataFrame:
    """(image_id, x, y, v) of every picture in ``sizes`` (image_id, width, height, out_w, out_h), across and then down."""
    sizes = cut_lineage(sizes.select("image_id", "width", "height", "out_w", "out_h"))
    wide = _pass(pixels.select("image_id", "x", "y", "v"), sizes, "x", "y", "width", "out_w", "height", kernel)
    return _pass(wide, sizes, "y", "x", "height", "out_h", "out_w", kernel).select("image_id", "x", "y", "v")
