"""Perceptual hashes, colour signatures and distances over pixel arrays.

Hashes are 64-bit BIGINTs; the first element of a row-major plane is the most
significant bit. Everything but the DCT is a built-in expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lumenloom.functions.numeric import let
from lumenloom.functions.pixels import perceptual_bits

HASH_METHODS = ("phash", "dhash", "whash", "average")


def primary_method(method: str) -> str:
    """Unknown names mean the perceptual hash."""
    return method if method in HASH_METHODS else "phash"


def secondary_method(method: str) -> str:
    return "phash" if primary_method(method) == "dhash" else "dhash"


def pack_bits(bits: Column) -> Column:
    """Array of booleans to one BIGINT by shifting, which cannot overflow."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        bits, zero, lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    )


def bit_string(bits: Column) -> Column:
    return F.array_join(F.transform(bits, lambda b: F.when(b, F.lit("1")).otherwise(F.lit("0"))), "")


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def median_of(values: Column) -> Column:
    def middle(ranked: Column) -> Column:
        n = F.size(ranked)
        low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
        return (F.element_at(ranked, low) + F.element_at(ranked, high)) / 2.0

    return let(F.array_sort(values), middle)


def _above(values: Column, level: Callable[[Column], Column]) -> Column:
    return let(values, lambda p: let(level(p), lambda m: F.transform(p, lambda v: v > m)))


def average_bits(plane: Column) -> Column:
    return _above(plane, mean_of)


def median_bits(plane: Column) -> Column:
    return _above(plane, median_of)


def difference_bits(plane: Column, rows: int, cols: int) -> Column:
    """Right neighbour brighter than left; (cols - 1) bits per row."""
    cells = F.array(*[F.lit(r * cols + c + 1) for r in range(rows) for c in range(cols - 1)])
    return let(plane, lambda p: F.transform(cells, lambda i: F.element_at(p, i + 1) > F.element_at(p, i)))


def block_means(plane: Column, side: int) -> Column:
    """8x8 block means of a square plane whose side is a power of two (Haar low band up to scale)."""
    b = max(1, side // 8)
    offsets = F.array(*[F.lit(i * side + j) for i in range(b) for j in range(b)])
    starts = F.array(*[F.lit(r * b * side + c * b + 1) for r in range(8) for c in range(8)])

    def mean_at(p: Column, s: Column) -> Column:
        return F.aggregate(offsets, F.lit(0.0), lambda acc, o: acc + F.element_at(p, s + o)) / F.lit(float(b * b))

    return let(plane, lambda p: F.transform(starts, lambda s: mean_at(p, s)))


def with_perceptual_hash(df: DataFrame, plane: str, out: str) -> DataFrame:
    """Replace 32x32 luminance planes by their DCT hash, one matrix product per Arrow batch."""
    kept = [c for c in df.columns if c != plane]

    def hash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf[plane].notna().to_numpy()
            bits = pd.array([None] * len(pdf), dtype="Int64")
            if known.any():
                stack = np.stack(pdf.loc[known, plane].to_list()).astype(np.float64).reshape(-1, 32, 32)
                bits[known] = perceptual_bits(stack)
            yield pdf[kept].assign(**{out: bits})

    return df.mapInPandas(hash_batches, df.select(*kept).schema.add(out, LongType()))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def color_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, v: acc + v)


def color_distance_unrolled(a: str, b: str, bins: int = 64) -> Column:
    """The same distance of two named columns of fixed length, as compiled arithmetic."""
    return F.expr(" + ".join(f"abs({a}[{i}] - {b}[{i}])" for i in range(bins)))


def color_signature(pixels: DataFrame, key: str, bins: int = 4) -> DataFrame:
    """Normalised RGB histogram of long-form pixels (key, r, g, b).

    Bins are counted map-side first, so an image with most of the pixels costs
    at most bins cubed rows per task in the shuffle.
    """
    step = 256 // bins

    def level(c: str) -> Column:
        return F.least(F.floor(F.col(c) / step), F.lit(bins - 1))

    bin_no = ((level("r") * bins + level("g")) * bins + level("b")).cast("int")
    counts = pixels.groupBy(key, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # at most bins^3 entries per image from here on
    per_image = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"))
    slots = F.sequence(F.lit(0), F.lit(bins**3 - 1))
    return per_image.select(
        key, F.transform(slots, lambda k: F.coalesce(F.col("m")[k], F.lit(0)) / F.col("total")).alias("color")
    )


def histogram_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over bins; two flat histograms correlate perfectly.

    Min-max scaling before the comparison would not change the result.
    """

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)

    def centred(values: Column) -> Column:
        return let(values.cast("array<double>"), lambda p: let(mean_of(p), lambda m: F.transform(p, lambda v: v - m)))

    def pearson(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        spread = total(F.transform(x, lambda v: v * v)) * total(F.transform(y, lambda v: v * v))
        cov = total(F.zip_with(x, y, lambda u, v: u * v))
        return F.when(spread > 0, cov / F.sqrt(spread)).otherwise(F.lit(1.0))

    both = let(F.struct(centred(a).alias("x"), centred(b).alias("y")), pearson)
    return F.when(a.isNotNull() & b.isNotNull(), both)
