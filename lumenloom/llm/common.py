"""Helpers shared by the text operators: bounded Arrow batches and per-text columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.runtime import cut_lineage, tune

#: Spark type of a new column -> Arrow type sent back for it
ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings, with Arrow batches bounded by rows and bytes."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def fold(key: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def per_text(
    docs: DataFrame,
    text: str,
    make: Callable[[], Callable[[list[bytes | None]], dict[str, list]]],
    fields: dict[str, str],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from the UTF-8 bytes of ``text``; no shuffle.

    ``make()`` runs once per task and returns a function from a list of texts
    (None for null) to one list per new column. ``keep`` names the columns to
    carry along (default: all); a kept column whose name is in ``fields`` is
    replaced.
    """
    prepare(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c not in fields]
    plain = [f"c{i}" for i in range(len(names))]  # any name is fine inside, dots and helpers' names included
    narrow = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain)], F.col(f"`{text}`").cast("string").cast("binary").alias("bytes"))
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]], *[f"n{i} {v}" for i, v in enumerate(fields.values())]])
    kinds = {k: ARROW[v] for k, v in fields.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            new = work(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(new[k], kinds[k]) for k in kinds]], names=[*plain, *[f"n{i}" for i in range(len(kinds))]]
            )

    return narrow.mapInArrow(run, schema).toDF(*names, *fields)


def deflated(df: DataFrame, column: str = "data") -> DataFrame:
    """Deflate a binary column before its rows are shuffled; ``zlib.decompress`` undoes it."""
    names = df.columns
    at = names.index(column)

    def run(batches):
        for b in batches:
            small = pa.array([zlib.compress(x.as_py(), 1) for x in b.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([small if i == at else c for i, c in enumerate(b.columns)], names=names)

    return df.mapInArrow(run, df.schema)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers of which ``repartition(n, key)`` puts exactly one into each partition.

    Dealing slices out by their bare numbers would leave some partitions with
    several and others with none.
    """
    ids = spark.range(0, 40 * n + 400).select(F.col("id").cast("int").alias("k"))
    rows = ids.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()  # n rows
    keys = [r["k"] for r in rows]
    spare = (k for k in range(-1, -n - 1, -1))  # only if a partition was missed, which costs evenness alone
    return sorted(keys) + [next(spare) for _ in range(n - len(keys))]


__all__ = ["ARROW", "cut_lineage", "deflated", "even_keys", "fold", "per_text", "prepare"]
