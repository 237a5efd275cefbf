"""Session helpers: reliable checkpoints, size-checked broadcasts, bounded windows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 200_000


# --- fixed values: runtime settings the operators are measured with -------------
RUNTIME_SETTINGS = {
    # the JVM never compiles methods above 8000 bytes of bytecode; wide projections
    # run several times faster when Spark splits them instead of fusing them
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts and images travel in Arrow batches; a Python worker holds several copies of one, so rows and bytes are bounded
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
# ---------------------------------------------------------------------------------


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; none of them changes a result."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    master may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="spark-ckpt-")
    sc.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` (with the given Parquet options) to the shared checkpoint folder and read it back.

    The table survives lost executors, and unlike an RDD checkpoint it keeps
    column pruning and gives the planner true sizes.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/frozen-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only after counting: at most ``max_rows`` rows.

    Larger inputs are returned unhinted, so the planner shuffles them.
    The count stops after ``max_rows + 1`` rows.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def look_up(df: DataFrame, table: DataFrame, key: str, uses: str, share: int = 1000) -> DataFrame:
    """``df`` left-joined with a table of one row per key, whose ``uses`` counts the rows that ``df`` has of it.

    Keys with more than 1/``share`` of the rows (so fewer than ``share`` keys)
    are broadcast, the others joined by a shuffle: no task gets a hot key. Both
    inputs are read twice.
    """
    total = table.agg(F.sum(uses).alias("n")).first()["n"] or 0
    hot = F.broadcast(table.where(F.col(uses) * share > total))
    rare = df.join(hot.select(key), key, "left_anti").join(table.where(F.col(uses) * share <= total), key, "left")
    return df.join(hot, key).unionByName(rare)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group; map-side combined, so a hot key is cheap."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("m")).first()
    return int(row["m"] or 0)
