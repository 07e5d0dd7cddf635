"""Session settings and the two cluster-facing helpers every operator shares."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def build_session(cores: int | str = "*", app: str = "lodegrid", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("LODEGRID_SHUFFLE", "8"))
        .config("spark.driver.memory", os.environ.get("LODEGRID_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a fresh local one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    fresh = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage with a written table that survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join that must not be broadcast by an estimate.

    The planner takes exploded rows to be as few as what they come from, so cells and edges of a small table seem small
    enough to go through the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of a small table dealt out over all tasks before each of them becomes many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def spread_join(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    salts: int = 16,
    spread_on: list[Column] | None = None,
) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks.

    ``small`` holds few rows per key and is repeated once per salt; ``large`` draws its salt from
    ``spread_on`` (any high-cardinality columns), so one key never lands in one task.
    """
    source = spread_on or [F.col(c) for c in large.columns]
    left = large.withColumn("_salt", F.pmod(F.xxhash64(*source), F.lit(salts)).cast("int"))
    right = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return left.join(shuffled(right), keys + ["_salt"], how).drop("_salt")
