"""Session helpers: a local session for tests, checkpoints, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that is sent whole to every executor. A side whose proven size is above
#: this is joined by shuffle instead.
MAX_BROADCAST_BYTES = 256 << 20


class InputError(ValueError):
    """The caller's table or options cannot be used; the message says why."""


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tagloom") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the session names none, a temporary one is made and recorded -- in a local session only: on a
    cluster a folder of the driver's machine is not shared, so that is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise InputError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="tagloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for rows of which later steps read some columns only."""
    path = f"{shared_dir(df.sparkSession)}/tagloom-{uuid.uuid4().hex}/stored"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, max_rows: int, bytes_per_row: int) -> DataFrame:
    """Broadcast hint only when ``max_rows`` -- a bound the caller proves -- keeps the side small.

    Otherwise the frame is returned unhinted, and Catalyst/AQE choose from real sizes.
    """
    return F.broadcast(df) if max_rows * bytes_per_row <= MAX_BROADCAST_BYTES else df


def broadcast_counted(stored: DataFrame, *texts: str) -> DataFrame:
    """Broadcast hint for a stored table whose measured size is small: its rows, and the bytes of its ``texts``.

    This runs one aggregate over the table; a larger one is returned unhinted.
    """
    lengths = [F.coalesce(F.sum(F.octet_length(F.col(c))), F.lit(0)) for c in texts]
    size = stored.agg((F.count("*") * 64).alias("rows"), *lengths).first()
    return F.broadcast(stored) if sum(size) <= MAX_BROADCAST_BYTES else stored


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two one-row frames (ungrouped aggregates) in one row."""
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")
