"""Written tables between the steps of an operator, on the storage that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tagloom.session import shared_dir


ROW_GROUP = 8 << 20
#: with this a query's shuffle files go when it is done, not when the driver happens to collect its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/tagloom-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    The table is what later steps read, so lost executors cost no recomputation, and the shuffle files behind it are
    not needed any more.  Row groups are small, because every open writer holds one in memory.  An operator drops what it does not need any more with `discard`; the
    rest goes with the shared folder, which the operator of the cluster clears.
    """
    path = new_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that `staged` has written and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
