"""Cutting lineage with tables in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FEWER = 4  # shuffle partitions that make one file of a small table


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Only a local session may go without one: its executors are this machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="concord-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str, row_group_mb: int | None = None, small: bool = False) -> DataFrame:
    """Write the table and read it back, so that what is built on it reads files; they go when the driver ends.

    A ``small`` table, of a few numbers a row, is written in fewer files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if small:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // FEWER))
    writer = df.write
    if row_group_mb:
        writer = writer.option("parquet.block.size", row_group_mb << 20).option("compression", "zstd")
    writer.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
