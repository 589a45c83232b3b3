"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from postloom.shipping import ship


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (tests), under a temporary folder. With its scheme, so that
    workers find it without Spark's settings. Ships the package on the way."""
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="postloom-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    full = full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full
    return f"{full.rstrip('/')}/postloom-{uuid.uuid4().hex}"


def keep(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: cuts lineage, survives lost executors, is computed once."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
