"""Cutting the lineage of loops by tables in the shared folder.

A table read back has the size of its files, so plans of later rounds are estimated afresh; a checkpointed frame would
keep the estimate of its plan, which multiplies with every join of a loop.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}  # folders of our own, by application


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="pixelspark-"))
    return found.rstrip("/")


def tabled(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/pixelspark-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._table = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete a table made by tabled(); nothing may read it afterwards."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._table)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that is there and empty, in the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pixelspark-{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return str(path)
