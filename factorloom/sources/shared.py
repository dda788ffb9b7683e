"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets a folder of its
    process; on a cluster, whose executors would not see that one, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='factorloom-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def set_shared_dir(spark: SparkSession) -> str:
    """The shared folder, set for checkpoints too."""
    found = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/factorloom/{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path; of a session that is stopped, only a local one can still be reached."""
    if spark.sparkContext._jsc is None:
        if path.startswith("file:"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def kept(rows: DataFrame, name: str = "kept") -> DataFrame:
    """rows as a table in the shared folder, which goes when the driver's Python ends: plans that use
    it several times read it instead of working it out again."""
    spark = rows.sparkSession
    path = new_path(spark, name)
    atexit.register(remove, spark, path)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Frees a kept table that no later step reads."""
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        remove(table.sparkSession, folder)
