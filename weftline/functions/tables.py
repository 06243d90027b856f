"""Tables written on the way, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple] = []


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir or the context's checkpoint folder, deleted when the driver's Python ends.

    Where neither is set, a local master gets a folder under /tmp; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and context.isDefined():
        base = context.get()
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/weftline-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_delete_all)
    _MADE.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder))
    return folder


def _delete_all() -> None:
    for jvm, configuration, folder in _MADE:
        with contextlib.suppress(Exception):  # a folder that can't be deleted any more is left
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(configuration).delete(path, True)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The table, written and read again, which cuts its lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
