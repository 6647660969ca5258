"""Tables written into the folder that driver and executors share, which end a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="pitchline-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; on one machine where none is set, as in tests, one of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (place or _own_folder()).rstrip("/")


def materialised(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet and read back: models that pass over it many times don't derive it each time, and lost executors don't either."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "written_path", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
