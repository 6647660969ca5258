"""Late rows of a stream kept apart with their reason, so that nothing is lost without a trace."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

#: Kinds of rows: in time, older than the watermark, without a day.
ACCEPTED, LATE, UNDATED = "accepted", "late", "no_date"


def split_batch(batch: DataFrame, n: int, place: str, late_days: int) -> None:
    """Write micro-batch n below `place`, once: a batch that is there already is left as it is.

    A row is late if its date is more than late_days before the newest day of all earlier batches, as a watermark says.
    Rows and their kinds are one write; the newest day so far is a note of one row, made from the one before it.
    """
    spark = batch.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda folder: system.exists(path(f"{folder}/_SUCCESS"))
    rows, note = f"{place}/rows/batch={n}", f"{place}/newest/{n}"
    before = spark.read.schema("day date").parquet(f"{place}/newest/{n - 1}").first()["day"] if n else None
    if not done(rows):
        mark = F.lit(before - dt.timedelta(days=late_days) if before else None).cast("date")
        kind = F.when(F.col("date").isNull(), UNDATED).when(F.col("date") < mark, LATE).otherwise(ACCEPTED)
        batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(rows)
    if not done(note):
        written = spark.read.schema(batch.schema).parquet(rows)
        written.select(F.greatest(F.max("date"), F.lit(before).cast("date")).alias("day")).coalesce(1).write.mode("overwrite").parquet(note)


def split_late(stream: DataFrame, place: str, late_days: int = 2) -> DataStreamWriter:
    """A writer that sends every row of the stream below `place`, in time or with the reason why not.

    Its checkpoint is there too, so a restart goes on with the batch that was cut off and writes no other again.
    """
    return stream.writeStream.foreachBatch(lambda batch, n: split_batch(batch, n, place, late_days)).option("checkpointLocation", f"{place}/check")


def split_rows(spark: SparkSession, place: str) -> DataFrame:
    """All rows so far with their kind and the batch that brought them."""
    return spark.read.parquet(f"{place}/rows")


def accepted_stream(spark: SparkSession, place: str, schema) -> DataFrame:
    """The rows in time as a stream, for the operators that keep state."""
    return spark.readStream.schema(schema).parquet(f"{place}/rows/batch=*/kind={ACCEPTED}")
