"""Running a stream to the end of its input into a table that can be replayed.

Each micro-batch writes its own ``batch=N`` folder, so a batch that is retried after a
failure replaces what it wrote before. Readers take the newest batch per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from catalog_audit.session import stage_path
from catalog_audit.sources.upsert import upsert_last_wins


def run_available(stream: DataFrame, name: str, mode: str = "update", path: str | None = None) -> DataFrame:
    """Process everything available now; returns all batches with their ``batch`` number."""
    spark = stream.sparkSession
    path = path or stage_path(spark, name)

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/table/batch={batch}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("basePath", f"{path}/table").parquet(f"{path}/table")


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    return upsert_last_wins(table, keys, ["batch"]).drop("batch")


def file_stream(spark, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream one Parquet table of a folder of tables (a single file or a folder of files)."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def as_instant(column: str):
    """Event time as a timestamp; zone-less file times are read as UTC (the session zone)."""
    return F.col(column).cast("timestamp")
