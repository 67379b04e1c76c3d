"""Incremental ingestion of landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from catalog_audit.session import stage_path
from catalog_audit.sources import flatten
from catalog_audit.sources.landed import PAGE_SCHEMA, accepted_nodes
from catalog_audit.sources.upsert import upsert_last_wins
from catalog_audit.streaming.keyed import KeyedTable

_ORDER = ["seq", "pos", "batch"]


def page_table(nodes: DataFrame, path: str, key: str = "id", buckets: int = 16) -> KeyedTable:
    """The latest node of every key, with where it came from."""
    schema = T.StructType([*nodes.schema.fields, T.StructField("batch", T.LongType())])
    return KeyedTable(nodes.sparkSession, path, schema, [key], lambda rows: upsert_last_wins(rows, [key], _ORDER), buckets)


def stream_page_ingest(spark: SparkSession, folder: str, query: str, key: str = "id", max_files: int | None = None,
                       path: str | None = None) -> DataFrame:
    """Latest node per key from pages that keep arriving in ``folder``.

    Each batch is merged into the buckets that its keys fall into. The file source remembers what it has read, so a
    restart with the same ``path`` resumes; re-landed pages only rewrite the same keys, a replayed batch nothing.
    """
    path = path or stage_path(spark, f"pages-{query}")
    reader = spark.readStream.schema(PAGE_SCHEMA)
    pages = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(folder)
    nodes = accepted_nodes(pages, query, flatten.NODES[query])
    table = page_table(nodes, f"{path}/table", key)

    def merge(df: DataFrame, batch: int) -> None:
        changes = df.withColumn("batch", F.lit(batch).cast("bigint")).persist()
        table.merge(changes, batch)
        changes.unpersist()

    stream = (nodes.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
              .trigger(availableNow=True).foreachBatch(merge).start())
    stream.awaitTermination()
    return table.read().drop(*_ORDER)
