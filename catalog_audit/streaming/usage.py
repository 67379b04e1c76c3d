"""Usage and refresh state maintained from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_audit.session import materialize, stage_path
from catalog_audit.streaming.keyed import KeyedTable
from catalog_audit.streaming.sinks import as_instant, latest, run_available

_EVENT = ["event_id", "workbook_id", "event_ts"]


def view_rows(events: DataFrame, luid_map: DataFrame) -> DataFrame:
    """One narrow row per view of a known item: event_id, workbook_id, event_ts. The identifier map is static."""
    views = events.filter("event_name = 'view' AND item_luid IS NOT NULL").withColumn("event_ts", as_instant("event_ts"))
    return views.join(luid_map, views["item_luid"] == luid_map["luid"]).select(*_EVENT)


def daily_views(rows: DataFrame) -> DataFrame:
    """Views per workbook and day."""
    return rows.groupBy(F.date_trunc("day", "event_ts").alias("day"), "workbook_id").agg(F.count(F.lit(1)).alias("views"))


def _summed(keys: list[str]):
    return lambda rows: rows.groupBy(*keys).agg(F.sum("views").cast("bigint").alias("views"))


class UsageStream:
    """Daily totals and trailing windows of a stream of views, both changed by what a batch brings.

    An event is its id, workbook and instant; it counts once however often it is delivered (one without id, always).
    Repeats are found in the stream's own state, which the watermark bounds: an event is remembered until the newest instant
    is ``delay`` past its own. Older rows leave that state's sight; they arrive on the side, and are looked up in
    the log of accepted events, of which only their days are read. So no event is lost for being late, none
    counts twice, and neither the order of files nor how they fall into batches changes a total.

    Every table commits a batch once, so a replay after a failure repeats nothing.
    """

    def __init__(self, events: DataFrame, luid_map: DataFrame, path: str, delay: str = "3 days", days: int = 30, buckets: int = 16):
        self.spark, self.path, self.delay, self.days = events.sparkSession, path, delay, days
        # stored, so that its true size decides how it is joined: the guess from its sources would send a large one through the driver
        self.rows = view_rows(events, materialize(luid_map, "luid-map"))
        self.daily = KeyedTable(self.spark, f"{path}/daily", "day timestamp, workbook_id string, views bigint", ["day", "workbook_id"], _summed(["day", "workbook_id"]), buckets)
        self.windows = KeyedTable(self.spark, f"{path}/windows", "workbook_id string, window_start date, views bigint", ["workbook_id"], _summed(["workbook_id", "window_start"]), buckets)
        self._log = f"{path}/accepted"

    def _stream(self) -> DataFrame:
        """Every row that arrives, and once more those that the watermarked state accepts."""
        named = self.rows.where("event_id IS NOT NULL AND event_ts IS NOT NULL").withWatermark("event_ts", self.delay).dropDuplicatesWithinWatermark(_EVENT)
        return named.select(*_EVENT, F.lit(True).alias("kept")).unionByName(self.rows.select(*_EVENT, F.lit(False).alias("kept")))

    def _late(self, arrived: DataFrame, kept: DataFrame, before: str | None, batch: int) -> DataFrame:
        """Named events behind the watermark, or without an instant, that no earlier batch accepted."""
        behind = F.col("event_ts").isNull()
        if before is not None:
            behind |= F.col("event_ts") <= F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _EVENT]
        late = arrived.where("event_id IS NOT NULL").where(behind).distinct().alias("l").join(kept.alias("r"), same, "left_anti")
        days = [r[0] for r in late.select(F.coalesce(F.to_date("event_ts").cast("string"), F.lit("none")).alias("day")).distinct().collect()]
        if not days or batch == 0:
            return late
        schema = "event_id bigint, workbook_id string, event_ts timestamp, batch bigint, day string"
        known = self.spark.read.schema(schema).parquet(self._log).where(F.col("day").isin(days) & (F.col("batch") < batch))
        return late.alias("l").join(known.alias("r"), same, "left_anti")

    def apply(self, df: DataFrame, batch: int) -> None:
        df = df.persist()
        state = self.daily.state()
        arrived, kept = df.where("NOT kept").select(*_EVENT), df.where("kept").select(*_EVENT)
        # a replayed batch is judged by the instant that stood before it
        before = state["notes"].get("newest") if state["batch"] < batch else state["notes"].get("newest_before")
        new = kept.unionByName(self._late(arrived, kept, before, batch))
        day = F.coalesce(F.to_date("event_ts").cast("string"), F.lit("none")).alias("day")
        new.select(*_EVENT, day).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self._log}/batch={batch}")
        stored = self.spark.read.schema("event_id bigint, workbook_id string, event_ts timestamp").parquet(f"{self._log}/batch={batch}").select(*_EVENT)
        changes = daily_views(stored.unionByName(arrived.where("event_id IS NULL"))).persist()
        seen = arrived.agg(F.max("event_ts").cast("string")).first()[0]
        newest = max(filter(None, [before, seen]), default=None)
        # windows first: the instants that judge a replay are kept with the daily totals, the last commit
        self.windows.merge(trailing_views(changes, self.days), batch)
        self.daily.merge(changes, batch, {"newest": newest, "newest_before": before})
        changes.unpersist()
        df.unpersist()

    def run(self) -> UsageStream:
        """Process everything available now."""
        query = (self._stream().writeStream.outputMode("append").option("checkpointLocation", f"{self.path}/checkpoint")
                 .trigger(availableNow=True).foreachBatch(self.apply).start())
        query.awaitTermination()
        return self


def stream_usage_rollup(events: DataFrame, luid_map: DataFrame, path: str | None = None, delay: str = "3 days") -> DataFrame:
    """The daily roll-up of everything that has arrived."""
    return UsageStream(events, luid_map, path or stage_path(events.sparkSession, "usage"), delay).run().daily.read()


def stream_trailing_usage(events: DataFrame, luid_map: DataFrame, path: str | None = None, delay: str = "3 days", days: int = 30) -> DataFrame:
    """Views in every window of ``days`` days; a batch adds its days to the windows that hold them and rewrites only their buckets."""
    return UsageStream(events, luid_map, path or stage_path(events.sparkSession, "usage"), delay, days).run().windows.read()


def trailing_views(daily: DataFrame, days: int = 30) -> DataFrame:
    """Views in every ``days``-long window sliding by a day.

    Built from daily totals (or from what a batch adds to them), so what is repeated per window is a day of a
    workbook, not each event.
    """
    starts = F.sequence(F.date_sub(F.to_date("day"), days - 1), F.to_date("day"))
    return (daily.where("day IS NOT NULL").select("workbook_id", "views", F.explode(starts).alias("window_start"))
            .groupBy("workbook_id", "window_start").agg(F.sum("views").cast("bigint").alias("views")))


def stream_latest_refresh(jobs: DataFrame, path: str | None = None) -> DataFrame:
    """Latest completion per source and whether any job finishing then failed."""
    at = as_instant("completed_at")
    state = jobs.filter("completed_at IS NOT NULL").groupBy("datasource_id").agg(
        F.max(at).alias("completed_at"), F.max(F.when(F.col("status") == "Failed", at)).alias("failure")).select(
        "datasource_id", "completed_at", F.coalesce(F.col("failure") == F.col("completed_at"), F.lit(False)).alias("failed"))
    return latest(run_available(state, "latest-refresh", path=path), ["datasource_id"])
