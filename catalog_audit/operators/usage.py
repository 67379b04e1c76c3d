"""Usage: window filter, roll-up to workbooks, field views, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_audit.functions.names import blank, days_ago
from catalog_audit.operators.ordering import cover_counts


def usage_window_filter(tables, now: str, window_days: int = 90, event_name: str = "view") -> DataFrame:
    """View events on or after ``now - window_days``; a range the scan can prune on."""
    start = F.date_sub(F.to_date(F.lit(now)), window_days)
    return tables["raw_usage"].filter(
        (F.col("event_name") == event_name) & (F.col("event_ts") >= start))


def luid_map_union(tables) -> DataFrame:
    """View and workbook identifiers in one map; a workbook's own identifier wins."""
    views = tables["views"].filter("luid IS NOT NULL").select("luid", "workbook_id", F.lit(0).alias("priority"))
    books = tables["workbooks"].filter("luid IS NOT NULL").select(
        "luid", F.col("id").alias("workbook_id"), F.lit(1).alias("priority"))
    # a combinable aggregate instead of a window: repeats of one luid fold map-side
    return views.unionByName(books).groupBy("luid").agg(
        F.max_by("workbook_id", F.struct("priority", "workbook_id")).alias("workbook_id"))


def item_totals(tables, now: str, window_days: int = 90) -> DataFrame:
    """Views and last date per item. Folding here first removes hot items from the join."""
    return (usage_window_filter(tables, now, window_days).filter("item_luid IS NOT NULL")
            .groupBy("item_luid").agg(F.count(F.lit(1)).alias("views"), F.max("event_ts").alias("last_ts")))


def usage_rollup(tables, now: str, window_days: int = 90) -> DataFrame:
    """One row per workbook: summed views, last event, days since."""
    items = item_totals(tables, now, window_days)
    return (items.join(luid_map_union(tables), items["item_luid"] == F.col("luid"))
            .groupBy("workbook_id")
            .agg(F.sum("views").cast("bigint").alias("event_count"), F.max("last_ts").alias("last_ts"))
            .withColumn("last_viewed_days_ago", days_ago(F.lit(now), F.col("last_ts"))))


def usage_match_totals(tables, now: str, window_days: int = 90) -> DataFrame:
    """Matched workbooks and views, and the item rows no scanned content explains."""
    items = item_totals(tables, now, window_days)
    j = items.join(luid_map_union(tables), items["item_luid"] == F.col("luid"), "left")
    known = F.col("workbook_id").isNotNull()
    return j.agg(
        F.count_distinct("workbook_id").cast("bigint").alias("matched_workbooks"),
        F.coalesce(F.sum(F.when(known, F.col("views"))), F.lit(0)).cast("bigint").alias("matched_views"),
        F.count_if(~known).cast("bigint").alias("unmatched_items"),
        F.coalesce(F.sum(F.when(~known, F.col("views"))), F.lit(0)).cast("bigint").alias("unmatched_views"))


def field_views(tables) -> DataFrame:
    """Views of the workbooks a field appears in, each workbook once. Unmeasured ones add nothing."""
    use = tables["usage_events"].select("workbook_id", "event_count")
    # uses in unmeasured workbooks leave before the rest are told apart
    pairs = tables["field_usage"].select("field_id", "workbook_id").join(use.select("workbook_id"), "workbook_id", "left_semi").distinct()
    return (pairs.join(use, "workbook_id")
            .groupBy("field_id")
            .agg(F.coalesce(F.sum("event_count"), F.lit(0)).cast("bigint").alias("views"),
                 F.count(F.lit(1)).cast("bigint").alias("workbooks")))


def zero_view_workbooks(tables) -> DataFrame:
    """Workbooks with no usage row or a zero one."""
    books = tables["workbooks"].select("id", "name", "project_name")
    use = tables["usage_events"].select(F.col("workbook_id").alias("id"), "event_count")
    return books.join(use, "id", "left").filter(F.coalesce("event_count", F.lit(0)) == 0).drop("event_count")


def total_measured_views(tables) -> DataFrame:
    return tables["usage_events"].agg(
        F.coalesce(F.sum("event_count"), F.lit(0)).cast("bigint").alias("views"))


def view_concentration(tables, fractions: dict[str, float]) -> DataFrame:
    """Workbooks that carry each fraction of all views (one row)."""
    use = tables["usage_events"].select(F.coalesce("event_count", F.lit(0)).alias("v"))
    return cover_counts(use, [], "v", fractions)


def adoption_depth(tables) -> DataFrame:
    """Events carrying a user identity, and how many users."""
    return tables["raw_usage"].agg(
        F.count(F.lit(1)).alias("events"), F.count("user_id").alias("with_user"),
        F.count_distinct("user_id").alias("users"))


def content_activation(tables) -> DataFrame:
    """Share of workbooks with any measured view; 0.0 for an empty estate."""
    books = tables["workbooks"].select("id")
    use = tables["usage_events"].select(F.col("workbook_id").alias("id"), "event_count")
    j = books.join(use, "id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("workbooks"),
        F.count_if(F.coalesce("event_count", F.lit(0)) == 0).alias("zero_view"),
        F.coalesce(F.try_divide(F.count_if(F.coalesce("event_count", F.lit(0)) != 0).cast("double"),
                                F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("activation"))


def workbooks_for_fields(tables, fields: DataFrame) -> DataFrame:
    """Distinct workbooks using any of ``fields`` (a frame with ``id``)."""
    used = (tables["field_usage"].filter(~blank(F.col("workbook_id")))
            .join(fields.select(F.col("id").alias("field_id")), "field_id", "left_semi")
            .select(F.col("workbook_id").alias("id")).distinct())
    return tables["workbooks"].select("id", "name", "owner").join(used, "id", "left_semi")
