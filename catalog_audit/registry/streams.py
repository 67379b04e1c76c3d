"""Streams run over everything the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_audit.operators.usage import luid_map_union
from catalog_audit.registry.base import add
from catalog_audit.registry.ingest import pages
from catalog_audit.session import stage_path
from catalog_audit.sources.estate import row_count, tagged
from catalog_audit.streaming import pages as sp, usage as su
from catalog_audit.streaming.sinks import file_stream


def _events(e):
    k = F.col("event_id")
    item = F.when(k % 50 == 0, tagged("wbl_", k % 97)).otherwise(tagged("vw_", (k * k) % 4201))
    return file_stream(e.spark, e.sf_dir, "events").select(
        "event_id", item.alias("item_luid"), F.col("event_type").alias("event_name"), F.col("ts").alias("event_ts"))


def _usage(e):
    if "usage_stream" not in e._made:
        e._made["usage_stream"] = su.UsageStream(_events(e), luid_map_union(e), stage_path(e.spark, "usage")).run()
    return e._made["usage_stream"]


def _jobs(e):
    return file_stream(e.spark, e.sf_dir, "orders").select(
        tagged("ds_", F.col("o_custkey") % row_count(e.raw("supplier"))).alias("datasource_id"), F.col("o_orderdate").alias("completed_at"),
        F.when(F.col("o_orderstatus") == "F", "Failed").otherwise("Success").alias("status"))


def _ingest(e):
    folder = stage_path(e.spark, "landed-workbooks")
    pages(e, "workbooks").write.json(folder)
    return sp.stream_page_ingest(e.spark, folder, "workbooks")


_DAILY = {"daily": """SELECT date_trunc('day', event_ts)::DATE AS day, workbook_id, count(*) AS views FROM e_raw_usage JOIN luid_map ON luid=item_luid
    WHERE event_name='view' GROUP BY 1,2"""}
add("stream_usage_rollup", lambda e: _usage(e).daily.read().select(F.date_format("day", "yyyy-MM-dd").alias("day"), "workbook_id", "views"),
    "SELECT strftime(day, '%Y-%m-%d') AS day, workbook_id, views FROM daily", _DAILY)
add("stream_trailing_usage", lambda e: _usage(e).windows.read().select("workbook_id", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "views"),
    """SELECT workbook_id, strftime(day - i::INT, '%Y-%m-%d') AS window_start, sum(views)::BIGINT AS views FROM daily, range(30) r(i) GROUP BY 1,2""", _DAILY)
add("stream_page_ingest", lambda e: _ingest(e).select("id", "luid", "name"), "SELECT id, luid, name FROM e_workbooks")
add("stream_latest_refresh", lambda e: su.stream_latest_refresh(_jobs(e)).select(
        "datasource_id", F.date_format("completed_at", "yyyy-MM-dd").alias("completed"), "failed"),
    """SELECT datasource_id, strftime(max(completed_at), '%Y-%m-%d') AS completed, bool_or(status='Failed' AND completed_at=mx) AS failed FROM
       (SELECT *, max(completed_at) OVER (PARTITION BY datasource_id) AS mx FROM e_refresh) GROUP BY 1""")
