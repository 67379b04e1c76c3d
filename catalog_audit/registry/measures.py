"""Filters, joins and aggregates over the estate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_audit.functions import formula as fx
from catalog_audit.functions.names import humanize_code
from catalog_audit.operators import graph, measures as m, stats, trends, usage as u
from catalog_audit.oracle.ctes import USER_CTX
from catalog_audit.registry.base import add
from catalog_audit.plans.catalog import broad_grant_policy

add("user_context_fields", lambda e: m.user_context_fields(e).select("id", "name"),
    f"SELECT id, name FROM e_calc WHERE regexp_matches(formula, '{USER_CTX}')")
add("permissive_grants", lambda e: m.permissive_grants(e, *broad_grant_policy()),
    """SELECT object_type, object_id, grantee_id, capability FROM e_permissions WHERE mode='Allow'
       AND grantee_id='AllUsers' AND capability IN ('Write','Delete','ChangePermissions','ProjectLeader')""")
add("sources_missing_owner", m.sources_missing_owner,
    "SELECT id, name FROM e_datasources WHERE trim(coalesce(owner,''))=''")
add("described_fields", m.described_fields,
    "SELECT id, description FROM e_fields WHERE trim(coalesce(description,''))<>''")
add("usage_window_filter", lambda e: u.usage_window_filter(e, e.now, 20).select("event_id", "item_luid"),
    """SELECT event_id, item_luid FROM e_raw_usage WHERE event_name='view'
       AND event_ts >= DATE '2024-02-01' - INTERVAL 20 DAY""")
add("field_views", u.field_views, "SELECT field_id, views, workbooks FROM field_views")
add("zero_view_workbooks", u.zero_view_workbooks,
    """SELECT w.id, w.name, w.project_name FROM e_workbooks w LEFT JOIN usage ON workbook_id=w.id
       WHERE coalesce(event_count,0)=0""")
add("sources_without_upstream", m.sources_without_upstream,
    """SELECT id, name FROM e_datasources d WHERE NOT EXISTS (SELECT 1 FROM e_lineage l
       WHERE l.downstream_type='datasource' AND l.downstream_id=d.id)""")
add("certified_with_active_warning", m.certified_with_active_warning,
    """SELECT d.id, d.name, w.id AS warning_id, w.is_elevated, w.warning_type FROM e_dqw w JOIN e_datasources d
       ON d.luid=w.asset_luid WHERE w.is_active AND d.is_certified""")
add("certified_clean", m.certified_clean,
    """SELECT id, name FROM e_datasources d WHERE is_certified AND NOT EXISTS (SELECT 1 FROM e_dqw w
       WHERE w.asset_luid=d.luid AND w.is_active)""")
_FAILED = {"broken": """SELECT DISTINCT datasource_id FROM e_refresh r WHERE status='Failed' AND completed_at =
    (SELECT max(completed_at) FROM e_refresh x WHERE x.datasource_id=r.datasource_id)""",
    "failed_views": """SELECT DISTINCT l.upstream_id AS datasource_id, l.downstream_id AS workbook_id, last_viewed_days_ago
    FROM e_lineage l JOIN broken b ON b.datasource_id=l.upstream_id JOIN usage ON workbook_id=l.downstream_id
    WHERE l.downstream_type='workbook' AND l.upstream_type='datasource' AND last_viewed_days_ago IS NOT NULL"""}
add("failed_source_recent_views", m.failed_source_recent_views, "SELECT * FROM failed_views", _FAILED)
add("shared_table_projection", m.shared_table_projection,
    """SELECT * FROM e_projection WHERE table_key IN (SELECT table_key FROM e_projection GROUP BY 1
       HAVING count(DISTINCT datasource_id)>=2)""")
add("calc_fields_resolved", lambda e: e["fields"].filter("is_calculated").select(
        F.col("id").alias("field_id"), "name", "datasource_id").join(
        e["resolved"].select("field_id", "normalized_hash", "resolution_status"), "field_id", "left"),
    """SELECT c.id AS field_id, c.name, c.datasource_id, normalized_hash, resolution_status FROM e_calc c
       LEFT JOIN resolved r ON r.field_id=c.id""")
add("workbooks_for_fields", lambda e: u.workbooks_for_fields(e, m.user_context_fields(e)),
    f"""SELECT id, name, owner FROM e_workbooks WHERE id IN (SELECT workbook_id FROM e_field_usage WHERE field_id IN
        (SELECT id FROM e_calc WHERE regexp_matches(formula, '{USER_CTX}')))""")
add("usage_rollup", lambda e: e["usage_events"].select(
        "workbook_id", "event_count", F.date_format("last_ts", "yyyy-MM-dd").alias("last_date"), "last_viewed_days_ago"),
    """SELECT workbook_id, event_count, strftime(last_ts, '%Y-%m-%d') AS last_date, last_viewed_days_ago FROM usage""")
add("usage_match_totals", lambda e: u.usage_match_totals(e, e.now, 22),
    """SELECT count(DISTINCT workbook_id) AS matched_workbooks, coalesce(sum(v) FILTER (workbook_id IS NOT NULL),0)::BIGINT AS matched_views,
       count(*) FILTER (workbook_id IS NULL) AS unmatched_items,
       coalesce(sum(v) FILTER (workbook_id IS NULL),0)::BIGINT AS unmatched_views FROM (SELECT item_luid, count(*) AS v
       FROM e_raw_usage WHERE event_name='view' AND event_ts >= DATE '2024-02-01' - INTERVAL 22 DAY GROUP BY 1)
       LEFT JOIN luid_map ON luid=item_luid""")
add("token_bind", lambda e: e["bindings"].select("field_id", "token", "ref_id", "ambiguous"),
    "SELECT field_id, token, ref_id, ambiguous FROM bound")

# -- aggregates ------------------------------------------------------------------
add("description_coverage", m.description_coverage,
    """SELECT d AS described, t AS total, d::DOUBLE/t AS coverage FROM (SELECT count(*) AS t,
       count(*) FILTER (trim(coalesce(description,''))<>'') AS d FROM e_fields)""")
add("datasource_ref_shares", m.datasource_ref_shares,
    """SELECT e AS embedded_refs, p AS published_refs, e::DOUBLE/(e+p) AS embedded_share, p::DOUBLE/(e+p) AS published_share FROM
       (SELECT count(*) FILTER (upstream_type='embedded_datasource') AS e, count(*) FILTER (upstream_type='datasource') AS p
        FROM e_lineage WHERE downstream_type='workbook')""")
_FANOUT = {"fanout": """SELECT upstream_id, upstream_id AS upstream_label, count(DISTINCT downstream_id) AS sources FROM e_lineage
    WHERE downstream_type='datasource' AND upstream_type='table' GROUP BY 1"""}
add("table_fanout", m.table_fanout, "SELECT * FROM fanout", _FANOUT)
add("max_fanout", m.max_fanout,
    "SELECT coalesce(max(sources),0) AS max_sources, count(*) FILTER (sources>1) AS redundant_tables FROM fanout", _FANOUT)
add("fields_per_source", m.fields_per_source, "SELECT datasource_id, count(*) AS fields FROM e_fields GROUP BY 1")
add("refresh_failure_rate", m.refresh_failure_rate,
    """SELECT t AS total, f AS failed, f::DOUBLE/t AS rate FROM (SELECT count(*) AS t,
       count(*) FILTER (status='Failed') AS f FROM e_refresh)""")
GROUP_BY, USER_FN = r"(?i)\bGROUP\s+BY\b", r"(?i)(\b(CURRENT_USER|SESSION_USER|SYSTEM_USER)\b|\b(USER|USERNAME)\s*\()"
add("custom_sql_grain", m.custom_sql_grain,
    f"""SELECT count(*) FILTER (regexp_matches(query, '{GROUP_BY}')) AS with_group_by,
        count(*) FILTER (regexp_matches(query, '{USER_FN}')) AS with_user_function, count(*) AS total FROM e_custom_sql""")
add("sql_grain_signals", lambda e: e["custom_sql"].select("id", *[c.alias(k) for k, c in fx.sql_grain_signals(F.col("query")).items()]),
    f"""SELECT id, regexp_matches(query, '{GROUP_BY}') AS has_group_by, regexp_matches(query, '{USER_FN}') AS has_user_function
        FROM e_custom_sql""")
add("database_table_stats", m.database_table_stats,
    """SELECT count(*) FILTER (is_embedded) AS embedded, count(*) FILTER (is_certified) AS certified,
       coalesce(max(downstream_datasource_count),0) AS max_downstream, count(*) AS total FROM e_database_tables""")
add("dq_warning_counts", m.dq_warning_counts, "SELECT count(*) FILTER (is_active) AS active, count(*) AS total FROM e_dqw")
add("certification_counts", m.certification_counts,
    "SELECT count(*) FILTER (is_certified) AS certified, count(*) AS total FROM e_datasources")
add("permission_counts", m.permission_counts,
    """SELECT count(*) AS grants, count(DISTINCT object_type||':'||object_id) AS objects,
       count(*) FILTER (mode='Deny') AS deny_rules FROM e_permissions""")
add("content_activation", u.content_activation,
    """SELECT t AS workbooks, z AS zero_view, (t-z)::DOUBLE/t AS activation FROM (SELECT count(*) AS t,
       count(*) FILTER (coalesce(event_count,0)=0) AS z FROM e_workbooks w LEFT JOIN usage ON workbook_id=w.id)""")
add("ownership_coverage", m.ownership_coverage,
    """SELECT o AS owned, t AS total, o::DOUBLE/t AS coverage FROM (SELECT count(*) AS t,
       count(*) FILTER (trim(coalesce(owner,''))<>'') AS o FROM e_datasources)""")
add("certification_coverage", m.certification_coverage,
    "SELECT (count(*) FILTER (is_certified))::DOUBLE/count(*) AS coverage FROM e_datasources")
add("column_divergence", m.column_divergence,
    """SELECT table_key, column_name, types, type_names, sources, table_sources, types>=2 AS type_divergent,
       sources<table_sources AS not_shared FROM (SELECT table_key, column_name, count(DISTINCT field_data_type) AS types,
       string_agg(DISTINCT field_data_type, ',' ORDER BY field_data_type) AS type_names, count(DISTINCT datasource_id) AS sources FROM e_projection GROUP BY 1,2) JOIN (SELECT table_key,
       count(DISTINCT datasource_id) AS table_sources FROM e_projection GROUP BY 1) USING (table_key) WHERE table_sources>=2""")
add("columns_not_shared", lambda e: m.columns_not_shared({"projection": e.raw("lineitem").select(
        F.concat(F.lit("ds_"), F.col("l_suppkey").cast("string")).alias("datasource_id"), F.concat(F.lit("tbl_"), (F.col("l_suppkey") % 9).cast("string")).alias("table_key"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("column_name"), F.lit("REAL").alias("field_data_type")).distinct()}),
    """SELECT table_key, column_name, sources, table_sources FROM (SELECT 'tbl_'||(l_suppkey%9) AS table_key, 'p'||l_partkey AS column_name,
       count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1,2) JOIN (SELECT 'tbl_'||(l_suppkey%9) AS table_key,
       count(DISTINCT l_suppkey) AS table_sources FROM lineitem GROUP BY 1) USING (table_key) WHERE table_sources>=2 AND sources<table_sources""")
add("permission_exposure", lambda e: m.permission_exposure(e, *broad_grant_policy()),
    """SELECT capability, count(*) AS permissive_grants, count(DISTINCT object_type||':'||object_id) AS exposed_objects
       FROM e_permissions WHERE mode='Allow' AND grantee_id='AllUsers' AND capability IN
       ('Write','Delete','ChangePermissions','ProjectLeader') GROUP BY GROUPING SETS ((capability),())""")
add("permission_sample", lambda e: m.permission_sample(e, 50),
    """SELECT object_type, total, sampled, CASE WHEN sampled>=total THEN 'all' ELSE 'sampled' END AS coverage, coalesce(grants,0) AS grants FROM
       (SELECT object_type, count(*) AS total, count(*) FILTER (object_type='project' OR rn<=50) AS sampled FROM objs GROUP BY 1)
       LEFT JOIN (SELECT p.object_type, count(*) AS grants FROM e_permissions p JOIN objs o ON o.object_type=p.object_type
       AND o.object_id=p.object_id WHERE o.object_type='project' OR rn<=50 GROUP BY 1) USING (object_type)""",
    {"objs": """SELECT *, row_number() OVER (PARTITION BY object_type ORDER BY object_id) AS rn FROM (
       SELECT 'project' AS object_type, id AS object_id FROM e_projects UNION ALL SELECT 'datasource', id FROM e_datasources
       UNION ALL SELECT 'workbook', id FROM e_workbooks)"""})
add("adoption_depth", u.adoption_depth,
    "SELECT count(*) AS events, count(user_id) AS with_user, count(DISTINCT user_id) AS users FROM e_raw_usage")
add("owner_attribution_gap", m.owner_attribution_gap,
    """SELECT count(*) AS objects_seen, count(*) FILTER (coalesce(owner,'')='') AS owner_missing FROM
       (SELECT owner FROM e_datasources UNION ALL SELECT owner FROM e_workbooks)""")
add("table_row_counts", lambda e: m.table_row_counts(e, ["projects", "datasources", "workbooks", "views", "fields", "field_usage",
                                                         "lineage", "permissions", "refresh_jobs", "dqw", "projection"]),
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM e_{t if t != 'refresh_jobs' else 'refresh'}"
                       for t in ["projects", "datasources", "workbooks", "views", "fields", "field_usage", "lineage",
                                 "permissions", "refresh_jobs", "dqw", "projection"]))
add("total_measured_views", u.total_measured_views, "SELECT coalesce(sum(event_count),0)::BIGINT AS views FROM usage")
add("cover_workbooks", lambda e: u.view_concentration(e, {"cover70": 0.7, "cover80": 0.8}).withColumn("total", F.col("total").cast("bigint")),
    """SELECT count(*) FILTER (cum-v < 0.7::DOUBLE*t) AS cover70, count(*) FILTER (cum-v < 0.8::DOUBLE*t) AS cover80, any_value(t)::BIGINT AS total
       FROM (SELECT event_count AS v, sum(event_count) OVER (ORDER BY event_count DESC, workbook_id ROWS UNBOUNDED PRECEDING) AS cum,
       sum(event_count) OVER () AS t FROM usage)""")
add("latest_refresh", lambda e: m.latest_refresh(e).select("datasource_id", F.date_format("completed_at", "yyyy-MM-dd").alias("completed"), "failed"),
    """SELECT datasource_id, strftime(max(completed_at), '%Y-%m-%d') AS completed,
       bool_or(status='Failed' AND completed_at=mx) AS failed FROM (SELECT *, max(completed_at) OVER (PARTITION BY datasource_id) AS mx
       FROM e_refresh) GROUP BY 1""")
add("luid_map_union", u.luid_map_union, "SELECT luid, workbook_id FROM luid_map")
add("source_chain_depth", graph.source_chain_depth,
    "SELECT coalesce(max(depth),0)::BIGINT AS depth FROM chain",
    {"chain": """SELECT downstream_id AS s, upstream_id AS node, [downstream_id] AS seen, 1 AS depth FROM e_lineage
       WHERE downstream_type='datasource' AND upstream_type='datasource'
       UNION ALL SELECT c.s, l.upstream_id, list_append(c.seen, c.node), c.depth+1 FROM chain c JOIN e_lineage l ON l.downstream_id=c.node
       AND l.downstream_type='datasource' AND l.upstream_type='datasource' WHERE NOT list_contains(c.seen, l.upstream_id)"""})
add("humanize_code", lambda e: e["lineage"].select("upstream_type").distinct().unionByName(
        e["dqw"].select(F.col("warning_type").alias("upstream_type")).distinct()).select(
        F.col("upstream_type").alias("code"), humanize_code(F.col("upstream_type")).alias("label")),
    """SELECT code, upper(s[1]) || lower(s[2:]) AS label FROM (SELECT code, trim(replace(replace(code,'.',' · '),'_',' ')) AS s
       FROM (SELECT DISTINCT upstream_type AS code FROM e_lineage UNION ALL SELECT DISTINCT warning_type FROM e_dqw))""")
add("evidence_topk", lambda e: m.top_evidence(e, 10),
    """SELECT datasource_id, id, name FROM (SELECT *, row_number() OVER (PARTITION BY datasource_id ORDER BY id) AS rn
       FROM e_calc) WHERE rn<=10""")
add("upstream_type_counts", lambda e: stats.int_histogram(
        e["lineage"].groupBy("downstream_id").agg(F.count(F.lit(1)).alias("edges")), "edges"),
    "SELECT edges AS value, count(*) AS n FROM (SELECT downstream_id, count(*) AS edges FROM e_lineage GROUP BY 1) GROUP BY 1")
_DAYS = "SELECT last_viewed_days_ago::DOUBLE AS v FROM usage"
add("five_number_stats", lambda e: stats.five_number_stats(e["usage_events"], "event_count"),
    """SELECT count(*) AS n, min(event_count)::DOUBLE AS min, quantile_cont(event_count, 0.25)::DOUBLE AS p25,
       quantile_cont(event_count, 0.5)::DOUBLE AS median, quantile_cont(event_count, 0.75)::DOUBLE AS p75,
       max(event_count)::DOUBLE AS max, sum(event_count)::DOUBLE/count(*) AS mean FROM usage""")
add("int_histogram", lambda e: stats.int_histogram(e["usage_events"], "event_count"),
    "SELECT event_count AS value, count(*) AS n FROM usage GROUP BY 1")
add("bucketize", lambda e: stats.bucketize(e["usage_events"], "last_viewed_days_ago", [7, 30, 90]),
    f"""SELECT b AS bucket, label, count(v) AS n FROM (VALUES (0,'≤ 7'),(1,'7–30'),(2,'30–90'),(3,'> 90')) k(b,label)
        LEFT JOIN ({_DAYS}) ON b = CASE WHEN v<=7 THEN 0 WHEN v<=30 THEN 1 WHEN v<=90 THEN 2 ELSE 3 END GROUP BY 1,2""")
add("parse_iso", lambda e: m.iso_probe(e),
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS parsed, greatest(0, date_diff('day', ts::DATE, DATE '2024-01-15'))::BIGINT AS days_ago
       FROM events""")


def _view_days(e):
    """Every view of a known workbook: day, workbook_id, user_id."""
    luids = u.luid_map_union(e)
    seen = e["raw_usage"].filter("event_name = 'view'").join(luids, F.col("item_luid") == F.col("luid"))
    return seen.select(F.to_date("event_ts").alias("day"), "workbook_id", "user_id")


def _adoption_trend(e, length: int = 7):
    """The sketched figures of every week beside exact ones: whether they lie within their bounds."""
    if "daily_sketches" not in e._made:
        e.put("daily_sketches", e._stage("daily-sketches", trends.daily_sketches(_view_days(e))))
    told = trends.trend(e["daily_sketches"], length).withColumnRenamed("users", "estimate")
    ends = F.explode(F.sequence(F.col("day"), F.date_add("day", length - 1))).alias("span_end")
    exact = _view_days(e).select("day", "user_id").distinct().select(ends, "user_id").groupBy("span_end").agg(F.count_distinct("user_id").alias("users"))
    depth = _view_days(e).groupBy("day", "workbook_id").agg(F.count(F.lit(1)).alias("n")).groupBy("day", "n").agg(F.count(F.lit(1)).alias("books"))
    ranks = depth.select(ends, "n", "books").join(told.select("span_end", "median_views"), "span_end").groupBy("span_end").agg(
        (F.sum(F.when(F.col("n") < F.col("median_views"), F.col("books")).otherwise(0)) / F.sum("books")).alias("below"),
        (F.sum(F.when(F.col("n") <= F.col("median_views"), F.col("books")).otherwise(0)) / F.sum("books")).alias("upto"))
    return told.join(exact, "span_end").join(ranks, "span_end").select(
        F.date_format("span_end", "yyyy-MM-dd").alias("span_end"), F.col("views").cast("bigint").alias("views"), "users",
        (F.abs(F.col("estimate") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("users_within"),
        ((F.col("below") <= 0.5 + 0.017) & (F.col("upto") >= 0.5 - 0.017)).alias("median_within"))


add("adoption_trend", _adoption_trend,
    """SELECT strftime(span_end, '%Y-%m-%d') AS span_end, count(*) AS views, count(DISTINCT user_id) AS users, true AS users_within, true AS median_within
       FROM (SELECT event_ts::DATE + i::INT AS span_end, user_id FROM e_raw_usage JOIN luid_map ON luid=item_luid, range(7) r(i) WHERE event_name='view') GROUP BY 1""")
