"""Landed pages, loaders, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_audit.plans import findings as fnd
from catalog_audit.oracle.ctes import NS
from catalog_audit.registry.base import add
from catalog_audit.sources import feeds, flatten, landed


pages = feeds.stored_pages


add("landed_pages", lambda e: landed.accepted_nodes(pages(e, "workbooks"), "workbooks", flatten.NODES["workbooks"]).select("id", "luid", "name"),
    "SELECT id, luid, name FROM e_workbooks")
_PAGES = {"graph_pages": f"""SELECT 'projects' AS q, NULL::VARCHAR AS s, n_nationkey//200 AS pg FROM nation UNION SELECT 'published_datasources', NULL, s_suppkey//200 FROM supplier
          UNION SELECT 'workbooks', NULL, p_partkey//200 FROM part UNION SELECT 'database_tables', NULL, p_partkey//200 FROM part
          UNION SELECT 'custom_sql', NULL, c_custkey//200 FROM customer UNION SELECT 'data_quality_warnings', NULL, c_custkey//200 FROM customer
          UNION SELECT 'datasource_fields', 'ds_'||s_suppkey, 0 FROM supplier UNION SELECT 'datasource_fields', 'ds_'||(p_partkey%{NS}), (5+p_partkey//{NS})//200 FROM part""",
          "rest_pages": """SELECT DISTINCT 'refresh_jobs' AS q, NULL::VARCHAR AS s, o_orderkey//200 AS pg FROM orders
          UNION ALL SELECT DISTINCT 'usage_events', NULL, workbook_id[4:]::BIGINT//200 FROM usage UNION ALL SELECT DISTINCT 'permissions', object_type||':'||object_id, 0 FROM e_permissions"""}
add("response_class", lambda e: landed.response_class(pages(e)).select("query_name", "scope_id", "cursor", "seq", "response", "error"),
    """SELECT q AS query_name, s AS scope_id, pg::VARCHAR AS cursor, pg*2+a AS seq, CASE WHEN a=1 THEN 'ok' ELSE 'partial' END AS response, NULL::VARCHAR AS error
       FROM graph_pages, (VALUES (0),(1)) v(a) WHERE a=1 OR pg%5=0 UNION ALL SELECT q, s, pg::VARCHAR, pg, 'ok', NULL FROM rest_pages""", _PAGES)
add("shard_completeness", lambda e: landed.shard_completeness(pages(e)).select("query_name", "scope_id", "pages", "nodes", "total_count", "subdivisions", "status", "error"),
    f"""SELECT query_name, scope_id, pages, nodes, nodes AS total_count, subdivisions, 'complete' AS status, NULL::VARCHAR AS error FROM (
        SELECT q, coalesce(s,'') AS k, count(*)+count(*) FILTER (pg%5=0) AS pages, count(*) FILTER (pg%5=0) AS subdivisions FROM graph_pages GROUP BY 1,2) p JOIN (
        SELECT 'projects' AS query_name, '' AS scope_id, count(*) AS nodes FROM nation UNION ALL SELECT 'published_datasources','',count(*) FROM supplier
        UNION ALL SELECT 'workbooks','',count(*) FROM part UNION ALL SELECT 'database_tables','',count(*) FROM part UNION ALL SELECT 'custom_sql','',count(*) FROM customer
        UNION ALL SELECT 'data_quality_warnings','',count(*) FROM customer UNION ALL SELECT 'datasource_fields', 'ds_'||s_suppkey, 5+coalesce(n,0) FROM supplier
        LEFT JOIN (SELECT p_partkey%{NS} AS s_suppkey, count(*) AS n FROM part GROUP BY 1) USING (s_suppkey)) ON query_name=q AND scope_id=k""", _PAGES)
add("load_projects", lambda e: flatten.load_projects(pages(e, "projects")),
    """SELECT 'prj_'||n.n_nationkey AS id, n.n_name AS name, 'prj_'||p.n_nationkey AS parent_id FROM nation n LEFT JOIN nation p ON p.n_nationkey=n.n_regionkey""")
add("load_datasources", lambda e: flatten.load_datasources(pages(e, "projects", "published_datasources")).select(
        "id", "luid", "name", "kind", "project_id", "owner", "is_certified", "field_count", F.col("upstream_table_count").cast("bigint").alias("upstream_table_count")),
    """SELECT id, luid, name, 'published' AS kind, project_id, owner, is_certified, (s_suppkey%7)::BIGINT AS field_count,
       CASE WHEN s_suppkey%10<>3 THEN 1 ELSE 0 END::BIGINT AS upstream_table_count FROM e_datasources JOIN supplier ON id='ds_'||s_suppkey""")
add("load_workbooks", lambda e: flatten.load_workbooks(pages(e, "projects", "workbooks")).select(
        "id", "luid", "name", "project_name", "owner", "sheet_count", "embedded_ds_count"),
    """SELECT id, luid, name, project_name, owner, 1 AS sheet_count, coalesce(n,0) AS embedded_ds_count FROM e_workbooks LEFT JOIN (SELECT downstream_id,
       count(*) FILTER (upstream_type='embedded_datasource') AS n FROM e_lineage WHERE downstream_type='workbook' GROUP BY 1) ON downstream_id=id""")
add("load_views", lambda e: flatten.load_views(pages(e, "workbooks")).select("luid", "workbook_id", "kind"), "SELECT luid, workbook_id, kind FROM e_views")
add("load_fields", lambda e: flatten.load_fields(pages(e, "datasource_fields")).select(
        "id", "name", "description", "datasource_id", "role", "data_type", "formula", "is_calculated"),
    "SELECT id, name, description, datasource_id, role, data_type, formula, is_calculated FROM e_fields")
add("load_field_usage", lambda e: flatten.load_field_usage(pages(e, "datasource_fields")), "SELECT field_id, sheet_id, workbook_id FROM e_field_usage")
add("load_lineage", lambda e: flatten.load_lineage(pages(e, "published_datasources", "workbooks")).select(
        "downstream_type", "downstream_id", "upstream_type", "upstream_id"),
    "SELECT downstream_type, downstream_id, upstream_type, upstream_id FROM e_lineage")
add("load_column_projection", lambda e: flatten.load_column_projection(pages(e, "datasource_fields")).select(
        "datasource_id", "table_key", "column_name", "field_data_type"),
    """SELECT datasource_id, table_key, column_name, CASE WHEN column_name[2:]::INT%5<4 THEN 'REAL' ELSE 'STRING' END AS field_data_type FROM e_projection""")
add("load_custom_sql", lambda e: flatten.load_custom_sql(pages(e, "custom_sql")).select("id", "datasource_id", "char_length", "has_group_by", "has_user_function"),
    r"""SELECT id, datasource_id, length(query) AS char_length, regexp_matches(query, '(?i)\bGROUP\s+BY\b') AS has_group_by,
        regexp_matches(query, '(?i)(\b(CURRENT_USER|SESSION_USER|SYSTEM_USER)\b|\b(USER|USERNAME)\s*\()') AS has_user_function FROM e_custom_sql""")
add("load_database_tables", lambda e: flatten.load_database_tables(pages(e, "database_tables")).select(
        "id", "is_embedded", "is_certified", "column_count", "downstream_datasource_count"),
    "SELECT id, is_embedded, is_certified, column_count, downstream_datasource_count FROM e_database_tables")
add("load_dq_warnings", lambda e: flatten.load_dq_warnings(pages(e, "data_quality_warnings")).select(
        "id", "asset_luid", "is_active", "is_elevated", "warning_type"), "SELECT id, asset_luid, is_active, is_elevated, warning_type FROM e_dqw")
add("load_refresh_jobs", lambda e: flatten.load_refresh_jobs(pages(e, "refresh_jobs")).select(
        "task_id", "datasource_id", F.date_format("completed_at", "yyyy-MM-dd").alias("completed"), "status"),
    "SELECT task_id::VARCHAR AS task_id, datasource_id, strftime(completed_at, '%Y-%m-%d') AS completed, status FROM e_refresh")
add("load_permissions", lambda e: flatten.load_permissions(pages(e, "permissions")),
    "SELECT object_type, object_id, 'group' AS grantee_type, grantee_id, capability, mode FROM e_permissions")
add("load_usage", lambda e: flatten.load_usage(pages(e, "usage_events")).select("workbook_id", "event_count", "last_viewed_days_ago"),
    "SELECT workbook_id, event_count, last_viewed_days_ago FROM usage")
add("load_interview", lambda e: _interview_scope(e),
    """SELECT facet_id, score, n AS sources_in_scope FROM (VALUES ('governance.preventive',4),('governance.detective',4),('governance.corrective',3),
       ('semantic.singularity',5),('semantic.consensus',2)) k(facet_id,score), (SELECT count(*) AS n FROM e_datasources)""")
_REG = _PAGES | {
    "own": "SELECT count(*) AS n, count(*) FILTER (coalesce(owner,'')='') AS gap FROM (SELECT owner FROM e_datasources UNION ALL SELECT owner FROM e_workbooks)",
    "graph_nodes": f"""SELECT 'projects' AS q, '' AS k, n_nationkey//200 AS pg, 'prj_'||n_nationkey AS id FROM nation
          UNION ALL SELECT 'published_datasources', '', s_suppkey//200, 'ds_'||s_suppkey FROM supplier UNION ALL SELECT 'workbooks', '', p_partkey//200, 'wb_'||p_partkey FROM part
          UNION ALL SELECT 'custom_sql', '', c_custkey//200, 'csq_'||c_custkey FROM customer UNION ALL SELECT 'database_tables', '', p_partkey//200, 'dbt_'||p_partkey FROM part
          UNION ALL SELECT 'data_quality_warnings', '', c_custkey//200, 'dqw_'||c_custkey FROM customer UNION ALL SELECT 'datasource_fields', datasource_id, 0, id FROM e_cols
          UNION ALL SELECT 'datasource_fields', datasource_id, (5+id[5:]::BIGINT//{NS})//200, id FROM e_calc""",
    "shards": """SELECT q, k, count(DISTINCT id) AS total, count(DISTINCT id) FILTER (landed) AS found FROM graph_nodes
          LEFT JOIN (SELECT DISTINCT q, coalesce(s,'') AS k, pg, true AS landed FROM graph_pages) USING (q, k, pg) GROUP BY q, k""",
    "fcov": "SELECT count(*) AS t, count(*) FILTER (found<total) AS f FROM shards WHERE q='datasource_fields'",
    "proj_ok": "SELECT count(*) AS n FROM e_projection WHERE datasource_id IN (SELECT datasource_id FROM e_cols)",
    "register": """SELECT measure, CASE WHEN found=total THEN 'ok' ELSE 'failed' END AS status,
          CASE WHEN found=total THEN found||' rows read' ELSE 'incomplete: '||q||coalesce(': '||found||' of '||total||' nodes read', '') END AS reason
          FROM (VALUES ('projects','projects'),('datasources','published_datasources'),('workbooks','workbooks'),('custom_sql','custom_sql'),
            ('database_tables','database_tables'),('data_quality_warnings','data_quality_warnings')) v(measure, q) LEFT JOIN shards USING (q)
          UNION ALL SELECT 'fields', CASE WHEN t=0 THEN 'failed' WHEN f=0 THEN 'ok' WHEN f<t THEN 'partial' ELSE 'failed' END,
            CASE WHEN t=0 THEN 'no sources, so no field shards' WHEN f=0 THEN t||' shards read' WHEN f<t THEN f||' of '||t||' field shards incomplete'
            ELSE 'none of '||t||' field shards complete' END FROM fcov
          UNION ALL SELECT 'column_lineage', CASE WHEN f<t AND n>0 THEN 'ok' ELSE 'skipped' END, CASE WHEN t=0 THEN 'no sources, so no columns'
            WHEN f=t THEN 'columns come with field shards, and none completed' WHEN n>0 THEN n||' columns read' ELSE 'field shards completed but list no columns' END FROM fcov, proj_ok
          UNION ALL SELECT measure, CASE WHEN n>0 THEN 'ok' ELSE 'skipped' END, CASE WHEN n>0 THEN n||noun ELSE 'feed not landed' END FROM (
            SELECT 'usage_events' AS measure, count(*) AS n, ' events read' AS noun FROM usage UNION ALL SELECT 'refresh_jobs', count(*), ' jobs read' FROM e_refresh
            UNION ALL SELECT 'permissions', count(*), ' grants read' FROM e_permissions)
          UNION ALL SELECT 'adoption_depth', 'skipped', CASE WHEN count(*)=0 THEN 'no events' ELSE 'no event names a user' END FROM usage
          UNION ALL SELECT 'owner_attribution','partial','no owner on '||gap||' of '||n||' objects' FROM own WHERE gap>0
          UNION ALL SELECT 'query_execution','skipped','a scan reads metadata and runs no query'
          UNION ALL SELECT 'adoption_trajectory','skipped','needs history longer than the event feed keeps'"""}


def _interview_scope(e):
    """Answers beside the number of sources they speak for."""
    n = e["datasources"].agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return e["interview"].select("facet_id", "score").withColumn("sources_in_scope", n)


def _gates(e):
    t = {"coverage": e["coverage"]}
    out = None
    for m in ("fields", "usage_events", "refresh_jobs", "permissions", "data_quality_warnings", "nothing"):
        g = fnd.coverage_gate(t, m)
        out = g if out is None else out.unionByName(g)
    return out


add("coverage_register", lambda e: e["coverage"], "SELECT measure, status, reason FROM register", _REG)
add("coverage_gaps", lambda e: fnd.coverage_gaps(e["coverage"]), "SELECT measure, status, reason FROM register WHERE status<>'ok'", _REG)
add("coverage_gate", _gates,
    """SELECT m AS measure, coalesce(status='ok', false) AS measured, coalesce(status,'absent') AS status, coalesce(reason,'no such row in the register') AS reason
       FROM (VALUES ('fields'),('usage_events'),('refresh_jobs'),('permissions'),('data_quality_warnings'),('nothing')) k(m) LEFT JOIN register ON measure=m""", _REG)
