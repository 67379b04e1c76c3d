"""Landed pages to typed tables. One function per feed; all share ``accepted_nodes``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from catalog_audit.functions import formula as fx
from catalog_audit.sources.landed import accepted_nodes
from catalog_audit.sources.upsert import insert_first_wins, upsert_last_wins

_OWNER = "owner: struct<username: string, email: string>"
_LINK = "array<struct<id: string, name: string>>"
NODES = {
    "projects": "struct<id: string, name: string, parentProjectName: string>",
    "published_datasources": (
        f"struct<id: string, luid: string, name: string, projectName: string, isCertified: boolean, certificationNote: string, {_OWNER}, "
        "hasExtracts: boolean, createdAt: string, updatedAt: string, fieldsConnection: struct<totalCount: bigint>, "
        f"upstreamTables: array<struct<id: string, name: string, fullName: string>>, upstreamDatasources: {_LINK}>"),
    "workbooks": (
        f"struct<id: string, luid: string, name: string, projectName: string, createdAt: string, updatedAt: string, {_OWNER}, "
        f"upstreamDatasources: {_LINK}, embeddedDatasources: {_LINK}, "
        "sheets: array<struct<id: string, name: string, luid: string>>, dashboards: array<struct<id: string, name: string, luid: string>>>"),
    "datasource_fields": (
        "struct<__typename: string, id: string, name: string, description: string, formula: string, dataType: string, role: string, "
        "sheetsUsedIn: array<struct<id: string, workbook: struct<id: string, luid: string>>>, "
        "upstreamColumns: array<struct<name: string, remoteType: string, table: struct<id: string, luid: string, fullName: string>>>>"),
    "custom_sql": f"struct<id: string, query: string, downstreamDatasources: {_LINK}>",
    "database_tables": (
        "struct<id: string, luid: string, name: string, fullName: string, schema: string, connectionType: string, isEmbedded: boolean, "
        "isCertified: boolean, columnsConnection: struct<totalCount: bigint>, downstreamDatasourcesConnection: struct<totalCount: bigint>>"),
    "data_quality_warnings": (
        "struct<id: string, luid: string, isActive: boolean, isSevere: boolean, isElevated: boolean, warningType: string, category: string, "
        "message: string, asset: struct<luid: string, name: string, __typename: string>>"),
    "usage_events": ("struct<workbook_id: string, workbook_luid: string, user_id: string, event_date: string, views: bigint, "
                     "event_count: bigint, last_viewed_days_ago: int>"),
    "refresh_jobs": "struct<task_id: string, datasource_id: string, scheduled_at: string, completed_at: string, status: string>",
    "permissions": ("struct<group: struct<id: string>, user: struct<id: string>, "
                    "capabilities: struct<capability: array<struct<name: string, mode: string>>>>"),
}
_SEQ = ["seq", "pos"]


def nodes(pages: DataFrame, query: str, *wanted: str) -> DataFrame:
    """Nodes of one feed with all their fields, or the ``wanted`` ones: the parser passes over what it is not asked for."""
    schema = NODES[query]
    if wanted:
        every = DataType.fromDDL(schema)
        schema = StructType([every[w] for w in wanted]).simpleString()
    return accepted_nodes(pages, query, schema)


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    return upsert_last_wins(df, keys, _SEQ).drop(*_SEQ)


def _count(xs: str) -> Column:
    return F.greatest(F.coalesce(F.size(xs), F.lit(0)), F.lit(0))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def project_names(pages: DataFrame) -> DataFrame:
    """Project id by name; of projects sharing a name the last one landed."""
    n = nodes(pages, "projects").select("name", "id", *_SEQ)
    return _latest(n, ["name"]).select(F.col("name").alias("project_name"), F.col("id").alias("project_id"))


def load_projects(pages: DataFrame) -> DataFrame:
    """Parents are found by name over the whole feed, whatever the page order."""
    p = _latest(nodes(pages, "projects"), ["id"])
    parent = project_names(pages).select(F.col("project_name").alias("parentProjectName"), F.col("project_id").alias("parent_id"))
    return p.join(parent, "parentProjectName", "left").select("id", "name", "parent_id")


def load_datasources(pages: DataFrame) -> DataFrame:
    d = _latest(nodes(pages, "published_datasources"), ["id"]).withColumnRenamed("projectName", "project_name")
    return d.join(project_names(pages), "project_name", "left").select(
        "id", "luid", "name", F.lit("published").alias("kind"), "project_id", "project_name", F.col("owner.username").alias("owner"),
        F.col("isCertified").alias("is_certified"), F.col("certificationNote").alias("certification_note"),
        F.col("hasExtracts").alias("has_extract"), F.col("fieldsConnection.totalCount").alias("field_count"),
        _count("upstreamTables").alias("upstream_table_count"), F.col("createdAt").alias("created_at"), F.col("updatedAt").alias("updated_at"))


def load_workbooks(pages: DataFrame) -> DataFrame:
    w = _latest(nodes(pages, "workbooks"), ["id"]).withColumnRenamed("projectName", "project_name")
    return w.join(project_names(pages), "project_name", "left").select(
        "id", "luid", "name", "project_id", "project_name", F.col("owner.username").alias("owner"), F.col("createdAt").alias("created_at"),
        F.col("updatedAt").alias("updated_at"), _count("sheets").alias("sheet_count"), _count("embeddedDatasources").alias("embedded_ds_count"))


def load_views(pages: DataFrame) -> DataFrame:
    w = nodes(pages, "workbooks")

    def kind(column, name):
        return w.select(F.col("id").alias("workbook_id"), "seq", "pos", F.explode(column).alias("v")).select(
            F.col("v.luid").alias("luid"), "workbook_id", F.lit(name).alias("kind"), F.col("v.name").alias("name"), *_SEQ)

    both = kind("sheets", "sheet").unionByName(kind("dashboards", "dashboard"))
    return _latest(both.filter("luid IS NOT NULL AND luid <> ''"), ["luid"])


def load_fields(pages: DataFrame) -> DataFrame:
    f = nodes(pages, "datasource_fields", "__typename", "id", "name", "description", "formula", "dataType", "role")
    return _latest(f, ["id"]).select(
        "id", "name", "description", F.col("scope_id").alias("datasource_id"), F.col("__typename").alias("field_type"),
        F.col("dataType").alias("data_type"), "role", "formula", (F.col("__typename") == "CalculatedField").alias("is_calculated"))


def load_field_usage(pages: DataFrame) -> DataFrame:
    s = nodes(pages, "datasource_fields", "id", "sheetsUsedIn").select(F.col("id").alias("field_id"), F.explode("sheetsUsedIn").alias("s"))
    return s.select("field_id", F.coalesce("s.id", F.lit("")).alias("sheet_id"),
                    F.coalesce(_filled(F.col("s.workbook.id")), _filled(F.col("s.workbook.luid")), F.lit("")).alias("workbook_id")).distinct()


def load_lineage(pages: DataFrame) -> DataFrame:
    """Source to table, source to source, workbook to published and to embedded source."""
    ds, wb = nodes(pages, "published_datasources"), nodes(pages, "workbooks")

    def edges(df, column, down, up, key, label):
        return df.select(F.col("id").alias("downstream_id"), "seq", "pos", F.explode(column).alias("u")).select(
            F.lit(down).alias("downstream_type"), "downstream_id", F.lit(up).alias("upstream_type"), key.alias("upstream_id"),
            label.alias("upstream_label"), *_SEQ)

    name, uid = F.col("u.name"), F.col("u.id")
    every = reduce(DataFrame.unionByName, [
        edges(ds, "upstreamTables", "datasource", "table", F.coalesce(_filled(F.col("u.fullName")), uid), F.col("u.fullName")),
        edges(ds, "upstreamDatasources", "datasource", "datasource", uid, name),
        edges(wb, "upstreamDatasources", "workbook", "datasource", uid, name),
        edges(wb, "embeddedDatasources", "workbook", "embedded_datasource", uid, name)])
    return _latest(every.filter("upstream_id IS NOT NULL AND upstream_id <> ''"),
                   ["downstream_type", "downstream_id", "upstream_type", "upstream_id"]).withColumn("depth", F.lit(1))


def load_column_projection(pages: DataFrame) -> DataFrame:
    """One row per source, physical table and column; the first field to map it wins."""
    c = nodes(pages, "datasource_fields", "dataType", "role", "upstreamColumns").select(
        F.col("scope_id").alias("datasource_id"), "seq", "pos", F.col("dataType").alias("field_data_type"), F.col("role").alias("field_role"),
        F.posexplode("upstreamColumns").alias("cpos", "c"))
    t = F.col("c.table")
    rows = c.select(
        "datasource_id", F.coalesce(_filled(t["fullName"]), _filled(t["luid"]), _filled(t["id"])).alias("table_key"),
        F.col("c.name").alias("column_name"), t["fullName"].alias("table_fullname"), F.col("c.remoteType").alias("remote_type"),
        "field_data_type", "field_role", "seq", "pos", "cpos").filter("table_key IS NOT NULL AND column_name <> ''")
    return insert_first_wins(rows, ["datasource_id", "table_key", "column_name"], ["seq", "pos", "cpos"]).drop("seq", "pos", "cpos")


def load_custom_sql(pages: DataFrame) -> DataFrame:
    c = _latest(nodes(pages, "custom_sql"), ["id"]).withColumn("query", F.coalesce("query", F.lit("")))
    return c.select("id", "query", F.get("downstreamDatasources", F.lit(0))["id"].alias("datasource_id"), F.length("query").alias("char_length"),
                    *[x.alias(k) for k, x in fx.sql_grain_signals(F.col("query")).items()])


def load_database_tables(pages: DataFrame) -> DataFrame:
    return _latest(nodes(pages, "database_tables"), ["id"]).select(
        "id", "luid", "name", F.col("fullName").alias("full_name"), F.col("schema").alias("schema_name"),
        F.col("connectionType").alias("connection_type"), F.col("isEmbedded").alias("is_embedded"), F.col("isCertified").alias("is_certified"),
        F.col("columnsConnection.totalCount").alias("column_count"),
        F.col("downstreamDatasourcesConnection.totalCount").alias("downstream_datasource_count"))


def load_dq_warnings(pages: DataFrame) -> DataFrame:
    return _latest(nodes(pages, "data_quality_warnings"), ["id"]).select(
        "id", "luid", F.col("asset.luid").alias("asset_luid"), F.col("asset.name").alias("asset_name"),
        F.col("asset.__typename").alias("asset_type"), F.col("isActive").alias("is_active"), F.col("isSevere").alias("is_severe"),
        F.col("isElevated").alias("is_elevated"), F.col("warningType").alias("warning_type"), "category", "message")


def load_refresh_jobs(pages: DataFrame) -> DataFrame:
    j = _latest(nodes(pages, "refresh_jobs"), ["task_id"])
    return j.select("task_id", "datasource_id", F.try_to_timestamp("scheduled_at").alias("scheduled_at"),
                    F.try_to_timestamp("completed_at").alias("completed_at"), "status")


def load_permissions(pages: DataFrame) -> DataFrame:
    """One row per object, grantee and capability. ``scope_id`` is ``type:id``; a grantee is a group or a user."""
    p = nodes(pages, "permissions").withColumn("grantee_type", F.when(F.col("group").isNotNull(), "group").when(F.col("user").isNotNull(), "user"))
    p = p.filter("grantee_type IS NOT NULL").select(
        F.substring_index("scope_id", ":", 1).alias("object_type"), F.expr("substring(scope_id, instr(scope_id, ':') + 1)").alias("object_id"),
        "grantee_type", F.coalesce("group.id", "user.id").alias("grantee_id"), "seq", "pos", F.explode("capabilities.capability").alias("c"))
    return _latest(p.select("object_type", "object_id", "grantee_type", "grantee_id", F.col("c.name").alias("capability"),
                            F.col("c.mode").alias("mode"), *_SEQ), ["object_type", "object_id", "grantee_type", "grantee_id", "capability"])


def load_usage(pages: DataFrame) -> DataFrame:
    u = _latest(nodes(pages, "usage_events"), ["workbook_id"])
    return u.select("workbook_id", "workbook_luid", "user_id", "event_date", F.coalesce("views", "event_count").alias("event_count"), "last_viewed_days_ago")


LOADERS = {
    "projects": load_projects, "datasources": load_datasources, "workbooks": load_workbooks, "views": load_views,
    "fields": load_fields, "field_usage": load_field_usage, "lineage": load_lineage, "projection": load_column_projection,
    "custom_sql": load_custom_sql, "database_tables": load_database_tables, "dqw": load_dq_warnings,
    "refresh_jobs": load_refresh_jobs, "permissions": load_permissions, "usage_events": load_usage,
}


def flatten_feeds(pages: DataFrame) -> dict[str, DataFrame]:
    """Every table of the model from one frame of landed pages."""
    return {name: load(pages) for name, load in LOADERS.items()}
