"""The derived estate as landed API pages.

Pages hold at most ``SIZE`` nodes of consecutive keys. Every fifth page is preceded by a
truncated response with a warning code, as a real API gives under load, so readers must
reject it and take the retry. Every page states how many nodes its shard has.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.session import shared_dir
from catalog_audit.sources.estate import Estate, row_count, tagged
from catalog_audit.sources.landed import CONNECTIONS

SIZE = 200
USES = 200  # sheets a field node lists; a field used more often becomes several nodes


def _links(ids: Column) -> Column:
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.concat(F.lit("name "), i).alias("name")))


def _graph_pages(df: DataFrame, query: str, scoped: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """df: scope, n, node. ``keys`` are the scope, n and id of the same nodes, where they can be had without building them.

    Nodes move once, into their pages; what a shard's pages state (its last page, its nodes) is found from the keys and
    meets the pages, not the nodes. Without scopes it is one row for the whole feed.
    """
    keys = df.select("scope", "n", F.col("node.id").alias("id")) if keys is None else keys
    facts = [F.floor(F.max("n") / SIZE).alias("last"), F.count_distinct("id").alias("total")]
    g = df.groupBy("scope", F.floor(F.col("n") / SIZE).alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "node"))), lambda x: x["node"]).alias("nodes"))  # one page's nodes
    if scoped:
        g = g.join(keys.groupBy("scope").agg(*facts), "scope")
    else:
        g = g.withColumn("_s", keys.agg(*facts).select(F.struct("last", "total").alias("s")).scalar()).select("*", "_s.*")
    conn = F.struct(F.col("nodes").alias("nodes"), F.struct((F.col("page") < F.col("last")).alias("hasNextPage"),
                    F.col("page").cast("string").alias("endCursor")).alias("pageInfo"), F.col("total").alias("totalCount"))
    partial = conn.withField("nodes", F.slice("nodes", 1, 1))
    warning = F.array(F.struct(F.lit("limit").alias("message"), F.struct(F.lit("node_limit_exceeded").alias("code")).alias("extensions")))

    def body(c, errors=None):
        if scoped:
            c = F.struct(F.array(F.struct(F.col("scope").alias("id"), c.alias("fieldsConnection"))).alias("nodes"))
        data = F.struct(F.struct(c.alias(CONNECTIONS[query])).alias("data"), *([errors.alias("errors")] if errors is not None else []))
        return F.to_json(data)

    attempts = F.array_compact(F.array(
        F.when(F.col("page") % 5 == 0, F.struct((F.col("page") * 2).alias("seq"), F.lit(SIZE).alias("size"), body(partial, warning).alias("body"))),
        F.struct((F.col("page") * 2 + 1).alias("seq"), F.lit(SIZE // 2).alias("size"), body(conn).alias("body"))))
    return g.select("scope", "page", F.explode(attempts).alias("a")).select(
        F.lit(query).alias("query_name"), F.col("scope").alias("scope_id"), F.col("page").cast("string").alias("cursor"),
        F.col("a.size").alias("page_size"), F.col("a.seq").cast("bigint").alias("seq"), F.lit(200).alias("status"), F.col("a.body").alias("body"))


def _rest_pages(df: DataFrame, query: str, container: str, key: str) -> DataFrame:
    g = df.groupBy("scope", F.floor(F.col("n") / SIZE).alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "node"))), lambda x: x["node"]).alias(key))
    return g.select(F.lit(query).alias("query_name"), F.col("scope").alias("scope_id"), F.col("page").cast("string").alias("cursor"),
                    F.lit(SIZE).alias("page_size"), F.col("page").cast("bigint").alias("seq"), F.lit(200).alias("status"),
                    F.to_json(F.struct(F.struct(F.col(key)).alias(container))).alias("body"))


def _none() -> Column:
    return F.lit(None).cast("string")


def projects(e: Estate) -> DataFrame:
    n = e.raw("nation")
    parent = n.select(F.col("n_nationkey").alias("n_regionkey"), F.col("n_name").alias("parent"))
    node = F.struct(tagged("prj_", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("parent").alias("parentProjectName"))
    return _graph_pages(n.join(parent, "n_regionkey", "left").select(_none().alias("scope"), F.col("n_nationkey").alias("n"), node.alias("node")),
                        "projects")


def datasources(e: Estate) -> DataFrame:
    s, k = e.raw("supplier"), F.col("s_suppkey")
    names = e.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("project"))
    d = e["datasources"].select("id", "owner", "is_certified")
    table = tagged("tbl_", F.col("s_nationkey") % 9)
    node = F.struct(
        tagged("ds_", k).alias("id"), tagged("dsl_", k).alias("luid"), F.col("s_name").alias("name"), F.col("project").alias("projectName"),
        F.col("is_certified").alias("isCertified"), F.struct(F.col("owner").alias("username")).alias("owner"),
        F.struct((k % 7).cast("bigint").alias("totalCount")).alias("fieldsConnection"),
        F.when(k % 10 != 3, F.array(F.struct(F.concat(F.lit("id "), table).alias("id"), table.alias("fullName")))).alias("upstreamTables"),
        F.when((k % 4 == 0) & (k > 0), _links(F.array(tagged("ds_", F.floor(k / 4))))).alias("upstreamDatasources"))
    rows = s.withColumn("id", tagged("ds_", k)).join(d, "id").join(names, "s_nationkey", "left")
    return _graph_pages(rows.select(_none().alias("scope"), k.alias("n"), node.alias("node")), "published_datasources")


def workbooks(e: Estate) -> DataFrame:
    p, k = e.raw("part"), F.col("p_partkey")
    pairs = e.raw("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", (F.col("l_returnflag") == "R").alias("emb")).distinct()
    # one node lists each source once, so the lists are bounded by the number of sources
    up = pairs.groupBy("p_partkey").agg(
        F.array_sort(F.collect_list(F.when(~F.col("emb"), tagged("ds_", "l_suppkey")))).alias("pub"),
        F.array_sort(F.collect_list(F.when(F.col("emb"), tagged("ds_", "l_suppkey")))).alias("emb"))

    def view(key, name):
        return F.array(F.struct(tagged("s", key).alias("id"), F.lit(name).alias("name"), tagged("vw_", key).alias("luid")))

    node = F.struct(
        tagged("wb_", k).alias("id"), tagged("wbl_", k).alias("luid"), F.concat_ws(" ", "p_name", k.cast("string")).alias("name"),
        F.col("p_brand").alias("projectName"), F.struct(tagged("user", k % 40).alias("username")).alias("owner"),
        _links(F.col("pub")).alias("upstreamDatasources"), _links(F.col("emb")).alias("embeddedDatasources"),
        view(2 * k, "sheet").alias("sheets"), view(2 * k + 1, "board").alias("dashboards"))
    return _graph_pages(p.join(up, "p_partkey", "left").select(_none().alias("scope"), k.alias("n"), node.alias("node")),
                        "workbooks", keys=p.select(k.alias("n"), k.alias("id")))


def fields(e: Estate) -> DataFrame:
    calc = e["calc"].withColumn("k", F.substring("id", 5, 20).cast("bigint")).withColumn("ns", row_count(e.raw("supplier")))
    # pairs stay numbers until their node is built
    uses = e.raw("lineitem").select(F.col("l_partkey").alias("k"), F.struct("l_linenumber", (F.col("l_orderkey") % row_count(e.raw("part"))).alias("w")).alias("s"))
    often = uses.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / USES).cast("int").alias("blocks"))
    usage = uses.join(often, "k").groupBy("k", F.pmod(F.hash("s"), "blocks").alias("block")).agg(F.collect_set("s").alias("uses")).select(
        "k", F.transform("uses", lambda u: F.struct(tagged("sh_", u["l_linenumber"]).alias("id"), F.struct(tagged("wb_", u["w"]).alias("id")).alias("workbook"))).alias("sheets"))
    empty = F.lit(None).cast("array<struct<name: string, remoteType: string, table: struct<id: string, luid: string, fullName: string>>>")
    cnode = calc.join(usage, "k", "left").select(
        F.col("datasource_id").alias("scope"), (F.lit(5) + F.floor(F.col("k") / F.col("ns"))).alias("n"),
        F.struct(F.lit("CalculatedField").alias("__typename"), "id", "name", "description", "formula", F.col("data_type").alias("dataType"), "role",
                 F.col("sheets").alias("sheetsUsedIn"), empty.alias("upstreamColumns")).alias("node"))
    s = e["columns"].withColumn("sk", F.split("id", "_")[1].cast("bigint")).withColumn("i", F.split("id", "_")[2].cast("int"))
    p = e["projection"].select("datasource_id", "table_key", "column_name", (F.substring("column_name", 2, 9).cast("int") % 5).alias("i"))
    up = p.groupBy("datasource_id", "i").agg(F.array_sort(F.collect_list(F.struct(  # forty columns at most
        F.col("column_name").alias("name"), F.lit("TYPE").alias("remoteType"),
        F.struct(F.concat(F.lit("id "), "table_key").alias("id"), _none().alias("luid"), F.col("table_key").alias("fullName")).alias("table")))).alias("up"))
    none = F.lit(None).cast("array<struct<id: string, workbook: struct<id: string>>>")
    snode = s.join(up, ["datasource_id", "i"], "left").select(
        F.col("datasource_id").alias("scope"), F.col("i").cast("bigint").alias("n"),
        F.struct(F.lit("ColumnField").alias("__typename"), "id", "name", "description", "formula", F.col("data_type").alias("dataType"), "role",
                 none.alias("sheetsUsedIn"), F.col("up").alias("upstreamColumns")).alias("node"))
    both = snode.unionByName(cnode)
    keys = s.select(F.col("datasource_id").alias("scope"), F.col("i").cast("bigint").alias("n"), "id").unionByName(
        calc.select(F.col("datasource_id").alias("scope"), (F.lit(5) + F.floor(F.col("k") / F.col("ns"))).alias("n"), "id"))
    return _graph_pages(both, "datasource_fields", scoped=True, keys=keys)


def custom_sql(e: Estate) -> DataFrame:
    c, k = e.raw("customer"), F.col("c_custkey")
    q = e["custom_sql"].withColumn("n", F.substring("id", 5, 20).cast("bigint"))
    node = F.struct("id", "query", F.array(F.struct(F.col("datasource_id").alias("id")), F.struct(F.lit("ds_other").alias("id"))).alias("downstreamDatasources"))
    return _graph_pages(q.select(_none().alias("scope"), "n", node.alias("node")), "custom_sql")


def database_tables(e: Estate) -> DataFrame:
    t = e["database_tables"].withColumn("n", F.substring("id", 5, 20).cast("bigint"))
    node = F.struct("id", F.col("is_embedded").alias("isEmbedded"), F.col("is_certified").alias("isCertified"),
                    F.struct(F.col("column_count").alias("totalCount")).alias("columnsConnection"),
                    F.struct(F.col("downstream_datasource_count").alias("totalCount")).alias("downstreamDatasourcesConnection"))
    return _graph_pages(t.select(_none().alias("scope"), "n", node.alias("node")), "database_tables")


def dq_warnings(e: Estate) -> DataFrame:
    w = e["dqw"].withColumn("n", F.substring("id", 5, 20).cast("bigint"))
    node = F.struct("id", F.col("is_active").alias("isActive"), F.col("is_elevated").alias("isElevated"), F.col("warning_type").alias("warningType"),
                    F.struct(F.col("asset_luid").alias("luid"), F.lit("Source").alias("__typename")).alias("asset"))
    return _graph_pages(w.select(_none().alias("scope"), "n", node.alias("node")), "data_quality_warnings")


def refresh_jobs(e: Estate) -> DataFrame:
    j = e["refresh_jobs"]
    node = F.struct(F.col("task_id").cast("string").alias("task_id"), "datasource_id", F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("completed_at"), "status")
    return _rest_pages(j.select(_none().alias("scope"), F.col("task_id").alias("n"), node.alias("node")), "refresh_jobs", "backgroundJobs", "job")


def permissions(e: Estate) -> DataFrame:
    p = e["permissions"]
    node = F.struct(F.struct(F.col("grantee_id").alias("id")).alias("group"),
                    F.struct(F.array(F.struct(F.col("capability").alias("name"), "mode")).alias("capability")).alias("capabilities"))
    return _rest_pages(p.select(F.concat_ws(":", "object_type", "object_id").alias("scope"), F.lit(0).alias("n"), node.alias("node")),
                       "permissions", "permissions", "granteeCapabilities")


def usage_events(e: Estate) -> DataFrame:
    u = e["usage_events"].withColumn("n", F.substring("workbook_id", 4, 20).cast("bigint"))
    odd = F.col("n") % 2 == 1
    node = F.struct("workbook_id", F.date_format("last_ts", "yyyy-MM-dd").alias("event_date"), F.when(odd, F.col("event_count")).alias("views"),
                    F.when(~odd, F.col("event_count")).alias("event_count"), F.col("last_viewed_days_ago").cast("int").alias("last_viewed_days_ago"))
    return _rest_pages(u.select(_none().alias("scope"), "n", node.alias("node")), "usage_events", "usage", "event")


FEEDS = {
    "projects": projects, "published_datasources": datasources, "workbooks": workbooks, "datasource_fields": fields,
    "custom_sql": custom_sql, "database_tables": database_tables, "data_quality_warnings": dq_warnings,
    "refresh_jobs": refresh_jobs, "permissions": permissions, "usage_events": usage_events,
}


_landed: dict[tuple[str, str, str], DataFrame] = {}


def stored_pages(e: Estate, *names: str) -> DataFrame:
    """Pages of the named feeds as they lie in the shared folder, landed once per application and folder of tables."""
    parts = []
    for n in names or FEEDS:
        key = (e.spark.sparkContext.applicationId, e.sf_dir, n)
        if key not in _landed:
            pages, path = FEEDS[n](e), f"{shared_dir(e.spark)}/catalog_audit/landed-{n}-{uuid.uuid4().hex}"
            pages.write.parquet(path)
            _landed[key] = e.spark.read.schema(pages.schema).parquet(path)
        parts.append(_landed[key])
    return reduce(DataFrame.unionByName, parts)


def stored_register(e: Estate) -> DataFrame:
    """The coverage register of all landed pages, written once beside them: part of landing, not of the queries that read it."""
    from catalog_audit.plans.coverage import coverage_register
    key = (e.spark.sparkContext.applicationId, e.sf_dir, "register")
    if key not in _landed:
        register, path = coverage_register(stored_pages(e)), f"{shared_dir(e.spark)}/catalog_audit/landed-register-{uuid.uuid4().hex}"
        register.coalesce(1).write.parquet(path)
        _landed[key] = e.spark.read.schema(register.schema).parquet(path)
    return _landed[key]
