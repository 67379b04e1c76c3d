"""Landed API pages: reading, classifying, and auditing shards.

One row is one response: query_name, scope_id, cursor, page_size, seq (order of the
request within its shard), status, body (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = ("query_name string, scope_id string, cursor string, page_size int, seq bigint, status int, body string")
_ENVELOPE = ("SESSION_EXPIRED string, error string, data string, "
             "errors array<struct<message: string, code: string, extensions: struct<code: string>>>")
_CONNECTION = "map<string, struct<nodes: array<string>, pageInfo: struct<hasNextPage: boolean, endCursor: string>, totalCount: bigint>>"

# Codes that still return usable data, connection names, schema-error markers,
# and the item key of each REST list.
WARNING_CODES = [
    "BACKFILL_RUNNING", "NODE_LIMIT_EXCEEDED", "TIME_LIMIT_EXCEEDED", "MAX_PAGE_SIZE_EXCEEDED",
    "INHERITANCE_INCOMPLETE", "LINKED_RESULTS_INCOMPLETE", "USER_VISIBILITY_IS_LIMITED", "PERMISSIONS_MODE_SWITCHED",
]
CONNECTIONS = {
    "projects": "projectsConnection",
    "published_datasources": "publishedDatasourcesConnection",
    "workbooks": "workbooksConnection",
    "datasource_fields": "publishedDatasourcesConnection",
    "custom_sql": "customSQLTablesConnection",
    "database_tables": "databaseTablesConnection",
    "data_quality_warnings": "dataQualityWarningsConnection",
}
# what the audit asks of a clean page
_OF = "pageInfo: struct<hasNextPage: boolean, endCursor: string>, totalCount: bigint"
_NODE = "id: string, owner: struct<username: string, email: string>"
_AUDITED = ("SESSION_EXPIRED string, errors array<string>, data struct<" + ", ".join(
    f"{c}: struct<nodes: array<struct<{_NODE}, fieldsConnection: struct<nodes: array<struct<{_NODE}>>, {_OF}>>>, {_OF}>"
    for c in dict.fromkeys(CONNECTIONS.values())) + ">")
SCHEMA_ERRORS = ["is undefined", "FieldUndefined", "Cannot query field", "Unknown field", "Unknown type"]
REST_ITEMS = {"usage_events": "event", "refresh_jobs": "job", "permissions": "granteeCapabilities"}


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Pages from a folder of JSON lines; an object body is kept as its text."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def _present(json_text: Column) -> Column:
    return json_text.isNotNull() & ~json_text.isin("", "null", "{}", "[]", "false", "0")


def response_class(pages: DataFrame) -> DataFrame:
    """Add ``response`` (ok, partial, fatal), ``error`` and the parsed ``data`` text."""
    p = pages.withColumn("_e", F.from_json("body", _ENVELOPE))
    codes = F.filter(F.transform("_e.errors", lambda e: F.upper(F.coalesce(
        F.when(e["extensions"]["code"] != "", e["extensions"]["code"]), e["code"], F.lit("")))), lambda c: c != "")
    known = F.array(*map(F.lit, WARNING_CODES))
    warned = _present(F.col("_e.data")) & (F.size("_codes") > 0) & F.forall("_codes", lambda c: F.array_contains(known, c))
    p = p.withColumn("_codes", F.coalesce(codes, F.array().cast("array<string>")))
    rest = F.col("query_name").isin(*REST_ITEMS)
    expired = (F.col("status") == 401) | _present(F.col("_e.SESSION_EXPIRED"))
    clean = F.coalesce(F.size(F.col("_e.errors")), F.lit(0)) <= 0
    kind = (F.when(rest, F.when(F.col("status").between(200, 299), "ok").otherwise("fatal"))
            .when(expired, "fatal").when(F.col("status") != 200, "fatal")
            .when(clean, "ok").when(warned, "partial").otherwise("fatal"))
    first = F.get(F.filter(F.transform("_e.errors", lambda e: e["message"]), lambda m: F.coalesce(m != "", F.lit(False))), F.lit(0))
    error = (F.when(kind != "fatal", F.lit(None)).when(rest, F.concat(F.lit("REST status "), F.col("status")))
             .when(expired, "SESSION_EXPIRED")
             .when(F.col("status") != 200, F.coalesce("_e.error", F.concat(F.lit("HTTP "), F.col("status"))))
             .otherwise(F.coalesce(first, F.get("_codes", F.lit(0)), F.lit("GraphQL error"))))
    return p.select(*pages.columns, kind.alias("response"), error.alias("error"), F.col("_e.data").alias("data"))


def _connection(query: Column, data: Column) -> Column:
    """The page's connection; fields sit one level deeper, under their source."""
    outer = F.get(F.map_values(F.from_json(data, _CONNECTION)), F.lit(0))
    fields = F.from_json(F.get_json_object(F.get(outer["nodes"], F.lit(0)), "$.fieldsConnection"),
                         "nodes array<string>, pageInfo struct<hasNextPage: boolean, endCursor: string>, totalCount bigint")
    return F.when(query == "datasource_fields", fields).otherwise(outer)


def accepted_nodes(pages: DataFrame, query_name: str, node_schema: str) -> DataFrame:
    """Typed nodes of one query with their arrival order (seq, pos).

    Complete responses only: a partial page is never accepted, its retry is. The body is
    parsed once, straight into the node type.
    """
    p = pages.filter(F.col("query_name") == query_name)
    if query_name in REST_ITEMS:
        raw = F.from_json(_items(F.col("body"), REST_ITEMS[query_name]), f"array<{node_schema}>")
        ok = p.filter(F.col("status").between(200, 299)).withColumn("_nodes", raw)
    else:
        inner = f"struct<nodes: array<{node_schema}>>"
        if query_name == "datasource_fields":  # one level deeper, under the source
            inner = f"struct<nodes: array<struct<fieldsConnection: {inner}>>>"
        shape = f"SESSION_EXPIRED string, errors array<string>, data struct<{CONNECTIONS[query_name]}: {inner}>"
        found = F.col(f"_e.data.{CONNECTIONS[query_name]}.nodes")
        if query_name == "datasource_fields":
            found = F.get(found, F.lit(0))["fieldsConnection"]["nodes"]
        p = p.filter("status = 200").withColumn("_e", F.from_json("body", shape))
        clean = ~_present(F.col("_e.SESSION_EXPIRED")) & (F.coalesce(F.size("_e.errors"), F.lit(0)) <= 0)
        ok = p.filter(clean).withColumn("_nodes", found)
    return ok.select("scope_id", "seq", F.posexplode("_nodes")).select("scope_id", "seq", "pos", "col.*")


def _items(body: Column, key: str) -> Column:
    """The list under ``key`` wherever it sits (the container's name is irregular)."""
    def under(text):
        return F.get(F.filter(F.transform(F.map_values(F.from_json(text, "map<string, string>")),
                                          lambda v: F.get_json_object(v, f"$.{key}")), lambda v: v.startswith("[")), F.lit(0))
    return F.coalesce(F.get_json_object(body, f"$.{key}"), under(body))


def page_audit(pages: DataFrame) -> DataFrame:
    """What each response says of itself, in one pass over the bodies.

    (query_name, scope_id, cursor, seq, response, error, ids of its nodes, total stated, whether a page follows,
    data sources or workbooks without any owner). A partial or fatal page has no nodes. A clean page whose nodes all
    have an id is parsed straight into what is asked of it; any other goes the long way, by its text.
    """
    graph = F.col("query_name").isin(*CONNECTIONS)
    p = pages.withColumn("_t", F.when(graph & (F.col("status") == 200), F.from_json("body", _AUDITED)))
    p = p.withColumn("_own", F.coalesce(*[F.col(f"_t.data.{c}") for c in dict.fromkeys(CONNECTIONS.values())]))
    p = p.withColumn("_typed", F.when(F.col("query_name") == "datasource_fields", F.get("_own.nodes", F.lit(0))["fieldsConnection"]).otherwise(
        F.struct(F.transform("_own.nodes", lambda n: n.dropFields("fieldsConnection")).alias("nodes"), "_own.pageInfo", "_own.totalCount")))
    clean = ~_present(F.col("_t.SESSION_EXPIRED")) & (F.coalesce(F.size("_t.errors"), F.lit(0)) <= 0)
    plain = F.coalesce(clean & F.forall("_typed.nodes", lambda n: n["id"].isNotNull()), F.lit(False))
    rest = F.coalesce(F.col("query_name").isin(*REST_ITEMS), F.lit(False))  # classed by status alone
    p = p.withColumn("_plain", plain).withColumn("body", F.when(~F.col("_plain") & ~rest, F.col("body")))
    c = response_class(p).withColumn("_c", F.when((F.col("response") == "ok") & graph & ~F.col("_plain"), _connection(F.col("query_name"), F.col("data"))))
    named = lambda n, path: F.coalesce(F.get_json_object(n, path), F.lit("")) != ""
    told = lambda n, key: F.coalesce(n["owner"][key], F.lit("")) != ""
    either = lambda typed, text: F.when(F.col("_plain"), typed).otherwise(text)
    # the other objects have no owner to look for
    unowned = F.when(F.col("query_name").isin("published_datasources", "workbooks"), either(
        F.size(F.filter("_typed.nodes", lambda n: ~told(n, "username") & ~told(n, "email"))),
        F.size(F.filter("_c.nodes", lambda n: ~named(n, "$.owner.username") & ~named(n, "$.owner.email")))))
    return c.select(
        "query_name", F.coalesce("scope_id", F.lit("")).alias("scope_id"), "cursor", "seq", "response", "error",
        either(F.col("_typed.nodes")["id"], F.transform("_c.nodes", lambda n: F.coalesce(F.get_json_object(n, "$.id"), n))).alias("ids"),
        either(F.col("_typed.totalCount"), F.col("_c.totalCount")).alias("total_count"),
        F.coalesce(either(F.col("_typed.pageInfo.hasNextPage"), F.col("_c.pageInfo.hasNextPage")), F.lit(False)).alias("has_next"),
        unowned.cast("bigint").alias("unowned"))


def shard_completeness(pages: DataFrame) -> DataFrame:
    return shard_status(page_audit(pages))


def shard_status(audit: DataFrame) -> DataFrame:
    """Per shard: pages, distinct accepted nodes, subdivisions, and whether it is whole.

    A shard is complete when an accepted page says that no page follows and its distinct nodes are as many as its
    pages state, so a page missing from the middle shows. Otherwise its last error tells
    ``unavailable`` (the site's schema lacks the query) from ``failed``. Nodes are counted through one row per
    (shard, id), which also carries the page figures of the page's first row: no shard is gathered.
    """
    shard = ["query_name", "scope_id"]
    each = audit.where(F.col("query_name").isin(*CONNECTIONS)).select(
        *shard, "seq", "response", "error", "total_count", "has_next", F.posexplode_outer("ids").alias("pos", "id"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    by_id = each.groupBy(*shard, "id").agg(
        F.count_if(first).alias("pages"), F.count_if(first & (F.col("response") == "partial")).alias("subdivisions"), F.max("total_count").alias("total_count"),
        F.bool_or((F.col("response") == "ok") & ~F.col("has_next")).alias("reached_end"),
        F.max(F.when(F.col("error").isNotNull(), F.struct("seq", "error"))).alias("last"))
    g = by_id.groupBy(*shard).agg(
        F.sum("pages").alias("pages"), F.count("id").alias("nodes"), F.max("total_count").alias("total_count"), F.sum("subdivisions").alias("subdivisions"),
        F.bool_or("reached_end").alias("reached_end"), F.max("last").alias("last"))
    short = F.coalesce(F.col("nodes") < F.col("total_count"), F.lit(False))
    whole = F.col("reached_end") & ~short
    lacking = F.coalesce(F.col("last.error").rlike("|".join(SCHEMA_ERRORS)), F.lit(False))
    status = F.when(whole, "complete").when(~F.col("reached_end") & lacking, "unavailable").otherwise("failed")
    error = F.when(whole, F.lit(None)).when(F.col("reached_end"), F.format_string("%d of %d nodes read", "nodes", "total_count")).otherwise(F.col("last.error"))
    return g.select(*shard, "pages", "nodes", "total_count", "subdivisions", status.alias("status"), error.alias("error"))
