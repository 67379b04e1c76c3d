import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from catalog_audit.plans import findings as fnd, rules, scoring
from catalog_audit.plans.coverage import coverage_register
from catalog_audit.sources import feeds, flatten, landed
from catalog_audit.sources.estate import Estate
from catalog_audit.streaming.pages import stream_page_ingest


def page(query, body, seq=1, status=200, scope=None, cursor=None, size=200):
    return {"query_name": query, "scope_id": scope, "cursor": cursor, "page_size": size, "seq": seq, "status": status, "body": body}


def conn(query, nodes, more=False, errors=None, total=None):
    body = {"data": {landed.CONNECTIONS[query]: {"nodes": nodes, "pageInfo": {"hasNextPage": more, "endCursor": "c"}, "totalCount": total}}}
    if errors is not None:
        body["errors"] = errors
    return body


def fields(scope, nodes, more=False):
    return {"data": {"publishedDatasourcesConnection": {"nodes": [{"id": scope, "fieldsConnection": {"nodes": nodes, "pageInfo": {"hasNextPage": more}}}]}}}


@pytest.fixture
def land(spark, tmp_path):
    def write(pages, name="pages"):
        d = tmp_path / name
        d.mkdir(exist_ok=True)
        (d / f"{len(list(d.iterdir()))}.json").write_text("\n".join(json.dumps(p) for p in pages))
        return landed.read_landed(spark, str(d)), str(d)
    return write


@pytest.mark.parametrize("status, body, kind, error", [
    (401, {}, "fatal", "SESSION_EXPIRED"), (200, {"SESSION_EXPIRED": True}, "fatal", "SESSION_EXPIRED"), (500, {"error": "boom"}, "fatal", "boom"),
    (503, {}, "fatal", "HTTP 503"), (200, {"data": {"a": 1}}, "ok", None), (200, {"data": {"a": 1}, "errors": []}, "ok", None),
    (200, {"data": {"a": 1}, "errors": [{"extensions": {"code": "node_limit_exceeded"}}]}, "partial", None),
    (200, {"data": {"a": 1}, "errors": [{"code": "BACKFILL_RUNNING"}, {"extensions": {"code": "OTHER"}, "message": "m"}]}, "fatal", "m"),
    (200, {"data": {}, "errors": [{"code": "BACKFILL_RUNNING"}]}, "fatal", "BACKFILL_RUNNING"),
    (200, {"data": None, "errors": [{"message": ""}]}, "fatal", "GraphQL error")])
def test_response_class(land, status, body, kind, error):
    df, _ = land([page("projects", body, status=status)])
    r = landed.response_class(df).first()
    assert (r.response, r.error) == (kind, error)


def test_partial_page_is_never_loaded(land):
    warn = [{"extensions": {"code": "NODE_LIMIT_EXCEEDED"}}]
    df, _ = land([page("projects", conn("projects", [{"id": "p1", "name": "A"}], errors=warn), seq=1),
                  page("projects", conn("projects", [{"id": "p1", "name": "A"}, {"id": "p2", "name": "B", "parentProjectName": "A"}], True), seq=2),
                  page("projects", conn("projects", [{"id": "p3", "name": "A"}]), seq=3),
                  page("workbooks", conn("workbooks", [{"id": "w"}], errors=warn), seq=1),
                  page("custom_sql", {"data": None, "errors": [{"message": "Cannot query field 'x'"}]})])
    got = {r.query_name: (r.nodes, r.subdivisions, r.status) for r in landed.shard_completeness(df).collect()}
    assert got == {"projects": (3, 1, "complete"), "workbooks": (0, 1, "failed"), "custom_sql": (0, 0, "unavailable")}
    assert rows(flatten.load_projects(df)) == [("p1", "A", None), ("p2", "B", "p3"), ("p3", "A", None)]  # of two projects named A the last
    assert flatten.load_workbooks(df).count() == 0
    reg = {r.measure: (r.status, r.reason) for r in coverage_register(df).collect()}
    assert reg["projects"] == ("ok", "3 rows read") and reg["workbooks"][0] == "failed" and reg["custom_sql"][0] == "unavailable"
    assert reg["fields"] == ("failed", "no sources, so no field shards") and reg["column_lineage"][0] == "skipped"
    assert reg["usage_events"] == ("skipped", "feed not landed") and reg["datasources"] == ("failed", "incomplete: published_datasources")


def test_a_lost_middle_page_shows(land):
    n = [{"id": f"p{i}", "name": str(i)} for i in range(6)]
    given = [page("projects", conn("projects", n[:2], True, total=6), seq=1), page("projects", conn("projects", n[2:4], True, total=6), seq=2), page("projects", conn("projects", n[4:], total=6), seq=3)]
    df, _ = land(given, "whole")
    assert rows(landed.shard_completeness(df), "nodes", "total_count", "status", "error") == [(6, 6, "complete", None)]
    df, _ = land([given[0], given[2], page("projects", conn("projects", n[4:], total=6), seq=4)], "lost")  # the last page landed twice
    assert rows(landed.shard_completeness(df), "pages", "nodes", "status", "error") == [(3, 4, "failed", "4 of 6 nodes read")]
    assert {r.measure: (r.status, r.reason) for r in coverage_register(df).collect()}["projects"] == ("failed", "incomplete: projects: 4 of 6 nodes read")


def with_faults(pages):
    """The same pages with the warnings feed refused for an unknown field, and every thirteenth source's fields answered by truncated pages only."""
    refused = F.col("query_name") == "data_quality_warnings"
    stuck = (F.col("query_name") == "datasource_fields") & (F.substring("scope_id", 4, 20).try_cast("bigint") % 13 == 5)
    body = (F.when(refused, '{"data": null, "errors": [{"message": "Field \'isElevated\' is undefined"}]}')
            .when(stuck, '{"data": {"publishedDatasourcesConnection": {"nodes": [{}]}}, "errors": [{"extensions": {"code": "TIME_LIMIT_EXCEEDED"}}]}')
            .otherwise(F.col("body")))
    return pages.withColumn("body", body)


def test_a_missing_feed_reaches_rules_facets_and_posture(spark):
    e = Estate(spark, "/root/testdata/sf0.001")
    whole, broken = Estate(spark, e.sf_dir), Estate(spark, e.sf_dir)
    clean = feeds.stored_pages(e)
    broken.put("coverage", coverage_register(with_faults(clean.where("query_name NOT IN ('permissions', 'published_datasources')"))))
    reg = {r.measure: (r.status, r.reason) for r in broken["coverage"].collect()}
    assert reg["data_quality_warnings"] == ("unavailable", "query refused by the schema: Field 'isElevated' is undefined")
    assert reg["fields"][0] == "partial" and reg["permissions"] == ("skipped", "feed not landed")
    for t in (whole, broken):
        t.put("dqw", e["dqw"].where("false"))
    assert rules.rule_result(whole, "GOV-02").first().fires and not rules.rule_result(broken, "GOV-02").first().fires
    status = lambda t: {r.mechanism: r.status for r in fnd.governance_posture(t).collect()}
    assert status(broken)["permission_grants"] == status(broken)["data_quality_warnings"] == "unmeasured" != status(whole)["permission_grants"]
    assert scoring.arc_scores(whole).count() > scoring.arc_scores(broken).count()
    assert fnd.calibrate_permissions(broken).count() == 0


def test_fields_and_projection(land):
    up = lambda t, c: {"name": c, "remoteType": "x", "table": t}
    df, _ = land([page("datasource_fields", fields("d1", [
        {"__typename": "ColumnField", "id": "c1", "name": "Sales", "dataType": "REAL", "upstreamColumns": [up({"id": "t", "fullName": "S.T"}, "a"), up({"id": "t2"}, "a"), up({}, "zz")]},
        {"__typename": "ColumnField", "id": "c2", "name": "Sales2", "dataType": "STRING", "upstreamColumns": [up({"id": "t", "fullName": "S.T"}, "a"), up({"luid": "l", "id": "i"}, "b")]},
        {"__typename": "CalculatedField", "id": "k", "name": "K", "formula": "1", "sheetsUsedIn": [
            {"id": "s1", "workbook": {"id": "w1", "luid": "l1"}}, {"workbook": {"luid": "l2"}}, {"id": "s3"}, {"id": "s1", "workbook": {"id": "w1"}}]}]), scope="d1")])
    assert rows(flatten.load_column_projection(df), "table_key", "column_name", "field_data_type") == [("S.T", "a", "REAL"), ("l", "b", "STRING"), ("t2", "a", "REAL")]
    assert rows(flatten.load_field_usage(df)) == [("k", "", "l2"), ("k", "s1", "w1"), ("k", "s3", "")]
    assert rows(flatten.load_fields(df), "id", "datasource_id", "is_calculated") == [("c1", "d1", False), ("c2", "d1", False), ("k", "d1", True)]


def test_lineage_views_and_sql(land):
    df, _ = land([page("published_datasources", conn("published_datasources", [
        {"id": "d", "upstreamTables": [{"id": "t1", "fullName": "S.T"}, {"id": "t2"}, {}], "upstreamDatasources": [{"id": "u", "name": "U"}, {"name": "x"}]}])),
        page("workbooks", conn("workbooks", [{"id": "w", "upstreamDatasources": [{"id": "d"}], "embeddedDatasources": [{"id": "e"}, {"id": "e"}],
                                              "sheets": [{"id": "s", "luid": "L1"}, {"id": "s2"}], "dashboards": [{"id": "b", "luid": "L2"}]}])),
        page("custom_sql", conn("custom_sql", [{"id": "q", "query": "select 1 group by 2", "downstreamDatasources": []}, {"id": "q2", "downstreamDatasources": [{"id": "d"}, {"id": "x"}]}]))])
    assert rows(flatten.load_lineage(df), "downstream_id", "upstream_type", "upstream_id") == [
        ("d", "datasource", "u"), ("d", "table", "S.T"), ("d", "table", "t2"), ("w", "datasource", "d"), ("w", "embedded_datasource", "e")]
    assert rows(flatten.load_views(df), "luid", "kind") == [("L1", "sheet"), ("L2", "dashboard")]
    assert rows(flatten.load_workbooks(df), "sheet_count", "embedded_ds_count") == [(2, 2)]
    assert rows(flatten.load_custom_sql(df), "id", "datasource_id", "char_length", "has_group_by") == [("q", None, 19, True), ("q2", "d", 0, False)]


def test_rest_lists_in_any_container(land):
    perm = {"permissions": {"granteeCapabilities": [
        {"group": {"id": "g"}, "capabilities": {"capability": [{"name": "Read", "mode": "Allow"}, {"name": "Write", "mode": "Deny"}]}},
        {"user": {"id": "u"}, "capabilities": {"capability": [{"name": "Read", "mode": "Allow"}]}}, {"other": {}}]}}
    df, _ = land([page("permissions", perm, scope="workbook:w:1"),
                  page("usage_events", {"odd": {"event": [{"workbook_id": "a", "views": 3, "user_id": "u"}, {"workbook_id": "b", "event_count": 2}]}}),
                  page("refresh_jobs", {"job": [{"task_id": "1", "completed_at": "2025-01-01T00:00:00Z", "status": "Failed"}]}),
                  page("refresh_jobs", {"error": "x"}, seq=2, status=404)])
    assert rows(flatten.load_permissions(df)) == [("workbook", "w:1", "group", "g", "Read", "Allow"), ("workbook", "w:1", "group", "g", "Write", "Deny"),
                                                  ("workbook", "w:1", "user", "u", "Read", "Allow")]
    assert rows(flatten.load_usage(df), "workbook_id", "event_count") == [("a", 3), ("b", 2)]
    reg = {r.measure: (r.status, r.reason) for r in coverage_register(df).collect()}
    assert reg["adoption_depth"] == ("ok", "user id on 1 of 2 events") and reg["refresh_jobs"] == ("failed", "REST status 404")
    assert reg["permissions"] == ("ok", "3 grants read")


def test_ingest_is_idempotent_and_resumes(spark, land, tmp_path):
    n = lambda i, name: {"id": i, "name": name}
    _, folder = land([page("projects", conn("projects", [n("p1", "A")], True), seq=1)], "feed")
    land([page("projects", conn("projects", [n("p1", "A2"), n("p2", "B")]), seq=2)], "feed")
    state = str(tmp_path / "state")
    assert rows(stream_page_ingest(spark, folder, "projects", path=state), "id", "name") == [("p1", "A2"), ("p2", "B")]
    assert rows(stream_page_ingest(spark, folder, "projects", path=state), "id", "name") == [("p1", "A2"), ("p2", "B")]  # nothing new
    land([page("projects", conn("projects", [n("p2", "B"), n("p3", "C")]), seq=3)], "feed")
    assert rows(stream_page_ingest(spark, folder, "projects", path=state), "id", "name") == [("p1", "A2"), ("p2", "B"), ("p3", "C")]


def test_nodes_are_not_gathered_by_shard(spark):
    e = Estate(spark, "/root/testdata/sf0.001")
    plan = feeds.workbooks(e)._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" not in plan and plan.count("Join ") == 1  # one task would get every workbook, under the empty scope
    totals = feeds.fields(e).where("cursor = '0'").select(F.get_json_object("body", "$.data.publishedDatasourcesConnection.nodes[0].fieldsConnection.totalCount").cast("int").alias("n"))
    assert totals.where("n IS NULL").isEmpty()


def test_a_field_is_one_node_unless_it_is_used_widely(spark):
    e = Estate(spark, "/root/testdata/sf0.001")
    hot = spark.range(1000).select(F.col("id").alias("l_orderkey"), F.lit(0).cast("bigint").alias("l_partkey"), F.lit(0).cast("bigint").alias("l_suppkey"), F.col("id").cast("int").alias("l_linenumber"))
    orders = F.col("l_orderkey") * 10_000  # far apart orders do not make nodes
    rest = e.raw("lineitem").select(orders.alias("l_orderkey"), "l_partkey", "l_suppkey", "l_linenumber").where("l_partkey > 0")
    e.put("raw:lineitem", rest.unionByName(hot))
    pages = feeds.fields(e)
    nodes = flatten.nodes(pages, "datasource_fields").where("__typename = 'CalculatedField'")
    per = {r.id: (r.n, r.most) for r in nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("sheetsUsedIn")).alias("most")).collect()}
    assert per.pop("fld_0")[0] > 1
    assert {n for n, _ in per.values()} == {1}
    assert rows(flatten.load_field_usage(pages).select("field_id", "sheet_id", "workbook_id")) == rows(e["field_usage"].select("field_id", "sheet_id", "workbook_id"))


def test_nodes_are_parsed_as_far_as_they_are_wanted(land):
    node = {"id": "f", "dataType": "REAL", "role": "MEASURE", "sheetsUsedIn": [{"id": "s", "workbook": {"id": "w"}}],
            "upstreamColumns": [{"name": "c", "remoteType": "T", "table": {"fullName": "t"}}]}
    df, _ = land([page("datasource_fields", fields("ds", [node]), scope="ds")])
    every, some = flatten.nodes(df, "datasource_fields"), flatten.nodes(df, "datasource_fields", "id", "sheetsUsedIn")
    assert some.columns == ["scope_id", "seq", "pos", "id", "sheetsUsedIn"]
    assert rows(some) == rows(every.select(*some.columns))
    assert [(r.table_key, r.column_name, r.field_data_type) for r in flatten.load_column_projection(df).collect()] == [("t", "c", "REAL")]


def test_a_clean_page_is_audited_without_its_text(land, monkeypatch):
    who = {"owner": {"username": "u"}}
    odd = [page("workbooks", conn("workbooks", [{"id": "w1", **who}, {"id": 2}, {"id": "w3", "owner": {"username": "", "email": "e"}}], total=3)),
           page("workbooks", conn("workbooks", [{"id": "w4"}, {"name": "no id"}], total=9), seq=2),
           page("workbooks", conn("workbooks", [{"id": "w5"}], errors=[{"code": "NODE_LIMIT_EXCEEDED"}]), seq=3),
           page("workbooks", {"data": {"otherConnection": {"nodes": [{"id": "w6"}], "totalCount": 1}}}, seq=4),
           page("datasource_fields", fields("d", [{"id": "f1"}, {"id": "f2"}], more=True), scope="d"),
           page("published_datasources", {"data": None}), page("refresh_jobs", {"x": {"job": []}}, status=500)]
    pages, _ = land(odd)
    columns = ["query_name", "seq", "response", "error", "ids", "total_count", "has_next", "unowned"]
    whole = rows(landed.page_audit(pages), *columns)
    assert whole == [
        ("datasource_fields", 1, "ok", None, ["f1", "f2"], None, True, None),
        ("published_datasources", 1, "ok", None, None, None, False, None),
        ("refresh_jobs", 1, "fatal", "REST status 500", None, None, False, None),
        ("workbooks", 1, "ok", None, ["w1", "2", "w3"], 3, False, 1),
        ("workbooks", 2, "ok", None, ["w4", '{"name":"no id"}'], 9, False, 2),
        ("workbooks", 3, "partial", None, None, None, False, None),
        ("workbooks", 4, "ok", None, ["w6"], 1, False, 1)]
    nothing = "struct<nodes: array<string>, pageInfo: struct<hasNextPage: boolean, endCursor: string>, totalCount: bigint>"
    monkeypatch.setattr(landed, "_connection", lambda query, data: F.lit(None).cast(nothing))
    short = rows(landed.page_audit(pages), *columns)
    assert [r for r in short if r[4]] == [r for r in whole if r[4] in (["f1", "f2"], ["w1", "2", "w3"])]
