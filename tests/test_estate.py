"""Behaviour that needs a whole (small) estate: usage, coverage, rules, disagreement, sinks."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from catalog_audit.operators import detail, disagreement as dis, measures as m, usage as u
from catalog_audit.plans import findings as fnd, reporting as rep, rules, scoring
from catalog_audit.sources.estate import Estate
from catalog_audit.sources.upsert import insert_first_wins, run_registry, upsert_last_wins

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def estate(spark):
    return Estate(spark, SF)


def test_usage_rolls_up_to_the_workbook(frame):
    ts = "2025-08-%02d 10:00:00"
    raw = [("v1", d) for d in [1] * 10] + [("v2", 5)] * 5 + [("v3", 3)] * 2 + [("w2", 7)] * 4 + [("ghost", 9)] * 99 + [(None, 9)]
    t = {"raw_usage": frame("item_luid string, event_name string, event_ts string", [(i, "view", ts % d) for i, d in raw] + [("v1", "edit", ts % 20)])
         .withColumn("event_ts", F.to_timestamp("event_ts")),
         "views": frame("luid string, workbook_id string", [("v1", "A"), ("v2", "A"), ("v3", "A"), ("w2", "A")]),
         "workbooks": frame("id string, luid string", [("A", "wA"), ("B", "w2")])}
    got = rows(u.usage_rollup(t, "2025-09-01"), "workbook_id", "event_count", "last_viewed_days_ago")
    assert got == [("A", 17, 27), ("B", 4, 25)]  # the workbook's own identifier wins over a view's
    r = u.usage_match_totals(t, "2025-09-01").first()
    assert (r.matched_workbooks, r.matched_views, r.unmatched_items, r.unmatched_views) == (2, 21, 1, 99)


def test_unmeasured_workbooks(frame):
    t = {"workbooks": frame("id string, name string, project_name string", [("a", "A", "p"), ("b", "B", "p"), ("c", "C", "p")]),
         "usage_events": frame("workbook_id string, event_count bigint", [("a", 3), ("b", 0)]),
         "field_usage": frame("field_id string, sheet_id string, workbook_id string", [("f", "1", "a"), ("f", "2", "a"), ("f", "1", "c"), ("g", "1", "c")])}
    assert rows(u.zero_view_workbooks(t), "id") == [("b",), ("c",)]
    assert rows(u.field_views(t)) == [("f", 3, 1)]  # same workbook once; an unmeasured one adds nothing
    assert u.content_activation(t).first().activation == pytest.approx(1 / 3)


def test_latest_refresh_keeps_ties(frame):
    t = {"refresh_jobs": frame("datasource_id string, completed_at string, status string", [
        ("a", "2025-01-01", "Failed"), ("a", "2025-01-02", "Success"), ("b", "2025-01-02", "Success"), ("b", "2025-01-02", "Failed"),
        ("c", None, "Failed"), ("d", None, "Failed"), ("d", "2025-01-01", "Success")])}
    assert rows(m.latest_refresh(t), "datasource_id", "failed") == [("a", False), ("b", True), ("d", False)]


def test_columns_not_shared(frame):
    t = {"projection": frame("datasource_id string, table_key string, column_name string, field_data_type string", [
        ("d1", "t", "a", "S"), ("d2", "t", "a", "I"), ("d1", "t", "b", None), ("d2", "t", "b", "S"), ("d1", "t", "c", "S"), ("d1", "alone", "z", "S")])}
    assert rows(m.column_divergence(t), "column_name", "type_divergent", "not_shared") == [("a", True, False), ("b", False, False), ("c", False, True)]
    assert rows(m.columns_not_shared(t), "column_name") == [("c",)]


def test_upserts_and_registry(frame):
    df = frame("k string, s int, v string", [("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z")])
    assert rows(upsert_last_wins(df, ["k"], ["s"])) == [("a", 3, None), ("b", 1, "z")]
    assert rows(insert_first_wins(df, ["k"], ["s"])) == [("a", 1, "x"), ("b", 1, "z")]
    once = upsert_last_wins(df, ["k"], ["s"])
    assert rows(upsert_last_wins(once.unionByName(df), ["k"], ["s"])) == rows(once)  # replay changes nothing
    a = frame("run_id string, seq int, started_at string", [("r1", 1, "2025-01-01"), ("r1", 2, "2025-03-01"), ("r2", 1, "2025-02-01"), ("r3", 1, None)])
    a = a.withColumn("started_at", F.to_timestamp("started_at"))
    assert rows(run_registry(a).withColumn("d", F.date_format("started_at", "yyyy-MM-dd")), "run_id", "d", "is_latest") == [
        ("r1", "2025-01-01", False), ("r2", "2025-02-01", True), ("r3", None, False)]


def with_coverage(estate, **status):
    t = dict(estate._made)
    cov = estate["coverage"]
    for measure, s in status.items():
        cov = cov.withColumn("status", F.when(F.col("measure") == measure, s).otherwise(F.col("status")))

    class View(dict):
        def __missing__(self, key):
            return estate[key]
    view = View(t)
    view["coverage"] = cov
    return view


def test_unmeasured_never_reads_as_clean(estate):
    r = fnd.retirement_case(with_coverage(estate, usage_events="failed")).first()
    assert not r.usage_measured and r.zero_view_workbooks is None and r.total_views is None and r.workbooks_total > 0
    facets = scoring.facet_threshold_scores(with_coverage(estate, usage_events="failed"))
    assert "adoption.reach" not in {x.id for x in facets.collect()}
    assert scoring.arc_scores(with_coverage(estate, datasources="partial")).count() == 0
    p = fnd.governance_posture(with_coverage(estate, permissions="skipped", data_quality_warnings="failed"))
    assert {(x.mechanism, x.status) for x in p.collect()} >= {("permission_grants", "unmeasured"), ("explicit_deny", "unmeasured"), ("data_quality_warnings", "unmeasured")}
    states = {x.dominance for x in fnd.definition_multiplicity(with_coverage(estate, usage_events="failed")).collect()}
    assert states <= {"singular", "unmeasured"}
    assert fnd.calibrate_permissions(with_coverage(estate, permissions="failed")).count() == 0
    assert fnd.calibrate_freshness(with_coverage(estate, refresh_jobs="failed")).first().n == 0
    none = {"coverage": estate["coverage"], "dqw": estate["dqw"].filter("false"), "fields": estate["fields"]}
    assert rules.rule_result(none, "GOV-02").first().fires
    none["coverage"] = with_coverage(estate, data_quality_warnings="failed")["coverage"]
    assert not rules.rule_result(none, "GOV-02").first().fires


def test_thresholds_change_firing(estate):
    from catalog_audit.plans import catalog
    r = catalog.load_rules()
    r["flags"]["SEM-04"]["threshold"] = {"max_field_count": 1}
    assert rules.rule_result(estate, "SEM-04", r).first().fires
    r["flags"]["GOV-03"]["threshold"] = {"require_elevated": True, "min_count": 1}
    assert rules.rule_result(estate, "GOV-03", r).first()["count"] <= rules.rule_result(estate, "GOV-03").first()["count"]


def test_domain_scoped_flags_repeat_per_domain(estate):
    got = rules.evaluate_rules(estate, domains=["a", "b"]).filter("outcome = 'fired'").groupBy("flag_id").agg(F.collect_set("domain").alias("d"))
    for r in got.collect():
        assert sorted(r.d) == (["a", "b"] if r.flag_id.startswith("SEM-0") and r.flag_id != "SEM-04" else [""])


VARIANT = ("group_id string, label string, field_id string, field_name string, definition_key string, views bigint, usage_rank bigint, is_dominant boolean")


def disagreement_tables(frame, members):
    v = frame("group_id string, label string, field_id string, name string, definition_key string, views bigint, usage_rank bigint, is_dominant boolean", members)
    ids = [x[2] for x in members]
    return {"variants": v,
            "fields": frame("id string, datasource_id string, role string, data_type string", [(i, "ds", "MEASURE", "REAL") for i in ids]),
            "datasources": frame("id string, name string, luid string, owner string", [("ds", "DS", "L", "o")]),
            "resolved": frame("field_id string, resolved_formula string, resolution_status string", [(i, "SUM([x])", "resolved") for i in ids])}


def groups_of(frame, *ids):
    return frame("group_id string, label string, dominance string, disagreeing bigint, definition_count bigint, variant_count bigint",
                 [(g, g, "contested", 9 - i, 2, 2) for i, g in enumerate(ids)])


def test_disagreement_against_the_reference(frame):
    t = disagreement_tables(frame, [("g", "g", "a", "A", "k1", 9, 1, True), ("g", "g", "b", "B", "k2", 5, 2, False), ("g", "g", "c", "C", "k3", 1, 3, False)])
    vals = frame("datasource_id string, definition_key string, value double", [("ds", "k1", 1000.0), ("ds", "k2", 1200.0), ("ds", "k3", 1001.0)])
    got = {r.field_id: r for r in dis.material_disagreement(t, groups_of(frame, "g"), vals, "2025-07").collect()}
    assert got["a"].is_reference and got["b"].material and got["b"].rel_diff == pytest.approx(0.2) and not got["c"].material
    s = dis.execution_summary(dis.material_disagreement(t, groups_of(frame, "g"), vals, "2025-07")).first()
    assert (s.tested, s.untested, s.variant_field, s.material_disagreement, s.reference_field) == (3, 0, "B", True, "A")


def test_reference_without_value_is_passed_over(frame):
    t = disagreement_tables(frame, [("g", "g", "a", "A", "k1", 9, 1, True), ("g", "g", "b", "B", "k2", 5, 2, False), ("g", "g", "c", "C", "k3", 1, 3, False)])
    vals = frame("datasource_id string, definition_key string, value double", [("ds", "k2", 100.0), ("ds", "k3", 130.0)])
    got = {r.field_id: r for r in dis.material_disagreement(t, groups_of(frame, "g"), vals, "p").collect()}
    assert got["b"].is_reference and got["c"].rel_diff == pytest.approx(0.3) and got["a"].value is None and got["a"].material is None


def test_zero_reference_states_no_relative_gap(frame):
    t = disagreement_tables(frame, [("g", "g", "a", "A", "k1", 9, 1, True), ("g", "g", "b", "B", "k2", 5, 2, False)])
    vals = frame("datasource_id string, definition_key string, value double", [("ds", "k1", 0.0), ("ds", "k2", 5.0)])
    got = {r.field_id: r for r in dis.material_disagreement(t, groups_of(frame, "g"), vals, "p").collect()}
    assert got["b"].rel_diff is None and got["b"].material is None and got["b"].zero_reference and got["a"].rel_diff == 0.0


def test_budget_is_a_prefix(frame):
    g = groups_of(frame, "g1", "g2", "g3")
    n = frame("group_id string, n_exec bigint", [("g1", 5), ("g2", 6), ("g3", 1)])
    ran = lambda *limits: rows(dis.budget_prefix(g, n, *limits).filter("state = 'run'"), "group_id")
    assert ran() == ran(10, 12) == [("g1",), ("g2",), ("g3",)] and ran(1, 1000) == [("g1",)]
    assert ran(10, 10) == [("g1",)]  # g2 overflows; g3 would fit but comes later
    assert ran(10, 4) == []
    assert rows(dis.budget_prefix(g, n, 2, 10), "group_id", "state_reason") == [("g1", ""), ("g2", "query budget spent"), ("g3", "group budget spent")]
    cover = lambda *limits: dis.disagreement_coverage(dis.budget_prefix(g, n, *limits)).first()
    assert [cover().status, cover(1).status, cover(0).status] == ["ok", "partial", "skipped"] and cover(1).reason == "1 of 3 groups tested with 5 queries"


def test_variant_classes(frame):
    t = disagreement_tables(frame, [("g", "g", x, x, "k", 1, i, False) for i, x in enumerate("abcde", 1)])
    t["resolved"] = frame("field_id string, resolved_formula string, resolution_status string", [
        ("a", "SUM([x])", "resolved"), ("b", "x", "cycle"), ("c", "IF USERNAME() = 'x'", "resolved"), ("d", "SUM([x])", "resolved")])
    t["fields"] = frame("id string, datasource_id string, role string, data_type string", [
        ("a", "ds", "measure", ""), ("b", "ds", "MEASURE", ""), ("c", "ds", "MEASURE", ""), ("d", "ds", "DIMENSION", ""), ("e", "none", "MEASURE", "")])
    got = {r.field_id: (r.executability_class, r.untested_reason) for r in detail.variant_class(t).collect()}
    assert got["a"] == ("executable", "") and got["b"] == ("unresolvable", "unresolved: cycle")
    assert got["c"][0] == "context_bound" and got["d"] == ("not_comparable", "not a measure but DIMENSION")
    assert got["e"] == ("unresolvable", "unresolved: no resolution")


def test_redaction_and_secret_guard(frame, estate, tmp_path):
    df = frame("id string, formula string", [("a", "x"), ("b", None)])
    assert rows(detail.redact_columns(df, ["formula"])) == [("a", "[redacted]"), ("b", None)]
    texts = frame("id string, t string", [("a", "Bearer abcdefghijklmnop1"), ("b", "pwd = hunter2"), ("c", '{"api_key": "z"}'), ("d", "X-Vendor-Auth: 1"), ("e", "plain password text")])
    assert rows(detail.secret_scan(texts, "id", "t")) == [("a", "bearer token"), ("b", "password literal"), ("c", "secret-shaped key"), ("d", "auth header")]
    with pytest.raises(Exception, match="looks like a secret"):
        detail.guarded(texts, ["t"], "working").write.json(str(tmp_path / "leak"))
    assert rows(detail.guarded(texts.filter("id = 'e'"), ["id", "t"], "working")) == [("e", "plain password text")]


def test_findings_are_published_together_or_not_at_all(frame, estate, tmp_path, spark):
    path = str(tmp_path / "doc")
    assert rep.published_findings(spark, path, estate.run_id) == {}
    good = {"a": frame("id string", [("x",), ("y",)]), "b": frame("n int", [])}
    assert rows(rep.write_findings(estate, path, sections=good)) == [("a", 2), ("b", 0)]
    bad = {"a": frame("id string", [("new",)]), "last": frame("id string", [("pwd = hunter2",)])}
    with pytest.raises(Exception, match="looks like a secret"):
        rep.write_findings(estate, path, sections=bad)
    assert rows(rep.published_findings(spark, path, estate.run_id)["a"]) == [("x",), ("y",)]
    assert len([p for p in (tmp_path / "doc" / "sections").iterdir() if p.is_dir()]) == 1  # what failed is gone
    rep.write_findings(estate, path, sections={"a": frame("id string", [("z",)])})
    assert {k: rows(v) for k, v in rep.published_findings(spark, path, estate.run_id).items()} == {"a": [("z",)]}


def test_builds(estate, tmp_path, spark):
    out = {r.section: r["rows"] for r in rep.write_findings(estate, str(tmp_path / "p"), "presentation").collect()}
    assert "security_fields" not in out and out["facets"] > 0
    v = rep.published_findings(spark, str(tmp_path / "p"), estate.run_id)["variants"]
    assert {r.resolved_formula for r in v.select("resolved_formula").distinct().collect()} == {"[redacted]"}
    light = {r.section for r in rep.report_tables(estate, "light").select("section").distinct().collect()}
    assert not light & {"facets", "register"} and "definitions" in light
