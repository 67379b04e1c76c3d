import pytest
from pyspark.sql import functions as F

from catalog_audit.functions.bands import band_score, capped_score, clause_holds
from catalog_audit.plans import catalog, scoring

FACET = "id string, dimension string, score int, evidence string, confidence string, derivation string, value double, gates array<int>"


def facet(i, dim, score, gates, evidence="observed"):
    return (i, dim, score, evidence, evidence, "", None, gates)


@pytest.mark.parametrize("value, bands, want", [
    (0.39, {2: "< 0.4", 3: "0.4 - 0.7", 4: "> 0.7"}, 2), (0.4, {2: "< 0.4", 3: "0.4 - 0.7"}, 3), (0.7, {3: "0.4 - 0.7", 4: "> 0.7"}, 3),
    (0.71, {3: "0.4 - 0.7", 4: "> 0.7"}, 4), (1.0, {6: "== 1"}, 6), (0.2, {2: "> 0.3"}, 1), (0.9, {3: ">= 0.4", 4: "> 0.7 and ratified == true"}, 3),
    (0.9, {5: "> 0.7 and ratified == false"}, 5)])
def test_bands(frame, value, bands, want):
    assert frame("v double", [(value,)]).select(band_score(bands, F.col("v"))).first()[0] == want


def test_band_inputs_and_errors(frame):
    df = frame("v double", [(0.9,)])
    assert df.select(band_score({4: "> 0.7 and ratified == true"}, F.col("v"), {"ratified": True})).first()[0] == 4
    with pytest.raises(ValueError):
        clause_holds("about 0.4", F.col("v"))


def test_caps(frame):
    df = frame("n int", [(0,), (3,)])
    caps = [{"flag": "X", "when": "> 0", "max_score": 2}, {"flag": "X", "when": "> 2", "max_score": 4}]
    assert [r[0] for r in df.select(capped_score(6, caps, {"X": F.col("n")})).collect()] == [6, 2]


def gov(frame, scores, target):
    f = frame(FACET, [facet(f"governance.{a}", "governance", s, []) for a, s in scores.items()] or [facet("data.x", "data", 3, [])])
    r = scoring.governance_rollup(f, frame("id string, target_stage int", [("d", target)])).first()
    return r.score, r.facets


@pytest.mark.parametrize("scores, target, score, binding", [
    ({"preventive": 5, "detective": 5, "corrective": 5, "accountability": 5, "assurance": 5}, 5, 5,
     ["governance.accountability", "governance.assurance", "governance.corrective", "governance.detective", "governance.preventive"]),
    ({"preventive": 4, "detective": 4, "accountability": 4, "assurance": 4}, 4, 4, ["governance.accountability", "governance.assurance", "governance.corrective",
                                                                                   "governance.detective", "governance.preventive"]),
    ({"preventive": 4, "detective": 4, "accountability": 4, "assurance": 4}, 5, None, []),  # corrective is active at 5 and unread
    ({"preventive": 2, "accountability": 3}, 2, 2, ["governance.assurance", "governance.detective", "governance.preventive"]),
    ({"preventive": 1, "accountability": 3}, 2, 1, ["governance.preventive"]),
    ({"preventive": 6, "detective": 6, "corrective": 6, "accountability": 6, "assurance": 6}, 5, 6, []),
    ({}, 3, None, [])])
def test_governance(frame, scores, target, score, binding):
    assert gov(frame, scores, target) == (score, binding)


def test_register_names_every_tie(frame):
    f = frame(FACET, [facet("semantic.a", "semantic", 2, [5]), facet("semantic.b", "semantic", 4, [5]), facet("data.a", "data", 2, [5]),
                      facet("adoption.a", "adoption", 1, [3]), facet("value.v", "value", 5, [5], "reported")])
    d = frame("id string, target_stage int", [("one", 5), ("two", 6)])
    got = {r.domain: r for r in scoring.domain_register(f, d).collect()}
    assert (got["one"].readiness, got["one"].gap, got["one"].binding_constraints, got["one"].confidence) == (2, 3, ["data.a", "semantic.a"], "mixed")
    assert got["one"].dimension_scores == {"semantic": 2, "data": 2, "value": 5}
    assert got["one"].unscored_dimensions == ["action_surface", "adoption", "governance", "operating_model"]
    assert (got["two"].readiness, got["two"].confidence, got["two"].binding_constraints) == (None, "unscored", [])
    assert len(got["two"].unscored_dimensions) == 7


def test_scan_wins_and_conflict_is_recorded(frame):
    scan = frame(FACET, [facet("semantic.a", "semantic", 3, [5])])
    said = frame("facet_id string, score int, evidence_note string, source_role string", [
        ("semantic.a", 5, "x", "analyst"), ("semantic.a", 6, "y", "lead"), ("semantic.a", 2, "z", "zed"), ("operating.ownership", 4, "n", "b"),
        ("operating.ownership", 4, "m", "a"), ("action.other", 2, "", ""), ("value.none", None, "", "")])
    c = scoring.interview_conflicts(scan, said).first()
    assert (c.facet, c.scan_score, c.interview_score, c.source_role) == ("semantic.a", 3, 6, "lead")
    got = {r.id: r for r in scoring.reconcile(scan, said).collect()}
    assert got["semantic.a"].score == 3 and "value.none" not in got
    assert (got["operating.ownership"].dimension, got["operating.ownership"].gates, got["operating.ownership"].evidence) == ("operating_model", [5], "reported")
    assert got["operating.ownership"].derivation == "interview: m [a]" and got["action.other"].derivation == "interview:  [?]"
    assert got["action.other"].dimension == "action_surface"


def test_rules_file_changes_a_threshold(tmp_path):
    p = tmp_path / "rules.json"
    p.write_text('{"flags": {"SEM-01": {"threshold": {"variant_count_gt": 50}, "suppress": true}}}')
    r = catalog.load_rules(str(p))
    assert r["flags"]["SEM-01"]["threshold"] == {"variant_count_gt": 50} and r["flags"]["SEM-01"]["suppress"]
    assert r["flags"]["SEM-01"]["facet"] == "semantic.singularity" and catalog.FLAGS["SEM-01"]["threshold"] == {"variant_count_gt": 5}


def test_no_top_level_score():
    from catalog_audit.plans.reporting import SECTIONS
    assert "score" not in SECTIONS


def test_comparisons_are_voided_by_the_guard(frame):
    from catalog_audit.plans import comparison as cmp
    head = "run string, query_set_version string, rules_version string, domain_map string, adoption_source string, grouping_mode string, tool_version string"
    runs = frame(head, [("a", "1", "1", "m", "events", "local", "1"), ("b", "1", "2", "m", "events", "local", "1"),
                        ("c", "1", "1", "m", "events", "full", "1"), ("d", "1", "1", "m", "events", "local", "2")])
    moved = frame("id string, delta int", [("f", 2)])

    def state(run, subject):
        r = cmp.guarded(moved, cmp.voids(runs, "run", "a", run), subject, ["delta"]).first()
        return r.delta, r.verdict, r.void_reason

    assert state("b", "facets") == (None, "incomparable", "rules_version") and state("b", "variants") == (2, "comparable", "")
    assert state("c", "variants")[1:] == ("incomparable", "grouping_mode") and state("c", "facets")[0] == 2
    assert state("d", "usage") == (None, "incomparable", "tool_version") and state("x", "usage")[2] == "run not recorded"
