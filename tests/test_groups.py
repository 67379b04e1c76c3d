import pytest
from conftest import rows

from catalog_audit.operators import groups, ranking, usage

METRICS = ["churn_rate", "win_rate", "conversion_rate", "bounce_rate", "sales_velocity", "cost_of_revenue", "revenue"]


@pytest.mark.parametrize("name, metrics, core", [
    ("Bounce Rate", ["churn_rate", "win_rate", "conversion_rate"], None),
    ("Monthly Churn", METRICS, "churn_rate"),
    ("Active Daily Monthly", ["daily_active", "monthly_active"], None),
    ("Number of Deals", ["cost_of_revenue"], None),
    ("Sales Tax", ["sales_velocity", "sales_cycle"], None),
    ("Total Revenue", ["revenue", "cost_of_revenue"], "revenue"),
    ("Customers Active", ["active_customer"], "active_customer"),
    (None, METRICS, None),
    ("Revenue", [], None),
])
def test_core_match(frame, name, metrics, core):
    assert groups.with_core_match(frame("n string", [(name,)]), "n", metrics).first()["core"] == core


MEMBER = "group_id string, label string, field_id string, definition_key string, views bigint, usage_rank bigint"


def dom(frame, *members):
    data = [("g", "L", f, d, v, i) for i, (f, d, v) in enumerate(sorted(members, key=lambda m: (-m[2], m[0])), 1)]
    t = {"ranked": frame(MEMBER, data)}
    won = [r.field_id for r in ranking.rank_groups(t).filter("is_dominant").collect()]
    return ranking.dominance(t["ranked"]).first(), won


def test_dominance_is_over_definitions(frame):
    # twenty small fields of one definition beat one larger field of another
    d, won = dom(frame, *[(f"f{i:02d}", "A", 5) for i in range(20)], ("z", "B", 30))
    assert d.has_dominant and d.top_key == "A" and won == ["f00"]
    assert d.top_ratio == pytest.approx(100 / 30)


@pytest.mark.parametrize("views, settled", [((60, 40), False), ((60, 30), True), ((60, 30, 10), True), ((59, 20, 21), False),
                                            ((5,), True), ((0,), False), ((0, 0), False), ((10, 0), True)])
def test_dominance_thresholds(frame, views, settled):
    d, won = dom(frame, *[(f"f{i}", f"D{i}", v) for i, v in enumerate(views)])
    assert d.has_dominant is settled and (len(won) == 1) is settled
    assert (d.top_ratio is None) == (len(views) < 2 or sorted(views)[-2] == 0)


def test_group_table(frame):
    c = frame("field_id string, name string, normalized_hash string, definition_key string, core string, concept_key string, views bigint, workbooks bigint", [
        ("f1", "Revenue", "h1", "k1", "revenue", "core:revenue", 1, 1), ("f2", "Net Revenue", "h2", "k2", "revenue", "core:revenue", 9, 1),
        ("f4", "B", "h4", "k4", None, "solo:x", 2, 1), ("f3", "A", "h4", "k4", None, "solo:x", 2, 1), ("f5", "C", "", "k5", None, "solo:y", 0, 0)])
    got = rows(groups.metric_groups({"candidates": c}), "group_id", "label", "variant_count", "definition_count", "method", "confidence")
    assert got == [("grp_0001", "revenue", 2, 2, "formula_signature", "medium"), ("grp_0002", "A", 2, 1, "exact_match", "high"),
                   ("grp_0003", "C", 1, 1, "exact_match", "high")]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


USED = "field_id string, workbook_id string, sheet_id string"


def test_uses_in_unmeasured_workbooks_leave_first(frame):
    used = [("f", "a", "1"), ("f", "a", "2"), ("f", "b", "1"), ("f", None, "1"), ("g", "b", "1"), ("h", "a", "3")]
    t = {"field_usage": frame(USED, used), "usage_events": frame("workbook_id string, event_count bigint", [("a", 5), ("c", 7)])}
    views = usage.field_views(t)
    assert rows(views, "field_id", "views", "workbooks") == [("f", 5, 1), ("h", 5, 1)]
    plan = optimized(views)
    assert plan.rindex("Aggregate [") < plan.index("LeftSemi")


def test_workbooks_of_a_group_are_told_apart_once(frame):
    used = [("f", "a", "1"), ("f", "a", "2"), ("g", "a", "1"), ("g", "b", "1"), ("g", " ", "1"), ("g", None, "1"), ("x", "c", "1")]
    t = {"field_usage": frame(USED, used), "variants": frame("group_id string, field_id string", [("1", "f"), ("1", "g"), ("2", "f"), ("3", "y")])}
    books = ranking.group_workbook_count(t)
    assert rows(books, "group_id", "workbooks_affected") == [("1", 2), ("2", 1)]
    plan = optimized(books)
    assert "Aggregate" not in plan[plan.index("Join"):]
