import random

from pyspark.sql import functions as F

from catalog_audit.operators import trends



def views(frame, rows):
    return frame("day string, workbook_id string, user_id bigint", rows).withColumn("day", F.to_date("day"))


def test_spans_from_stored_days_stay_within_their_bounds(frame):
    rnd = random.Random(5)
    rows = [(f"2025-03-{1 + i % 20:02d}", f"w{int(rnd.paretovariate(1)) % 300}", rnd.randrange(6000)) for i in range(24000)] + [("2025-03-05", "w1", None)] * 50
    days = trends.daily_sketches(views(frame, rows))
    got = trends.span(days, "2025-03-04", "2025-03-12").first()
    inside = [r for r in rows if "2025-03-04" <= r[0] <= "2025-03-12"]
    users = {u for _, _, u in inside if u is not None}
    assert got["views"] == len(inside) and abs(got["users"] - len(users)) <= 0.05 * len(users)
    per = {}
    for d, w, _ in inside:
        per[d, w] = per.get((d, w), 0) + 1
    sizes = sorted(per.values())
    for share, name in ((0.5, "median_views"), (0.9, "top_views")):
        below, upto = (sum(ok(n) for n in sizes) / len(sizes) for ok in (lambda n, v=got[name]: n < v, lambda n, v=got[name]: n <= v))
        assert below <= share + 0.017 and upto >= share - 0.017


def test_a_day_read_anew_replaces_its_row_and_spans_overlap(frame):
    one = trends.daily_sketches(views(frame, [("2025-01-01", "a", 1), ("2025-01-01", "a", 2), ("2025-01-03", "b", 1)]))
    got = {str(r["span_end"]): (r["views"], r["users"]) for r in trends.trend(one, 3).collect()}
    assert got == {"2025-01-01": (2, 2), "2025-01-02": (2, 2), "2025-01-03": (3, 2), "2025-01-04": (1, 1), "2025-01-05": (1, 1)}
    later = one.where("day <> '2025-01-03'").unionByName(trends.daily_sketches(views(frame, [("2025-01-03", "b", 9), ("2025-01-03", "c", 8)])))
    change = {r["run"]: (r["views"], r["users"]) for r in trends.run_change(one, later).collect()}
    assert change == {"earlier": (3, 2), "later": (4, 4)}
    assert trends.trend(one.where("false"), 3).count() == 0
