import pytest
from pyspark.sql import functions as F

from catalog_audit.functions import formula as fx
from catalog_audit.functions.names import content_tokens, days_ago, humanize_code, int_or_null, parse_iso


@pytest.fixture
def norm(frame):
    def run(*texts):
        df = frame("i int, f string", list(enumerate(texts)))
        return [r.n for r in df.select("i", fx.normalize_formula(F.col("f")).alias("n")).orderBy("i").collect()]
    return run


@pytest.mark.parametrize("a, b", [
    ("SUM([Sales])", "sum( [ sales ] )"),
    ("[A] * 1.0", "[a]*1"),
    ("'EU'", '"EU"'),
    ("SUM([A]) // tail", "SUM([A])"),
    ("/* head\n two */ SUM([A])", "SUM([A])"),
    ("[Net   Sales]", "[net sales]"),
    (".5 + 007", "0.5 + 7"),
    ("2e3", "2000"),
    ("[Año] + 1", "[AÑO] + 1"),
])
def test_same_logic(norm, a, b):
    left, right = norm(a, b)
    assert left == right


@pytest.mark.parametrize("a, b", [
    ("[d] > 30", "[d] > 90"),
    ("SUM([A])", "AVG([A])"),
    ("'Active'", "'active'"),
    ("#2024-01-01#", "#2024-01-02#"),
    ("[A] - [B]", "[B] - [A]"),
])
def test_different_logic(norm, a, b):
    left, right = norm(a, b)
    assert left != right


def test_normal_form_details(norm):
    got = norm('IF [Region]="E U // x" THEN #2024-01-01# END', "'say \"hi\"'", "1e400", "12345678901234567890123", "1e22", "0.00001",
               "12345678.5", "a\\b", "", None, '"open', "x<=y<>z", "0.0001", "1.50", "000")
    assert got[0] == 'if [region] = "E U // x" then #2024-01-01# end'
    assert got[1] == '"say "hi""'
    assert got[2] == "1e400"  # beyond a double: spelling kept
    assert got[3] == "12345678901234567890123"
    assert got[4] == "10000000000000000000000"
    assert got[5] == "1e-05"
    assert got[6] == "12345678.5"
    assert got[7] == "a \\ b"
    assert got[8] == got[9] == ""
    assert got[10] == '" open'
    assert got[11] == "x <= y <> z"
    assert got[12] == "0.0001" and got[13] == "1.5" and got[14] == "0"


def test_whitespace_and_case_edits_keep_the_hash(frame):
    base = ["SUM([Sales]) / COUNTD([Customer ID])", 'IF [R] = "EU" THEN [Amount] END', "WINDOW_SUM(SUM([x]), -2, 0)"]
    texts = [(f, e) for f in base for e in (f, f.replace(" ", "  "), f.replace("SUM", "sum"), f + " // c", "/*c*/" + f, f.replace("(", "( "))]
    df = frame("f string, e string", texts).select(fx.formula_hash(F.col("f")).alias("a"), fx.formula_hash(F.col("e")).alias("b"))
    assert all(r.a == r.b and len(r.a) == 40 for r in df.collect())


def test_long_literal_does_not_overflow(norm):
    text = '"' + "x" * 200_000 + '"'
    assert norm(text) == [text]


def test_signature(frame):
    df = frame("norm string", [('sum ( [sum] ) / count ( [b] ) + "avg(x)" + #max(1)#',), ("[a] + 1",), ("max ( 0.48 )",)])
    got = [(r.cols, r.funcs, r.has_ratio, r.definition_key) for r in fx.with_signature(df, "norm").collect()]
    assert got[0] == (["b", "sum"], ["count", "sum"], True, "funcs=count,sum|ratio=1|cols=b,sum")
    assert got[1][:3] == (["a"], [], False)
    assert got[2][:3] == ([], ["max"], False)


def test_sql_signals_and_user_context(frame):
    df = frame("q string", [("select a group  by a",), ("select groupby",), ("where x = CURRENT_USER",), ("user ( )",), ("username",)])
    s = fx.sql_grain_signals(F.col("q"))
    assert [(r.a, r.b) for r in df.select(s["has_group_by"].alias("a"), s["has_user_function"].alias("b")).collect()] == [
        (True, False), (False, False), (False, True), (False, True), (False, False)]
    f = frame("f string", [("IsMemberOf ('x')",), ("[USERNAME]",), ("MYUSERNAME()",), (None,)])
    assert [r[0] for r in f.select(fx.is_user_context(F.col("f"))).collect()] == [True, False, False, False]


def test_names(frame):
    df = frame("s string", [("Number of Deals",), ("Gross Loss per Customers",), ("ab 12",), (None,)])
    assert [sorted(r[0]) for r in df.select(content_tokens(F.col("s"))).collect()] == [
        ["deal", "number"], ["customer", "gross", "loss"], [], []]
    assert frame("s string", [("data.freshness_age",)]).select(humanize_code(F.col("s"))).first()[0] == "Data · freshness age"


def test_lenient_scalars(frame):
    df = frame("s string", [("2025-08-01T10:00:00Z",), ("2025-08-01",), ("2025-08-01 nonsense",), ("bad",), ("2025",), ("2025-10-01",)])
    got = [r[0] for r in df.select(days_ago(F.lit("2025-09-01"), parse_iso(F.col("s")))).collect()]
    assert got == [31, 31, 31, None, None, 0]
    df = frame("s string", [("3.9",), ("x",), ("-2",), (None,)])
    assert [r[0] for r in df.select(int_or_null(F.col("s"))).collect()] == [3, None, -2, None]
