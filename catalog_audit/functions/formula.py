"""Formula text as column expressions: tokens, normal form, hash, signature.

All of it is built-in regular-expression and array functions, so one formula is one
row of a narrow projection and nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Aggregate and user-context function names, native-aggregate names.
AGGREGATES = [
    "sum", "avg", "count", "countd", "min", "max", "median", "attr",
    "stdev", "stdevp", "var", "varp", "percentile", "corr", "covar",
]
USER_CONTEXT = ["USERNAME", "ISMEMBEROF", "FULLNAME", "USERDOMAIN"]
NATIVE_AGGREGATES = [
    "SUM", "AVG", "COUNTD", "COUNT", "MIN", "MAX", "MEDIAN", "ATTR", "STDEV", "STDEVP", "VAR", "VARP",
    "PERCENTILE", "CORR", "COVAR", "COVARP", "TOTAL", r"RUNNING_\w+", r"WINDOW_\w+",
]

SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")  # the same class, for trimming without a pattern
WORD = r"[\p{L}\p{Nl}\p{No}_][\p{L}\p{N}_]*"
NUMBER = r"(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?"
REFERENCE = r"\[[^\]]*\]"

# Literals and comments come first so that nothing inside them is read as code. The
# quoted-string loops are unrolled and possessive: no backtracking on long literals.
TOKEN = "|".join([
    r"/\*(?s:.*?)\*/",
    r"//[^\n\r]*",
    r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"',
    r"'[^'\\]*+(?:\\(?s:.)[^'\\]*+)*+'",
    r"#[^#]*#",
    REFERENCE,
    NUMBER,
    WORD,
    r"<=|>=|<>|!=|==|[-+*/%^()<>=,.:!&|~{}]",
    SPACE,
    r"(?s:.)",
])


def tokenize_formula(formula: Column) -> Column:
    return F.regexp_extract_all(formula, F.lit(TOKEN), F.lit(0))


def canonical_number(token: Column) -> Column:
    """``007`` -> ``7``, ``1.0`` -> ``1``, ``.5`` -> ``0.5``, ``2e3`` -> ``2000``.

    Digits-only text never passes through a float. A literal beyond the double range
    keeps its spelling.
    """
    digits = F.regexp_replace(token, r"^0+(?=[0-9])", "")
    value = token.try_cast("double")
    whole = value.try_cast("decimal(38,0)")
    plain = F.regexp_replace(value.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    # below 1e-4 the shortest form is scientific with a two-digit exponent
    mantissa = F.regexp_replace(F.substring_index(value.cast("string"), "E", 1), r"\.0$", "")
    exponent = F.substring_index(value.cast("string"), "E-", -1)
    tiny = F.concat(mantissa, F.lit("e-"), F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent))
    huge = value >= 1e38
    return (F.when(token.rlike(r"^[0-9]+$"), digits)
            .when(value.isNull() | huge, token)
            .when(value == F.rint(value), whole.cast("string"))
            .when(value < 1e-4, tiny)
            .otherwise(plain))


def _canonical_token(t: Column) -> Column:
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    long = F.length(t) > 1
    ident = F.concat(F.lit("["), F.lower(F.trim(F.regexp_replace(inner, SPACE, " "))), F.lit("]"))
    return (F.when(long & (t.startswith('"') | t.startswith("#")), t)
            .when(long & t.startswith("'"), F.concat(F.lit('"'), inner, F.lit('"')))
            .when(long & t.startswith("["), ident)
            .when(t.rlike(r"^\.?[0-9]"), canonical_number(t))
            .when(t.rlike(r"^[\p{L}\p{Nl}\p{No}_]"), F.lower(t))  # the lexer made it a word
            .otherwise(t))


def normalize_formula(formula: Column) -> Column:
    """Space-joined canonical tokens; comments and white space dropped; NULL -> ''."""
    tokens = F.filter(tokenize_formula(formula), lambda t: ~(
        t.startswith("/*") | t.startswith("//") | (F.btrim(t, F.lit(SPACES)) == "")))
    return F.coalesce(F.array_join(F.transform(tokens, _canonical_token), " "), F.lit(""))


def hash_normalized(norm: Column) -> Column:
    return F.when(norm == "", F.lit("")).otherwise(F.sha1(norm))


def formula_hash(formula: Column) -> Column:
    return hash_normalized(normalize_formula(formula))


def with_signature(df: DataFrame, norm: str) -> DataFrame:
    """Add base columns, aggregate functions, ratio marker and definition key of a normalised formula.

    Built in steps so that the stripped text is computed once per row.
    """
    code = F.col(norm)
    for literal in (REFERENCE, r'"[^"]*"', r"#[^#]*#"):
        code = F.regexp_replace(code, literal, " ")
    names = F.transform(F.regexp_extract_all(norm, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda c: F.trim(c))
    words = F.regexp_extract_all("_code", F.lit(r"[a-z_][\p{L}\p{N}_]*"), F.lit(0))
    df = df.withColumns({"_code": code, "cols": F.array_sort(F.array_distinct(F.filter(names, lambda c: c != "")))})
    df = df.withColumns({"funcs": F.array_sort(F.array_intersect(words, F.array(*map(F.lit, AGGREGATES)))),
                         "has_ratio": F.contains("_code", F.lit("/"))}).drop("_code")
    return df.withColumn("definition_key", definition_key(F.col("cols"), F.col("funcs"), F.col("has_ratio")))


def definition_key(cols: Column, funcs: Column, has_ratio: Column) -> Column:
    return F.concat(F.lit("funcs="), F.array_join(funcs, ","), F.lit("|ratio="),
                    has_ratio.cast("int").cast("string"), F.lit("|cols="), F.array_join(cols, ","))


def bracket_refs(formula: Column) -> Column:
    """Every ``[...]`` of the raw text, in order, literals and comments included."""
    return F.regexp_extract_all(formula, F.lit(REFERENCE), F.lit(0))


def reference_key(token_or_name: Column) -> Column:
    """Case- and edge-space-insensitive lookup key of a field name."""
    return F.lower(F.btrim(token_or_name, F.lit(SPACES)))


def is_user_context(formula: Column) -> Column:
    return F.coalesce(formula.rlike(r"(?i)\b(" + "|".join(USER_CONTEXT) + r")\s*\("), F.lit(False))


def is_native_aggregate(formula: Column) -> Column:
    return F.coalesce(formula.rlike(r"(?i)\b(" + "|".join(NATIVE_AGGREGATES) + r")\s*\("), F.lit(False))


def sql_grain_signals(query: Column) -> dict[str, Column]:
    """GROUP BY and user-function markers of hand-written SQL."""
    return {
        "has_group_by": query.rlike(r"(?i)\bGROUP\s+BY\b"),
        "has_user_function": query.rlike(
            r"(?i)\b(?:CURRENT_USER|SESSION_USER|SYSTEM_USER)\b|\b(?:USER|USERNAME)\s*\("),
    }
