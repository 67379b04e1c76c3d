"""Material disagreement: what competing definitions return over the same data.

The definitions of a metric are evaluated together in one grouped aggregate over the
fact table (one row per source), unpivoted, and joined to the variants. The number of
variants never multiplies passes over the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.operators.detail import variant_class
from catalog_audit.operators.ordering import numbered, running

TOLERANCE = 0.005
DOMINANCE_ORDER = {"contested": 0, "unmeasured": 1, "dominant": 2, "singular": 3}


def backlog_order(groups: DataFrame) -> list[Column]:
    """Contested first, then most disagreeing, most definitions, most variants, label."""
    rank = F.lit(len(DOMINANCE_ORDER))
    for state, i in DOMINANCE_ORDER.items():
        rank = F.when(F.col("dominance") == state, i).otherwise(rank)
    return [rank, F.col("disagreeing").desc(), F.col("definition_count").desc(), F.col("variant_count").desc(),
            F.coalesce("label", F.lit("")), F.col("group_id")]


def budget_prefix(groups: DataFrame, executable: DataFrame, max_groups: int | None = None,
                  max_queries: int | None = None) -> DataFrame:
    """Every group with its priority, the queries up to it, and whether it runs.

    Without a budget all groups run. With one, the longest priority prefix within both limits runs, each group whole or
    not at all; the others stay in the result as ``not_run`` with the limit that stopped them.
    """
    sized = groups.join(executable, "group_id", "left").withColumn("n_exec", F.coalesce("n_exec", F.lit(0)).cast("bigint"))
    order = backlog_order(groups)
    ranked = running(sized, [], order, {"queries_upto": F.col("n_exec"), "priority": F.lit(1).cast("bigint")})
    reason = F.lit("")
    if max_queries is not None:
        reason = F.when(F.col("queries_upto") > max_queries, "query budget spent").otherwise(reason)
    if max_groups is not None:
        reason = F.when(F.col("priority") > max_groups, "group budget spent").otherwise(reason)
    return ranked.select("group_id", "priority", "n_exec", "queries_upto", F.when(reason == "", "run").otherwise("not_run").alias("state"),
                         reason.alias("state_reason"))


def disagreement_coverage(plan: DataFrame) -> DataFrame:
    """The coverage row of the measure: ok, partial or skipped, with how many groups ran."""
    n, ran, queries = F.count(F.lit(1)), F.count_if(F.col("state") == "run"), F.sum(F.when(F.col("state") == "run", F.col("n_exec")).otherwise(0))
    status = F.when(F.col("ran") == 0, "skipped").when(F.col("ran") < F.col("n"), "partial").otherwise("ok")
    why = F.when(F.col("n") == 0, "no groups to test").otherwise(
        F.format_string("%d of %d groups tested with %d queries", "ran", "n", F.coalesce("queries", F.lit(0))))
    return plan.agg(n.alias("n"), ran.alias("ran"), queries.alias("queries")).select(
        F.lit("material_disagreement").alias("measure"), status.alias("status"), why.alias("reason"))


def definition_values(fact: DataFrame, source: Column, period: Column, measures: dict[str, Column]) -> DataFrame:
    """Value of every definition per source over one period: datasource_id, definition_key, value."""
    named = {f"m{i}": (key, expr) for i, (key, expr) in enumerate(measures.items())}
    wide = fact.filter(period).groupBy(source.alias("datasource_id")).agg(
        *[expr.cast("double").alias(c) for c, (_, expr) in named.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(key).alias("definition_key"), F.col(c).alias("value")) for c, (key, _) in named.items()]))
    return wide.select("datasource_id", pairs.alias("p")).select("datasource_id", "p.definition_key", "p.value")


def material_disagreement(tables, groups: DataFrame, values: DataFrame, period: str, tolerance: float = TOLERANCE,
                          abs_floor: float = 0.0, max_groups: int | None = None, max_queries: int | None = None) -> DataFrame:
    """Each variant of every group, its value where its group runs, and its gap to the reference.

    The reference is an executable variant, preferring one that returned a value, then
    the dominant one, then the best usage rank.
    """
    rows = variant_class(tables)
    runnable = rows.filter("executability_class = 'executable'").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_exec"))
    chosen = budget_prefix(groups, runnable, max_groups, max_queries)
    rows = rows.join(chosen.select("group_id", "priority", "state", "state_reason"), "group_id")
    rows = rows.join(values, ["datasource_id", "definition_key"], "left").withColumn(
        "value", F.when((F.col("executability_class") == "executable") & (F.col("state") == "run"), F.col("value")))
    preference = F.struct(F.col("value").isNull(), ~F.col("is_dominant"), F.coalesce("usage_rank", F.lit(1 << 30)), "field_id")
    best = rows.filter("executability_class = 'executable'").groupBy("group_id").agg(
        F.min_by(F.struct(F.col("field_id").alias("ref_field"), F.col("value").alias("ref_value")), preference).alias("r")).select(
        "group_id", "r.ref_field", "r.ref_value")
    gap = F.abs(F.col("value") - F.col("ref_value"))
    rel = F.when(F.col("ref_value") != 0, gap / F.abs("ref_value")).when(gap == 0, F.lit(0.0))
    out = rows.join(best, "group_id", "left").withColumns({
        "is_reference": F.coalesce(F.col("field_id") == F.col("ref_field"), F.lit(False)), "abs_diff": gap, "rel_diff": rel})
    return out.select(
        "group_id", "label", "priority", "state", "state_reason", "field_id", "field_name", "executability_class", "untested_reason", "is_reference",
        F.lit(period).alias("period"), "value", "abs_diff", "rel_diff",
        # no relative gap can be stated against a zero reference
        (F.coalesce(F.col("ref_value") == 0, F.lit(False)) & F.coalesce(F.col("abs_diff") > 0, F.lit(False))).alias("zero_reference"),
        F.when(F.col("rel_diff").isNotNull(), (F.col("rel_diff") > tolerance) & (
            (F.col("abs_diff") > abs_floor) if abs_floor else F.lit(True))).alias("material"))


def execution_summary(executed: DataFrame) -> DataFrame:
    """Per group: tested, untested, material or not, and the widest gap to the reference."""
    other = ~F.col("is_reference") & F.col("rel_diff").isNotNull()
    counts = [F.count_if(F.col("executability_class") == c).alias(c)
              for c in ("executable", "context_bound", "not_comparable", "unresolvable")]
    widest = F.min_by(F.struct("field_name", "value", "abs_diff", "rel_diff"),
                      F.when(other, F.struct(-F.col("rel_diff"), F.col("field_id"))))
    return executed.groupBy("group_id", "label").agg(
        *counts, F.count(F.lit(1)).alias("variants"),
        F.max(F.when(F.col("is_reference"), F.col("field_name"))).alias("reference_field"),
        F.max(F.when(F.col("is_reference"), F.col("value"))).alias("reference_value"),
        F.coalesce(F.bool_or(F.col("material") & ~F.col("is_reference")), F.lit(False)).alias("material_disagreement"),
        widest.alias("w")).select(
        "group_id", "label", F.col("executable").alias("tested"), (F.col("variants") - F.col("executable")).alias("untested"),
        "context_bound", "not_comparable", "unresolvable", "reference_field", "reference_value", "material_disagreement",
        F.col("w.field_name").alias("variant_field"), F.col("w.value").alias("variant_value"),
        F.col("w.abs_diff").alias("abs_diff"), F.col("w.rel_diff").alias("rel_diff"))


def backlog(groups: DataFrame) -> DataFrame:
    """Groups with their place in the adjudication backlog."""
    return numbered(groups, [], backlog_order(groups), "position")
