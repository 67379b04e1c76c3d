"""Two runs side by side: what moved, what is new debt, and whether they compare at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_audit.operators import measures as m
from catalog_audit.plans import catalog, rules

# run attribute -> what a mismatch voids
GUARDS = {
    "query_set_version": "facets", "rules_version": "facets", "domain_map": "domains",
    "adoption_source": "usage", "grouping_mode": "variants", "tool_version": "all",
}


def voids(runs: DataFrame, run: str, baseline: str, current: str) -> DataFrame:
    """One row (subjects, reason): what a comparison of two runs may not state, by the attributes of ``GUARDS`` that differ.

    A run that is missing from ``runs`` voids everything.
    """
    of = {tag: runs.filter(F.col(run) == name).agg(F.max(F.struct(*[F.col(a).cast("string").alias(a) for a in GUARDS])).alias("r"))
          for tag, name in (("b", baseline), ("c", current))}
    both = of["b"].withColumn("c", of["c"].select("r").scalar())
    absent = F.col("r").isNull() | F.col("c").isNull()
    differ = [F.when(~F.col(f"r.{a}").eqNullSafe(F.col(f"c.{a}")), F.struct(F.lit(a).alias("attribute"), F.lit(s).alias("subject"))) for a, s in GUARDS.items()]
    found = both.select(absent.alias("absent"), F.array_compact(F.array(*differ)).alias("found"))
    return found.select(
        F.when(F.col("absent"), F.array(F.lit("all"))).otherwise(F.array_distinct(F.transform("found", lambda x: x["subject"]))).alias("subjects"),
        F.when(F.col("absent"), "run not recorded").otherwise(F.array_join(F.transform("found", lambda x: x["attribute"]), ",")).alias("reason"))


def guarded(comparison: DataFrame, guard: DataFrame, subject: str, stated: list[str]) -> DataFrame:
    """``comparison`` with a verdict: where the guard voids its subject, what it states is removed and the reason given."""
    one = comparison.withColumn("_subjects", guard.select("subjects").scalar()).withColumn("_reason", guard.select("reason").scalar())
    void = F.array_contains("_subjects", subject) | F.array_contains("_subjects", "all")
    return one.withColumns({c: F.when(~void, F.col(c)) for c in stated}).withColumns({
        "verdict": F.when(void, "incomparable").otherwise("comparable"), "void_reason": F.when(void, F.col("_reason")).otherwise("")}).drop("_subjects", "_reason")


def flag_states(tables, rules_doc: dict | None = None) -> DataFrame:
    """Every evaluated, unsuppressed flag with its count and whether it fires."""
    doc = rules_doc or catalog.load_rules()
    live = [f for f, s in doc["flags"].items() if s["implemented"] and not s["suppress"] and s["rule"] in rules.EVALUATORS]
    return reduce(DataFrame.unionByName, [rules.rule_result(tables, f, doc).select("flag_id", "fires", "count") for f in sorted(live)])


def flag_lifecycle(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """resolved, new, persisting or silent, with both counts."""
    b = baseline.select("flag_id", F.col("fires").alias("was"), F.col("count").alias("baseline_count"))
    c = current.select("flag_id", F.col("fires").alias("now"), F.col("count").alias("current_count"))
    was, now = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    state = F.when(was & now, "persisting").when(was, "resolved").when(now, "new").otherwise("silent")
    return b.join(c, "flag_id", "full").select("flag_id", "baseline_count", "current_count", state.alias("state"))


def facet_movement(baseline: DataFrame, current: DataFrame) -> DataFrame:
    b = baseline.select("id", F.col("score").alias("baseline_score"))
    c = current.select("id", F.col("score").alias("current_score"))
    return b.join(c, "id", "full").select("id", "baseline_score", "current_score",
                                          (F.col("current_score") - F.col("baseline_score")).alias("delta"))


def variant_convergence(baseline, current) -> DataFrame:
    """Variant and dominance change per concept (concepts keep their key between runs)."""
    def side(t, tag):
        won = t["variants"].groupBy("group_id").agg(F.bool_or("is_dominant").alias(f"{tag}_dominant"))
        return t["groups"].join(won, "group_id").select("concept_key", F.col("variant_count").alias(f"{tag}_variants"), f"{tag}_dominant")
    return side(baseline, "baseline").join(side(current, "current"), "concept_key", "full")


def variant_change(baseline, current) -> DataFrame:
    """``variant_convergence`` with what moved: the number of variants, and whether a dominant one was gained or lost."""
    won = [F.coalesce(f"{tag}_dominant", F.lit(False)) for tag in ("baseline", "current")]
    return variant_convergence(baseline, current).withColumns({
        "variants_delta": F.col("current_variants") - F.col("baseline_variants"),
        "dominance": F.when(won[0] == won[1], "unchanged").when(won[1], "gained").otherwise("lost")})


def estate_drift(baseline, current) -> DataFrame:
    """New and cleared debt per kind, both directions side by side."""
    def debts(t):
        emb = t["lineage"].filter("upstream_type = 'embedded_datasource'").select(
            F.lit("embedded_source").alias("kind"), F.concat_ws("/", "downstream_id", "upstream_id").alias("item"))
        own = m.sources_missing_owner(t).select(F.lit("unowned_source").alias("kind"), F.col("id").alias("item"))
        sec = m.user_context_fields(t).select(F.lit("workbook_security_rule").alias("kind"), F.col("id").alias("item"))
        return emb.unionByName(own).unionByName(sec).distinct()

    b, c = debts(baseline).withColumn("b", F.lit(1)), debts(current).withColumn("c", F.lit(1))
    j = b.join(c, ["kind", "item"], "full")
    return j.groupBy("kind").agg(F.count_if(F.col("b").isNull()).alias("new_debt"), F.count_if(F.col("c").isNull()).alias("cleared_debt"),
                                 F.count_if(F.col("b").isNotNull() & F.col("c").isNotNull()).alias("persisting"))


def coverage_change(baseline: DataFrame, current: DataFrame) -> DataFrame:
    b, c = baseline.select("measure", F.col("status").alias("was")), current.select("measure", F.col("status").alias("now"))
    ok_b, ok_c = F.coalesce(F.col("was") == "ok", F.lit(False)), F.coalesce(F.col("now") == "ok", F.lit(False))
    return b.join(c, "measure", "full").select("measure", "was", "now", F.when(ok_c & ~ok_b, "newly available").when(
        ok_b & ~ok_c, "newly missing").otherwise("unchanged").alias("change"))


def comparability_guard(runs: DataFrame, site: str, order: str, attributes: list[str]) -> DataFrame:
    """Each run against its site's first run: comparable, or the attributes that differ.

    The first run is found with a combinable aggregate, so a site with very many runs is
    not gathered into a window.
    """
    first = runs.groupBy(site).agg(F.min_by(F.struct(*attributes), F.struct(order)).alias("base"), F.min(order).alias("base_at"))
    differs = F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(f"base.{a}")), F.lit(a)) for a in attributes]))
    j = runs.join(first, site).filter(F.col(order) > F.col("base_at")).withColumn("mismatches", F.array_join(differs, ","))
    return j.select(site, order, F.when(F.col("mismatches") == "", "comparable").otherwise("incomparable").alias("verdict"), "mismatches")
