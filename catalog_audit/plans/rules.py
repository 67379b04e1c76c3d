"""Rule evaluation: one aggregate per flag, unioned into one frame.

Every evaluator returns one row (fires, count, evidence). Evidence holds the measured numbers; the items behind
them, all of them, are the rows of ``flag_evidence``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.operators import graph, measures as m, usage as u
from catalog_audit.plans import catalog

EVALUATORS: dict[str, Callable] = {}


def evaluator(name: str):
    def keep(fn):
        EVALUATORS[name] = fn
        return fn
    return keep


def outcome(df: DataFrame, fires: Column, count: Column, /, **evidence: Column) -> DataFrame:
    facts = F.to_json(F.struct(*[evidence[k].alias(k) for k in sorted(evidence)]))
    return df.select(fires.alias("fires"), count.cast("bigint").alias("count"), facts.alias("evidence"))


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


@evaluator("formula_contains_user_context")
def _user_context(t, th):
    hits = m.user_context_fields(t)
    n = F.col("n")
    return outcome(counted(hits), n >= th.get("min_count", 1), n, count=n)


@evaluator("permissive_grants")
def _permissive(t, th):
    everyone, sensitive = th.get("everyone_grantees", catalog.EVERYONE), th.get("sensitive_capabilities", catalog.SENSITIVE)
    hits = m.permissive_grants(t, everyone, sensitive)
    n = F.col("n")
    return outcome(counted(hits), n >= th.get("min_count", 1), n, count=n,
                   everyone_grantees=F.array(*map(F.lit, sorted(everyone))),
                   sensitive_capabilities=F.array(*map(F.lit, sorted(sensitive))))


@evaluator("metric_group_variant_count")
def _variant_count(t, th):
    limit = th.get("variant_count_gt", 5)
    labels = t["groups"].filter(F.col("variant_count") > limit).groupBy("label").agg(F.max("variant_count").alias("fields"))
    n = F.col("n")
    return outcome(counted(labels), n > 0, n, threshold=F.lit(limit))


def contested_labels(t, least: int) -> DataFrame:
    """Labels of groups with several viewed members and no dominant one."""
    return (t["variants"].groupBy("group_id", "label").agg(
        F.bool_or("is_dominant").alias("dominant"), F.count_if(F.col("views") > 0).alias("used"))
        .filter((~F.col("dominant")) & (F.col("used") >= least)).select("label").distinct())


@evaluator("metric_group_no_dominant")
def _no_dominant(t, th):
    least = th.get("min_usage_variants", 2)
    n = F.col("n")
    return outcome(counted(contested_labels(t, least)), n > 0, n, min_usage_variants=F.lit(least))


@evaluator("description_coverage")
def _description(t, th):
    least = th.get("min_coverage", 0.40)
    return outcome(m.description_coverage(t), F.col("coverage") < least, F.col("total") - F.col("described"),
                   coverage=F.round("coverage", 4), described=F.col("described"), total=F.col("total"), threshold=F.lit(least))


@evaluator("embedded_datasource_share")
def _embedded(t, th):
    most = th.get("max_embedded_share", 0.60)
    return outcome(m.datasource_ref_shares(t), F.col("embedded_share") > most, F.col("embedded_refs"),
                   embedded_share=F.round("embedded_share", 4), embedded_refs=F.col("embedded_refs"),
                   published_refs=F.col("published_refs"), threshold=F.lit(most))


@evaluator("upstream_table_fanout")
def _fanout(t, th):
    most = th.get("max_sources_per_table", 10)
    fan = m.table_fanout(t)
    over = F.count_if(F.col("sources") > most)
    top = fan.agg(F.coalesce(F.max("sources"), F.lit(0)).alias("top"), over.alias("over"))
    # the flag's count is the largest fan-out, not the number of tables
    return outcome(top, F.col("over") > 0, F.col("top"), max_sources_per_table=F.col("top"), tables_over_threshold=F.col("over"), threshold=F.lit(most))


@evaluator("published_on_published_depth")
def _chain(t, th):
    least = th.get("min_depth", 2)
    return outcome(graph.source_chain_depth(t), F.col("depth") >= least, F.col("depth"), depth=F.col("depth"), threshold=F.lit(least))


@evaluator("zero_view_workbooks")
def _zero_view(t, th):
    hits = u.zero_view_workbooks(t)
    n = F.col("n")
    return outcome(counted(hits), n >= th.get("min_count", 1), n, count=n, idle_days=F.lit(th.get("idle_days", 90)))


@evaluator("view_concentration")
def _concentration(t, th):
    fraction = th.get("coverage_fraction", 0.80)
    key = f"workbooks_covering_{round(fraction * 100)}pct_views"
    return outcome(u.view_concentration(t, {"cover": fraction}), F.coalesce(F.col("total") > 0, F.lit(False)), F.col("cover"),
                   **{key: F.col("cover")}, total_views=F.col("total"), coverage_fraction=F.lit(fraction))


@evaluator("datasource_field_count")
def _field_count(t, th):
    most = th.get("max_field_count", 300)
    per = m.fields_per_source(t)
    top = per.agg(F.coalesce(F.max("fields"), F.lit(0)).alias("top"), F.count_if(F.col("fields") > most).alias("over"))
    return outcome(top, F.col("over") > 0, F.col("over"), max_field_count=F.col("top"), threshold=F.lit(most))


@evaluator("source_without_upstream")
def _no_upstream(t, th):
    hits = m.sources_without_upstream(t)
    n = F.col("n")
    return outcome(counted(hits), n >= th.get("min_count", 1), n, count=n)


@evaluator("refresh_failure_rate")
def _failure_rate(t, th):
    most = th.get("max_failure_rate", 0.10)
    return outcome(m.refresh_failure_rate(t), F.col("rate") > most, F.col("failed"), failure_rate=F.round("rate", 4),
                   failed=F.col("failed"), total=F.col("total"), threshold=F.lit(most))


@evaluator("failed_refresh_recent_view")
def _stale_in_use(t, th):
    within = th.get("viewed_within_days", 30)
    hits = (m.failed_source_recent_views(t).filter(F.col("last_viewed_days_ago") <= within).select("datasource_id").distinct())
    n = F.col("n")
    return outcome(counted(hits), n >= th.get("min_count", 1), n, count=n, viewed_within_days=F.lit(within))


@evaluator("custom_sql_grain_loss")
def _grain(t, th):
    least = th.get("min_count", 1)
    g = F.col("with_group_by")
    return outcome(m.custom_sql_grain(t), g >= least, g, with_group_by=g, with_user_function=F.col("with_user_function"),
                   total=F.col("total"), threshold=F.lit(least))


@evaluator("source_owner_missing")
def _no_owner(t, th):
    hits = m.sources_missing_owner(t)
    n = F.col("n")
    return outcome(counted(hits), n >= th.get("min_count", 1), n, count=n)


@evaluator("root_table_column_divergence")
def _divergence(t, th):
    names = bool(th.get("flag_name_divergence", False))
    cols = m.column_divergence(t)
    totals = cols.agg(F.count_if("type_divergent").alias("by_type"),
                      F.count_distinct(F.when(F.col("not_shared"), F.col("table_key"))).alias("by_name"),
                      F.count_distinct("table_key").alias("tables"))
    n = F.col("by_type") + (F.col("by_name") if names else F.lit(0))
    return outcome(totals, n >= th.get("min_count", 1), n,
                   type_divergent_count=F.col("by_type"),
                   name_divergent_count=F.col("by_name"), flag_name_divergence=F.lit(names), shared_tables=F.col("tables"))


@evaluator("no_data_quality_warnings")
def _no_warnings(t, th):
    status = t["coverage"].filter("measure = 'data_quality_warnings'").agg(F.max("status").alias("s")).select("s").scalar()
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    df = counted(t["dqw"]).withColumn("status", status)
    return outcome(df, ok & (F.col("n") == 0), F.col("n"), warning_count=F.col("n"), coverage_status=F.col("status"), measured=ok)


@evaluator("certification_dqw_divergence")
def _certified_warned(t, th):
    elevated = bool(th.get("require_elevated", False))
    hits = m.certified_with_active_warning(t)
    if elevated:
        hits = hits.filter("is_elevated")
    per = hits.select("id").distinct()
    n = F.col("n")
    return outcome(counted(per), n >= th.get("min_count", 1), n, count=n, require_elevated=F.lit(elevated))


def rule_result(tables, flag_id: str, rules: dict | None = None) -> DataFrame:
    """One flag evaluated: flag_id, fires, count, evidence."""
    spec = (rules or catalog.load_rules())["flags"][flag_id]
    return EVALUATORS[spec["rule"]](tables, spec.get("threshold") or {}).select(F.lit(flag_id).alias("flag_id"), "fires", "count", "evidence")


def evaluate_rules(tables, rules: dict | None = None, domains: list[str] | None = None) -> DataFrame:
    """One row per flag and domain with its outcome.

    outcome: fired, silent, suppressed, skipped (no evaluator) or unimplemented.
    """
    rules = rules or catalog.load_rules()
    parts = []
    spark = tables["fields"].sparkSession
    absent = []
    for flag_id, spec in sorted(rules["flags"].items()):
        if not spec.get("implemented", False):
            absent.append((flag_id, "unimplemented"))
        elif spec.get("rule") not in EVALUATORS:
            absent.append((flag_id, "skipped"))
        else:
            r = rule_result(tables, flag_id, rules)
            state = F.lit("suppressed") if spec.get("suppress") else F.when(F.col("fires"), "fired").otherwise("silent")
            scope = domains if spec.get("scope") == "domain" and domains else [""]
            r = r.withColumn("outcome", state).withColumn(
                "domain", F.explode(F.when(F.col("outcome") == "fired", F.array(*map(F.lit, scope))).otherwise(F.array(F.lit("")))))
            parts.append(r)
    if absent:
        parts.append(spark.createDataFrame(absent, "flag_id string, outcome string").select(
            "flag_id", F.lit(None).cast("boolean").alias("fires"), F.lit(None).cast("bigint").alias("count"),
            F.lit(None).cast("string").alias("evidence"), "outcome", F.lit("").alias("domain")))
    meta = spark.createDataFrame(
        [(f, s.get("severity", "warning"), s.get("confidence", "observed"), s.get("facet", "")) for f, s in rules["flags"].items()],
        "flag_id string, severity string, confidence string, facet string")
    return reduce(DataFrame.unionByName, parts).join(meta, "flag_id")


def flags_table(outcomes: DataFrame) -> DataFrame:
    """The flags a report shows: fired and not suppressed."""
    return outcomes.filter("outcome = 'fired'").select("flag_id", "severity", "confidence", "facet", "domain", "count", "evidence")


def rule_log(outcomes: DataFrame) -> DataFrame:
    """One readable line per flag, suppressed and unimplemented ones included."""
    line = (F.when(F.col("outcome") == "fired", F.format_string("FLAG %s [%s] count=%s facet=%s", "flag_id", "severity", "count", "facet"))
            .when(F.col("outcome") == "suppressed", F.format_string("SUPPRESSED %s (would_fire=%s, count=%s)", "flag_id", "fires", "count"))
            .when(F.col("outcome") == "skipped", F.format_string("SKIPPED %s -- no evaluator", "flag_id"))
            .when(F.col("outcome") == "unimplemented", F.format_string("UNIMPLEMENTED %s", "flag_id"))
            .otherwise(F.format_string("SILENT %s count=%s", "flag_id", "count")))
    return outcomes.select("flag_id", "outcome", line.alias("line")).distinct()


def rule_catalog(spark, rules: dict | None = None) -> DataFrame:
    """The catalog as rows, thresholds as JSON text."""
    import json
    rows = [(f, s["rule"], s["severity"], s["confidence"], s["facet"], s["scope"], s["implemented"], s["suppress"],
             json.dumps(s.get("threshold") or {}, sort_keys=True)) for f, s in (rules or catalog.load_rules())["flags"].items()]
    return spark.createDataFrame(rows, "flag_id string, rule string, severity string, confidence string, facet string, scope string, "
                                       "implemented boolean, suppress boolean, threshold string")


def flag_evidence(tables, rules: dict | None = None) -> DataFrame:
    """Every item behind the list-valued flags: flag_id, item, value."""
    th = {f: s.get("threshold") or {} for f, s in (rules or catalog.load_rules())["flags"].items()}
    none = F.lit(None).cast("bigint")

    def items(flag, df, item, value=none):
        return df.select(F.lit(flag).alias("flag_id"), (F.col(item) if isinstance(item, str) else item).alias("item"),
                         value.cast("bigint").alias("value"))

    def limit(flag, name, default):
        return th[flag].get(name, default)

    groups, fan, per, cols = tables["groups"], m.table_fanout(tables), m.fields_per_source(tables), m.column_divergence(tables)
    everyone, sensitive = limit("SEC-02", "everyone_grantees", catalog.EVERYONE), limit("SEC-02", "sensitive_capabilities", catalog.SENSITIVE)
    warned = m.certified_with_active_warning(tables)
    if limit("GOV-03", "require_elevated", False):
        warned = warned.filter("is_elevated")
    stale = m.failed_source_recent_views(tables).filter(F.col("last_viewed_days_ago") <= limit("DF-05", "viewed_within_days", 30))
    column = F.concat_ws("/", "table_key", "column_name")
    return reduce(DataFrame.unionByName, [
        items("SEC-01", m.user_context_fields(tables), "id"),
        items("SEC-02", m.permissive_grants(tables, everyone, sensitive), F.concat_ws("/", "object_type", "object_id", "grantee_id", "capability")),
        items("SEM-01", groups.filter(F.col("variant_count") > limit("SEM-01", "variant_count_gt", 5)), "group_id", F.col("variant_count")),
        items("SEM-02", contested_labels(tables, limit("SEM-02", "min_usage_variants", 2)), "label"),
        items("SEM-04", per.filter(F.col("fields") > limit("SEM-04", "max_field_count", 300)), "datasource_id", F.col("fields")),
        items("DF-02", fan.filter(F.col("sources") > limit("DF-02", "max_sources_per_table", 10)), "upstream_id", F.col("sources")),
        items("DF-04", m.sources_without_upstream(tables), "id"),
        items("DF-05", stale.select("datasource_id").distinct(), "datasource_id"),
        items("DF-08", cols.filter("type_divergent"), F.concat_ws(":", F.lit("types"), column, "type_names"), F.col("types")),
        items("DF-08", cols.filter("not_shared"), F.concat_ws(":", F.lit("column"), column), F.col("sources")),
        items("GOV-01", m.sources_missing_owner(tables), "id"),
        items("GOV-03", warned, F.concat_ws("/", "id", "warning_id")),
        items("EST-01", u.zero_view_workbooks(tables), "id"),
    ])
