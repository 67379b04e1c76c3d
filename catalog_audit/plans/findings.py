"""The four findings, governance posture, run header, calibration distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.operators import detail, measures as m, ranking, stats, usage as u
from catalog_audit.operators.disagreement import backlog
from catalog_audit.operators.ordering import cover_counts
from catalog_audit.plans import catalog
from catalog_audit.plans.scoring import is_measured

TOOL_VERSION = "1.0"


def one(df: DataFrame) -> Column:
    """A one-row frame as a struct scalar subquery."""
    return df.select(F.struct(*df.columns).alias("r")).select("r").scalar()


# -- finding one ---------------------------------------------------------------------
def definition_multiplicity(tables) -> DataFrame:
    """Per concept: fields, definitions, live disagreement, usage cover, dominance."""
    v = tables["variants"]
    per = v.groupBy("group_id").agg(
        F.sum("views").cast("bigint").alias("group_views"), F.bool_or("is_dominant").alias("has_dominant"),
        F.count_distinct(F.when(F.col("views") > 0, F.col("definition_key"))).alias("used"))
    cover = ranking.cover_count(tables["ranked"]).select("group_id", F.col("cover").alias("cover80"))
    books = ranking.group_workbook_count(tables)
    g = (tables["groups"].drop("concept_key").join(per, "group_id").join(cover, "group_id").join(books, "group_id", "left"))
    state = (F.when(F.col("definition_count") < 2, "singular").when(~is_measured(tables, "usage_events"), "unmeasured")
             .when(F.col("has_dominant"), "dominant").otherwise("contested"))
    return g.select(
        "group_id", "label", "method", "confidence", "variant_count", "definition_count", "group_views", "cover80",
        F.when(F.col("used") > 0, F.col("used")).otherwise(F.col("definition_count")).alias("disagreeing"),
        F.coalesce("workbooks_affected", F.lit(0)).alias("workbooks_affected"), state.alias("dominance"))


def multiplicity_totals(tables) -> DataFrame:
    g = tables["multiplicity"]
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("definition_count") >= 2).alias("multiplicity_groups"),
                 F.count_if(F.col("dominance") == "contested").alias("contested_groups"))


def adjudication_backlog(tables) -> DataFrame:
    return backlog(tables["multiplicity"])


# -- finding two -----------------------------------------------------------------------
def security_exposure(tables) -> DataFrame:
    hits = m.user_context_fields(tables)
    books = u.workbooks_for_fields(tables, hits).agg(F.count(F.lit(1)).alias("n"))
    return hits.agg(F.count(F.lit(1)).alias("user_context_fields")).withColumn("affected_workbooks", books.select("n").scalar()).withColumn(
        "severity", F.when(F.col("user_context_fields") >= 1, catalog.FLAGS["SEC-01"]["severity"]))


def security_fields(tables) -> DataFrame:
    src = tables["datasources"].select(F.col("id").alias("datasource_id"), F.col("name").alias("datasource_name"), "owner")
    return m.user_context_fields(tables).join(src, "datasource_id", "left").select("name", "formula", "datasource_name", "owner")


# -- finding three ----------------------------------------------------------------------
def retirement_case(tables) -> DataFrame:
    """Recoverable content and redundant tables; usage figures are NULL when usage was not measured."""
    df = m.max_fanout(tables).withColumn("usage_measured", is_measured(tables, "usage_events"))
    df = df.withColumn("a", one(u.content_activation(tables))).withColumn(
        "c", one(u.view_concentration(tables, {"cover70": 0.7, "cover80": 0.8})))

    def seen(c):
        return F.when(F.col("usage_measured"), F.coalesce(c, F.lit(0)).cast("bigint"))

    return df.select(
        F.col("a.workbooks").alias("workbooks_total"), "usage_measured", F.col("redundant_tables").alias("redundant_source_tables"),
        F.col("max_sources").alias("max_sources_per_table"), seen(F.col("a.zero_view")).alias("zero_view_workbooks"),
        seen(F.col("c.total")).alias("total_views"), seen(F.col("c.cover70")).alias("workbooks_covering_70pct_views"),
        seen(F.col("c.cover80")).alias("workbooks_covering_80pct_views"))


# -- finding four -------------------------------------------------------------------------
def governance_posture(tables) -> DataFrame:
    """Is each governance mechanism present and exercised? Unmeasured never reads as unused."""
    perms, ds, dq = m.permission_counts(tables), m.certification_counts(tables), m.dq_warning_counts(tables)

    def mechanism(df, arc, name, feed, used, total):
        row = df.select(used.alias("exercised"), total.alias("recorded")).withColumn("measured", is_measured(tables, feed))
        status = F.when(~F.col("measured"), "unmeasured").when(F.col("exercised") > 0, "in_use").otherwise("not_exercised")
        return row.select(F.lit(arc).alias("arc"), F.lit(name).alias("mechanism"), "measured", status.alias("status"),
                          F.when(F.col("measured"), F.col("exercised")).alias("exercised"),
                          F.when(F.col("measured"), F.col("recorded")).alias("recorded"))

    return reduce(DataFrame.unionByName, [
        mechanism(perms, "preventive", "permission_grants", "permissions", F.col("grants"), F.col("objects")),
        mechanism(perms, "preventive", "explicit_deny", "permissions", F.col("deny_rules"), F.col("grants")),
        mechanism(ds, "detective", "certification", "datasources", F.col("certified"), F.col("total")),
        mechanism(dq, "detective", "data_quality_warnings", "data_quality_warnings", F.col("total"), F.col("active")),
    ])


def posture_examples(tables, rules: dict | None = None) -> DataFrame:
    """All good and bad examples behind the posture, and how many there are of each."""
    everyone, sensitive = catalog.broad_grant_policy(rules)
    p = tables["permissions"].filter((F.col("mode") == "Allow") & F.col("capability").isin(*sensitive))
    item = F.concat_ws("/", "object_type", "object_id", "grantee_id", "capability").alias("item")
    broad = F.col("grantee_id").isin(*everyone)
    warned = m.certified_with_active_warning(tables).select("id").distinct()
    ok_perm = is_measured(tables, "permissions")
    ok_dq = is_measured(tables, "datasources") & is_measured(tables, "data_quality_warnings")
    rows = [
        p.filter(broad).select(F.lit("preventive").alias("arc"), F.lit("bad").alias("kind"), item).filter(ok_perm),
        p.filter(~broad & (F.col("grantee_type") == "group")).select(F.lit("preventive").alias("arc"), F.lit("good").alias("kind"), item).filter(ok_perm),
        warned.select(F.lit("detective").alias("arc"), F.lit("bad").alias("kind"), F.col("id").alias("item")).filter(ok_dq),
        m.certified_clean(tables).select(F.lit("detective").alias("arc"), F.lit("good").alias("kind"), F.col("id").alias("item")).filter(ok_dq),
    ]
    every = reduce(DataFrame.unionByName, rows)
    totals = every.groupBy("arc", "kind").agg(F.count(F.lit(1)).alias("total"))
    return every.join(totals, ["arc", "kind"]).select("arc", "kind", "item", "total")


# -- header ----------------------------------------------------------------------------------
def run_meta(tables, run_id: str, adoption_source: str = "events", mode: str = "local") -> DataFrame:
    """Run header with the span of the scanned usage."""
    span = tables["raw_usage"].agg(F.min("event_ts").alias("a"), F.max("event_ts").alias("b"), F.count(F.lit(1)).alias("events"))
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    return span.select(
        F.lit(run_id).alias("run_id"), F.lit(TOOL_VERSION).alias("tool_version"), F.lit(mode).alias("grouping_mode"),
        F.lit(adoption_source).alias("adoption_source"), F.date_format("a", stamp).alias("usage_from"),
        F.date_format("b", stamp).alias("usage_to"), F.col("events").alias("usage_events"))


# -- calibration -----------------------------------------------------------------------------
def coverage_gate(tables, measure: str) -> DataFrame:
    """One row: measured, status, reason; an absent measure is said to be absent."""
    row = tables["coverage"].filter(F.col("measure") == measure).agg(F.max("status").alias("s"), F.max("reason").alias("r"))
    return row.select(
        F.lit(measure).alias("measure"), F.coalesce(F.col("s") == "ok", F.lit(False)).alias("measured"),
        F.coalesce("s", F.lit("absent")).alias("status"),
        F.when(F.col("s").isNull(), "no such row in the register").otherwise(F.coalesce("r", F.lit(""))).alias("reason"))


def coverage_gaps(coverage: DataFrame) -> DataFrame:
    return coverage.filter("status <> 'ok'")


def calibrate_variant_count(tables, threshold: int = 5) -> DataFrame:
    g = tables["groups"].filter(is_measured(tables, "fields"))
    s = stats.five_number_stats(g, "variant_count")
    over = g.agg(F.count_if(F.col("variant_count") > threshold).alias("n"))
    return s.withColumn("over_threshold", over.select("n").scalar())


def group_field_leaders(tables) -> DataFrame:
    """Per group with views: top field's share, its ratio to the next, fields covering 80%.

    Over fields on purpose: dominance itself is decided over definitions.
    """
    v = tables["variants"].filter(is_measured(tables, "usage_events"))
    lead = v.groupBy("group_id").agg(
        F.max(F.when(F.col("usage_rank") == 1, F.col("views"))).alias("first"),
        F.max(F.when(F.col("usage_rank") == 2, F.col("views"))).alias("second"),
        F.bool_or("is_dominant").alias("dominant"))
    cover = cover_counts(v, ["group_id"], "views", {"cover80": ranking.COVER})
    return lead.join(cover.filter("total > 0"), "group_id").select(
        "group_id", (F.col("first") / F.col("total")).alias("share"),
        F.when(F.col("second") > 0, F.col("first") / F.col("second")).alias("ratio"), "cover80", "dominant")


def calibrate_dominance(tables) -> DataFrame:
    g = group_field_leaders(tables)
    return reduce(DataFrame.unionByName, [
        stats.five_number_stats(g, c).select(F.lit(c).alias("measure"), "n", *[F.round(x, 6).alias(x) for x in ("min", "p25", "median", "p75", "max", "mean")])
        for c in ("share", "ratio", "cover80")])


def calibrate_dominance_buckets(tables) -> DataFrame:
    g = group_field_leaders(tables)
    share = stats.bucketize(g, "share", [0.4, ranking.MIN_SHARE, 0.8]).withColumn("measure", F.lit("share"))
    ratio = stats.bucketize(g, "ratio", [1.5, ranking.MIN_RATIO, 3.0]).withColumn("measure", F.lit("ratio"))
    return share.unionByName(ratio).select("measure", "bucket", "label", "n")


def calibrate_freshness(tables, within: int = 30) -> DataFrame:
    """Failure rate, and how recently content on broken sources was still viewed."""
    views = m.failed_source_recent_views(tables).filter(is_measured(tables, "refresh_jobs"))
    s = stats.five_number_stats(views, "last_viewed_days_ago")
    near = views.agg(F.count_if(F.col("last_viewed_days_ago") <= within).alias("n"))
    r = one(m.refresh_failure_rate(tables))
    return s.withColumn("within_window", near.select("n").scalar()).withColumn("r", r).select(
        F.col("r.total").alias("jobs_total"), F.col("r.failed").alias("jobs_failed"), F.col("r.rate").alias("failure_rate"),
        "n", "min", "p25", "median", "p75", "max", F.round("mean", 6).alias("mean"), "within_window")


def calibrate_permissions(tables, rules: dict | None = None) -> DataFrame:
    gate = is_measured(tables, "permissions")
    return m.permission_exposure(tables, *catalog.broad_grant_policy(rules)).filter(gate)


# -- presentation builds ------------------------------------------------------------------------
def variant_sheet(tables) -> DataFrame:
    """The working detail of every group, one row per field (fixed column list)."""
    d = detail.variant_detail(tables)
    share = ranking.view_share(tables["variants"]).select("field_id", "view_share")
    return d.join(share, "field_id").select(
        "group_id", "label", "field_name", "usage_rank", F.col("views").alias("view_count"), "view_share",
        F.col("workbooks").alias("workbook_count"), "is_dominant", "resolution_status", "datasource_name", "owner", "resolved_formula")


def payload_projection(tables) -> DataFrame:
    """The circulating build of the variant detail: formulas and owners marked removed."""
    return detail.redact_columns(variant_sheet(tables), ["resolved_formula", "owner"])
