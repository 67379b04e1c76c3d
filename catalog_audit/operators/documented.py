"""Measures the methodology documents beyond the shipped rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_audit.functions.names import blank, content_tokens
from catalog_audit.operators.ordering import running


def stale_refresh(tables, as_of: str, within: int = 30) -> DataFrame:
    """Sources whose last success is older than twice their median refresh interval and whose content was viewed lately.

    Intervals are days between completions that follow one another, over distinct days: a source has no more
    of them than days, however many jobs it ran.
    """
    jobs = tables["refresh_jobs"].filter("completed_at IS NOT NULL")
    day = F.to_date("completed_at")
    days = jobs.groupBy("datasource_id", day.alias("day")).agg(F.count_if(F.col("status") != "Failed").alias("good"))
    gaps = days.withColumn("gap", F.date_diff("day", F.lag("day").over(Window.partitionBy("datasource_id").orderBy("day"))))
    per = gaps.groupBy("datasource_id").agg(
        F.percentile("gap", F.lit(0.5)).alias("interval_days"), F.max(F.when(F.col("good") > 0, F.col("day"))).alias("last_success"))
    age = F.date_diff(F.to_date(F.lit(as_of)), F.col("last_success"))
    late = per.withColumn("age_days", age).filter(F.col("last_success").isNull() | (F.col("age_days") > 2 * F.col("interval_days")))
    edges = tables["lineage"].filter("downstream_type = 'workbook' AND upstream_type = 'datasource'").select(
        F.col("upstream_id").alias("datasource_id"), F.col("downstream_id").alias("workbook_id"))
    seen = tables["usage_events"].filter(F.col("last_viewed_days_ago") <= within).select("workbook_id")
    used = edges.join(seen, "workbook_id", "left_semi").select("datasource_id").distinct()
    return late.join(used, "datasource_id", "left_semi").select("datasource_id", "age_days")


def active_workbooks(tables, fraction: float = 0.8) -> DataFrame:
    """The most viewed workbooks that together reach ``fraction`` of all views."""
    use = tables["usage_events"].filter("event_count > 0").select("workbook_id", "event_count")
    cum = running(use, [], [F.col("event_count").desc(), F.col("workbook_id")], {"upto": F.col("event_count")})
    total = use.agg(F.sum("event_count").alias("t")).select("t").scalar()
    return cum.withColumn("total", total).filter(F.col("upto") - F.col("event_count") < F.lit(fraction) * F.col("total")).select("workbook_id")


def domain_scope(tables, projects: DataFrame, owners: DataFrame) -> DataFrame:
    """Workbooks to domains by project, else owner; the rest is to be mapped by hand when active, else unmappable.

    projects: project_name, project_domain. owners: owner, owner_domain.
    """
    active = active_workbooks(tables).select(F.col("workbook_id").alias("id"), F.lit(True).alias("active"))
    w = (tables["workbooks"].join(projects, "project_name", "left").join(owners, "owner", "left").join(active, "id", "left"))
    mech = (F.when(F.col("project_domain").isNotNull(), "project").when(F.col("owner_domain").isNotNull(), "owner")
            .when(F.col("active"), "manual").otherwise("unmappable"))
    return w.select("id", F.coalesce("project_domain", "owner_domain").alias("domain"), mech.alias("mechanism"))


def active_user_penetration(tables, licensed: DataFrame, least: float = 0.30) -> DataFrame:
    """Share of licensed users (``user_id``) with a view event."""
    active = tables["raw_usage"].filter("event_name = 'view'").select("user_id").distinct()
    n = licensed.agg(F.count_distinct("user_id").alias("n")).select("n").scalar()
    a = licensed.select("user_id").distinct().join(active, "user_id", "left_semi").agg(F.count(F.lit(1)).alias("active"))
    rate = F.try_divide(F.col("active").cast("double"), F.col("licensed").cast("double"))
    return a.withColumn("licensed", n).select("active", "licensed", rate.alias("penetration"), (rate < least).alias("fires"))


def rule_editors(tables) -> DataFrame:
    """Grantees who may edit workbooks that hold calculations, and how many workbooks."""
    calc = tables["fields"].filter("is_calculated").select(F.col("id").alias("field_id"))
    books = tables["field_usage"].join(calc, "field_id", "left_semi").select(F.col("workbook_id").alias("object_id")).distinct()
    edit = tables["permissions"].filter("object_type = 'workbook' AND mode = 'Allow' AND capability = 'Write'")
    return edit.join(books, "object_id", "left_semi").groupBy("grantee_id").agg(F.count_distinct("object_id").alias("workbooks"))


def description_divergence(one: DataFrame, other: DataFrame) -> DataFrame:
    """Fields two feeds describe differently. Both: id, description; NULL and absent differ from text."""
    j = one.select("id", F.col("description").alias("a")).join(other.select("id", F.col("description").alias("b")), "id", "full")
    return j.filter(~F.col("a").eqNullSafe(F.col("b"))).select("id", F.col("a").alias("first_description"), F.col("b").alias("second_description"))


def duplicate_logic(tables) -> DataFrame:
    """The same resolved logic in two or more sources."""
    f = tables["fields"].select(F.col("id").alias("field_id"), "datasource_id")
    r = tables["resolved"].filter("normalized_hash <> ''").select("field_id", "normalized_hash")
    return r.join(f, "field_id").groupBy("normalized_hash").agg(
        F.count(F.lit(1)).alias("fields"), F.count_distinct("datasource_id").alias("sources")).filter("sources >= 2")


def cryptic_name_rate(names: DataFrame, column: str) -> DataFrame:
    """Share of names that are too short, carry a version suffix, or are abbreviated."""
    c = F.trim(F.coalesce(F.col(column), F.lit("")))
    short = F.length(c) < 4
    version = c.rlike(r"(?i)[_ ]v?[0-9]+$")
    abbreviated = c.rlike(r"(?i)\b(rev|amt|qty|avg|cnt|pct|num|tot|yoy|ytd|adj)\b")
    total = F.count(F.lit(1))
    return names.agg(total.alias("names"), F.count_if(short).alias("short"), F.count_if(version).alias("versioned"),
                     F.count_if(abbreviated).alias("abbreviated"),
                     F.try_divide(F.count_if(short | version | abbreviated).cast("double"), total.cast("double")).alias("rate"))


def reuse_depth(tables) -> DataFrame:
    """Per published source: workbooks built on it and upstream tables it draws on."""
    books = (tables["lineage"].filter("downstream_type = 'workbook' AND upstream_type = 'datasource'")
             .groupBy(F.col("upstream_id").alias("id")).agg(F.count_distinct("downstream_id").alias("workbooks")))
    ups = (tables["lineage"].filter("downstream_type = 'datasource' AND upstream_type = 'table'")
           .groupBy(F.col("downstream_id").alias("id")).agg(F.count_distinct("upstream_id").alias("tables")))
    return tables["datasources"].select("id").join(books, "id", "left").join(ups, "id", "left").select(
        "id", F.coalesce("workbooks", F.lit(0)).alias("workbooks"), F.coalesce("tables", F.lit(0)).alias("tables"))


def unused_fields(tables) -> DataFrame:
    used = tables["field_usage"].filter(~blank(F.col("workbook_id"))).select(F.col("field_id").alias("id"))
    return tables["fields"].select("id", "name").join(used, "id", "left_anti")


def fuzzy_name_groups(tables) -> DataFrame:
    """Names whose words differ by at most one, proposed for review and never merged.

    Each distinct word set files itself under itself and under every set with one word
    removed; sets meeting under a key form a proposal. No pair of names is ever built.
    """
    toks = F.array_sort(content_tokens(F.col("name")))
    sets = (tables["fields"].filter("is_calculated").groupBy(toks.alias("toks")).agg(F.count(F.lit(1)).alias("names"))
            .filter("size(toks) >= 1"))
    less = F.transform("toks", lambda t: F.array_remove(F.col("toks"), t))
    keys = F.array_distinct(F.concat(F.array("toks"), F.filter(less, lambda s: F.size(s) >= 1)))
    filed = sets.select("names", F.array_join("toks", " ").alias("words"), F.explode(keys).alias("key"))
    return filed.groupBy(F.array_join("key", " ").alias("key")).agg(
        F.count(F.lit(1)).alias("word_sets"), F.sum("names").cast("bigint").alias("names"), F.min("words").alias("first_words")).filter(
        "word_sets >= 2").select("key", "word_sets", "names", "first_words", F.lit("medium").alias("confidence"))
