"""Estate measures: counts, shares and filtered sets over one or two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.functions import formula as fx
from catalog_audit.functions.names import blank


def n(cond: Column | None = None) -> Column:
    return F.count(F.lit(1)) if cond is None else F.count_if(cond)


def share(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL on an empty denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def share0(part: Column, whole: Column) -> Column:
    """The same, but 0.0 on an empty denominator (facet measures)."""
    return F.coalesce(share(part, whole), F.lit(0.0))


# -- fields --------------------------------------------------------------------
def user_context_fields(tables) -> DataFrame:
    return (tables["fields"].filter(F.col("is_calculated") & fx.is_user_context(F.col("formula")))
            .select("id", "name", "formula", "datasource_id"))


def described_fields(tables) -> DataFrame:
    return tables["fields"].filter(~blank(F.col("description"))).select("id", "description")


def description_coverage(tables) -> DataFrame:
    has = ~blank(F.col("description"))
    return tables["fields"].agg(n(has).alias("described"), n().alias("total"), share0(n(has), n()).alias("coverage"))


def fields_per_source(tables) -> DataFrame:
    return tables["fields"].groupBy("datasource_id").agg(n().alias("fields"))


# -- lineage -------------------------------------------------------------------
def datasource_ref_shares(tables) -> DataFrame:
    books = tables["lineage"].filter("downstream_type = 'workbook'")
    emb, pub = n(F.col("upstream_type") == "embedded_datasource"), n(F.col("upstream_type") == "datasource")
    return books.agg(emb.alias("embedded_refs"), pub.alias("published_refs"),
                     share0(emb, emb + pub).alias("embedded_share"), share0(pub, emb + pub).alias("published_share"))


def table_fanout(tables) -> DataFrame:
    return (tables["lineage"].filter("downstream_type = 'datasource' AND upstream_type = 'table'")
            .groupBy("upstream_id", "upstream_label")
            .agg(F.count_distinct("downstream_id").alias("sources")))


def max_fanout(tables) -> DataFrame:
    return table_fanout(tables).agg(
        F.coalesce(F.max("sources"), F.lit(0)).alias("max_sources"), n(F.col("sources") > 1).alias("redundant_tables"))


def sources_without_upstream(tables) -> DataFrame:
    edges = (tables["lineage"].filter("downstream_type = 'datasource'")
             .select(F.col("downstream_id").alias("id")))
    return tables["datasources"].select("id", "name").join(edges, "id", "left_anti")


# -- column projections --------------------------------------------------------
def shared_table_projection(tables) -> DataFrame:
    """Projections of physical tables that two or more sources read."""
    p = tables["projection"]
    shared = (p.groupBy("table_key").agg(F.count_distinct("datasource_id").alias("n"))
              .filter("n >= 2").select("table_key"))
    return p.join(shared, "table_key", "left_semi")


def column_divergence(tables) -> DataFrame:
    """Per column of a shared table: distinct types, exposing sources, sources of the table."""
    p = tables["projection"]
    sources = p.groupBy("table_key").agg(F.count_distinct("datasource_id").alias("table_sources")).filter("table_sources >= 2")
    cols = p.groupBy("table_key", "column_name").agg(
        F.count_distinct("field_data_type").alias("types"), F.count_distinct("datasource_id").alias("sources"),
        F.array_join(F.sort_array(F.collect_set("field_data_type")), ",").alias("type_names"))
    return cols.join(sources, "table_key").select(
        "table_key", "column_name", "types", "type_names", "sources", "table_sources",
        (F.col("types") >= 2).alias("type_divergent"), (F.col("sources") < F.col("table_sources")).alias("not_shared"))


def columns_not_shared(tables) -> DataFrame:
    return column_divergence(tables).filter("not_shared").select("table_key", "column_name", "sources", "table_sources")


# -- sources, warnings, certification ------------------------------------------
def sources_missing_owner(tables) -> DataFrame:
    return tables["datasources"].filter(blank(F.col("owner"))).select("id", "name")


def certified_with_active_warning(tables) -> DataFrame:
    """One row per active warning on a certified source."""
    certified = tables["datasources"].filter("is_certified").select("id", "name", "luid")
    active = tables["dqw"].filter("is_active").select(
        F.col("id").alias("warning_id"), F.col("asset_luid").alias("luid"), "is_elevated", "warning_type")
    return active.join(certified, "luid").select("id", "name", "warning_id", "is_elevated", "warning_type")


def certified_clean(tables) -> DataFrame:
    """Certified sources with no active warning."""
    active = tables["dqw"].filter("is_active").select(F.col("asset_luid").alias("luid"))
    return tables["datasources"].filter("is_certified").select("id", "name", "luid").join(active, "luid", "left_anti").select("id", "name")


def dq_warning_counts(tables) -> DataFrame:
    return tables["dqw"].agg(n(F.col("is_active")).alias("active"), n().alias("total"))


def certification_counts(tables) -> DataFrame:
    return tables["datasources"].agg(n(F.col("is_certified")).alias("certified"), n().alias("total"))


def ownership_coverage(tables) -> DataFrame:
    owned = n(~blank(F.col("owner")))
    return tables["datasources"].agg(owned.alias("owned"), n().alias("total"), share(owned, n()).alias("coverage"))


def certification_coverage(tables) -> DataFrame:
    return tables["datasources"].agg(share(n(F.col("is_certified")), n()).alias("coverage"))


def owner_attribution_gap(tables) -> DataFrame:
    """Objects seen and objects the feed gave no owner for."""
    seen = tables["datasources"].select("owner").unionByName(tables["workbooks"].select("owner"))
    return seen.agg(n().alias("objects_seen"), n(F.coalesce("owner", F.lit("")) == "").alias("owner_missing"))


def custom_sql_grain(tables) -> DataFrame:
    s = fx.sql_grain_signals(F.col("query"))
    return tables["custom_sql"].agg(
        n(s["has_group_by"]).alias("with_group_by"), n(s["has_user_function"]).alias("with_user_function"), n().alias("total"))


def database_table_stats(tables) -> DataFrame:
    return tables["database_tables"].agg(
        n(F.col("is_embedded")).alias("embedded"), n(F.col("is_certified")).alias("certified"),
        F.coalesce(F.max("downstream_datasource_count"), F.lit(0)).alias("max_downstream"), n().alias("total"))


# -- refresh -------------------------------------------------------------------
def refresh_failure_rate(tables) -> DataFrame:
    failed = n(F.col("status") == "Failed")
    return tables["refresh_jobs"].agg(n().alias("total"), failed.alias("failed"), share0(failed, n()).alias("rate"))


def latest_refresh(tables) -> DataFrame:
    """Latest completion per source and whether any job finishing then failed.

    Two maxima in one hash aggregate: a failure at the latest time is a latest failure,
    whatever else finished at the same moment.
    """
    failure = F.when(F.col("status") == "Failed", F.col("completed_at"))
    return (tables["refresh_jobs"].filter("completed_at IS NOT NULL").groupBy("datasource_id")
            .agg(F.max("completed_at").alias("completed_at"), F.max(failure).alias("_failure"))
            .select("datasource_id", "completed_at", F.coalesce(F.col("_failure") == F.col("completed_at"), F.lit(False)).alias("failed")))


def failed_source_recent_views(tables) -> DataFrame:
    """Published workbooks on sources whose latest refresh failed, with days since last view."""
    broken = latest_refresh(tables).filter("failed").select("datasource_id")
    edges = (tables["lineage"].filter("downstream_type = 'workbook' AND upstream_type = 'datasource'")
             .select(F.col("upstream_id").alias("datasource_id"), F.col("downstream_id").alias("workbook_id")).distinct())
    use = tables["usage_events"].filter("last_viewed_days_ago IS NOT NULL").select("workbook_id", "last_viewed_days_ago")
    return edges.join(broken, "datasource_id", "left_semi").join(use, "workbook_id").select(
        "datasource_id", "workbook_id", "last_viewed_days_ago")


# -- permissions ---------------------------------------------------------------
def is_permissive(everyone, sensitive) -> Column:
    return ((F.col("mode") == "Allow") & F.col("grantee_id").isin(*everyone) & F.col("capability").isin(*sensitive))


def permissive_grants(tables, everyone, sensitive) -> DataFrame:
    return tables["permissions"].filter(is_permissive(everyone, sensitive)).select(
        "object_type", "object_id", "grantee_id", "capability")


def permission_counts(tables) -> DataFrame:
    return tables["permissions"].agg(
        n().alias("grants"), F.count_distinct(F.concat_ws(":", "object_type", "object_id")).alias("objects"),
        n(F.col("mode") == "Deny").alias("deny_rules"))


def permission_exposure(tables, everyone, sensitive) -> DataFrame:
    """Permissive grants and exposed objects per capability, and the total (NULL capability)."""
    spark = tables["permissions"].sparkSession
    hits = permissive_grants(tables, everyone, sensitive)
    return spark.sql(
        """SELECT capability, count(*) AS permissive_grants, count(DISTINCT struct(object_type, object_id)) AS exposed_objects
           FROM {hits} GROUP BY GROUPING SETS ((capability), ())""", hits=hits)


def permission_sample(tables, per_type: int = 50) -> DataFrame:
    """Sampling basis: every project, the first ``per_type`` objects of each content type.

    The ranked filter is a window group limit: each map task forwards at most
    ``per_type`` rows of a type, so no type is gathered whole.
    """
    from pyspark.sql import Window
    kinds = [("project", "projects"), ("datasource", "datasources"), ("workbook", "workbooks")]
    objects = None
    for kind, table in kinds:
        part = tables[table].select(F.lit(kind).alias("object_type"), F.col("id").alias("object_id"))
        objects = part if objects is None else objects.unionByName(part)
    w = Window.partitionBy("object_type").orderBy("object_id")
    content = objects.filter("object_type <> 'project'").withColumn("rn", F.row_number().over(w)).filter(
        F.col("rn") <= per_type).drop("rn")
    chosen = objects.filter("object_type = 'project'").unionByName(content)
    granted = tables["permissions"].join(chosen, ["object_type", "object_id"], "left_semi")
    none = {"total": F.lit(0), "sampled": F.lit(0), "grants": F.lit(0)}

    def tally(df, what):
        return df.select("object_type", *[(F.lit(1) if k == what else zero).alias(k) for k, zero in none.items()])

    sums = tally(objects, "total").unionByName(tally(chosen, "sampled")).unionByName(tally(granted, "grants"))
    basis = sums.groupBy("object_type").agg(*[F.sum(k).alias(k) for k in none])
    return basis.select("object_type", "total", "sampled",
                        F.when(F.col("sampled") >= F.col("total"), "all").otherwise("sampled").alias("coverage"), "grants")


def table_row_counts(tables, names) -> DataFrame:
    out = None
    for name in names:
        part = tables[name].agg(n().alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def top_evidence(tables, k: int) -> DataFrame:
    """The first ``k`` calculated fields of each source by id (a ranked filter: limited per map task)."""
    from pyspark.sql import Window
    w = Window.partitionBy("datasource_id").orderBy("id")
    return (tables["fields"].filter("is_calculated").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
            .select("datasource_id", "id", "name"))


def iso_probe(tables, now: str = "2024-01-15") -> DataFrame:
    """Text dates of all events, parsed leniently, with their age."""
    from catalog_audit.functions.names import days_ago, parse_iso
    text = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parsed = parse_iso(text)
    return tables["raw_usage"].select(
        "event_id", F.date_format(parsed, "yyyy-MM-dd").alias("parsed"), days_ago(F.lit(now), parsed).alias("days_ago"))
