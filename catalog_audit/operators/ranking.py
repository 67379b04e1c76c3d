"""Usage rank, definition totals, dominance and cover counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_audit.operators.ordering import cover_counts, numbered

# Provisional dominance thresholds.
MIN_SHARE, MIN_RATIO, COVER = 0.6, 2.0, 0.8


def usage_rank(tables) -> DataFrame:
    """Members of each group, ranked 1..n by views then field id."""
    members = tables["candidates"].join(tables["groups"].select("concept_key", "group_id", "label"), "concept_key").select(
        "group_id", "label", "field_id", "name", "normalized_hash", "definition_key", "views", "workbooks")
    return numbered(members, ["group_id"], [F.col("views").desc(), F.col("field_id")], "usage_rank")


def definition_views(members: DataFrame) -> DataFrame:
    """Views per (group, definition), with the rank of the definition's best field."""
    return members.groupBy("group_id", "definition_key").agg(
        F.sum("views").cast("bigint").alias("total"), F.min("usage_rank").alias("first_rank"))


def dominance(members: DataFrame, min_share: float = MIN_SHARE, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Per group: leading definition, runner-up total, and whether the leader dominates.

    The two leaders come from a ranked filter, which Spark limits per map task, so a
    group with very many definitions is not gathered.
    """
    totals = definition_views(members)
    w = Window.partitionBy("group_id").orderBy(F.col("total").desc(), "first_rank")
    top2 = totals.withColumn("rk", F.row_number().over(w)).filter("rk <= 2")
    lead = top2.groupBy("group_id").agg(
        F.max(F.when(F.col("rk") == 1, F.col("total"))).alias("top_total"),
        F.max(F.when(F.col("rk") == 1, F.col("definition_key"))).alias("top_key"),
        F.max(F.when(F.col("rk") == 1, F.col("first_rank"))).alias("first_rank"),
        F.max(F.when(F.col("rk") == 2, F.col("total"))).alias("second_total"))
    sums = totals.groupBy("group_id").agg(F.sum("total").cast("bigint").alias("group_total"))
    wins = ((F.col("group_total") > 0) & (F.col("top_total") >= F.lit(min_share) * F.col("group_total"))
            & (F.col("second_total").isNull() | (F.col("top_total") >= F.lit(min_ratio) * F.col("second_total"))))
    return lead.join(sums, "group_id").withColumn("has_dominant", wins).withColumn(
        "top_ratio", F.when(F.col("second_total") > 0, F.col("top_total") / F.col("second_total")))


def rank_groups(tables, min_share: float = MIN_SHARE, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Ranked members with the dominant field of each settled group marked."""
    members = tables["ranked"]
    dom = dominance(members, min_share, min_ratio).select(
        "group_id", F.col("first_rank").alias("_rank"), "has_dominant")
    return members.join(dom, "group_id", "left").withColumn(
        "is_dominant", F.coalesce("has_dominant", F.lit(False)) & (F.col("usage_rank") == F.col("_rank"))
    ).drop("_rank", "has_dominant")


def cover_count(members: DataFrame, fraction: float = COVER) -> DataFrame:
    """Definitions per group that reach ``fraction`` of its views; 0 without views."""
    return cover_counts(definition_views(members), ["group_id"], "total", {"cover": fraction})


def view_share(variants: DataFrame) -> DataFrame:
    """Each field's share of its group's views; 0.0 when the group has none."""
    totals = variants.groupBy("group_id").agg(F.sum("views").alias("group_views"))
    share = F.when(F.col("group_views") > 0, F.col("views") / F.col("group_views")).otherwise(F.lit(0.0))
    return variants.join(totals, "group_id").select("group_id", "field_id", "views", share.alias("view_share"))


def dominant_group_share(tables) -> DataFrame:
    """(groups with a dominant variant) / groups; 0.0 when there are none."""
    won = tables["variants"].groupBy("group_id").agg(F.bool_or("is_dominant").alias("won"))
    total = F.count(F.lit(1))
    return won.agg(F.count_if("won").alias("dominant"), total.alias("groups"),
                   F.coalesce(F.try_divide(F.count_if("won").cast("double"), total.cast("double")), F.lit(0.0)).alias("share"))


def group_workbook_count(tables) -> DataFrame:
    """Distinct workbooks any field of a group is used in."""
    used = tables["field_usage"].filter("trim(coalesce(workbook_id, '')) <> ''").select("field_id", "workbook_id")
    # repeats of a pair fall with those of its group
    return (tables["variants"].select("group_id", "field_id").join(used, "field_id").select("group_id", "workbook_id").distinct()
            .groupBy("group_id").agg(F.count(F.lit(1)).alias("workbooks_affected")))
