"""Concept grouping: which calculated fields are the same business metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_audit.functions import formula as fx
from catalog_audit.functions.names import content_tokens
from catalog_audit.operators.ordering import numbered


def formula_fingerprint(tables) -> DataFrame:
    """Normal form, hash, signature and definition key of each resolved formula.

    A stored ``resolved`` stage carries the signature already.
    """
    r = tables["resolved"]
    if "definition_key" not in r.columns:
        r = fx.with_signature(r, "norm")
    return r.select("field_id", "norm", "normalized_hash", "cols", "funcs", "has_ratio", "definition_key")


def core_metric_tokens(core_metrics: list[str]) -> list[tuple[str, list[str], list[str]]]:
    """(label, tokens, distinctive tokens) of the declared metrics; configuration, not data."""
    from catalog_audit.functions.names import STOP_WORDS
    prepared = []
    for label in core_metrics:
        words = [w for w in label.replace("_", " ").lower().split() if w.isalpha() and len(w) >= 3 and w not in STOP_WORDS]
        toks = list(dict.fromkeys(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words))
        if toks:
            prepared.append((label, toks))
    owners: dict[str, int] = {}
    for _, toks in prepared:
        for t in toks:
            owners[t] = owners.get(t, 0) + 1
    return [(label, toks, [t for t in toks if owners[t] == 1]) for label, toks in prepared]


def with_core_match(df: DataFrame, name: str, core_metrics: list[str]) -> DataFrame:
    """Add ``core``: the one declared metric a name names, or NULL.

    Scored by (coverage, shared words); the best must beat the runner-up strictly and be
    anchored: every word of the metric, or a word no other metric has. The declared list
    is configuration, so it is a literal array and the match needs no join.
    """
    metrics = core_metric_tokens(core_metrics)
    if not metrics:
        return df.withColumn("core", F.lit(None).cast("string"))

    def words(ws):
        return F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")

    table = F.array(*[F.struct(F.lit(m).alias("label"), words(t).alias("toks"), words(d).alias("own"))
                      for m, t, d in metrics])

    def scored(m):
        shared = F.array_intersect(m["toks"], F.col("_toks"))
        k = F.size(shared)
        return F.struct((k.cast("double") / F.size(m["toks"])).alias("coverage"), k.alias("shared"),
                        ((k == F.size(m["toks"])) | F.arrays_overlap(shared, m["own"])).alias("anchored"),
                        m["label"].alias("label"))

    df = df.withColumn("_toks", content_tokens(F.col(name)))
    df = df.withColumn("_ranked", F.sort_array(F.filter(F.transform(table, scored), lambda s: s["shared"] > 0), asc=False))
    df = df.withColumns({"_top": F.get("_ranked", F.lit(0)), "_next": F.get("_ranked", F.lit(1))})
    tie = F.coalesce((F.col("_top.coverage") == F.col("_next.coverage")) & (F.col("_top.shared") == F.col("_next.shared")), F.lit(False))
    return df.withColumn("core", F.when(F.col("_top.anchored") & ~tie, F.col("_top.label"))).drop("_toks", "_ranked", "_top", "_next")


def measure_candidates(tables) -> DataFrame:
    """Calculated fields that aggregate a base column and carry no entitlement logic."""
    fields = (tables["fields"].filter(F.col("is_calculated") & ~fx.is_user_context(F.col("formula")))
              .select(F.col("id").alias("field_id"), "name"))
    prints = formula_fingerprint(tables).filter("size(funcs) > 0 AND size(cols) > 0")
    return fields.join(prints, "field_id").select(
        "field_id", "name", "normalized_hash", "definition_key", "funcs", "has_ratio", "cols")


def grouping_candidates(tables, core_metrics: list[str]) -> DataFrame:
    """Candidates with their concept key and measured usage."""
    c = with_core_match(measure_candidates(tables), "name", core_metrics)
    solo = F.concat(F.lit("solo:"), F.to_json(F.struct("funcs", "has_ratio", "cols")))
    c = c.withColumn("concept_key", F.when(F.col("core").isNotNull(), F.concat(F.lit("core:"), F.col("core"))).otherwise(solo))
    return c.join(tables["field_views"], "field_id", "left").select(
        "field_id", "name", "normalized_hash", "definition_key", "core", "concept_key",
        F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("workbooks", F.lit(0)).alias("workbooks"))


def metric_groups(tables) -> DataFrame:
    """One row per concept: label, size, method, and its ordinal id."""
    hashed = F.when(F.col("normalized_hash") != "", F.col("normalized_hash"))
    g = tables["candidates"].groupBy("concept_key").agg(
        F.max("core").alias("core"), F.min_by("name", F.struct(-F.col("views"), F.col("field_id"))).alias("used_name"),
        F.count(F.lit(1)).alias("variant_count"), F.count_distinct("definition_key").alias("definition_count"),
        F.min("field_id").alias("first_field"),
        # one hash or none, without a second distinct aggregate
        F.coalesce(F.min(hashed) == F.max(hashed), F.lit(True)).alias("exact"))
    g = numbered(g, [], [F.col("variant_count").desc(), F.col("first_field")], "ordinal")
    digits = F.col("ordinal").cast("string")
    return g.select(
        F.concat(F.lit("grp_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)).alias("group_id"),
        "concept_key", F.coalesce("core", "used_name").alias("label"), "variant_count", "definition_count",
        F.when(F.col("exact"), "exact_match").otherwise("formula_signature").alias("method"),
        F.when(F.col("exact"), "high").otherwise("medium").alias("confidence"))
