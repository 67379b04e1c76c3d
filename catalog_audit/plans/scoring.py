"""Facet scores, interview reconciliation, dimension and domain roll-ups.

There is no composite: a domain's readiness is its weakest scored dimension and the
register names what binds it. Everything after the measures is facet-sized.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.functions.bands import band_score, capped_score
from catalog_audit.operators import measures as m, ranking, usage as u
from catalog_audit.plans import catalog
from catalog_audit.plans.rules import rule_result

FACET_COLUMNS = ["id", "dimension", "score", "evidence", "confidence", "derivation", "value", "gates"]

# measure name -> one-row frame with `value`; facets read 0.0 on an empty table
MEASURES = {
    "dominant_variant_share": lambda t: ranking.dominant_group_share(t).select(F.col("share").alias("value")),
    "description_coverage": lambda t: m.description_coverage(t).select(F.col("coverage").alias("value")),
    "published_datasource_share": lambda t: m.datasource_ref_shares(t).select(F.col("published_share").alias("value")),
    "content_activation": lambda t: u.content_activation(t).select(F.col("activation").alias("value")),
}
# arcs read NULL on an empty table: nothing to own is no reading
ARC_MEASURES = {
    "ownership_coverage": lambda t: m.ownership_coverage(t).select(F.col("coverage").alias("value")),
    "certification_coverage": lambda t: m.certification_coverage(t).select(F.col("coverage").alias("value")),
}


def is_measured(tables, measure: str) -> Column:
    """True only when the feed's coverage row says ``ok``; absent is not measured."""
    status = tables["coverage"].filter(F.col("measure") == measure).agg(F.max("status").alias("s")).select("s").scalar()
    return F.coalesce(status == "ok", F.lit(False))


def _facet(df: DataFrame, fid: str, dimension: str, score: Column, derivation: Column, gates: list[int]) -> DataFrame:
    levels = F.array(*map(F.lit, gates)) if gates else F.array().cast("array<int>")
    return df.select(
        F.lit(fid).alias("id"), F.lit(dimension).alias("dimension"), score.cast("int").alias("score"),
        F.lit("observed").alias("evidence"), F.lit("observed").alias("confidence"), derivation.alias("derivation"),
        F.col("value").cast("double").alias("value"), levels.alias("gates"))


def _measured_only(tables, df: DataFrame, needs: list[str]) -> DataFrame:
    for feed in needs or []:
        df = df.filter(is_measured(tables, feed))
    return df


def facet_threshold_scores(tables, rules: dict | None = None, inputs: dict[str, bool] | None = None) -> DataFrame:
    """Banded facets whose feeds were measured."""
    rules = rules or catalog.load_rules()
    parts = []
    for fid, spec in rules["facets"].items():
        if spec.get("scored") and "measure" in spec:
            if spec["measure"] not in MEASURES:
                raise ValueError(f"no measure {spec['measure']!r} for facet {fid}")
            df = _measured_only(tables, MEASURES[spec["measure"]](tables), spec.get("requires_coverage"))
            score = band_score(spec.get("bands", {}), F.col("value"), inputs)
            text = F.format_string("band %d of %s at %.4f", score.cast("int"), F.lit(spec["measure"]), F.col("value"))
            parts.append(_facet(df, fid, spec["dimension"], score, text, spec.get("gates", [])))
    return reduce(DataFrame.unionByName, parts)


def facet_capped_scores(tables, rules: dict | None = None) -> DataFrame:
    """Facets that start at a base and are capped by fired, unsuppressed flags."""
    rules = rules or catalog.load_rules()
    parts = []
    for fid, spec in rules["facets"].items():
        if not spec.get("scored") or "caps" not in spec:
            continue
        counts = {}
        df = tables["fields"].sparkSession.range(1).select(F.lit(None).cast("double").alias("value"))
        df = _measured_only(tables, df, spec.get("requires_coverage"))
        for cap in spec["caps"]:
            flag = rules["flags"].get(cap["flag"], {})
            if flag.get("implemented") and not flag.get("suppress"):
                fired = rule_result(tables, cap["flag"], rules).filter("fires").agg(F.coalesce(F.max("count"), F.lit(0)).alias("n"))
                df = df.withColumn(f"_{cap['flag']}", fired.select("n").scalar())
                counts[cap["flag"]] = F.col(f"`_{cap['flag']}`")
            else:
                counts[cap["flag"]] = F.lit(0)
        score = capped_score(spec.get("base", 6), spec["caps"], counts)
        text = F.format_string("base %d, scored %d after caps", F.lit(spec.get("base", 6)), score)
        parts.append(_facet(df, fid, spec["dimension"], score, text, spec.get("gates", [])))
    return reduce(DataFrame.unionByName, parts)


def arc_scores(tables, rules: dict | None = None) -> DataFrame:
    """Governance arcs the scan can read."""
    rules = rules or catalog.load_rules()
    parts = []
    for arc, spec in rules["governance_arcs"].items():
        if not spec.get("measure"):
            continue
        if spec["measure"] not in ARC_MEASURES:
            raise ValueError(f"no measure {spec['measure']!r} for arc {arc}")
        df = _measured_only(tables, ARC_MEASURES[spec["measure"]](tables), spec.get("requires_coverage")).filter("value IS NOT NULL")
        score = band_score(spec.get("bands", {}), F.col("value"))
        text = F.format_string("band %d of %s at %.4f", score.cast("int"), F.lit(spec["measure"]), F.col("value"))
        parts.append(_facet(df, f"governance.{arc}", "governance", score, text, []))
    return reduce(DataFrame.unionByName, parts)


def scan_facets(tables, rules: dict | None = None) -> DataFrame:
    return (facet_threshold_scores(tables, rules).unionByName(facet_capped_scores(tables, rules))
            .unionByName(arc_scores(tables, rules)))


def interview_conflicts(scan: DataFrame, interview: DataFrame) -> DataFrame:
    """INT-01: an answer stronger than the scan. Per facet the last role's answer stands."""
    j = interview.join(scan.select(F.col("id").alias("facet_id"), F.col("score").alias("scan_score")), "facet_id").filter(
        F.col("score") > F.col("scan_score"))
    last = j.groupBy("facet_id").agg(F.max_by(F.struct("score", "scan_score", "source_role", "evidence_note"), "source_role").alias("r"))
    return last.select(F.lit("INT-01").alias("flag_id"), F.col("facet_id").alias("facet"), F.lit(1).cast("bigint").alias("count"),
                       F.col("r.scan_score").alias("scan_score"), F.col("r.score").alias("interview_score"),
                       F.col("r.source_role").alias("source_role"), F.col("r.evidence_note").alias("note"))


def reconcile(scan: DataFrame, interview: DataFrame, rules: dict | None = None) -> DataFrame:
    """All facets: the scan's reading where there is one, else the best interview answer."""
    rules = rules or catalog.load_rules()
    spark = scan.sparkSession
    defs = spark.createDataFrame([(f, s["dimension"], s.get("gates", [])) for f, s in rules["facets"].items()],
                                 "facet_id string, dimension string, gates array<int>")
    best = interview.filter("score IS NOT NULL").groupBy("facet_id").agg(
        F.min_by(F.struct("score", "evidence_note", "source_role"), F.struct(-F.col("score"), F.col("source_role"))).alias("r"))
    prefix = F.substring_index("facet_id", ".", 1)
    mapped = F.create_map(*[F.lit(x) for kv in catalog.DIMENSION_PREFIX.items() for x in kv])
    said = best.join(defs, "facet_id", "left").select(
        F.col("facet_id").alias("id"), F.coalesce("dimension", F.try_element_at(mapped, prefix), prefix).alias("dimension"),
        F.col("r.score").alias("score"), F.lit("reported").alias("evidence"), F.lit("reported").alias("confidence"),
        F.concat(F.lit("interview: "), F.col("r.evidence_note"), F.lit(" ["), F.when(F.col("r.source_role") == "", "?").otherwise(F.col("r.source_role")),
                 F.lit("]")).alias("derivation"),
        F.lit(None).cast("double").alias("value"), F.coalesce("gates", F.array().cast("array<int>")).alias("gates"))
    return scan.select(*FACET_COLUMNS).unionByName(said.join(scan.select("id"), "id", "left_anti").select(*FACET_COLUMNS))


def score_facets(tables, rules: dict | None = None) -> DataFrame:
    return reconcile(scan_facets(tables, rules), tables["interview"], rules)


def dimension_rollup(facets: DataFrame, domains: DataFrame) -> DataFrame:
    """Per domain and non-governance dimension: lowest score among facets gating the target, and all facets at it."""
    gating = facets.filter("dimension <> 'governance'").select("id", "dimension", "score", F.explode("gates").alias("target_stage"))
    j = domains.select(F.col("id").alias("domain"), "target_stage").join(gating, "target_stage")
    ranked = j.groupBy("domain", "target_stage", "dimension", "score").agg(F.array_sort(F.collect_list("id")).alias("facets"))
    return ranked.groupBy("domain", "target_stage", "dimension").agg(
        F.min("score").alias("score"), F.min_by("facets", "score").alias("facets"))


def _arc_row(facets: DataFrame, arcs: dict) -> Column:
    row = [F.max(F.when(F.col("id") == f"governance.{a}", F.col("score"))).alias(a) for a in arcs]
    return facets.agg(F.struct(*row).alias("arcs")).select("arcs").scalar()


def governance_rollup(facets: DataFrame, domains: DataFrame, rules: dict | None = None) -> DataFrame:
    """Per domain: the highest stage whose loop closes, and the arcs that stop the next.

    NULL when no arc is read or one active at the target is not: an unread arc is
    unassessed, not a zero.
    """
    arcs = (rules or catalog.load_rules())["governance_arcs"]
    starts = {a: s.get("activates_at", 2) for a, s in arcs.items()}
    df = domains.select(F.col("id").alias("domain"), "target_stage").withColumn("arcs", _arc_row(facets, arcs))
    read = {a: F.col(f"arcs.{a}") for a in arcs}
    unread = reduce(lambda x, y: x | y, [(F.col("target_stage") >= s) & read[a].isNull() for a, s in starts.items()])
    none = reduce(lambda x, y: x & y, [read[a].isNull() for a in arcs])
    score = F.lit(1)
    for stage in range(2, 7):  # higher closed stages override lower ones
        active = [F.coalesce(read[a], F.lit(0)) >= stage for a, s in starts.items() if stage >= s]
        score = F.when(reduce(lambda x, y: x & y, active), F.lit(stage)).otherwise(score)
    df = df.withColumn("score", F.when(~(unread | none), score))
    short = F.array(*[F.when((F.col("score") + 1 >= s) & (F.coalesce(read[a], F.lit(0)) < F.col("score") + 1),
                             F.lit(f"governance.{a}")) for a, s in starts.items()])
    binding = F.when(F.col("score").isNull() | (F.col("score") >= 6), F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_compact(short)))
    return df.select("domain", "target_stage", "score", binding.alias("facets"))


def domain_register(facets: DataFrame, domains: DataFrame, rules: dict | None = None) -> DataFrame:
    """Readiness, gap, every binding constraint, unscored dimensions and confidence per domain."""
    gov = governance_rollup(facets, domains, rules).filter("score IS NOT NULL").withColumn("dimension", F.lit("governance"))
    scored = dimension_rollup(facets, domains).unionByName(gov.select("domain", "target_stage", "dimension", "score", "facets"))
    low = scored.groupBy("domain").agg(
        F.min("score").alias("readiness"), F.collect_set("dimension").alias("dims"),
        F.array_sort(F.collect_list(F.struct("dimension", "score", "facets"))).alias("rows"))  # at most seven rows
    bound = F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.filter("rows", lambda r: r["score"] == F.col("readiness")), lambda r: r["facets"]))))
    reported = facets.filter("evidence IN ('reported', 'interview')").agg(F.collect_set("id").alias("ids")).select("ids").scalar()
    every = F.array(*map(F.lit, sorted(catalog.DIMENSIONS)))
    d = domains.select(F.col("id").alias("domain"), "target_stage").join(low, "domain", "left")
    d = d.withColumn("binding", F.coalesce(bound, F.array().cast("array<string>"))).withColumn("reported", reported)
    confidence = (F.when(F.col("readiness").isNull(), "unscored")
                  .when(F.arrays_overlap("binding", "reported"), "reported")
                  .when(F.size("reported") > 0, "mixed").otherwise("observed"))
    return d.select(
        "domain", "target_stage", "readiness", (F.col("target_stage") - F.col("readiness")).alias("gap"),
        F.coalesce(F.map_from_entries(F.transform("rows", lambda r: F.struct(r["dimension"], r["score"]))),
                   F.create_map().cast("map<string,int>")).alias("dimension_scores"),
        F.col("binding").alias("binding_constraints"),
        F.array_except(every, F.coalesce("dims", F.array().cast("array<string>"))).alias("unscored_dimensions"),
        confidence.alias("confidence"))
