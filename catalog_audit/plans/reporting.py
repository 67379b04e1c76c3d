"""Sinks and report tables."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from catalog_audit.functions.bands import band_score
from catalog_audit.functions.names import blank, humanize_code
from catalog_audit.operators.detail import guarded, redact_columns
from catalog_audit.plans import catalog, findings as fnd, scoring
from catalog_audit.plans.rules import flags_table
from catalog_audit.session import stage_path


def labels(spark) -> DataFrame:
    return spark.createDataFrame([(k, n, d) for k, (n, d) in catalog.LABELS.items()], "code string, name string, description string")


def label_join(df: DataFrame, code: str) -> DataFrame:
    """Reader-facing names for a code column (and ``facet`` when present); unknown codes are humanised."""
    lab = labels(df.sparkSession)  # the shipped catalog: a few dozen rows
    out = df.join(F.broadcast(lab.withColumnRenamed("code", code)), code, "left").withColumn(
        "name", F.coalesce("name", humanize_code(F.col(code))))
    if "facet" in df.columns and code != "facet":
        out = out.join(F.broadcast(lab.select(F.col("code").alias("facet"), F.col("name").alias("_fname"))), "facet", "left")
        out = out.withColumn("facet_name", F.coalesce("_fname", humanize_code(F.col("facet")))).drop("_fname")
    return out


def band_table(tables) -> DataFrame:
    """Description coverage of every source, banded with the shipped condition texts."""
    described = F.count_if(~blank(F.col("description"))).cast("double") / F.count(F.lit(1))
    cov = tables["fields"].groupBy("datasource_id").agg(described.alias("coverage"))
    bands = catalog.FACETS["semantic.describability"]["bands"]
    return cov.withColumn("score", band_score(bands, F.col("coverage")))


def facet_rows(tables) -> DataFrame:
    return tables["facets"].select(
        "id", "dimension", "score", "evidence", "confidence", "derivation", "value", F.array_join(F.col("gates").cast("array<string>"), ",").alias("gates"))


def score_findings(tables) -> DataFrame:
    """Facets and domains as rows; domains only where a target stage is declared."""
    facets = tables["facets"]
    f = facets.select(F.lit("facet").alias("kind"), "id", "score", F.col("evidence").alias("confidence"), F.col("derivation").alias("detail"))
    domains = tables["domains"].filter("target_stage IS NOT NULL")
    d = scoring.domain_register(facets, domains).select(
        F.lit("domain").alias("kind"), F.col("domain").alias("id"), F.col("readiness").alias("score"), "confidence",
        F.array_join("binding_constraints", ",").alias("detail"))
    return f.unionByName(d)


SECTIONS = {
    "facets": facet_rows,
    "domains": lambda t: scoring.domain_register(t["facets"], t["domains"]),
    "flags": lambda t: flags_table(t["outcomes"]),
    "coverage": lambda t: t["coverage"],
    "definition_multiplicity": lambda t: t["multiplicity"],
    "variants": fnd.variant_sheet,
    "security_exposure": fnd.security_exposure,
    "security_fields": fnd.security_fields,
    "retirement": fnd.retirement_case,
    "governance_posture": fnd.governance_posture,
    "meta": lambda t: fnd.run_meta(t, t.run_id),
}
# columns removed from the circulating build, and sections it does not carry
REDACTED_COLUMNS = {"variants": ["resolved_formula", "owner"]}
WORKING_ONLY = {"security_fields"}


def findings_sections(tables, build: str = "working") -> dict[str, DataFrame]:
    out = {}
    for name, make in SECTIONS.items():
        if build == "presentation" and name in WORKING_ONLY:
            continue
        df = make(tables)
        if build == "presentation":
            df = redact_columns(df, REDACTED_COLUMNS.get(name, []))
        out[name] = df
    return out


def write_findings(tables, path: str | None = None, build: str = "working", sections: dict[str, DataFrame] | None = None) -> DataFrame:
    """Write every section as JSON and publish them together; returns the rows written per section.

    Sections are scanned for credentials while they are written to a folder of their own. Only when all are there,
    one rename puts a manifest in place that names the folder: a credential-shaped text or a failure in the last
    section leaves what was published before as it was, and nothing of the new document.
    """
    spark = tables["fields"].sparkSession
    path = path or stage_path(spark, f"findings-{build}")
    staged = f"sections/{uuid.uuid4().hex}"
    fs, at = _files(spark, path)
    written = []
    try:
        for name, df in (sections or findings_sections(tables, build)).items():
            texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
            if texts:
                df = guarded(df, texts, build)
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.json(f"{path}/{staged}/{name}")
            written.append((name, seen.get["rows"]))
    except Exception:
        fs.delete(at(staged), True)
        raise
    manifest = {"run_id": tables.run_id, "build": build, "folder": staged, "sections": dict(written)}
    out = fs.create(at(f"{staged}.json"), True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    published = at(f"published/run_id={tables.run_id}.json")
    fs.mkdirs(published.getParent())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    chosen = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    chosen[0] = options
    context.rename(fs.makeQualified(at(f"{staged}.json")), fs.makeQualified(published), chosen)
    return spark.createDataFrame(written, "section string, rows bigint")


def _files(spark, path: str):
    """The file system of ``path`` and the paths below it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: hadoop.Path(f"{path}/{name}")


def published_findings(spark, path: str, run_id: str) -> dict[str, DataFrame]:
    """The sections of a run as last published; empty if none were."""
    fs, at = _files(spark, path)
    name = f"published/run_id={run_id}.json"
    if not fs.exists(at(name)):
        return {}
    manifest = json.loads(spark.read.text(f"{path}/{name}", wholetext=True).first()[0])
    return {s: spark.read.json(f"{path}/{manifest['folder']}/{s}") for s in manifest["sections"]}


def write_variant_sheets(tables, path: str | None = None) -> DataFrame:
    """The variant sheets clustered by metric group, plus the overview; returns rows per group.

    Rows are range-partitioned on (group, rank): a reader of one group touches only the
    files whose statistics cover it, a very large group spans several files, and millions
    of small groups do not become millions of folders.
    """
    spark = tables["fields"].sparkSession
    path = path or stage_path(spark, "variant-sheets")
    fnd.variant_sheet(tables).repartitionByRange("group_id", "usage_rank").sortWithinPartitions("group_id", "usage_rank") \
        .write.mode("overwrite").parquet(f"{path}/groups")
    tables["multiplicity"].write.mode("overwrite").parquet(f"{path}/overview")
    return spark.read.parquet(f"{path}/groups").groupBy("group_id").agg(F.count(F.lit(1)).alias("rows"))


def report_tables(tables, framing: str = "full") -> DataFrame:
    """Content of the report as (section, item, text) rows; light framing has no stages or scores."""
    def rows(name, df, item, text):
        return df.select(F.lit(name).alias("section"), item.alias("item"), text.alias("text"))

    flags = label_join(flags_table(tables["outcomes"]), "flag_id")
    parts = [
        rows("definitions", tables["multiplicity"], F.col("label"), F.format_string(
            "defined %d ways across %d fields; %s", "definition_count", "variant_count", "dominance")),
        rows("flags", flags, F.col("flag_id"), F.format_string("%s: %d", "name", "count")),
        rows("security", fnd.security_exposure(tables), F.lit("user context"), F.format_string(
            "%d fields, %d workbooks", "user_context_fields", "affected_workbooks")),
        rows("retirement", fnd.retirement_case(tables), F.lit("workbooks"), F.format_string(
            "%d of %d without views", "zero_view_workbooks", "workbooks_total")),
        rows("governance", fnd.governance_posture(tables), F.col("mechanism"), F.col("status")),
        rows("coverage", fnd.coverage_gaps(tables["coverage"]), F.col("measure"), F.concat_ws(": ", "status", "reason")),
    ]
    if framing != "light":
        facets = tables["facets"]
        stage = F.try_element_at(F.create_map(*[F.lit(x) for kv in catalog.STAGES.items() for x in kv]), F.col("readiness"))
        reg = scoring.domain_register(facets, tables["domains"])
        parts += [
            rows("facets", label_join(facets, "id"), F.col("name"), F.format_string("%d (%s)", "score", "evidence")),
            rows("register", reg, F.col("domain"), F.concat_ws(
                " ", F.coalesce(F.col("readiness").cast("string"), F.lit("unscored")), stage, F.lit("bound by"), F.array_join("binding_constraints", ", "))),
        ]
    return reduce(DataFrame.unionByName, parts)
