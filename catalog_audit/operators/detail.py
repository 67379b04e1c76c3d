"""Variant detail and executability, redaction, secret scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.functions import formula as fx
from catalog_audit.functions.names import blank

REDACTED = "[redacted]"

# Credential shapes. Pattern name -> expression over free text. The header
# pattern covers any vendor's `X-<vendor>-Auth` header.
SECRET_PATTERNS = {
    "auth header": r"(?i)x-[a-z]+-auth",
    "bearer token": r"Bearer\s+[A-Za-z0-9._\-]{16,}",
    "password literal": r"(?i)(?:password|pwd)\s*=\s*[^;\s\"&]+",
    "secret-shaped key": (r'(?i)"(?:pat|password|passwd|pwd|secret|client_secret|access_token|refresh_token|private_key'
                          r'|api_?key|credentials?|x-[a-z]+-auth)"\s*:\s*"[^"]+?"'),
}


def variant_detail(tables) -> DataFrame:
    """Every grouped field with its formula, source and owner."""
    fields = tables["fields"].select(F.col("id").alias("field_id"), "datasource_id", "role", "data_type")
    sources = tables["datasources"].select(F.col("id").alias("datasource_id"), F.col("name").alias("datasource_name"),
                                           F.col("luid").alias("datasource_luid"), "owner")
    resolved = tables["resolved"].select("field_id", "resolved_formula", "resolution_status")
    return (tables["variants"].withColumnRenamed("name", "field_name").join(fields, "field_id", "left")
            .join(resolved, "field_id", "left").join(sources, "datasource_id", "left"))


def variant_class(tables) -> DataFrame:
    """Whether a variant can be evaluated, and if not why."""
    d = variant_detail(tables)
    status = F.coalesce("resolution_status", F.lit("no resolution"))
    role = F.col("role")
    unresolved = F.coalesce(F.col("resolution_status") != "resolved", F.lit(True))
    bound = fx.is_user_context(F.col("resolved_formula"))
    measure = F.lower(F.trim(F.coalesce(role, F.lit("")))) == "measure"
    kind = (F.when(unresolved, "unresolvable").when(bound, "context_bound")
            .when(blank(F.col("datasource_luid")) | ~measure, "not_comparable").otherwise("executable"))
    reason = (F.when(unresolved, F.concat(F.lit("unresolved: "), status))
              .when(bound, "reads the signed-in user")
              .when(blank(F.col("datasource_luid")), "source has no public id")
              .when(~measure, F.concat(F.lit("not a measure but "), F.when(blank(role), "unknown").otherwise(role))).otherwise(""))
    return d.withColumns({"executability_class": kind, "untested_reason": reason,
                          "native_aggregate": fx.is_native_aggregate(F.col("resolved_formula"))})


def redact_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mark the given columns removed where they hold something; NULL stays NULL."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(REDACTED)) for c in columns})


def secret_hits(text: Column, patterns: dict[str, str] = SECRET_PATTERNS) -> Column:
    """Names of the credential patterns found, sorted and comma-joined; never the value."""
    found = F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in sorted(patterns.items())])
    return F.array_join(F.array_compact(found), ", ")


def secret_scan(df: DataFrame, key: str, text: str, patterns: dict[str, str] = SECRET_PATTERNS) -> DataFrame:
    hits = secret_hits(F.col(text), patterns)
    return df.select(key, hits.alias("patterns")).filter("patterns <> ''")


def guarded(df: DataFrame, texts: list[str], build: str, patterns: dict[str, str] = SECRET_PATTERNS) -> DataFrame:
    """``df`` unchanged, failing the job that writes it if any text holds a credential."""
    blob = F.concat_ws("\n", *texts)
    hits = secret_hits(blob, patterns)
    message = F.concat(F.lit(f"not written, the {build} document holds what looks like a secret: "), hits)
    first = texts[0]
    return df.withColumn(first, F.when(F.coalesce(hits, F.lit("")) == "", F.col(first)).otherwise(
        F.raise_error(message).cast(df.schema[first].dataType)))
