"""Driver-sized inputs: interview answers and the rule catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INTERVIEW_SCHEMA = ("facet_id string, score int, evidence_note string, source_role string, source_name string, "
                    "captured_by string, confidence string")


def load_interview(spark: SparkSession, document: dict, captured_by: str = "specialist") -> DataFrame:
    """Interview responses as rows. A response without a facet is an error."""
    rows = []
    for r in document.get("responses") or []:
        if not r.get("facet"):
            raise ValueError(f"interview response missing `facet`: {r!r}")
        rows.append((r["facet"], r.get("score"), r.get("note", ""), r.get("source_role", ""),
                     r.get("source_name", ""), captured_by, r.get("confidence", "reported")))
    return spark.createDataFrame(rows, INTERVIEW_SCHEMA)


def read_document(path: str) -> dict:
    """A JSON or YAML configuration file."""
    with open(path, encoding="utf-8") as fh:
        if path.endswith(".json"):
            import json
            return json.load(fh)
        import yaml
        return yaml.safe_load(fh) or {}
