"""The rule, facet and label catalog. All of it is configuration that a user may replace.

Fixed values: identifiers, severities, thresholds, bands, caps, gates and labels below
are the shipped catalog.
"""

from __future__ import annotations

import copy

DIMENSIONS = ["data", "semantic", "action_surface", "governance", "operating_model", "adoption", "value"]
STAGES = {1: "Minimal", 2: "Emerging", 3: "Performing", 4: "Optimizing", 5: "Leading", 6: "Autonomous"}
DIMENSION_PREFIX = {
    "data": "data", "semantic": "semantic", "action": "action_surface", "governance": "governance",
    "operating": "operating_model", "adoption": "adoption", "value": "value",
}
EVERYONE = ["AllUsers"]
SENSITIVE = ["Write", "Delete", "ChangePermissions", "ProjectLeader"]


def _flag(severity, confidence, facet, rule, scope="estate", implemented=True, suppress=False, **threshold):
    return {"severity": severity, "confidence": confidence, "facet": facet, "rule": rule, "threshold": threshold,
            "scope": scope, "implemented": implemented, "suppress": suppress}


FLAGS = {
    "SEC-01": _flag("critical", "observed", "data.entitlement_at_source", "formula_contains_user_context", min_count=1),
    "SEC-02": _flag("warning", "observed", "governance.preventive", "permissive_grants",
                    everyone_grantees=EVERYONE, sensitive_capabilities=SENSITIVE, min_count=1),
    "SEM-01": _flag("warning", "derived", "semantic.singularity", "metric_group_variant_count", "domain", variant_count_gt=5),
    "SEM-02": _flag("critical", "derived", "semantic.singularity", "metric_group_no_dominant", "domain", min_usage_variants=2),
    "SEM-03": _flag("warning", "observed", "semantic.describability", "description_coverage", "domain", min_coverage=0.40),
    "SEM-04": _flag("warning", "observed", "semantic.exposure_shape", "datasource_field_count", max_field_count=300),
    "SEM-05": _flag("informational", "observed", "semantic.describability", "rest_metadata_description_divergence",
                    implemented=False),
    "DF-01": _flag("warning", "observed", "semantic.exposure_shape", "embedded_datasource_share", max_embedded_share=0.60),
    "DF-02": _flag("warning", "derived", "data.provenance", "upstream_table_fanout", max_sources_per_table=10),
    "DF-03": _flag("warning", "derived", "data.provenance", "published_on_published_depth", min_depth=2),
    "DF-04": _flag("warning", "observed", "data.provenance", "source_without_upstream", min_count=1),
    "DF-05": _flag("critical", "observed", "data.freshness", "failed_refresh_recent_view", viewed_within_days=30, min_count=1),
    "DF-06": _flag("warning", "observed", "data.freshness", "refresh_failure_rate", max_failure_rate=0.10),
    "DF-07": _flag("warning", "derived", "data.retained_grain", "custom_sql_grain_loss", suppress=True, min_count=1),
    "DF-08": _flag("warning", "derived", "data.provenance", "root_table_column_divergence",
                   min_count=1, flag_name_divergence=False),
    "GOV-01": _flag("warning", "observed", "governance.accountability", "source_owner_missing", min_count=1),
    "GOV-02": _flag("informational", "observed", "data.integrity", "no_data_quality_warnings"),
    "GOV-03": _flag("warning", "observed", "governance.detective", "certification_dqw_divergence",
                    min_count=1, require_elevated=False),
    "EST-01": _flag("informational", "observed", "adoption.reach", "zero_view_workbooks", min_count=1, idle_days=90),
    "EST-02": _flag("warning", "observed", "semantic.lifecycle", "business_rule_editors", implemented=False, suppress=True),
    "ADO-01": _flag("warning", "observed", "adoption.reach", "active_user_penetration", implemented=False, min_penetration=0.30),
    "ADO-02": _flag("informational", "observed", "adoption.reach", "view_concentration", coverage_fraction=0.80),
}

_THIRDS = {2: "< 0.4", 3: "0.4 - 0.7", 4: "> 0.7"}
FACETS = {
    "semantic.singularity": {
        "dimension": "semantic", "scored": True, "measure": "dominant_variant_share", "gates": [5],
        "bands": {2: "< 0.4", 3: ">= 0.4", 4: "> 0.7 and duplicates_deprecated == true",
                  5: "> 0.7 and duplicates_deprecated == true and ratified == true", 6: "estate_wide == true"}},
    "semantic.describability": {"dimension": "semantic", "scored": True, "measure": "description_coverage", "bands": _THIRDS, "gates": [3]},
    "semantic.exposure_shape": {"dimension": "semantic", "scored": True, "measure": "published_datasource_share", "bands": _THIRDS, "gates": [3]},
    "semantic.consensus": {"dimension": "semantic", "scored": False, "gates": [5]},
    "adoption.reach": {"dimension": "adoption", "scored": True, "measure": "content_activation",
                       "requires_coverage": ["usage_events"], "bands": _THIRDS, "gates": [3]},
    "adoption.decision_culture": {"dimension": "adoption", "scored": False, "gates": [4, 5]},
    "data.entitlement_at_source": {"dimension": "data", "scored": True, "base": 6, "gates": [5],
                                   "caps": [{"flag": "SEC-01", "when": "> 0", "max_score": 2}]},
    "data.provenance": {"dimension": "data", "scored": False, "gates": [3]},
    "action.reversibility": {"dimension": "action_surface", "scored": False, "gates": [5]},
    "operating.ownership": {"dimension": "operating_model", "scored": False, "gates": [5]},
    "value.attribution": {"dimension": "value", "scored": False, "gates": [4]},
}

_LADDER = {2: "> 0.3", 3: "> 0.6", 4: "> 0.8", 5: "> 0.95", 6: "== 1"}
ARCS = {
    "preventive": {"activates_at": 2},
    "detective": {"activates_at": 3},
    "corrective": {"activates_at": 5},
    "accountability": {"activates_at": 2, "measure": "ownership_coverage", "bands": _LADDER, "requires_coverage": ["datasources"]},
    "assurance": {"activates_at": 3, "measure": "certification_coverage", "bands": _LADDER, "requires_coverage": ["datasources"]},
}

DIMENSION_LABELS = {
    "semantic": "Semantic", "data": "Data", "governance": "Governance", "adoption": "Adoption",
    "action_surface": "Action surface", "operating_model": "Operating model", "value": "Value",
}

# code -> (name, what is measured)
LABELS = {
    "semantic.singularity": ("One formula per metric", "Share of metric groups in which a single formula draws most of the views."),
    "semantic.describability": ("Described fields", "Fields with a non-blank description, over all fields."),
    "semantic.exposure_shape": ("Published versus embedded", "References of workbooks to published sources, over their references to published and embedded ones."),
    "semantic.consensus": ("Interviewed agreement", "Interview score: do owners accept the same formulas?"),
    "semantic.lifecycle": ("Rule changes", "How edits to formulas are made; not measured by a scan."),
    "adoption.reach": ("Viewed content", "Workbooks with at least one view in the window, over all workbooks."),
    "adoption.decision_culture": ("Use in decisions", "Interview score: are decisions taken with these reports open?"),
    "data.entitlement_at_source": ("Row filters", "Starts full and is capped while formulas filter rows by the signed-in user."),
    "data.provenance": ("Lineage", "Edges from sources to tables: missing ones, long chains, and tables with many readers."),
    "data.freshness": ("Refresh outcome", "Failed against finished refresh jobs, and what was viewed after a failure."),
    "data.retained_grain": ("Query grain", "Custom queries that group, deduplicate or limit rows."),
    "data.integrity": ("Warnings set", "Count of quality warnings on the estate."),
    "action.reversibility": ("Undo", "Interview score: can an automatic action be taken back?"),
    "operating.ownership": ("Operating roles", "Interview score: is every asset somebody's job?"),
    "value.attribution": ("Attributed value", "Interview score: is benefit booked to the reports that brought it?"),
    "governance.accountability": ("Owned sources", "Sources whose owner name is not blank, over all sources."),
    "governance.assurance": ("Certified sources", "Sources marked certified, over all sources."),
    "governance.preventive": ("Before the fact", "Interview score, lowered by sensitive grants to everyone."),
    "governance.detective": ("While it happens", "Interview score, lowered by certified items under a live warning."),
    "governance.corrective": ("After the fact", "Interview score: does a finding get fixed?"),
    "SEC-01": ("User test in a formula", "Formulas whose own text calls a user or group function; what they refer to is not expanded."),
    "SEC-02": ("Sensitive grant to all", "Allow grants of a listed capability to a group that holds every user."),
    "SEM-01": ("Crowded metric group", "Groups with more members than the limit."),
    "SEM-02": ("Contested metric group", "Groups in which two or more formulas are viewed and none meets the share and ratio tests."),
    "SEM-03": ("Blank descriptions", "Description share under the limit."),
    "SEM-04": ("Very wide source", "Sources with more fields than the limit."),
    "SEM-05": ("Two descriptions", "Fields whose text differs between two feeds of the same object."),
    "DF-01": ("Mostly embedded", "Embedded references over all references, above the limit."),
    "DF-02": ("Table read many times", "Tables that more published sources read than the limit."),
    "DF-03": ("Source on source", "Longest chain of published sources, at or above the limit."),
    "DF-04": ("No table upstream", "Published sources whose lineage never reaches a table."),
    "DF-05": ("Viewed after a failure", "Sources whose latest refresh failed and whose workbooks were opened within the window."),
    "DF-06": ("Failing jobs", "Failed refresh jobs over all jobs, above the limit."),
    "DF-07": ("Coarser query", "Custom queries with a sign of lost rows."),
    "DF-08": ("Columns differ", "Sources on one table that type a shared column differently, or, if asked for, project other columns."),
    "GOV-01": ("Ownerless source", "Published sources whose owner name is blank."),
    "GOV-02": ("No warnings at all", "The warning feed was read and is empty."),
    "GOV-03": ("Certified under warning", "Certified sources with an active warning."),
    "EST-01": ("Never opened", "Workbooks with no view in the usage that was read."),
    "EST-02": ("Rule writers", "People who may edit formulas; not measured by a scan."),
    "ADO-01": ("Few active people", "Distinct viewers over licensed people, under the limit."),
    "ADO-02": ("Views in few places", "The smallest number of workbooks that reaches the given part of all views."),
}


def broad_grant_policy(rules: dict | None = None) -> tuple[list[str], list[str]]:
    """(groups that hold everyone, sensitive capabilities): the thresholds of SEC-02, which all measures share."""
    threshold = (rules or load_rules())["flags"]["SEC-02"].get("threshold") or {}
    return threshold.get("everyone_grantees", EVERYONE), threshold.get("sensitive_capabilities", SENSITIVE)


def load_rules(path: str | None = None) -> dict:
    """The catalog, overlaid with a JSON or YAML file of the same shape.

    A file may state a whole section entry or only the keys it changes, so a threshold is
    retuned without touching code.
    """
    rules = copy.deepcopy({"flags": FLAGS, "facets": FACETS, "governance_arcs": ARCS})
    if path:
        from catalog_audit.sources.config_inputs import read_document
        for section, entries in read_document(path).items():
            if section not in rules:
                continue
            for key, spec in (entries or {}).items():
                base = rules[section].setdefault(key, {})
                for field, value in spec.items():
                    if field == "threshold":
                        base.setdefault("threshold", {}).update(value or {})
                    else:
                        base[field] = value
    return rules
