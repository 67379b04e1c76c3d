"""Documents whose statements are put together from those of their sections."""

from __future__ import annotations

from catalog_audit.plans import catalog, reporting as rep
from catalog_audit.registry.base import ORACLES, add


def _of(name: str, alias: str = "x") -> str:
    return f"({ORACLES[name]}) {alias}"


def _counted(section: str, rows: str) -> str:
    return f"SELECT '{section}' AS section, (SELECT {rows})::BIGINT AS rows"


_SECTIONS = {
    "facets": f"count(*) FROM {_of('score_findings')} WHERE kind='facet'", "domains": f"count(*) FROM {_of('domain_register')}",
    "flags": f"count(DISTINCT flag_id) FROM {_of('evaluate_rules')} WHERE outcome='fired'", "coverage": f"count(*) FROM {_of('coverage_register')}",
    "definition_multiplicity": f"count(*) FROM {_of('definition_multiplicity')}", "variants": f"sum(rows) FROM {_of('write_variant_sheets')}",
    "security_exposure": f"count(*) FROM {_of('security_exposure')}", "security_fields": f"count(*) FROM {_of('user_context_fields')}",
    "retirement": f"count(*) FROM {_of('retirement_case')}", "governance_posture": f"count(*) FROM {_of('governance_posture')}", "meta": f"count(*) FROM {_of('run_meta')}",
}
add("write_findings", rep.write_findings, " UNION ALL ".join(_counted(k, v) for k, v in _SECTIONS.items()))


def _cases(code: str, names: dict, otherwise: str) -> str:
    quoted = [(str(k).replace("'", "''"), str(v).replace("'", "''")) for k, v in names.items()]
    return f"CASE {code}::VARCHAR " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quoted) + f" ELSE {otherwise} END"


_NAME = {k: n for k, (n, _) in catalog.LABELS.items()}
add("report_tables", rep.report_tables, f"""
SELECT 'definitions' AS section, label AS item, 'defined '||definition_count||' ways across '||variant_count||' fields; '||dominance AS text FROM {_of('definition_multiplicity')}
UNION ALL SELECT DISTINCT 'flags', flag_id, {_cases('flag_id', _NAME, 'flag_id')}||': '||count FROM {_of('evaluate_rules')} WHERE outcome='fired'
UNION ALL SELECT 'security', 'user context', user_context_fields||' fields, '||affected_workbooks||' workbooks' FROM {_of('security_exposure')}
UNION ALL SELECT 'retirement', 'workbooks', zero_view_workbooks||' of '||workbooks_total||' without views' FROM {_of('retirement_case')}
UNION ALL SELECT 'governance', mechanism, status FROM {_of('governance_posture')}
UNION ALL SELECT 'coverage', measure, status||': '||reason FROM {_of('coverage_gaps')}
UNION ALL SELECT 'facets', {_cases('id', _NAME, 'id')}, score||' ('||evidence||')' FROM {_of('scan_interview_reconcile')}
UNION ALL SELECT 'register', domain, concat_ws(' ', coalesce(readiness::VARCHAR,'unscored'), {_cases('readiness', catalog.STAGES, 'NULL')}, 'bound by', replace(binding, ',', ', ')) FROM {_of('domain_register')}""")
