"""Rules, scoring, findings, calibration and disagreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_audit.operators import detail, disagreement as dis
from catalog_audit.oracle.ctes import USER_CTX
from catalog_audit.plans import catalog, findings as fnd, reporting as rep, rules, scoring
from catalog_audit.registry.base import add
from catalog_audit.registry.formulas import _DETAIL
from catalog_audit.registry.measures import _FAILED, _FANOUT, GROUP_BY

_RULE_SQL = {
    "SEC-01": f"SELECT count(*)>=1 AS fires, count(*) AS count FROM e_calc WHERE regexp_matches(formula, '{USER_CTX}')",
    "SEC-02": """SELECT count(*)>=1 AS fires, count(*) AS count FROM e_permissions WHERE mode='Allow' AND grantee_id='AllUsers'
        AND capability IN ('Write','Delete','ChangePermissions','ProjectLeader')""",
    "SEM-01": "SELECT count(DISTINCT label)>0 AS fires, count(DISTINCT label) AS count FROM groups WHERE variant_count>5",
    "SEM-02": """SELECT count(DISTINCT label)>0 AS fires, count(DISTINCT label) AS count FROM (SELECT group_id, label FROM variants
        GROUP BY 1,2 HAVING NOT bool_or(is_dominant) AND count(*) FILTER (views>0)>=2)""",
    "SEM-03": """SELECT d::DOUBLE/t<0.4 AS fires, t-d AS count FROM (SELECT count(*) AS t,
        count(*) FILTER (trim(coalesce(description,''))<>'') AS d FROM e_fields)""",
    "SEM-04": "SELECT count(*)>0 AS fires, count(*) AS count FROM (SELECT 1 FROM e_fields GROUP BY datasource_id HAVING count(*)>300)",
    "DF-01": """SELECT e::DOUBLE/(e+p)>0.6 AS fires, e AS count FROM (SELECT count(*) FILTER (upstream_type='embedded_datasource') AS e,
        count(*) FILTER (upstream_type='datasource') AS p FROM e_lineage WHERE downstream_type='workbook')""",
    "DF-02": "SELECT coalesce(max(sources),0)>10 AS fires, coalesce(max(sources),0) AS count FROM fanout",
    "DF-03": "SELECT max(depth)>=2 AS fires, max(depth)::BIGINT AS count FROM up_chain",
    "DF-04": """SELECT count(*)>=1 AS fires, count(*) AS count FROM e_datasources ANTI JOIN (SELECT downstream_id AS id FROM e_lineage
        WHERE downstream_type='datasource') USING (id)""",
    "DF-05": "SELECT count(DISTINCT datasource_id)>=1 AS fires, count(DISTINCT datasource_id) AS count FROM failed_views WHERE last_viewed_days_ago<=30",
    "DF-06": "SELECT f::DOUBLE/t>0.1 AS fires, f AS count FROM (SELECT count(*) AS t, count(*) FILTER (status='Failed') AS f FROM e_refresh)",
    "DF-07": f"SELECT count(*)>=1 AS fires, count(*) AS count FROM e_custom_sql WHERE regexp_matches(query, '{GROUP_BY}')",
    "DF-08": """SELECT count(*)>=1 AS fires, count(*) AS count FROM (SELECT 1 FROM e_projection WHERE table_key IN (SELECT table_key
        FROM e_projection GROUP BY 1 HAVING count(DISTINCT datasource_id)>=2) GROUP BY table_key, column_name
        HAVING count(DISTINCT field_data_type)>=2)""",
    "GOV-01": "SELECT count(*)>=1 AS fires, count(*) AS count FROM e_datasources WHERE trim(coalesce(owner,''))=''",
    "GOV-02": "SELECT count(*)=0 AS fires, count(*) AS count FROM e_dqw",
    "GOV-03": """SELECT count(DISTINCT d.id)>=1 AS fires, count(DISTINCT d.id) AS count FROM e_dqw w JOIN e_datasources d
        ON d.luid=w.asset_luid WHERE w.is_active AND d.is_certified""",
    "EST-01": """SELECT count(*)>=1 AS fires, count(*) AS count FROM e_workbooks w LEFT JOIN usage ON workbook_id=w.id
        WHERE coalesce(event_count,0)=0""",
    "ADO-02": """SELECT coalesce(any_value(t),0)>0 AS fires, count(*) FILTER (cum-v < 0.8::DOUBLE*t) AS count FROM (SELECT event_count AS v,
        sum(event_count) OVER (ORDER BY event_count DESC, workbook_id ROWS UNBOUNDED PRECEDING) AS cum, sum(event_count) OVER () AS t FROM usage)""",
}
_EXTRA = _FANOUT | _FAILED | {"up_chain": """SELECT downstream_id AS s, upstream_id AS node, 1 AS depth FROM e_lineage
    WHERE downstream_type='datasource' AND upstream_type='datasource' UNION ALL SELECT c.s, l.upstream_id, c.depth+1 FROM up_chain c
    JOIN e_lineage l ON l.downstream_id=c.node AND l.downstream_type='datasource' AND l.upstream_type='datasource' WHERE c.depth<50"""}
for _flag, _sql in _RULE_SQL.items():
    add(_flag, lambda e, f=_flag: rules.rule_result(e, f).select("flag_id", "fires", "count"),
        f"SELECT '{_flag}' AS flag_id, fires, count FROM ({_sql})", _EXTRA)

_ALL = " UNION ALL ".join(f"SELECT '{f}' AS flag_id, fires, count FROM ({s})" for f, s in _RULE_SQL.items())
_META = ", ".join(f"('{f}','{s['severity']}','{s['facet']}','{s['scope']}',{str(s['implemented']).lower()},{str(s['suppress']).lower()})"
                  for f, s in catalog.FLAGS.items())
_OUT = _EXTRA | {"all_rules": _ALL, "outcomes": f"""SELECT k.*, fires, count, CASE WHEN NOT implemented THEN 'unimplemented' WHEN suppress THEN 'suppressed'
    WHEN fires THEN 'fired' ELSE 'silent' END AS outcome FROM (VALUES {_META}) k(flag_id,severity,facet,scope,implemented,suppress)
    LEFT JOIN all_rules USING (flag_id)"""}
_DOMAINS = ["revenue_ops", "all"]
add("evaluate_rules", lambda e: rules.evaluate_rules(e, domains=_DOMAINS).select("flag_id", "severity", "facet", "domain", "outcome", "fires", "count"),
    """SELECT flag_id, severity, facet, unnest(CASE WHEN outcome='fired' AND scope='domain' THEN ['revenue_ops','all'] ELSE [''] END) AS domain,
       outcome, fires, count FROM outcomes""", _OUT)
add("rule_log", lambda e: rules.rule_log(e["outcomes"]),
    """SELECT flag_id, outcome, CASE outcome WHEN 'fired' THEN format('FLAG {} [{}] count={} facet={}', flag_id, severity, count, facet)
       WHEN 'suppressed' THEN format('SUPPRESSED {} (would_fire={}, count={})', flag_id, fires, count)
       WHEN 'unimplemented' THEN 'UNIMPLEMENTED '||flag_id ELSE format('SILENT {} count={}', flag_id, count) END AS line FROM outcomes""", _OUT)
add("flag_evidence", rules.flag_evidence,
    f"""SELECT 'SEC-01' AS flag_id, id AS item, NULL::BIGINT AS value FROM e_calc WHERE regexp_matches(formula, '{USER_CTX}')
        UNION ALL SELECT 'SEC-02', object_type||'/'||object_id||'/'||grantee_id||'/'||capability, NULL FROM e_permissions WHERE mode='Allow' AND grantee_id='AllUsers'
        AND capability IN ('Write','Delete','ChangePermissions','ProjectLeader') UNION ALL SELECT 'SEM-01', group_id, variant_count FROM groups WHERE variant_count>5
        UNION ALL SELECT DISTINCT 'SEM-02', label, NULL::BIGINT FROM (SELECT group_id, label FROM variants GROUP BY 1,2 HAVING NOT bool_or(is_dominant) AND count(*) FILTER (views>0)>=2)
        UNION ALL SELECT 'SEM-04', datasource_id, count(*) FROM e_fields GROUP BY datasource_id HAVING count(*)>300 UNION ALL SELECT 'DF-02', upstream_id, sources FROM fanout WHERE sources>10
        UNION ALL SELECT 'DF-04', id, NULL FROM e_datasources ANTI JOIN (SELECT downstream_id AS id FROM e_lineage WHERE downstream_type='datasource') USING (id)
        UNION ALL SELECT DISTINCT 'DF-05', datasource_id, NULL::BIGINT FROM failed_views WHERE last_viewed_days_ago<=30
        UNION ALL SELECT 'DF-08', 'types:'||table_key||'/'||column_name||':'||names, types FROM evidence_cols WHERE types>=2
        UNION ALL SELECT 'DF-08', 'column:'||table_key||'/'||column_name, sources FROM evidence_cols WHERE sources<table_sources
        UNION ALL SELECT 'GOV-01', id, NULL FROM e_datasources WHERE trim(coalesce(owner,''))=''
        UNION ALL SELECT 'GOV-03', d.id||'/'||w.id, NULL FROM e_dqw w JOIN e_datasources d ON d.luid=w.asset_luid WHERE w.is_active AND d.is_certified
        UNION ALL SELECT 'EST-01', id, NULL FROM e_workbooks w LEFT JOIN usage ON workbook_id=w.id WHERE coalesce(event_count,0)=0""", _EXTRA | {"evidence_cols": """SELECT table_key, column_name, count(DISTINCT field_data_type) AS types, string_agg(DISTINCT field_data_type, ',' ORDER BY field_data_type) AS names,
        count(DISTINCT datasource_id) AS sources, any_value(table_sources) AS table_sources FROM e_projection JOIN (SELECT table_key, count(DISTINCT datasource_id) AS table_sources
        FROM e_projection GROUP BY 1 HAVING count(DISTINCT datasource_id)>=2) USING (table_key) GROUP BY 1,2"""})


def _q(text):
    return "'" + text.replace("'", "''") + "'"


_LABELS = {"labels_k": "SELECT * FROM (VALUES " + ", ".join(f"({_q(k)},{_q(n)})" for k, (n, _) in catalog.LABELS.items()) + ") k(code,name)"}
_HUMAN = "upper(trim(replace(replace({0},'.',' · '),'_',' '))[1]) || lower(trim(replace(replace({0},'.',' · '),'_',' '))[2:])"
add("label_join", lambda e: rep.label_join(e["outcomes"].select("flag_id", "facet", "outcome"), "flag_id").select("flag_id", "facet", "outcome", "name", "facet_name"),
    """SELECT flag_id, facet, outcome, a.name, b.name AS facet_name FROM outcomes JOIN labels_k a ON a.code=flag_id JOIN labels_k b ON b.code=facet""", _OUT | _LABELS)
add("label_join_codes", lambda e: rep.label_join(e["lineage"].select("upstream_type").distinct(), "upstream_type").select("upstream_type", "name"),
    f"""SELECT upstream_type, {_HUMAN.format('upstream_type')} AS name FROM (SELECT DISTINCT upstream_type FROM e_lineage)""")
add("load_rules", lambda e: rules.rule_catalog(e.spark).join(e["outcomes"].select("flag_id", "outcome"), "flag_id").select(
        "flag_id", "severity", "facet", "scope", "implemented", "suppress", "outcome"),
    "SELECT flag_id, severity, facet, scope, implemented, suppress, outcome FROM outcomes", _OUT)
add("evidence_json", lambda e: rules.rule_result(e, "DF-06").unionByName(rules.rule_result(e, "SEM-03")).select("flag_id", "evidence"),
    """SELECT 'DF-06' AS flag_id, json_object('failed', f, 'failure_rate', round(f::DOUBLE/t,4), 'threshold', 0.1::DOUBLE, 'total', t)::VARCHAR AS evidence FROM
       (SELECT count(*) AS t, count(*) FILTER (status='Failed') AS f FROM e_refresh) UNION ALL SELECT 'SEM-03',
       json_object('coverage', round(d::DOUBLE/t,4), 'described', d, 'threshold', 0.4::DOUBLE, 'total', t)::VARCHAR FROM (SELECT count(*) AS t,
       count(*) FILTER (trim(coalesce(description,''))<>'') AS d FROM e_fields)""")

# -- scoring ---------------------------------------------------------------------------------
_BANDS = "CASE WHEN v>0.7 THEN 4 WHEN v>=0.4 AND v<=0.7 THEN 3 WHEN v<0.4 THEN 2 ELSE 1 END"
_LADDER = "CASE WHEN v=1 THEN 6 WHEN v>0.95 THEN 5 WHEN v>0.8 THEN 4 WHEN v>0.6 THEN 3 WHEN v>0.3 THEN 2 ELSE 1 END"
_SCORES = _EXTRA | {
    "banded": f"""SELECT 'semantic.singularity' AS id, 'semantic' AS dimension, CASE WHEN v>=0.4 THEN 3 WHEN v<0.4 THEN 2 ELSE 1 END AS score, v AS value, [5] AS gates
      FROM (SELECT (count(*) FILTER (w))::DOUBLE/count(*) AS v FROM (SELECT bool_or(is_dominant) AS w FROM variants GROUP BY group_id))
      UNION ALL SELECT 'semantic.describability','semantic',{_BANDS}, v, [3] FROM (SELECT (count(*) FILTER (trim(coalesce(description,''))<>''))::DOUBLE/count(*) AS v FROM e_fields)
      UNION ALL SELECT 'semantic.exposure_shape','semantic',{_BANDS}, v, [3] FROM (SELECT (count(*) FILTER (upstream_type='datasource'))::DOUBLE/count(*) AS v FROM e_lineage WHERE downstream_type='workbook')
      UNION ALL SELECT 'adoption.reach','adoption',{_BANDS}, v, [3] FROM (SELECT (count(*) FILTER (coalesce(event_count,0)<>0))::DOUBLE/count(*) AS v FROM e_workbooks w LEFT JOIN usage ON workbook_id=w.id)""",
    "capped": f"SELECT 'data.entitlement_at_source' AS id, 'data' AS dimension, CASE WHEN count(*)>0 THEN 2 ELSE 6 END AS score, NULL::DOUBLE AS value, [5] AS gates FROM e_calc WHERE regexp_matches(formula, '{USER_CTX}')",
    "arcs": f"""SELECT 'governance.accountability' AS id, 'governance' AS dimension, {_LADDER} AS score, v AS value, []::INT[] AS gates FROM (SELECT (count(*) FILTER (trim(coalesce(owner,''))<>''))::DOUBLE/count(*) AS v FROM e_datasources)
      UNION ALL SELECT 'governance.assurance','governance',{_LADDER}, v, []::INT[] FROM (SELECT (count(*) FILTER (is_certified))::DOUBLE/count(*) AS v FROM e_datasources)""",
    "said": """SELECT * FROM (VALUES ('governance.preventive',4,'governance',[]::INT[]),('governance.detective',4,'governance',[]::INT[]),('governance.corrective',3,'governance',[]::INT[]),
      ('semantic.singularity',5,'semantic',[5]),('semantic.consensus',2,'semantic',[5])) k(id,score,dimension,gates)""",
    "scanned": "SELECT * FROM banded UNION ALL SELECT * FROM capped UNION ALL SELECT * FROM arcs",
    "facets": """SELECT id, dimension, score, 'observed' AS evidence, value, gates FROM scanned UNION ALL
      SELECT id, dimension, score, 'reported', NULL, gates FROM said WHERE id NOT IN (SELECT id FROM scanned)""",
    "targets": "SELECT * FROM (VALUES ('revenue_ops',5),('all',3)) k(domain,target_stage)",
    "rolled": """SELECT domain, target_stage, dimension, min(score) AS score, string_agg(id, ',' ORDER BY id) FILTER (score=low) AS facets FROM
      (SELECT *, min(score) OVER (PARTITION BY domain, dimension) AS low FROM targets JOIN facets ON list_contains(gates, target_stage) WHERE dimension<>'governance') GROUP BY 1,2,3""",
    "arc_read": """SELECT a.arc, a.starts, f.score FROM (VALUES ('preventive',2),('detective',3),('corrective',5),('accountability',2),('assurance',3)) a(arc,starts)
      LEFT JOIN facets f ON f.id='governance.'||a.arc""",
    "governed": """SELECT domain, target_stage, CASE WHEN EXISTS (SELECT 1 FROM arc_read WHERE starts<=target_stage AND score IS NULL) THEN NULL ELSE
      coalesce((SELECT max(stage) FROM (VALUES (2),(3),(4),(5),(6)) s(stage) WHERE NOT EXISTS (SELECT 1 FROM arc_read WHERE starts<=stage AND coalesce(score,0)<stage)),1) END AS score FROM targets""",
    "gov_bound": """SELECT g.*, coalesce((SELECT string_agg('governance.'||arc, ',' ORDER BY arc) FROM arc_read WHERE g.score<6 AND starts<=g.score+1 AND coalesce(score,0)<g.score+1),'') AS facets FROM governed g""",
    "dims": "SELECT domain, target_stage, dimension, score, facets FROM rolled UNION ALL SELECT domain, target_stage, 'governance', score, facets FROM gov_bound WHERE score IS NOT NULL",
    "bound_facets": """SELECT domain, unnest(string_split(facets, ',')) AS fid FROM (SELECT *, min(score) OVER (PARTITION BY domain) AS low FROM dims) WHERE score=low AND facets<>''""",
}
add("facet_threshold_scores", lambda e: scoring.facet_threshold_scores(e).select("id", "score", "value"), "SELECT id, score, value FROM banded", _SCORES)
add("facet_capped_scores", lambda e: scoring.facet_capped_scores(e).select("id", "score"), "SELECT id, score FROM capped", _SCORES)
add("arc_scores", lambda e: scoring.arc_scores(e).select("id", "score", "value"), "SELECT id, score, value FROM arcs", _SCORES)
add("scan_interview_reconcile", lambda e: e["facets"].select("id", "dimension", "score", "evidence"),
    "SELECT id, dimension, score, evidence FROM facets", _SCORES)
add("INT-01", lambda e: scoring.interview_conflicts(scoring.scan_facets(e), e["interview"]).select("flag_id", "facet", "count", "scan_score", "interview_score"),
    "SELECT 'INT-01' AS flag_id, s.id AS facet, 1::BIGINT AS count, s.score AS scan_score, i.score AS interview_score FROM said i JOIN scanned s USING (id) WHERE i.score>s.score", _SCORES)
add("dimension_rollup", lambda e: scoring.dimension_rollup(e["facets"], e["domains"]).select("domain", "dimension", "score", F.array_join("facets", ",").alias("facets")),
    "SELECT domain, dimension, score, facets FROM rolled", _SCORES)
add("governance_closure", lambda e: scoring.governance_rollup(e["facets"], e["domains"]).select("domain", "score"),
    "SELECT domain, score FROM governed", _SCORES)
add("governance_binding", lambda e: scoring.governance_rollup(e["facets"], e["domains"]).select("domain", F.array_join("facets", ",").alias("facets")),
    "SELECT domain, facets FROM gov_bound", _SCORES)
_DIMS = "['action_surface','adoption','data','governance','operating_model','semantic','value']"
add("unscored_dimensions", lambda e: scoring.domain_register(e["facets"], e["domains"]).select("domain", F.array_join("unscored_dimensions", ",").alias("unscored")),
    f"""SELECT t.domain, array_to_string(list_filter({_DIMS}, lambda d: NOT list_contains(list(dimension), d)), ',') AS unscored
        FROM targets t JOIN dims USING (domain) GROUP BY t.domain""", _SCORES)
add("domain_register", lambda e: scoring.domain_register(e["facets"], e["domains"]).select(
        "domain", "target_stage", "readiness", "gap", F.array_join("binding_constraints", ",").alias("binding"), "confidence"),
    """SELECT t.domain, t.target_stage, min(score) AS readiness, t.target_stage-min(score) AS gap,
       coalesce((SELECT string_agg(DISTINCT fid, ',' ORDER BY fid) FROM bound_facets b WHERE b.domain=t.domain),'') AS binding,
       CASE WHEN EXISTS (SELECT 1 FROM bound_facets b JOIN facets f ON f.id=b.fid WHERE b.domain=t.domain AND f.evidence='reported') THEN 'reported'
       WHEN EXISTS (SELECT 1 FROM facets WHERE evidence='reported') THEN 'mixed' ELSE 'observed' END AS confidence
       FROM targets t JOIN dims USING (domain) GROUP BY t.domain, t.target_stage""", _SCORES)
add("band_holds", lambda e: rep.band_table(e),
    f"""SELECT datasource_id, v AS coverage, {_BANDS} AS score FROM (SELECT datasource_id, (count(*) FILTER (trim(coalesce(description,''))<>''))::DOUBLE/count(*) AS v
        FROM e_fields GROUP BY 1)""")

# -- findings -----------------------------------------------------------------------------------
add("definition_multiplicity", lambda e: e["multiplicity"],
    """SELECT group_id, label, method, confidence, variant_count, definition_count, group_views, cover80::BIGINT AS cover80, disagreeing, workbooks_affected, dominance FROM multiplicity""")
add("multiplicity_totals", fnd.multiplicity_totals,
    """SELECT count(*) AS groups, count(*) FILTER (definition_count>=2) AS multiplicity_groups, count(*) FILTER (dominance='contested') AS contested_groups FROM multiplicity""")
_BACK = {"backlog": """SELECT *, row_number() OVER (ORDER BY CASE dominance WHEN 'contested' THEN 0 WHEN 'unmeasured' THEN 1 WHEN 'dominant' THEN 2 ELSE 3 END,
    disagreeing DESC, definition_count DESC, variant_count DESC, label, group_id) AS position FROM multiplicity"""}
add("adjudication_backlog", lambda e: fnd.adjudication_backlog(e).select("group_id", "label", "dominance", "position"),
    "SELECT group_id, label, dominance, position::BIGINT AS position FROM backlog", _BACK)
add("security_exposure", fnd.security_exposure,
    f"""SELECT count(*) AS user_context_fields, (SELECT count(*) FROM e_workbooks WHERE id IN (SELECT workbook_id FROM e_field_usage WHERE field_id IN
        (SELECT id FROM e_calc WHERE regexp_matches(formula, '{USER_CTX}')))) AS affected_workbooks, CASE WHEN count(*)>=1 THEN 'critical' END AS severity
        FROM e_calc WHERE regexp_matches(formula, '{USER_CTX}')""")
add("retirement_case", fnd.retirement_case,
    """SELECT (SELECT count(*) FROM e_workbooks) AS workbooks_total, true AS usage_measured, (SELECT count(*) FILTER (sources>1) FROM fanout) AS redundant_source_tables,
       (SELECT coalesce(max(sources),0) FROM fanout) AS max_sources_per_table,
       (SELECT count(*) FROM e_workbooks w LEFT JOIN usage ON workbook_id=w.id WHERE coalesce(event_count,0)=0) AS zero_view_workbooks,
       coalesce(any_value(t),0)::BIGINT AS total_views, count(*) FILTER (cum-v < 0.7::DOUBLE*t) AS workbooks_covering_70pct_views,
       count(*) FILTER (cum-v < 0.8::DOUBLE*t) AS workbooks_covering_80pct_views FROM (SELECT event_count AS v,
       sum(event_count) OVER (ORDER BY event_count DESC, workbook_id ROWS UNBOUNDED PRECEDING) AS cum, sum(event_count) OVER () AS t FROM usage)""", _FANOUT)
add("governance_posture", fnd.governance_posture,
    """SELECT 'preventive' AS arc, 'permission_grants' AS mechanism, true AS measured, CASE WHEN count(*)>0 THEN 'in_use' ELSE 'not_exercised' END AS status,
       count(*) AS exercised, count(DISTINCT object_type||':'||object_id) AS recorded FROM e_permissions
       UNION ALL SELECT 'preventive','explicit_deny',true,CASE WHEN count(*) FILTER (mode='Deny')>0 THEN 'in_use' ELSE 'not_exercised' END, count(*) FILTER (mode='Deny'), count(*) FROM e_permissions
       UNION ALL SELECT 'detective','certification',true,CASE WHEN count(*) FILTER (is_certified)>0 THEN 'in_use' ELSE 'not_exercised' END, count(*) FILTER (is_certified), count(*) FROM e_datasources
       UNION ALL SELECT 'detective','data_quality_warnings',true,CASE WHEN count(*)>0 THEN 'in_use' ELSE 'not_exercised' END, count(*), count(*) FILTER (is_active) FROM e_dqw""")
add("posture_examples", fnd.posture_examples,
    """SELECT arc, kind, item, total FROM (SELECT *, count(*) OVER (PARTITION BY arc, kind) AS total FROM (
       SELECT 'preventive' AS arc, CASE WHEN grantee_id='AllUsers' THEN 'bad' ELSE 'good' END AS kind, object_type||'/'||object_id||'/'||grantee_id||'/'||capability AS item
       FROM e_permissions WHERE mode='Allow' AND capability IN ('Write','Delete','ChangePermissions','ProjectLeader')
       UNION ALL SELECT 'detective', CASE WHEN EXISTS (SELECT 1 FROM e_dqw w WHERE w.asset_luid=d.luid AND w.is_active) THEN 'bad' ELSE 'good' END, d.id
       FROM e_datasources d WHERE d.is_certified))""")
add("run_meta", lambda e: fnd.run_meta(e, e.run_id),
    """SELECT 'run_current' AS run_id, '1.0' AS tool_version, 'local' AS grouping_mode, 'events' AS adoption_source,
       strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS usage_from, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS usage_to, count(*) AS usage_events FROM events""")

# -- calibration ---------------------------------------------------------------------------------
def _five(source, v, r=False):
    w = (lambda x: f"round({x}, 6)") if r else (lambda x: x)
    return (f"count({v}) AS n, {w(f'min({v})::DOUBLE')} AS min, {w(f'quantile_cont({v}, 0.25)::DOUBLE')} AS p25, {w(f'quantile_cont({v}, 0.5)::DOUBLE')} AS median, "
            f"{w(f'quantile_cont({v}, 0.75)::DOUBLE')} AS p75, {w(f'max({v})::DOUBLE')} AS max, round(sum({v})::DOUBLE/count({v}), 6) AS mean")


_LEAD = {"leaders": """SELECT group_id, f::DOUBLE/t AS share, CASE WHEN s>0 THEN f::DOUBLE/s END AS ratio, cover80 FROM (SELECT group_id,
    max(views) FILTER (usage_rank=1) AS f, max(views) FILTER (usage_rank=2) AS s, sum(views) AS t FROM variants GROUP BY 1) JOIN
    (SELECT group_id, count(*) FILTER (cum-views < 0.8::DOUBLE*gt) AS cover80 FROM (SELECT group_id, views, sum(views) OVER (PARTITION BY group_id) AS gt,
     sum(views) OVER (PARTITION BY group_id ORDER BY usage_rank ROWS UNBOUNDED PRECEDING) AS cum FROM variants) GROUP BY 1) USING (group_id) WHERE t>0"""}
add("calibrate_variant_count", lambda e: fnd.calibrate_variant_count(e).withColumn("mean", F.round("mean", 6)),
    f"SELECT {_five('groups', 'variant_count')}, count(*) FILTER (variant_count>5) AS over_threshold FROM groups")
add("calibrate_dominance", fnd.calibrate_dominance,
    " UNION ALL ".join(f"SELECT '{c}' AS measure, {_five('leaders', c, True)} FROM leaders" for c in ("share", "ratio", "cover80")), _LEAD)
add("calibrate_dominance_buckets", fnd.calibrate_dominance_buckets,
    """SELECT 'share' AS measure, b AS bucket, label, count(share) AS n FROM (VALUES (0,'≤ 0.4'),(1,'0.4–0.6'),(2,'0.6–0.8'),(3,'> 0.8')) k(b,label) LEFT JOIN leaders
       ON b=CASE WHEN share<=0.4 THEN 0 WHEN share<=0.6 THEN 1 WHEN share<=0.8 THEN 2 ELSE 3 END GROUP BY 2,3 UNION ALL
       SELECT 'ratio', b, label, count(ratio) FROM (VALUES (0,'≤ 1.5'),(1,'1.5–2'),(2,'2–3'),(3,'> 3')) k(b,label) LEFT JOIN leaders
       ON b=CASE WHEN ratio<=1.5 THEN 0 WHEN ratio<=2 THEN 1 WHEN ratio<=3 THEN 2 ELSE 3 END GROUP BY 2,3""", _LEAD)
add("calibrate_freshness", fnd.calibrate_freshness,
    f"""SELECT (SELECT count(*) FROM e_refresh) AS jobs_total, (SELECT count(*) FILTER (status='Failed') FROM e_refresh) AS jobs_failed,
        (SELECT (count(*) FILTER (status='Failed'))::DOUBLE/count(*) FROM e_refresh) AS failure_rate, {_five('failed_views', 'last_viewed_days_ago')},
        count(*) FILTER (last_viewed_days_ago<=30) AS within_window FROM failed_views""", _FAILED)
add("calibrate_permissions", fnd.calibrate_permissions,
    """SELECT capability, count(*) AS permissive_grants, count(DISTINCT object_type||':'||object_id) AS exposed_objects FROM e_permissions WHERE mode='Allow'
       AND grantee_id='AllUsers' AND capability IN ('Write','Delete','ChangePermissions','ProjectLeader') GROUP BY GROUPING SETS ((capability),())""")

# -- disagreement over the facts --------------------------------------------------------------------
def _money(expr):
    return F.sum(expr.cast("decimal(18,4)"))


def fact_measures():
    """Definition key -> aggregate over the fact table."""
    p, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return {
        "funcs=sum|ratio=0|cols=sales": _money(p),
        "funcs=sum|ratio=0|cols=amount,cost": _money(p * (1 - d)) - _money(p * t),
        "funcs=countd|ratio=0|cols=customer id": F.count_distinct("l_orderkey"),
        "funcs=sum|ratio=1|cols=cost,sales": F.try_divide((_money(p) - _money(p * t)).cast("double"), _money(p).cast("double")),
        "funcs=sum|ratio=0|cols=amount,region": _money(F.when(F.col("l_returnflag") == "R", p * (1 - d))),
    }


def _values(e):
    month = (F.col("l_shipdate") >= "1995-03-01") & (F.col("l_shipdate") < "1995-04-01")
    source = F.concat(F.lit("ds_"), F.col("l_suppkey").cast("string"))
    return dis.definition_values(e.raw("lineitem"), source, month, fact_measures())


def _executed(e):
    return dis.material_disagreement(e, e["multiplicity"], _values(e), "1995-03")


_M = lambda x: f"sum(CAST({x} AS DECIMAL(18,4)))"
_VAL = _DETAIL | _BACK | {
    "month": "SELECT * FROM lineitem WHERE l_shipdate >= DATE '1995-03-01' AND l_shipdate < DATE '1995-04-01'",
    "wide": f"""SELECT 'ds_'||l_suppkey AS datasource_id, {_M('l_extendedprice')}::DOUBLE AS a,
        ({_M('l_extendedprice*(1-l_discount)')} - {_M('l_extendedprice*l_tax')})::DOUBLE AS b, count(DISTINCT l_orderkey)::DOUBLE AS c,
        ({_M('l_extendedprice')} - {_M('l_extendedprice*l_tax')})::DOUBLE / {_M('l_extendedprice')}::DOUBLE AS d,
        {_M("CASE WHEN l_returnflag='R' THEN l_extendedprice*(1-l_discount) END")}::DOUBLE AS e FROM month GROUP BY 1""",
    "vals": """SELECT datasource_id, 'funcs=sum|ratio=0|cols=sales' AS definition_key, a AS value FROM wide UNION ALL SELECT datasource_id, 'funcs=sum|ratio=0|cols=amount,cost', b FROM wide
        UNION ALL SELECT datasource_id, 'funcs=countd|ratio=0|cols=customer id', c FROM wide UNION ALL SELECT datasource_id, 'funcs=sum|ratio=1|cols=cost,sales', d FROM wide
        UNION ALL SELECT datasource_id, 'funcs=sum|ratio=0|cols=amount,region', e FROM wide""",
    "budget": """SELECT * FROM (SELECT b.group_id, position, coalesce(x.n,0) AS n_exec, sum(coalesce(x.n,0)) OVER (ORDER BY position) AS upto FROM backlog b LEFT JOIN
        (SELECT group_id, count(*) AS n FROM classed WHERE executability_class='executable' GROUP BY 1) x USING (group_id))""",
    "ran": """SELECT c.*, b.position, CASE WHEN executability_class='executable' THEN v.value END AS value FROM classed c JOIN budget b USING (group_id) LEFT JOIN vals v
        ON v.datasource_id=c.datasource_id AND v.definition_key=c.definition_key""",
    "refs": """SELECT group_id, field_id AS ref_field, value AS ref_value FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY value IS NULL, NOT is_dominant, usage_rank, field_id) AS rn
        FROM ran WHERE executability_class='executable') WHERE rn=1""",
    "gaps": """SELECT r.*, f.ref_field, coalesce(r.field_id=f.ref_field, false) AS is_reference, abs(value-ref_value) AS abs_diff, ref_value,
        CASE WHEN ref_value<>0 THEN abs(value-ref_value)/abs(ref_value) WHEN abs(value-ref_value)=0 THEN 0.0 END AS rel_diff FROM ran r LEFT JOIN refs f USING (group_id)""",
}
add("definition_values", lambda e: _values(e).withColumn("value", F.round("value", 4)), "SELECT datasource_id, definition_key, round(value, 4) AS value FROM vals", _VAL)
def _budget(e, **limits):
    runnable = detail.variant_class(e).filter("executability_class = 'executable'").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_exec"))
    return dis.budget_prefix(e["multiplicity"], runnable, **limits)


add("budget_prefix", lambda e: _budget(e).select("group_id", "priority", "n_exec", "queries_upto", "state"),
    "SELECT group_id, position::BIGINT AS priority, n_exec, upto::BIGINT AS queries_upto, 'run' AS state FROM budget", _VAL)
add("budget_states", lambda e: _budget(e, max_groups=10, max_queries=1000).select("group_id", "priority", "state", "state_reason"),
    """SELECT group_id, position::BIGINT AS priority, CASE WHEN position>10 OR upto>1000 THEN 'not_run' ELSE 'run' END AS state, CASE WHEN position>10 THEN 'group budget spent'
       WHEN upto>1000 THEN 'query budget spent' ELSE '' END AS state_reason FROM budget""", _VAL)
add("disagreement_coverage", lambda e: dis.disagreement_coverage(_budget(e)),
    """SELECT 'material_disagreement' AS measure, CASE WHEN count(*)=0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN count(*)=0 THEN 'no groups to test' ELSE
       count(*)||' of '||count(*)||' groups tested with '||sum(n_exec)::BIGINT||' queries' END AS reason FROM budget""", _VAL)
add("pick_reference", lambda e: _executed(e).filter("is_reference").select("group_id", "field_id"), "SELECT group_id, ref_field AS field_id FROM refs", _VAL)
add("material_disagreement", lambda e: _executed(e).select("group_id", "field_id", "executability_class", "is_reference", F.round("value", 4).alias("value"),
                                                           F.round("abs_diff", 4).alias("abs_diff"), F.round("rel_diff", 6).alias("rel_diff"), "material"),
    """SELECT group_id, field_id, executability_class, is_reference, round(value, 4) AS value, round(abs_diff, 4) AS abs_diff, round(rel_diff, 6) AS rel_diff, rel_diff>0.005 AS material FROM gaps""", _VAL)
add("execution_summary", lambda e: dis.execution_summary(_executed(e)).select("group_id", "tested", "untested", "context_bound", "not_comparable", "unresolvable", "reference_field", "material_disagreement"),
    """SELECT group_id, count(*) FILTER (executability_class='executable') AS tested, count(*) FILTER (executability_class<>'executable') AS untested,
       count(*) FILTER (executability_class='context_bound') AS context_bound, count(*) FILTER (executability_class='not_comparable') AS not_comparable,
       count(*) FILTER (executability_class='unresolvable') AS unresolvable, max(field_name) FILTER (is_reference) AS reference_field,
       coalesce(bool_or(rel_diff>0.005 AND NOT is_reference), false) AS material_disagreement FROM gaps GROUP BY 1""", _VAL)
add("most_material_pair", lambda e: dis.execution_summary(_executed(e)).select("group_id", "reference_field", "variant_field", F.round("rel_diff", 6).alias("rel_diff")),
    """SELECT g.group_id, r.reference_field, w.field_name AS variant_field, round(w.rel_diff, 6) AS rel_diff FROM (SELECT DISTINCT group_id FROM gaps) g
       LEFT JOIN (SELECT group_id, max(field_name) FILTER (is_reference) AS reference_field FROM gaps GROUP BY 1) r USING (group_id) LEFT JOIN (SELECT *, row_number()
       OVER (PARTITION BY group_id ORDER BY rel_diff DESC, field_id) AS rn FROM gaps WHERE NOT is_reference AND rel_diff IS NOT NULL) w ON w.group_id=g.group_id AND w.rn=1""", _VAL)

# -- report tables ------------------------------------------------------------------------------------
add("write_variant_sheets", rep.write_variant_sheets, "SELECT group_id, count(*) AS rows FROM variants GROUP BY 1")
add("payload_projection", lambda e: fnd.payload_projection(e).select("group_id", "field_name", "usage_rank", "view_count", "resolved_formula", "owner"),
    """SELECT group_id, field_name, usage_rank::BIGINT AS usage_rank, views AS view_count, CASE WHEN resolved_formula IS NOT NULL THEN '[redacted]' END AS resolved_formula,
       CASE WHEN owner IS NOT NULL THEN '[redacted]' END AS owner FROM detail""", _DETAIL)
add("score_findings", lambda e: rep.score_findings(e).select("kind", "id", "score"),
    "SELECT 'facet' AS kind, id, score FROM facets UNION ALL SELECT 'domain', domain, min(score) FROM dims GROUP BY domain", _SCORES)
