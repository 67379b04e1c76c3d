"""Run comparison and the documented measures."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog_audit.operators import documented as doc, similar
from catalog_audit.oracle.ctes import CTES, NS, STOPS
from catalog_audit.plans import comparison as cmp, scoring
from catalog_audit.plans.coverage import coverage_register
from catalog_audit.registry.base import add
from catalog_audit.registry.ingest import _REG, pages
from catalog_audit.registry.reports import _EXTRA, _RULE_SQL, _SCORES
from catalog_audit.sources.estate import Estate


def baseline(e: Estate) -> Estate:
    """The same estate scanned in mid January: less usage, facts shipped before 1998."""
    if "_baseline" not in e._made:
        b = Estate(e.spark, e.sf_dir)
        for shared in ("bindings", "resolved", "coverage"):
            b.put(shared, e[shared])
        b.put("raw_usage", e["raw_usage"].filter(F.col("event_ts") < "2024-01-16"))
        e._made["_baseline"] = b
    return e._made["_baseline"]


def earlier_lineage(e: Estate) -> Estate:
    b = Estate(e.spark, e.sf_dir)
    b.put("raw:lineitem", e.raw("lineitem").filter(F.col("l_shipdate") < "1998-01-01"))
    return b


def _before(text: str, names: list[str]) -> str:
    for n in names:
        text = re.sub(rf"\b{n}\b", f"{n}_b", text)
    return text


_CHAIN = ["e_raw_usage", "usage", "field_views", "candidates", "groups", "members", "def_totals", "def_ranked", "dominance", "variants", "failed_views"]
_OLD = {f"{n}_b": _before((CTES | _EXTRA)[n], [x for x in _CHAIN if x != "e_raw_usage" or n != "e_raw_usage"]) for n in _CHAIN}
_OLD["e_raw_usage_b"] = "SELECT * FROM e_raw_usage WHERE event_ts < TIMESTAMP '2024-01-16'"
_LIVE = [f for f in _RULE_SQL if f != "DF-07"]
_NOW = " UNION ALL ".join(f"SELECT '{f}' AS flag_id, fires, count FROM ({_RULE_SQL[f]})" for f in _LIVE)
_THEN = " UNION ALL ".join(f"SELECT '{f}' AS flag_id, fires, count FROM ({_before(_RULE_SQL[f], _CHAIN)})" for f in _LIVE)

add("run_compare", lambda e: cmp.flag_lifecycle(cmp.flag_states(baseline(e)), cmp.flag_states(e)),
    """SELECT flag_id, b.count AS baseline_count, c.count AS current_count, CASE WHEN b.fires AND c.fires THEN 'persisting' WHEN b.fires THEN 'resolved'
       WHEN c.fires THEN 'new' ELSE 'silent' END AS state FROM flags_then b FULL JOIN flags_now c USING (flag_id)""",
    _EXTRA | _OLD | {"flags_now": _NOW, "flags_then": _THEN})
add("facet_movement", lambda e: cmp.facet_movement(scoring.facet_threshold_scores(baseline(e)), scoring.facet_threshold_scores(e)),
    """SELECT id, b.score AS baseline_score, c.score AS current_score, c.score-b.score AS delta FROM banded_then b FULL JOIN banded c USING (id)""",
    _SCORES | _OLD | {"banded_then": _before(_SCORES["banded"], _CHAIN)})
add("variant_convergence", lambda e: cmp.variant_convergence(baseline(e), e).select(
        F.substring_index("concept_key", ":", 1).alias("kind"), "baseline_variants", "current_variants", "baseline_dominant", "current_dominant"),
    """SELECT split_part(concept_key, ':', 1) AS kind, b.variant_count AS baseline_variants, c.variant_count AS current_variants, b.won AS baseline_dominant, c.won AS current_dominant
       FROM (SELECT concept_key, variant_count, (SELECT bool_or(is_dominant) FROM variants_b v WHERE v.group_id=g.group_id) AS won FROM groups_b g) b FULL JOIN
       (SELECT concept_key, variant_count, (SELECT bool_or(is_dominant) FROM variants v WHERE v.group_id=g.group_id) AS won FROM groups g) c USING (concept_key)""", _OLD)

_SAME = ("query_set_version", "rules_version", "tool_version")


def _guard(e, same: tuple[str, ...] = ()):
    """What two runs may not be compared on; their headers are the oldest order and the newest (of those ``same`` in the named attributes)."""
    runs = e.raw("orders").select(F.col("o_orderkey").alias("run"), *[F.expr(x).alias(a) for a, x in _ATTRIBUTES.items()])
    first = runs.agg(F.min_by(F.struct(*runs.columns), "run").alias("r"))
    like = runs.withColumn("first", first.select("r").scalar())
    for a in same:
        like = like.where(F.col(a) == F.col(f"first.{a}"))
    last = like.agg(F.max("run").alias("b"))
    named = runs.withColumn("run", F.when(F.col("run") == first.select("r.run").scalar(), "first").when(F.col("run") == last.select("b").scalar(), "last"))
    return cmp.voids(named, "run", "first", "last")


def _guarded_movement(e):
    moved = cmp.facet_movement(scoring.facet_threshold_scores(baseline(e)), scoring.facet_threshold_scores(e))
    return cmp.guarded(moved, _guard(e), "facets", ["delta"])


_DEBTS = {"same_debt": r"""SELECT 'unowned_source' AS kind, id AS item FROM e_datasources WHERE trim(coalesce(owner,''))='' UNION ALL SELECT 'workbook_security_rule', id FROM e_calc
       WHERE regexp_matches(formula, '(?i)\b(USERNAME|ISMEMBEROF|FULLNAME|USERDOMAIN)\s*\(')""",
     "debt_now": "SELECT * FROM same_debt UNION ALL SELECT DISTINCT 'embedded_source', 'wb_'||l_partkey||'/ds_'||l_suppkey FROM lineitem WHERE l_returnflag='R'",
     "debt_then": """SELECT * FROM same_debt UNION ALL SELECT DISTINCT 'embedded_source', 'wb_'||l_partkey||'/ds_'||l_suppkey FROM lineitem WHERE l_returnflag='R'
       AND l_shipdate < DATE '1998-01-01'"""}
add("estate_drift", lambda e: cmp.estate_drift(earlier_lineage(e), e),
    """SELECT kind, count(*) FILTER (b IS NULL) AS new_debt, count(*) FILTER (c IS NULL) AS cleared_debt, count(*) FILTER (b IS NOT NULL AND c IS NOT NULL) AS persisting
       FROM (SELECT kind, item, 1 AS b FROM debt_then) FULL JOIN (SELECT kind, item, 1 AS c FROM debt_now) USING (kind, item) GROUP BY 1""",
    _DEBTS)


def _first_pages(e):
    """The register as it stood when every shard had landed its first page of two hundred keys."""
    if "coverage_then" not in e._made:
        e.put("coverage_then", e._stage("coverage-then", coverage_register(pages(e).where("cursor = '0'"))))
    return e["coverage_then"]


add("coverage_change", lambda e: cmp.coverage_change(_first_pages(e), e["coverage"]),
    f"""SELECT measure, CASE WHEN measure IN (SELECT measure FROM cut) THEN CASE WHEN measure='fields' THEN 'partial' ELSE 'failed' END ELSE status END AS was, status AS now,
       CASE WHEN status='ok' AND measure IN (SELECT measure FROM cut) THEN 'newly available' ELSE 'unchanged' END AS change FROM register""",
    _REG | {"cut": f"""SELECT 'workbooks' AS measure FROM part WHERE p_partkey>=200 UNION SELECT 'database_tables' FROM part WHERE p_partkey>=200
       UNION SELECT 'datasources' FROM supplier WHERE s_suppkey>=200 UNION SELECT unnest(['custom_sql','data_quality_warnings']) FROM customer WHERE c_custkey>=200
       UNION SELECT 'fields' FROM part WHERE 5+p_partkey//{NS}>=200"""})
_ATTRIBUTES = {"query_set_version": "o_orderpriority", "rules_version": "o_orderstatus", "domain_map": "o_totalprice > 150000", "adoption_source": "o_orderkey % 2",
               "grouping_mode": "o_custkey % 2", "tool_version": "year(o_orderdate)"}
add("comparability_guard", lambda e: cmp.comparability_guard(
        e.raw("orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("run"), *[F.expr(x).alias(a) for a, x in _ATTRIBUTES.items()]),
        "site", "run", list(_ATTRIBUTES)),
    """SELECT site, run, CASE WHEN mm='' THEN 'comparable' ELSE 'incomparable' END AS verdict, mm AS mismatches FROM (SELECT o.site, o.run, array_to_string(list_filter([
       """ + ", ".join(f"CASE WHEN o.{a} IS DISTINCT FROM b.{a} THEN '{a}' END" for a in _ATTRIBUTES) + """], lambda x: x IS NOT NULL), ',') AS mm
       FROM order_runs o JOIN (SELECT site, min(run) AS k FROM order_runs GROUP BY 1) f USING (site) JOIN order_runs b ON b.run=f.k WHERE o.run>f.k)""",
    {"order_runs": "SELECT o_custkey AS site, o_orderkey AS run, " + ", ".join(f"{x} AS {a}" for a, x in _ATTRIBUTES.items()) + " FROM orders"})
add("guarded_movement", lambda e: _guarded_movement(e),
    """SELECT m.id, m.baseline_score, m.current_score, CASE WHEN g.facets_void THEN NULL ELSE m.delta END AS delta,
       CASE WHEN g.facets_void THEN 'incomparable' ELSE 'comparable' END AS verdict, CASE WHEN g.facets_void THEN g.why ELSE '' END AS void_reason
       FROM (SELECT id, b.score AS baseline_score, c.score AS current_score, c.score-b.score AS delta FROM banded_then b FULL JOIN banded c USING (id)) m,
       (SELECT b.query_set_version<>c.query_set_version OR b.rules_version<>c.rules_version OR b.tool_version<>c.tool_version AS facets_void,
        array_to_string(list_filter([""" + ", ".join(f"CASE WHEN b.{a} IS DISTINCT FROM c.{a} THEN '{a}' END" for a in (
            "query_set_version", "rules_version", "domain_map", "adoption_source", "grouping_mode", "tool_version")) + """], lambda x: x IS NOT NULL), ',') AS why
        FROM order_runs b, order_runs c WHERE b.run=(SELECT min(run) FROM order_runs) AND c.run=(SELECT max(run) FROM order_runs)) g""",
    _SCORES | _OLD | {"banded_then": _before(_SCORES["banded"], _CHAIN),
                      "order_runs": "SELECT o_custkey AS site, o_orderkey AS run, " + ", ".join(f"{x} AS {a}" for a, x in _ATTRIBUTES.items()) + " FROM orders"})
_HEADERS = {"order_runs": "SELECT o_custkey AS site, o_orderkey AS run, " + ", ".join(f"{x} AS {a}" for a, x in _ATTRIBUTES.items()) + " FROM orders",
            "oldest": "SELECT * FROM order_runs WHERE run=(SELECT min(run) FROM order_runs)",
            "ends": "SELECT b, c FROM oldest b, order_runs c WHERE c.run=(SELECT max(n.run) FROM order_runs n, oldest o WHERE " + " AND ".join(f"n.{a}=o.{a}" for a in _SAME) + ")",
            "void": "SELECT " + ", ".join(f"coalesce(bool_or({' OR '.join(f'b.{a} IS DISTINCT FROM c.{a}' for a, s in cmp.GUARDS.items() if s in (subject, 'all'))}), true) AS {subject}"
                                          for subject in ("facets", "variants", "all")).replace(" AS all", " AS estate") + """,
              array_to_string(list_filter(any_value([""" + ", ".join(f"CASE WHEN b.{a} IS DISTINCT FROM c.{a} THEN '{a}' END" for a in cmp.GUARDS) + """]), lambda x: x IS NOT NULL), ',') AS why FROM ends"""}


def _verdict(subject: str) -> str:
    return f"CASE WHEN {subject} THEN 'incomparable' ELSE 'comparable' END AS verdict, CASE WHEN {subject} THEN why ELSE '' END AS void_reason"


add("guarded_compare", lambda e: cmp.guarded(cmp.flag_lifecycle(cmp.flag_states(baseline(e)), cmp.flag_states(e)), _guard(e, _SAME), "facets", ["state"]),
    """SELECT flag_id, b.count AS baseline_count, c.count AS current_count, CASE WHEN facets THEN NULL WHEN b.fires AND c.fires THEN 'persisting' WHEN b.fires THEN 'resolved'
       WHEN c.fires THEN 'new' ELSE 'silent' END AS state, """ + _verdict("facets") + " FROM flags_then b FULL JOIN flags_now c USING (flag_id), void",
    _EXTRA | _OLD | _HEADERS | {"flags_now": _NOW, "flags_then": _THEN})
add("guarded_convergence", lambda e: cmp.guarded(cmp.variant_change(baseline(e), e), _guard(e, _SAME), "variants", ["variants_delta", "dominance"]).select(
        "baseline_variants", "current_variants", "variants_delta", "dominance", "verdict", "void_reason"),
    """SELECT b.variant_count AS baseline_variants, c.variant_count AS current_variants, CASE WHEN NOT variants THEN c.variant_count-b.variant_count END AS variants_delta,
       CASE WHEN variants THEN NULL WHEN coalesce(c.won,false)=coalesce(b.won,false) THEN 'unchanged' WHEN c.won THEN 'gained' ELSE 'lost' END AS dominance, """ + _verdict("variants") + """
       FROM (SELECT concept_key, variant_count, (SELECT bool_or(is_dominant) FROM variants_b v WHERE v.group_id=g.group_id) AS won FROM groups_b g) b FULL JOIN
       (SELECT concept_key, variant_count, (SELECT bool_or(is_dominant) FROM variants v WHERE v.group_id=g.group_id) AS won FROM groups g) c USING (concept_key), void""", _OLD | _HEADERS)
add("guarded_drift", lambda e: cmp.guarded(cmp.estate_drift(earlier_lineage(e), e), _guard(e, _SAME), "estate", ["new_debt", "cleared_debt"]),
    """SELECT kind, CASE WHEN NOT estate THEN count(*) FILTER (b IS NULL) END AS new_debt, CASE WHEN NOT estate THEN count(*) FILTER (c IS NULL) END AS cleared_debt,
       count(*) FILTER (b IS NOT NULL AND c IS NOT NULL) AS persisting, """ + _verdict("estate") + """
       FROM (SELECT kind, item, 1 AS b FROM debt_then) FULL JOIN (SELECT kind, item, 1 AS c FROM debt_now) USING (kind, item), void GROUP BY kind, estate, why""", _DEBTS | _HEADERS)
add("stale_refresh", lambda e: doc.stale_refresh(e, "2001-08-20").withColumn("age_days", F.col("age_days").cast("bigint")),
    """SELECT datasource_id, age_days FROM (SELECT datasource_id, quantile_cont(gap, 0.5) AS iv, date_diff('day', max(day) FILTER (good), DATE '2001-08-20') AS age_days
       FROM (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY datasource_id ORDER BY day), day) AS gap FROM (SELECT datasource_id, completed_at::DATE AS day,
       bool_or(status<>'Failed') AS good FROM e_refresh GROUP BY 1,2)) GROUP BY 1)
       WHERE (age_days IS NULL OR age_days > 2*iv) AND datasource_id IN (SELECT l.upstream_id FROM e_lineage l JOIN usage ON workbook_id=l.downstream_id
       WHERE l.downstream_type='workbook' AND l.upstream_type='datasource' AND last_viewed_days_ago<=30)""")


def _scope(e):
    """Brands ending in an even digit are mapped projects; the first twenty users are mapped owners."""
    brand = F.substring_index("project_name", "#", -1).cast("int")
    projects = e["workbooks"].select("project_name").distinct().filter(brand % 2 == 0).select(
        "project_name", F.concat(F.lit("brand_"), (brand % 3).cast("string")).alias("project_domain"))
    uid = F.expr("cast(substring(owner, 5) as int)")
    owners = e["workbooks"].select("owner").distinct().filter(uid < 20).select("owner", F.lit("owner_unit").alias("owner_domain"))
    return doc.domain_scope(e, projects, owners)


add("domain_scope", lambda e: _scope(e).groupBy("mechanism", "domain").agg(F.count(F.lit(1)).alias("workbooks")),
    """SELECT mechanism, domain, count(*) AS workbooks FROM (SELECT CASE WHEN b%2=0 THEN 'project' WHEN u<20 THEN 'owner' WHEN act THEN 'manual' ELSE 'unmappable' END AS mechanism,
       CASE WHEN b%2=0 THEN 'brand_'||(b%3) WHEN u<20 THEN 'owner_unit' END AS domain FROM (SELECT id, split_part(project_name,'#',2)::INT AS b, owner[5:]::INT AS u,
       coalesce(a.act, false) AS act FROM e_workbooks LEFT JOIN (SELECT workbook_id, cum-event_count < 0.8::DOUBLE*t AS act FROM (SELECT *, sum(event_count) OVER (ORDER BY event_count DESC,
       workbook_id ROWS UNBOUNDED PRECEDING) AS cum, sum(event_count) OVER () AS t FROM usage)) a ON a.workbook_id=id)) GROUP BY 1,2""")
add("active_user_penetration", lambda e: doc.active_user_penetration(e, e.raw("customer").select(F.col("c_custkey").alias("user_id"))),
    """SELECT a AS active, n AS licensed, a::DOUBLE/n AS penetration, a::DOUBLE/n<0.3 AS fires FROM (SELECT count(DISTINCT c_custkey) AS n,
       count(DISTINCT c_custkey) FILTER (c_custkey IN (SELECT user_id FROM e_raw_usage WHERE event_name='view')) AS a FROM customer)""")
add("rule_editors", doc.rule_editors,
    """SELECT grantee_id, count(DISTINCT object_id) AS workbooks FROM e_permissions WHERE mode='Allow' AND capability='Write' AND object_id IN
       (SELECT workbook_id FROM e_field_usage JOIN e_calc ON id=field_id) GROUP BY 1""")
add("description_divergence", lambda e: doc.description_divergence(e["fields"], e["fields"].filter("id <> 'fld_1'").withColumn(
        "description", F.when(F.col("datasource_id").endswith("7"), F.concat("description", F.lit(" (cached)"))).otherwise(F.col("description")))),
    """SELECT id, description AS first_description, CASE WHEN id<>'fld_1' THEN description||' (cached)' END AS second_description FROM e_fields
       WHERE (datasource_id LIKE '%7' AND id<>'fld_1' AND description IS NOT NULL) OR (id='fld_1' AND description IS NOT NULL)""")
add("duplicate_logic", doc.duplicate_logic,
    """SELECT normalized_hash, count(*) AS fields, count(DISTINCT datasource_id) AS sources FROM resolved JOIN e_calc ON id=field_id WHERE normalized_hash<>''
       GROUP BY 1 HAVING count(DISTINCT datasource_id)>=2""")
add("cryptic_name_rate", lambda e: doc.cryptic_name_rate(e["fields"], "name"),
    r"""SELECT count(*) AS names, count(*) FILTER (s) AS short, count(*) FILTER (v) AS versioned, count(*) FILTER (a) AS abbreviated,
        (count(*) FILTER (s OR v OR a))::DOUBLE/count(*) AS rate FROM (SELECT length(trim(name))<4 AS s, regexp_matches(trim(name), '(?i)[_ ]v?[0-9]+$') AS v,
        regexp_matches(trim(name), '(?i)\b(rev|amt|qty|avg|cnt|pct|num|tot|yoy|ytd|adj)\b') AS a FROM e_fields)""")
add("reuse_depth", doc.reuse_depth,
    """SELECT id, (SELECT count(DISTINCT downstream_id) FROM e_lineage l WHERE l.upstream_id=d.id AND downstream_type='workbook' AND upstream_type='datasource') AS workbooks,
       (SELECT count(DISTINCT upstream_id) FROM e_lineage l WHERE l.downstream_id=d.id AND downstream_type='datasource' AND upstream_type='table') AS tables FROM e_datasources d""")
add("unused_fields", doc.unused_fields, "SELECT id, name FROM e_fields WHERE id NOT IN (SELECT field_id FROM e_field_usage)")
add("fuzzy_name_groups", doc.fuzzy_name_groups,
    """SELECT array_to_string(key, ' ') AS key, count(*) AS word_sets, sum(names)::BIGINT AS names, min(words) AS first_words, 'medium' AS confidence FROM (
       SELECT names, array_to_string(toks, ' ') AS words, unnest(list_distinct([toks] || list_filter(list_transform(toks, lambda t: list_filter(toks, lambda x: x<>t)),
       lambda s: len(s)>=1))) AS key FROM (SELECT toks, count(*) AS names FROM (SELECT field_id, list_sort(list(tok)) AS toks FROM name_tokens GROUP BY 1) GROUP BY 1))
       GROUP BY 1 HAVING count(*)>=2""")
_NAMES = {"plain_names": r"""SELECT DISTINCT trim(regexp_replace(lower(name), '[^\p{L}]+', ' ', 'g')) AS name FROM (SELECT name FROM e_workbooks UNION ALL SELECT name FROM e_fields)
          WHERE trim(regexp_replace(lower(name), '[^\p{L}]+', ' ', 'g'))<>''""",
          "name_words": """SELECT name, list_distinct(list_transform(list_filter(regexp_extract_all(name, '([a-z]{2,})', 1), lambda t: length(t)>=3 AND NOT list_contains("""
          + STOPS + """, t)), lambda t: CASE WHEN length(t)>3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END)) AS ws FROM plain_names"""}


def _names(e):
    return similar.distinct_names(e["workbooks"].select("name").unionByName(e["fields"].select("name")), "name")


add("fuzzy_name_edits", lambda e: similar.within_edits(_names(e), 3).withColumn("distance", F.col("distance").cast("bigint")),
    "SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS distance FROM plain_names a JOIN plain_names b ON a.name<b.name AND levenshtein(a.name, b.name)<=3", _NAMES)
add("fuzzy_name_words", lambda e: similar.alike_words(_names(e), 0.3).select("a", "b", F.col("shared").cast("bigint").alias("shared"), F.round("jaccard", 6).alias("jaccard")),
    """SELECT a.name AS a, b.name AS b, len(list_intersect(a.ws, b.ws)) AS shared, round(len(list_intersect(a.ws, b.ws))/(len(a.ws)+len(b.ws)-len(list_intersect(a.ws, b.ws))), 6) AS jaccard
       FROM name_words a JOIN name_words b ON a.name<b.name WHERE len(a.ws)>0 AND len(b.ws)>0 AND
       len(list_intersect(a.ws, b.ws))/(len(a.ws)+len(b.ws)-len(list_intersect(a.ws, b.ws)))>=0.3""", _NAMES)
