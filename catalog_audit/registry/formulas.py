"""Formula text, reference graph, concept groups, ranking, calibration of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_audit.functions import formula as fx
from catalog_audit.functions.names import content_tokens, int_or_null
from catalog_audit.operators import detail, graph, groups, ranking
from catalog_audit.oracle.ctes import TOKEN, USER_CTX, norm_sql
from catalog_audit.registry.base import add
from catalog_audit.sources import upsert

def _linked_fields(e):
    """Calculated fields that refer to one another by customer number: chains, rings, ways into rings, and loose ends, by blocks of twenty."""
    key = F.col("c_custkey")
    block, b = F.floor(key / 20) % 4, key % 20
    ring = key - b + F.floor(b / 4) * 4 + (b + 1) % 4
    ref = (F.when(block == 0, F.when(b > 0, key - 1)).when(block == 1, ring)
           .when(block == 2, F.when(b < 3, key - b + (b + 1) % 3).otherwise(key - 1)).otherwise(F.when(b == 0, -1).otherwise(key - 1 - b % 2)))
    text = F.coalesce(F.concat(F.lit("[Field "), ref.cast("string"), F.lit("] * 2")), F.lit("COUNT(1)"))
    fields = e.raw("customer").select(
        F.concat(F.lit("lf_"), key.cast("string")).alias("id"), F.concat(F.lit("Field "), key.cast("string")).alias("name"),
        F.lit("linked").alias("datasource_id"), text.alias("formula"), F.lit(True).alias("is_calculated"))
    tables = {"fields": fields}
    return tables | {"bindings": graph.token_bind(tables)}


# -- scalars over the whole formula table -------------------------------------------
add("tokenize_formula", lambda e: e["calc"].select("id", F.array_join(fx.tokenize_formula(F.col("formula")), "¦").alias("tokens")),
    f"SELECT id, array_to_string(regexp_extract_all(formula, '{TOKEN}', 1), '¦') AS tokens FROM e_calc")
add("normalize_formula", lambda e: e["calc"].select("id", fx.normalize_formula(F.col("formula")).alias("norm")),
    f"SELECT id, {norm_sql('formula')} AS norm FROM e_calc")
add("formula_hash", lambda e: e["calc"].select("id", fx.formula_hash(F.col("formula")).alias("hash")),
    f"SELECT id, sha1({norm_sql('formula')}) AS hash FROM e_calc")
add("canonical_number", lambda e: e.raw("lineitem").select(
        "l_orderkey", "l_linenumber", fx.canonical_number(F.col("l_extendedprice").cast("string")).alias("price"),
        fx.canonical_number(F.concat(F.lit("00"), F.col("l_linenumber").cast("string"))).alias("line")),
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice=floor(l_extendedprice) THEN l_extendedprice::BIGINT::VARCHAR
       ELSE l_extendedprice::VARCHAR END AS price, l_linenumber::VARCHAR AS line FROM lineitem""")
add("formula_signature", lambda e: groups.formula_fingerprint(e).select(
        "field_id", F.array_join("cols", ",").alias("cols"), F.array_join("funcs", ",").alias("funcs"), "has_ratio"),
    "SELECT field_id, array_to_string(cols, ',') AS cols, array_to_string(funcs, ',') AS funcs, has_ratio FROM signature")
add("formula_fingerprint", lambda e: groups.formula_fingerprint(e).select("field_id", "norm", "normalized_hash", "definition_key"),
    "SELECT field_id, norm, normalized_hash, definition_key FROM resolved JOIN signature USING (field_id)")
add("content_tokens", lambda e: e["calc"].select(F.col("id").alias("field_id"), F.array_join(F.array_sort(content_tokens(F.col("name"))), ",").alias("tokens")),
    "SELECT field_id, string_agg(tok, ',' ORDER BY tok) AS tokens FROM name_tokens GROUP BY 1")
add("bracket_refs", lambda e: e["calc"].select("id", F.array_join(fx.bracket_refs(F.col("formula")), ",").alias("refs")),
    r"SELECT id, array_to_string(regexp_extract_all(formula, '(\[[^\]]*\])', 1), ',') AS refs FROM e_calc")
add("int_or_null", lambda e: e.raw("events").select("event_id", int_or_null(F.get_json_object("props", "$.k")).alias("k"),
                                                    int_or_null(F.col("event_type")).alias("bad")),
    "SELECT event_id, try_cast(trunc(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT) AS k, NULL::BIGINT AS bad FROM events")

# -- reference graph ------------------------------------------------------------------
add("reference_edges", graph.reference_edges,
    "SELECT DISTINCT field_id, ref_id AS referenced_field_id FROM bound WHERE ref_id IS NOT NULL")
add("formula_closure", lambda e: e["resolved"].select("field_id", "resolution_status", "resolution_depth"),
    "SELECT field_id, resolution_status, resolution_depth::BIGINT AS resolution_depth FROM closure")
_LINKED = {"linked": """SELECT c_custkey AS id, CASE WHEN k%4=0 THEN CASE WHEN b=0 THEN NULL ELSE c_custkey-1 END
        WHEN k%4=1 THEN c_custkey-b+b//4*4+(b+1)%4 WHEN k%4=2 THEN CASE WHEN b<3 THEN c_custkey-b+(b+1)%3 ELSE c_custkey-1 END
        WHEN b=0 THEN -1 ELSE c_custkey-1-b%2 END AS ref FROM (SELECT *, c_custkey//20 AS k, c_custkey%20 AS b FROM customer)""",
    "linked_walk": """SELECT id AS root, id AS node, [id] AS path, 0 AS depth, 0 AS worst FROM linked
        UNION ALL SELECT w.root, l.ref, list_append(w.path, l.ref), w.depth+1, CASE WHEN x.id IS NULL THEN 1
        WHEN list_contains(w.path, l.ref) THEN 3 WHEN w.depth+1>12 THEN 2 ELSE 0 END
        FROM linked_walk w JOIN linked l ON l.id=w.node LEFT JOIN linked x ON x.id=l.ref WHERE w.worst=0 AND l.ref IS NOT NULL"""}
add("closure_statuses", lambda e: graph.resolve_formulas(_linked_fields(e)).select("field_id", "resolution_status", "resolution_depth"),
    """SELECT 'lf_'||root AS field_id, max(CASE WHEN worst=1 THEN depth ELSE depth+1 END)::BIGINT AS resolution_depth, CASE max(worst)
       WHEN 0 THEN 'resolved' WHEN 1 THEN 'unresolved_reference' WHEN 2 THEN 'too_deep' ELSE 'cycle' END AS resolution_status
       FROM linked_walk GROUP BY root""", _LINKED)
add("resolved_formula_text", lambda e: e["resolved"].select("field_id", "resolved_formula"),
    "SELECT field_id, resolved_formula FROM resolved")
add("ambiguous_refs", graph.ambiguous_refs,
    """SELECT count(*) FILTER (ambiguous) AS ambiguous_refs, count(*) AS tokens, count(*) FILTER (ref_id IS NULL) AS unbound_refs FROM bound""")
add("resolution_status_counts", graph.resolution_status_counts,
    "SELECT resolution_status, count(*) AS fields FROM closure GROUP BY 1")

# -- groups -----------------------------------------------------------------------------
add("measure_candidates", lambda e: groups.measure_candidates(e).select("field_id", "definition_key"),
    "SELECT field_id, definition_key FROM candidates")
add("core_metric_match", lambda e: groups.with_core_match(e["calc"], "name", e.core_metrics).select(F.col("id").alias("field_id"), "core"),
    "SELECT id AS field_id, core FROM e_calc LEFT JOIN core_match ON field_id=id")
add("core_match_tie", lambda e: groups.with_core_match(
        e["calc"].withColumn("name", F.regexp_replace("name", "Churn Rate|Bounce Rate", "Bounce Churn Rate")), "name", e.core_metrics).select(
        F.col("id").alias("field_id"), "core"),
    """SELECT id AS field_id, CASE WHEN name LIKE 'Churn Rate%' OR name LIKE 'Bounce Rate%' THEN NULL ELSE core END AS core
       FROM e_calc LEFT JOIN core_match ON field_id=id""")
add("token_intersection", lambda e: e["calc"].select(F.col("id").alias("field_id"), F.explode(content_tokens(F.col("name"))).alias("tok")).join(
        e.spark.createDataFrame([(m, t, t in d) for m, ts, d in groups.core_metric_tokens(e.core_metrics) for t in ts],
                                "label string, tok string, distinctive boolean"), "tok").groupBy("field_id", "label").agg(
        F.count(F.lit(1)).alias("shared"), F.count_if("distinctive").alias("distinctive")),
    """SELECT field_id, label, count(*) AS shared, count(*) FILTER (owners=1) AS distinctive
       FROM name_tokens JOIN core_tokens USING (tok) GROUP BY 1,2""")
add("concept_groups", lambda e: e["groups"].select("group_id", "label", "variant_count", "definition_count"),
    "SELECT group_id, label, variant_count, definition_count FROM groups")
add("group_method", lambda e: e["groups"].select("group_id", "method", "confidence"), "SELECT group_id, method, confidence FROM groups")
add("group_ordinals", lambda e: e["ranked"].select("group_id", "field_id"), "SELECT group_id, field_id FROM members")
add("group_label", lambda e: e["groups"].select("group_id", "label"), "SELECT group_id, label FROM groups")
add("usage_rank", lambda e: e["ranked"].select("group_id", "field_id", "views", "workbooks", "usage_rank"),
    "SELECT group_id, field_id, views, workbooks, usage_rank::BIGINT AS usage_rank FROM members")
add("rank_groups", lambda e: e["variants"].select("group_id", "field_id", "definition_key", "usage_rank", "is_dominant"),
    "SELECT group_id, field_id, definition_key, usage_rank::BIGINT AS usage_rank, is_dominant FROM variants")
add("definition_views", lambda e: ranking.definition_views(e["ranked"]).select("group_id", "definition_key", "total"),
    "SELECT group_id, definition_key, total FROM def_totals")
add("dominance", lambda e: ranking.dominance(e["ranked"]).select("group_id", "top_key", "top_total", "second_total", "group_total", "has_dominant"),
    """SELECT group_id, top_key, top_total, second AS second_total, group_total::BIGINT AS group_total, has_dominant FROM dominance""")
add("top_ratio", lambda e: ranking.dominance(e["ranked"]).select("group_id", "top_ratio"),
    "SELECT group_id, CASE WHEN second>0 THEN top_total::DOUBLE/second END AS top_ratio FROM dominance")
add("cover_count", lambda e: ranking.cover_count(e["ranked"]).select("group_id", "cover"),
    "SELECT group_id, cover80::BIGINT AS cover FROM cover80")
add("view_share", lambda e: ranking.view_share(e["variants"]),
    """SELECT group_id, field_id, views, CASE WHEN t>0 THEN views::DOUBLE/t ELSE 0.0 END AS view_share FROM
       (SELECT *, sum(views) OVER (PARTITION BY group_id) AS t FROM variants)""")
add("dominant_group_share", ranking.dominant_group_share,
    """SELECT d AS dominant, g AS groups, d::DOUBLE/g AS share FROM (SELECT count(*) AS g, count(*) FILTER (w) AS d FROM
       (SELECT group_id, bool_or(is_dominant) AS w FROM variants GROUP BY 1))""")
add("group_workbook_count", ranking.group_workbook_count,
    "SELECT group_id, workbooks_affected FROM multiplicity WHERE workbooks_affected>0")

# -- detail ---------------------------------------------------------------------------
_DETAIL = {"detail": """SELECT v.group_id, v.field_id, v.name AS field_name, v.usage_rank, r.resolution_status, r.resolved_formula,
    c.role, c.datasource_id, d.luid AS datasource_luid, d.name AS datasource_name, d.owner, v.views, v.is_dominant, v.definition_key
    FROM variants v JOIN e_calc c ON c.id=v.field_id LEFT JOIN resolved r ON r.field_id=v.field_id
    LEFT JOIN e_datasources d ON d.id=c.datasource_id""",
    "classed": rf"""SELECT *, CASE WHEN resolution_status<>'resolved' THEN 'unresolvable'
    WHEN regexp_matches(resolved_formula, '{USER_CTX}') THEN 'context_bound' WHEN role<>'MEASURE' THEN 'not_comparable'
    ELSE 'executable' END AS executability_class, CASE WHEN resolution_status<>'resolved' THEN 'unresolved: '||resolution_status
    WHEN regexp_matches(resolved_formula, '{USER_CTX}') THEN 'reads the signed-in user'
    WHEN role<>'MEASURE' THEN 'not a measure but '||role ELSE '' END AS untested_reason FROM detail"""}
add("variant_detail", lambda e: detail.variant_detail(e).select(
        "group_id", "field_id", "field_name", "resolution_status", "resolved_formula", "datasource_name", "owner"),
    "SELECT group_id, field_id, field_name, resolution_status, resolved_formula, datasource_name, owner FROM detail", _DETAIL)
add("variant_execution_input", lambda e: detail.variant_detail(e).select("group_id", "field_id", "role", "datasource_luid", "resolution_status"),
    "SELECT group_id, field_id, role, datasource_luid, resolution_status FROM detail", _DETAIL)
add("variant_class", lambda e: detail.variant_class(e).select("field_id", "executability_class", "untested_reason"),
    "SELECT field_id, executability_class, untested_reason FROM classed", _DETAIL)
add("native_aggregate", lambda e: e["resolved"].select("field_id", fx.is_native_aggregate(F.col("resolved_formula")).alias("native_aggregate")),
    r"""SELECT field_id, regexp_matches(resolved_formula, '(?i)\b(SUM|AVG|COUNTD|COUNT|MIN|MAX|MEDIAN|ATTR|STDEV|STDEVP|VAR|VARP|PERCENTILE|CORR|COVAR|COVARP|TOTAL|RUNNING_\w+|WINDOW_\w+)\s*\(')
        AS native_aggregate FROM resolved""")
add("redact_columns", lambda e: detail.redact_columns(detail.variant_detail(e).select("field_id", "resolved_formula", "owner", "views"),
                                                      ["resolved_formula", "owner"]),
    """SELECT field_id, CASE WHEN resolved_formula IS NOT NULL THEN '[redacted]' END AS resolved_formula,
       CASE WHEN owner IS NOT NULL THEN '[redacted]' END AS owner, views FROM detail""", _DETAIL)
_TOKEN_LIT = r'token\s*=\s*"[0-9a-f]{40}"'
add("secret_scan", lambda e: detail.secret_scan(e.raw("documents"), "doc_id", "text", detail.SECRET_PATTERNS | {"token literal": _TOKEN_LIT}),
    r"""SELECT * FROM (SELECT doc_id, array_to_string(list_filter([
        CASE WHEN regexp_matches(text, '(?i)x-[a-z]+-auth') THEN 'auth header' END,
        CASE WHEN regexp_matches(text, 'Bearer\s+[A-Za-z0-9._\-]{16,}') THEN 'bearer token' END,
        CASE WHEN regexp_matches(text, '(?i)(password|pwd)\s*=\s*[^;\s"&]+') THEN 'password literal' END,
        CASE WHEN regexp_matches(text, '(?i)"(pat|password|passwd|pwd|secret|client_secret|access_token|refresh_token|private_key|api_?key|credentials?|x-[a-z]+-auth)"\s*:\s*"[^"]+"') THEN 'secret-shaped key' END,
        CASE WHEN regexp_matches(text, 'token\s*=\s*"[0-9a-f]{40}"') THEN 'token literal' END], lambda t: t IS NOT NULL), ', ') AS patterns FROM documents)
        WHERE patterns<>''""")

# -- keyed upserts -------------------------------------------------------------------------
_USE = ["item_luid", "event_id", "event_name"]
add("upsert_last_wins", lambda e: upsert.upsert_last_wins(e["raw_usage"].select(*_USE), ["item_luid"], ["event_id"]),
    "SELECT item_luid, max(event_id) AS event_id, arg_max(event_name, event_id) AS event_name FROM e_raw_usage GROUP BY 1")
add("insert_first_wins", lambda e: upsert.insert_first_wins(e["raw_usage"].select(*_USE), ["item_luid"], ["event_id"]),
    "SELECT item_luid, min(event_id) AS event_id, arg_min(event_name, event_id) AS event_name FROM e_raw_usage GROUP BY 1")
add("run_registry", lambda e: upsert.run_registry(e.raw("events").select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").alias("started_at")))
        .select("run_id", F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"), "is_latest"),
    """SELECT run_id, strftime(s, '%Y-%m-%dT%H:%M:%S') AS started_at, row_number() OVER (ORDER BY s DESC, run_id DESC)=1 AS is_latest
       FROM (SELECT 'run_'||user_id AS run_id, arg_min(ts, event_id) AS s FROM events GROUP BY 1)""")
