"""DuckDB definitions of the derived estate and of the derived stages.

Each entry is the body of one CTE. ``with_ctes`` prefixes a statement with exactly the
entries it (transitively) names, so every check is one self-contained statement over
the given tables. These texts are written independently of the Spark operators.
"""

from __future__ import annotations

import re

NS = "(SELECT count(*) FROM supplier)"
NP = "(SELECT count(*) FROM part)"
WS = r"[\s\p{Z}]+"
TOKEN = (
    r'(/\*(?s:.*?)\*/|//[^\n\r]*|"(?:[^"\\]|\\(?s:.))*"|' r"''(?:[^''\\]|\\(?s:.))*''"
    r"|#[^#]*#|\[[^\]]*\]|(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?"
    r"|[\p{L}_][\p{L}\p{N}_]*|<=|>=|<>|!=|==|[-+*/%^()<>=,.:!&|~{}]|[\s\p{Z}]+|(?s:.))"
)
USER_CTX = r"(?i)\b(USERNAME|ISMEMBEROF|FULLNAME|USERDOMAIN)\s*\("
AGGS = ("['sum','avg','count','countd','min','max','median','attr','stdev','stdevp','var','varp',"
        "'percentile','corr','covar']")
STOPS = ("['of','the','an','and','or','to','in','on','at','by','for','per','vs','with','from','as','is','not','no']")


def norm_sql(expr: str) -> str:
    """Normal form of formula text ``expr``."""
    return f"""array_to_string(list_transform(list_filter(
      regexp_extract_all({expr}, '{TOKEN}', 1),
      lambda t: NOT (t LIKE '/*%' OR t LIKE '//%' OR regexp_full_match(t, '{WS}'))),
      lambda t: CASE
        WHEN length(t) > 1 AND (t LIKE '"%' OR t LIKE '#%') THEN t
        WHEN length(t) > 1 AND t LIKE '''%' THEN '"' || t[2:-2] || '"'
        WHEN length(t) > 1 AND t LIKE '[%' THEN '[' || lower(trim(regexp_replace(t[2:-2], '{WS}', ' ', 'g'))) || ']'
        WHEN regexp_full_match(t, '[0-9]+') THEN CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END
        WHEN regexp_full_match(t, '[.]?[0-9].*') THEN
          CASE WHEN t::DOUBLE = floor(t::DOUBLE) THEN (t::DOUBLE)::HUGEINT::VARCHAR ELSE (t::DOUBLE)::VARCHAR END
        ELSE lower(t) END), ' ')"""


_STRIPPED = (r"""regexp_replace(regexp_replace(regexp_replace(norm, '\[[^\]]*\]', ' ', 'g'), '"[^"]*"', ' ', 'g'),"""
             r""" '#[^#]*#', ' ', 'g')""")

NAME = ("['Revenue','Total Revenue','Net Rev','Active Customers','Gross Margin','Churn Rate',"
        "'Average Order Value','Number of Deals','Bounce Rate','Margin Adj']")


def _name(k: str) -> str:
    return f"{NAME}[({k})%10+1] || ' ' || ({k})"


CTES: dict[str, str] = {
    "e_projects": "SELECT 'prj_'||n_nationkey AS id, n_name AS name, 'reg_'||n_regionkey AS parent_id FROM nation",
    "e_datasources": """SELECT 'ds_'||s_suppkey AS id, 'dsl_'||s_suppkey AS luid, s_name AS name,
        'prj_'||s_nationkey AS project_id, CASE WHEN s_suppkey%13=0 THEN NULL WHEN s_suppkey%17=0 THEN ' '
        ELSE 'user'||(s_suppkey%40) END AS owner, s_acctbal>=5000 AS is_certified FROM supplier""",
    "e_workbooks": """SELECT 'wb_'||p_partkey AS id, 'wbl_'||p_partkey AS luid, p_name||' '||p_partkey AS name,
        p_brand AS project_name, 'user'||(p_partkey%40) AS owner FROM part""",
    "e_views": """SELECT 'vw_'||(2*p_partkey) AS luid, 'wb_'||p_partkey AS workbook_id, 'sheet' AS kind FROM part
        UNION ALL SELECT 'vw_'||(2*p_partkey+1), 'wb_'||p_partkey, 'dashboard' FROM part""",
    "e_custom_sql": f"""SELECT 'csq_'||c_custkey AS id, CASE c_custkey%5
        WHEN 0 THEN 'select region, sum(amount) from t'||c_nationkey||' group by region'
        WHEN 1 THEN 'SELECT * FROM t'||c_nationkey||' WHERE owner = CURRENT_USER'
        WHEN 2 THEN 'select * from t'||c_nationkey||' where u = USERNAME ( )'
        WHEN 3 THEN 'select groupby, user from t'||c_nationkey
        ELSE 'SELECT a FROM t'||c_nationkey||' GROUP   BY a HAVING USER() = a' END AS query,
        'ds_'||(c_custkey%{NS}) AS datasource_id FROM customer""",
    "e_database_tables": """SELECT 'dbt_'||p_partkey AS id, p_size%3=0 AS is_embedded, p_size%4=0 AS is_certified,
        p_partkey%40 AS column_count, p_size::BIGINT AS downstream_datasource_count FROM part""",
    "e_dqw": f"""SELECT 'dqw_'||c_custkey AS id, 'dsl_'||(c_custkey%{NS}) AS asset_luid, c_acctbal>9500 AS is_active,
        c_acctbal>9800 AS is_elevated, c_mktsegment AS warning_type FROM customer""",
    "e_lineage": """SELECT DISTINCT 'workbook' AS downstream_type, 'wb_'||l_partkey AS downstream_id,
        CASE WHEN l_returnflag='R' THEN 'embedded_datasource' ELSE 'datasource' END AS upstream_type,
        'ds_'||l_suppkey AS upstream_id FROM lineitem
        UNION ALL SELECT 'datasource','ds_'||s_suppkey,'table','tbl_'||(s_nationkey%9) FROM supplier WHERE s_suppkey%10<>3
        UNION ALL SELECT 'datasource','ds_'||s_suppkey,'datasource','ds_'||CAST(floor(s_suppkey/4) AS BIGINT)
        FROM supplier WHERE s_suppkey%4=0 AND s_suppkey>0""",
    "e_permissions": """SELECT DISTINCT 'workbook' AS object_type, 'wb_'||c_custkey AS object_id,
        CASE WHEN c_nationkey=0 THEN 'AllUsers' ELSE 'grp_'||c_nationkey END AS grantee_id,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'Write' WHEN 'MACHINERY' THEN 'Delete'
        WHEN 'HOUSEHOLD' THEN 'ChangePermissions' ELSE 'Read' END AS capability,
        CASE WHEN c_acctbal<0 THEN 'Deny' ELSE 'Allow' END AS mode FROM customer""",
    "e_refresh": f"""SELECT o_orderkey AS task_id,'ds_'||(o_custkey%{NS}) AS datasource_id,o_orderdate AS completed_at,
        CASE o_orderstatus WHEN 'F' THEN 'Failed' ELSE 'Success' END AS status FROM orders""",
    "e_projection": """SELECT 'ds_'||l_suppkey AS datasource_id,'tbl_'||(l_suppkey%9) AS table_key,
        'c'||(l_partkey%40) AS column_name,
        CASE WHEN min(l_orderkey)%37=0 THEN 'INTEGER' ELSE 'STRING' END AS field_data_type
        FROM lineitem GROUP BY 1,2,3""",
    "e_calc": f"""SELECT 'fld_'||p_partkey AS id, {_name('p_partkey')} AS name,
        CASE p_partkey%5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'note '||p_partkey END AS description,
        'ds_'||(p_partkey%{NS}) AS datasource_id,
        CASE WHEN p_partkey%6=0 THEN 'DIMENSION' ELSE 'MEASURE' END AS role, 'REAL' AS data_type,
        CASE p_size%9 WHEN 0 THEN 'SUM([Sales])' WHEN 1 THEN 'SUM( [sales] ) // net'
        WHEN 2 THEN 'SUM([Amount]) - SUM([Cost])' WHEN 3 THEN 'COUNTD([Customer ID])'
        WHEN 4 THEN '(SUM([Sales]) - SUM([Cost])) / SUM([Sales])'
        WHEN 5 THEN 'SUM(IF [Region] = "EU" THEN [Amount] END)'
        WHEN 6 THEN 'IF ISMEMBEROF("Finance") THEN SUM([Sales]) END'
        WHEN 7 THEN '[' || CASE WHEN p_partkey>={NS} THEN {_name(f'p_partkey-{NS}')} ELSE 'No Such Field' END || '] + 1.0'
        ELSE 'MAX(0.48)' END AS formula, true AS is_calculated FROM part""",
    "e_cols": """SELECT 'col_'||s_suppkey||'_'||i AS id, name,
        CASE WHEN (s_suppkey+i)%3=0 THEN '' ELSE 'column '||i END AS description, 'ds_'||s_suppkey AS datasource_id,
        CASE WHEN i<4 THEN 'MEASURE' ELSE 'DIMENSION' END AS role, CASE WHEN i<4 THEN 'REAL' ELSE 'STRING' END AS data_type,
        NULL::VARCHAR AS formula, false AS is_calculated FROM supplier,
        (VALUES (0,'Sales'),(1,'Amount'),(2,'Cost'),(3,'Region'),(4,'Customer ID')) v(i,name)""",
    "e_fields": "SELECT * FROM e_calc UNION ALL SELECT * FROM e_cols",
    "e_field_usage": f"""SELECT DISTINCT 'fld_'||l_partkey AS field_id,'sh_'||l_linenumber AS sheet_id,
        'wb_'||(l_orderkey%{NP}) AS workbook_id FROM lineitem""",
    "e_raw_usage": """SELECT event_id, CASE WHEN event_id%50=0 THEN 'wbl_'||(event_id%97)
        ELSE 'vw_'||((event_id*event_id)%4201) END AS item_luid, event_type AS event_name, ts AS event_ts, user_id FROM events""",
    # -- derived stages ----------------------------------------------------------
    "luid_map": """SELECT luid, arg_max(workbook_id, pri) AS workbook_id FROM (
        SELECT luid, workbook_id, 0 AS pri FROM e_views UNION ALL SELECT luid, id, 1 FROM e_workbooks) GROUP BY luid""",
    "usage": """SELECT m.workbook_id, count(*)::BIGINT AS event_count, max(event_ts) AS last_ts,
        greatest(0, date_diff('day', max(event_ts)::DATE, DATE '2024-02-01'))::BIGINT AS last_viewed_days_ago
        FROM e_raw_usage u JOIN luid_map m ON m.luid=u.item_luid
        WHERE event_name='view' AND event_ts >= DATE '2024-02-01' - INTERVAL 90 DAY GROUP BY 1""",
    "tokens": r"""SELECT id AS field_id, datasource_id, unnest(regexp_extract_all(formula, '(\[[^\]]*\])', 1)) AS token
        FROM e_calc""",
    "name_index": r"""SELECT datasource_id, lower(trim(name)) AS key, count(DISTINCT id) AS n, min(id) AS ref_id,
        bool_or(is_calculated) AS ref_calc FROM e_fields GROUP BY 1,2""",
    "bound": """SELECT t.field_id, t.token, CASE WHEN n=1 THEN ref_id END AS ref_id, coalesce(n,0)>1 AS ambiguous,
        CASE WHEN n=1 THEN ref_calc END AS ref_calc FROM tokens t LEFT JOIN name_index x
        ON x.datasource_id=t.datasource_id AND x.key=lower(trim(t.token[2:-2]))""",
    "calc_edges": "SELECT DISTINCT field_id, ref_id FROM bound WHERE ref_calc",
    "walk": """SELECT id AS root, id AS node, [id] AS path, 0 AS depth, 0 AS worst FROM e_calc
        UNION ALL SELECT w.root, e.ref_id, list_append(w.path, e.ref_id), w.depth+1,
        CASE WHEN list_contains(w.path, e.ref_id) THEN 3 WHEN w.depth+1>12 THEN 2 ELSE 0 END
        FROM walk w JOIN calc_edges e ON e.field_id=w.node WHERE w.worst=0""",
    "loose": "SELECT DISTINCT field_id FROM bound WHERE ref_id IS NULL",
    "closure": """SELECT root AS field_id, max(depth)+1 AS resolution_depth,
        CASE max(greatest(worst, CASE WHEN l.field_id IS NOT NULL AND worst=0 THEN 1 ELSE 0 END))
        WHEN 0 THEN 'resolved' WHEN 1 THEN 'unresolved_reference' WHEN 2 THEN 'too_deep' ELSE 'cycle' END
        AS resolution_status FROM walk LEFT JOIN loose l ON l.field_id=walk.node GROUP BY root""",
    # at most one calculated reference per formula in this estate: expand it in place
    "expand": """SELECT id AS root, id AS node, formula AS txt, 0 AS depth FROM e_calc
        UNION ALL SELECT x.root, c.id, replace(x.txt, b.token, '(' || c.formula || ')'), x.depth+1
        FROM expand x JOIN bound b ON b.field_id=x.node AND b.ref_calc JOIN e_calc c ON c.id=b.ref_id WHERE x.depth<12""",
    "resolved": f"""SELECT field_id, resolved_formula, resolution_depth, resolution_status, norm,
        CASE WHEN norm='' THEN '' ELSE sha1(norm) END AS normalized_hash FROM (
        SELECT c.*, t.txt AS resolved_formula, {norm_sql('t.txt')} AS norm FROM closure c JOIN
        (SELECT root, arg_max(txt, depth) AS txt FROM expand GROUP BY root) t ON t.root=c.field_id)""",
    "signature": rf"""SELECT field_id, cols, funcs, has_ratio, 'funcs=' || array_to_string(funcs, ',') || '|ratio='
        || has_ratio::INT || '|cols=' || array_to_string(cols, ',') AS definition_key FROM (
        SELECT field_id, list_sort(list_distinct(list_filter(list_transform(
          regexp_extract_all(norm, '\[([^\]]*)\]', 1), lambda c: trim(c)), lambda c: c<>''))) AS cols,
        list_sort(list_distinct(list_filter(regexp_extract_all({_STRIPPED}, '([a-z_][\p{{L}}\p{{N}}_]*)', 1),
          lambda w: list_contains({AGGS}, w)))) AS funcs, contains({_STRIPPED}, '/') AS has_ratio FROM resolved)""",
    "core_defs": """SELECT * FROM (VALUES ('revenue',['revenue']),('active_customer',['active','customer']),
        ('gross_margin',['gross','margin']),('churn_rate',['churn','rate']),
        ('average_order_value',['average','order','value']),('bounce_rate',['bounce','rate']),
        ('win_rate',['win','rate'])) v(label, toks)""",
    "core_tokens": """SELECT label, tok, count(*) OVER (PARTITION BY tok) AS owners, len(toks) AS size
        FROM (SELECT label, toks, unnest(toks) AS tok FROM core_defs)""",
    "name_tokens": f"""SELECT id AS field_id, unnest(list_distinct(list_transform(list_filter(
        regexp_extract_all(lower(name), '([a-z]{{2,}})', 1), lambda t: length(t)>=3 AND NOT list_contains({STOPS}, t)),
        lambda t: CASE WHEN length(t)>3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END))) AS tok FROM e_calc""",
    "core_scores": """SELECT field_id, label, count(*)::DOUBLE/any_value(size) AS coverage, count(*) AS shared,
        count(*)=any_value(size) OR bool_or(owners=1) AS anchored
        FROM name_tokens JOIN core_tokens USING (tok) GROUP BY 1,2""",
    "core_match": """SELECT field_id, label AS core FROM (SELECT *, count(*) OVER (PARTITION BY field_id, coverage, shared) AS ties,
        rank() OVER (PARTITION BY field_id ORDER BY coverage DESC, shared DESC) AS rk FROM core_scores)
        WHERE rk=1 AND ties=1 AND anchored""",
    "field_views": """SELECT field_id, sum(event_count)::BIGINT AS views, count(*)::BIGINT AS workbooks FROM
        (SELECT DISTINCT field_id, workbook_id FROM e_field_usage) JOIN usage USING (workbook_id) GROUP BY 1""",
    "candidates": rf"""SELECT c.id AS field_id, c.name, r.normalized_hash, s.definition_key, m.core,
        CASE WHEN m.core IS NOT NULL THEN 'core:'||m.core ELSE 'solo:'||s.definition_key END AS concept_key,
        coalesce(v.views,0) AS views, coalesce(v.workbooks,0) AS workbooks
        FROM e_calc c JOIN resolved r ON r.field_id=c.id JOIN signature s ON s.field_id=c.id
        LEFT JOIN core_match m ON m.field_id=c.id LEFT JOIN field_views v ON v.field_id=c.id
        WHERE NOT regexp_matches(c.formula, '{USER_CTX}') AND len(s.funcs)>0 AND len(s.cols)>0""",
    "groups": """SELECT *, 'grp_' || lpad(ordinal::VARCHAR, greatest(4, length(ordinal::VARCHAR))::INT, '0') AS group_id FROM (
        SELECT concept_key, coalesce(any_value(core), arg_min(name, (-views, field_id))) AS label,
        count(*)::BIGINT AS variant_count, count(DISTINCT definition_key)::BIGINT AS definition_count,
        CASE WHEN count(DISTINCT nullif(normalized_hash,''))<=1 THEN 'exact_match' ELSE 'formula_signature' END AS method,
        CASE WHEN count(DISTINCT nullif(normalized_hash,''))<=1 THEN 'high' ELSE 'medium' END AS confidence,
        row_number() OVER (ORDER BY count(*) DESC, min(field_id)) AS ordinal FROM candidates GROUP BY concept_key)""",
    "members": """SELECT g.group_id, g.label, c.*, row_number() OVER (PARTITION BY g.group_id ORDER BY views DESC, field_id)
        AS usage_rank FROM candidates c JOIN groups g USING (concept_key)""",
    "def_totals": """SELECT group_id, definition_key, sum(views)::BIGINT AS total, min(usage_rank) AS first_rank
        FROM members GROUP BY 1,2""",
    "def_ranked": """SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY total DESC, first_rank) AS rk,
        sum(total) OVER (PARTITION BY group_id) AS group_total,
        lead(total) OVER (PARTITION BY group_id ORDER BY total DESC, first_rank) AS second FROM def_totals""",
    "dominance": """SELECT group_id, definition_key AS top_key, first_rank, total AS top_total, second, group_total,
        group_total>0 AND total>=0.6::DOUBLE*group_total AND (second IS NULL OR total>=2.0::DOUBLE*second) AS has_dominant
        FROM def_ranked WHERE rk=1""",
    "cover80": """SELECT group_id, CASE WHEN any_value(gt)<=0 THEN 0 ELSE count(*) FILTER (cum-total < 0.8::DOUBLE*gt) END AS cover80
        FROM (SELECT group_id, total, sum(total) OVER w AS cum, sum(total) OVER (PARTITION BY group_id) AS gt FROM def_totals
        WINDOW w AS (PARTITION BY group_id ORDER BY total DESC, definition_key ROWS UNBOUNDED PRECEDING)) GROUP BY 1""",
    "variants": """SELECT m.*, coalesce(d.has_dominant,false) AND m.usage_rank=d.first_rank AS is_dominant
        FROM members m LEFT JOIN dominance d USING (group_id)""",
    "multiplicity": """SELECT group_id, label, method, confidence, variant_count, definition_count, group_views, cover80,
        CASE WHEN used_defs=0 THEN definition_count ELSE used_defs END AS disagreeing, coalesce(wb, 0) AS workbooks_affected,
        CASE WHEN definition_count<2 THEN 'singular' WHEN has_dom THEN 'dominant' ELSE 'contested' END AS dominance
        FROM groups JOIN (SELECT group_id, sum(views)::BIGINT AS group_views, bool_or(is_dominant) AS has_dom,
          count(DISTINCT CASE WHEN views>0 THEN definition_key END)::BIGINT AS used_defs FROM variants GROUP BY 1) USING (group_id)
        JOIN cover80 USING (group_id) LEFT JOIN (SELECT v.group_id, count(DISTINCT f.workbook_id)::BIGINT AS wb FROM variants v
          JOIN e_field_usage f USING (field_id) WHERE trim(coalesce(f.workbook_id,''))<>'' GROUP BY 1) USING (group_id)""",
}


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    known = CTES | (extra or {})
    picked: list[str] = []

    def visit(text: str, stack: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in known and word not in picked and word not in stack:
                visit(known[word], stack + (word,))
                picked.append(word)

    # string literals may contain CTE-like words; a spare CTE costs nothing
    visit(sql, ())
    if not picked:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n]})" for n in picked) + "\n" + sql
