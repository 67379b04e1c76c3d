"""A catalog estate derived from the star-schema tables.

Each table of the audit model is a projection (or one distinct / one aggregate) of a
given table, so an estate built from 100 TB of facts is a 100 TB estate. Frames are
built lazily and only once per ``Estate``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_audit.session import materialize

NOW = "2024-02-01"
RUN_ID = "run_current"

# Names and formulas of the derived calculated fields.
METRIC_NAMES = [
    "Revenue", "Total Revenue", "Net Rev", "Active Customers", "Gross Margin",
    "Churn Rate", "Average Order Value", "Number of Deals", "Bounce Rate", "Margin Adj",
]
FORMULAS = {
    0: "SUM([Sales])",
    1: "SUM( [sales] ) // net",
    2: "SUM([Amount]) - SUM([Cost])",
    3: "COUNTD([Customer ID])",
    4: "(SUM([Sales]) - SUM([Cost])) / SUM([Sales])",
    5: 'SUM(IF [Region] = "EU" THEN [Amount] END)',
    6: 'IF ISMEMBEROF("Finance") THEN SUM([Sales]) END',
    8: "MAX(0.48)",
}
SOURCE_COLUMNS = ["Sales", "Amount", "Cost", "Region", "Customer ID"]
CORE_METRICS = [
    "revenue", "active_customer", "gross_margin", "churn_rate",
    "average_order_value", "bounce_rate", "win_rate",
]


def tagged(prefix: str, key: Column | str) -> Column:
    return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))


def choose(index: Column, values: dict[int, Column]) -> Column:
    out = None
    for i, value in values.items():
        out = F.when(index == i, value) if out is None else out.when(index == i, value)
    return out


def row_count(df: DataFrame) -> Column:
    """Row count of ``df`` as an uncorrelated scalar subquery (stays in the plan)."""
    return df.agg(F.count(F.lit(1))).scalar()


class Estate(Mapping):
    """Lazy mapping of model table name to DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str, now: str = NOW, run_id: str = RUN_ID):
        self.spark, self.sf_dir, self.now, self.run_id = spark, sf_dir, now, run_id
        self.core_metrics = CORE_METRICS
        self._made: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        key = f"raw:{table}"
        if key not in self._made:
            self._made[key] = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return self._made[key]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            builder = getattr(self, f"_{name}", None)
            if builder is None:
                raise KeyError(name)
            self._made[name] = builder()
        return self._made[name]

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Replace a table (a stored stage, or a test's own rows)."""
        self._made[name] = df
        return df

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    # -- content ---------------------------------------------------------------
    def _projects(self):
        return self.raw("nation").select(
            tagged("prj_", "n_nationkey").alias("id"),
            F.col("n_name").alias("name"),
            tagged("reg_", "n_regionkey").alias("parent_id"))

    def _datasources(self):
        k = F.col("s_suppkey")
        owner = (F.when(k % 13 == 0, F.lit(None).cast("string"))
                 .when(k % 17 == 0, F.lit(" ")).otherwise(tagged("user", k % 40)))
        return self.raw("supplier").select(
            tagged("ds_", k).alias("id"), tagged("dsl_", k).alias("luid"),
            F.col("s_name").alias("name"), tagged("prj_", "s_nationkey").alias("project_id"),
            owner.alias("owner"), (F.col("s_acctbal") >= 5000).alias("is_certified"))

    def _workbooks(self):
        k = F.col("p_partkey")
        return self.raw("part").select(
            tagged("wb_", k).alias("id"), tagged("wbl_", k).alias("luid"),
            F.concat_ws(" ", "p_name", k.cast("string")).alias("name"),
            F.col("p_brand").alias("project_name"), tagged("user", k % 40).alias("owner"))

    def _views(self):
        k = F.col("p_partkey")
        pair = F.array(
            F.struct(tagged("vw_", 2 * k).alias("luid"), F.lit("sheet").alias("kind")),
            F.struct(tagged("vw_", 2 * k + 1).alias("luid"), F.lit("dashboard").alias("kind")))
        return (self.raw("part").select(tagged("wb_", k).alias("workbook_id"), F.explode(pair).alias("v"))
                .select("v.luid", "workbook_id", "v.kind"))

    def _custom_sql(self):
        k = F.col("c_custkey")
        table = tagged("t", "c_nationkey")
        text = choose(k % 5, {
            0: F.concat(F.lit("select region, sum(amount) from "), table, F.lit(" group by region")),
            1: F.concat(F.lit("SELECT * FROM "), table, F.lit(" WHERE owner = CURRENT_USER")),
            2: F.concat(F.lit("select * from "), table, F.lit(" where u = USERNAME ( )")),
            3: F.concat(F.lit("select groupby, user from "), table),
            4: F.concat(F.lit("SELECT a FROM "), table, F.lit(" GROUP   BY a HAVING USER() = a")),
        })
        return self.raw("customer").select(
            tagged("csq_", k).alias("id"), text.alias("query"),
            tagged("ds_", k % self._n("supplier")).alias("datasource_id"))

    def _database_tables(self):
        k = F.col("p_partkey")
        return self.raw("part").select(
            tagged("dbt_", k).alias("id"), (F.col("p_size") % 3 == 0).alias("is_embedded"),
            (F.col("p_size") % 4 == 0).alias("is_certified"), (k % 40).alias("column_count"),
            F.col("p_size").cast("bigint").alias("downstream_datasource_count"))

    def _dqw(self):
        k = F.col("c_custkey")
        return self.raw("customer").select(
            tagged("dqw_", k).alias("id"), tagged("dsl_", k % self._n("supplier")).alias("asset_luid"),
            (F.col("c_acctbal") > 9500).alias("is_active"),
            (F.col("c_acctbal") > 9800).alias("is_elevated"),
            F.lit(False).alias("is_severe"), F.col("c_mktsegment").alias("warning_type"))

    # -- edges -----------------------------------------------------------------
    def _lineage(self):
        kind = F.when(F.col("l_returnflag") == "R", "embedded_datasource").otherwise("datasource")
        books = self.raw("lineitem").select(
            "l_partkey", "l_suppkey", kind.alias("upstream_type")).distinct().select(
            F.lit("workbook").alias("downstream_type"), tagged("wb_", "l_partkey").alias("downstream_id"),
            "upstream_type", tagged("ds_", "l_suppkey").alias("upstream_id"))
        k = F.col("s_suppkey")
        up = F.array(
            F.when(k % 10 != 3, F.struct(F.lit("table").alias("upstream_type"),
                                         tagged("tbl_", F.col("s_nationkey") % 9).alias("upstream_id"))),
            F.when((k % 4 == 0) & (k > 0),
                   F.struct(F.lit("datasource").alias("upstream_type"),
                            tagged("ds_", F.floor(k / 4)).alias("upstream_id"))))
        sources = (self.raw("supplier").select(
            F.lit("datasource").alias("downstream_type"), tagged("ds_", k).alias("downstream_id"),
            F.explode(up).alias("u")).filter("u IS NOT NULL")
            .select("downstream_type", "downstream_id", "u.upstream_type", "u.upstream_id"))
        return books.unionByName(sources).withColumn("upstream_label", F.col("upstream_id"))

    def _permissions(self):
        seg = F.col("c_mktsegment")
        return self.raw("customer").select(
            F.lit("workbook").alias("object_type"), tagged("wb_", "c_custkey").alias("object_id"),
            F.lit("group").alias("grantee_type"),
            F.when(F.col("c_nationkey") == 0, "AllUsers").otherwise(tagged("grp_", "c_nationkey")).alias("grantee_id"),
            F.when(seg == "BUILDING", "Write").when(seg == "MACHINERY", "Delete")
            .when(seg == "HOUSEHOLD", "ChangePermissions").otherwise("Read").alias("capability"),
            F.when(F.col("c_acctbal") < 0, "Deny").otherwise("Allow").alias("mode")).distinct()

    def _refresh_jobs(self):
        return self.raw("orders").select(
            F.col("o_orderkey").alias("task_id"),
            tagged("ds_", F.col("o_custkey") % self._n("supplier")).alias("datasource_id"),
            F.col("o_orderdate").alias("completed_at"),
            F.when(F.col("o_orderstatus") == "F", "Failed").otherwise("Success").alias("status"))

    def _projection(self):
        return (self.raw("lineitem").groupBy(
            tagged("ds_", "l_suppkey").alias("datasource_id"),
            tagged("tbl_", F.col("l_suppkey") % 9).alias("table_key"),
            tagged("c", F.col("l_partkey") % 40).alias("column_name"))
            .agg(F.when(F.min("l_orderkey") % 37 == 0, "INTEGER").otherwise("STRING").alias("field_data_type")))

    # -- fields ----------------------------------------------------------------
    def _n(self, table: str) -> Column:
        return row_count(self.raw(table))

    def _calc(self):
        k, n = F.col("p_partkey"), F.col("_ns")

        def named(key):
            label = F.element_at(F.array(*map(F.lit, METRIC_NAMES)), (key % 10 + 1).cast("int"))
            return F.concat_ws(" ", label, key.cast("string"))

        chained = F.concat(F.lit("["), F.when(k >= n, named(k - n)).otherwise("No Such Field"), F.lit("] + 1.0"))
        texts = {i: F.lit(t) for i, t in FORMULAS.items()} | {7: chained}
        note = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit(None)).otherwise(tagged("note ", k))
        return self.raw("part").select("p_partkey", "p_size", self._n("supplier").alias("_ns")).select(
            tagged("fld_", k).alias("id"), named(k).alias("name"), note.alias("description"),
            tagged("ds_", k % n).alias("datasource_id"),
            F.when(k % 6 == 0, "DIMENSION").otherwise("MEASURE").alias("role"),
            F.lit("REAL").alias("data_type"), choose(F.col("p_size") % 9, texts).alias("formula"),
            F.lit(True).alias("is_calculated"))

    def _columns(self):
        k = F.col("s_suppkey")
        cols = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"))
                         for i, c in enumerate(SOURCE_COLUMNS)])
        c = self.raw("supplier").select(k, F.explode(cols).alias("c"))
        i = F.col("c.i")
        return c.select(
            F.concat_ws("_", F.lit("col"), k.cast("string"), i.cast("string")).alias("id"),
            F.col("c.name").alias("name"),
            F.when((k + i) % 3 == 0, F.lit("")).otherwise(tagged("column ", i)).alias("description"),
            tagged("ds_", k).alias("datasource_id"),
            F.when(i < 4, "MEASURE").otherwise("DIMENSION").alias("role"),
            F.when(i < 4, "REAL").otherwise("STRING").alias("data_type"),
            F.lit(None).cast("string").alias("formula"), F.lit(False).alias("is_calculated"))

    def _fields(self):
        return self["calc"].unionByName(self["columns"])

    def _field_usage(self):
        return (self.raw("lineitem")
                .select("l_partkey", "l_linenumber", (F.col("l_orderkey") % self._n("part")).alias("w"))
                .distinct().select(tagged("fld_", "l_partkey").alias("field_id"),
                                   tagged("sh_", "l_linenumber").alias("sheet_id"),
                                   tagged("wb_", "w").alias("workbook_id")))

    # -- usage -----------------------------------------------------------------
    def _raw_usage(self):
        e = F.col("event_id")
        item = F.when(e % 50 == 0, tagged("wbl_", e % 97)).otherwise(tagged("vw_", (e * e) % 4201))
        return self.raw("events").select(
            "event_id", item.alias("item_luid"), F.col("event_type").alias("event_name"),
            F.col("ts").alias("event_ts"), "user_id")

    def _usage_events(self):
        from catalog_audit.operators.usage import usage_rollup
        return self._stage("usage", usage_rollup(self, now=self.now, window_days=90))

    # -- stored stages: each is written once and read by many operators ---------
    def _stage(self, name: str, df: DataFrame) -> DataFrame:
        return materialize(df, name)

    def _bindings(self):
        from catalog_audit.operators.graph import token_bind
        return self._stage("bindings", token_bind(self))

    def _resolved(self):
        from catalog_audit.functions.formula import with_signature
        from catalog_audit.operators.graph import resolve_formulas
        return self._stage("resolved", with_signature(resolve_formulas(self), "norm"))

    def _field_views(self):
        from catalog_audit.operators.usage import field_views
        return field_views(self)

    def _candidates(self):
        from catalog_audit.operators.groups import grouping_candidates
        return self._stage("candidates", grouping_candidates(self, self.core_metrics))

    def _groups(self):
        from catalog_audit.operators.groups import metric_groups
        return self._stage("groups", metric_groups(self))

    def _ranked(self):
        from catalog_audit.operators.ranking import usage_rank
        return self._stage("ranked", usage_rank(self))

    def _variants(self):
        from catalog_audit.operators.ranking import rank_groups
        return self._stage("variants", rank_groups(self))

    def _multiplicity(self):
        from catalog_audit.plans.findings import definition_multiplicity
        return self._stage("multiplicity", definition_multiplicity(self))

    def _outcomes(self):
        from catalog_audit.plans.rules import evaluate_rules
        return self._stage("outcomes", evaluate_rules(self))

    def _facets(self):
        from catalog_audit.plans.scoring import score_facets
        return self._stage("facets", score_facets(self))

    # -- configuration ---------------------------------------------------------
    def _coverage(self):
        """What the landed pages show to be measured; rules, facets and findings read it."""
        from catalog_audit.sources.feeds import stored_register
        return stored_register(self)

    def _interview(self):
        from catalog_audit.sources.config_inputs import load_interview
        return load_interview(self.spark, {"responses": INTERVIEW})

    def _domains(self):
        return self.spark.createDataFrame(DOMAINS, "id string, target_stage int")


# Interview answers and declared domains of the derived estate.
INTERVIEW = [
    {"facet": "governance.preventive", "score": 4, "note": "checked each quarter", "source_role": "access_admin"},
    {"facet": "governance.detective", "score": 4, "note": "mails on failure", "source_role": "platform_owner"},
    {"facet": "governance.corrective", "score": 3, "note": "case by case", "source_role": "platform_owner"},
    {"facet": "semantic.singularity", "score": 5, "note": "shared list kept", "source_role": "report_owner"},
    {"facet": "semantic.consensus", "score": 2, "note": "totals differ", "source_role": "controller"},
]
DOMAINS = [("revenue_ops", 5), ("all", 3)]

TABLES = [
    "projects", "datasources", "workbooks", "views", "fields", "field_usage", "custom_sql",
    "database_tables", "projection", "dqw", "lineage", "permissions", "refresh_jobs",
    "raw_usage", "usage_events", "coverage", "interview", "domains",
]
