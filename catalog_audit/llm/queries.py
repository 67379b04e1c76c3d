"""The queries of this subpackage by name, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_audit.llm import align, byte_bpe, exact_dedup, html_text, language_id, lm_score, mixing, near_dedup, ngram_join, perplexity, quality_rules, repair, url_filter
from catalog_audit.llm.text import small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"), keep=("doc_id",))
    c = F.col("counts")
    return judged.select("row.doc_id", c["n_words"].alias("n_words"), *[c[x].alias(x) for x in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         "base_failed", "kept", "reason")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op1_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t"""


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_components(table(spark, sf_dir, "documents"), k=2, threshold=0.8)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


@query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.replicate(table(spark, sf_dir, "documents"))
    return drawn.select("row.*", "copy", "copies")


def token_digests(docs: DataFrame, share: int = 1) -> DataFrame:
    """Per document the number of ids, their digest, and the digest of what they decode to."""
    made = docs.select("doc_id", byte_bpe.ByteBpe(small_batches(docs), share=share).round_trip(F.col("text")).alias("t"))
    return made.select("doc_id", (F.octet_length("t.ids") / 4).cast("long").alias("n_tokens"), F.sha2("t.ids", 256).alias("ids_sha256"),
                       F.sha2("t.decoded", 256).alias("decoded_sha256"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), keep=("page_id",))
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "score")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept_out = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    told = language_id.identify(docs.withColumn("held_out", kept_out), model, keep=("doc_id", "held_out"))
    return told.select("row.doc_id", "row.held_out", "lang_pred", "score")


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), keep=("page_id", "url"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


@query
def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return perplexity.judge_perplexity(table(spark, sf_dir, "documents"), trusted)


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(repair.damage(table(spark, sf_dir, "conversations")))


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = align.align(table(spark, sf_dir, "documents"))
    return rated.select("row.doc_id", *[c for c in rated.columns if c != "row"])


@query
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, threshold=0.9)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


#: Every pair that shares a shingle is counted here, which small tables allow.
ORACLES["op7_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.k + q.k - c)),
ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, ways.y FROM reach JOIN ways ON ways.x = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.k, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLES["op13_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.k + q.k - c)),
ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, ways.y FROM reach JOIN ways ON ways.x = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.k, 0) AS n_shingles, component_id FROM w JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)"""
