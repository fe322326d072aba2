"""Fingerprints, redaction, repeated and oversized results, coverage of fields, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.functions import text
from meterloom.operators import aggregates
from meterloom.plans.registry import query, table


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS bytes, CASE WHEN octet_length(encode(text)) >= 16 THEN sha256(text) END AS fingerprint FROM documents")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes"), text.fingerprint("text").alias("fingerprint"))


#: The forms that the SQL knows; tests hold the others to literal texts, since DuckDB has no lookahead.
_SQL_SECRETS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"(?i)bearer\s+[A-Za-z0-9._~+/-]{8,}=*", "[bearer]"),
    (r"\b(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{8,}", "[key]"),
    (r"""(?i)((?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|authorization|credential)[A-Za-z0-9_-]*["'']?\s*[:=]\s*["'']?)[^"''\s,;&}\]]+""", r"\1[REDACTED]"),
)


def _redacted_sql() -> str:
    found = "text"
    for pattern, stand_in in _SQL_SECRETS:
        found = f"regexp_replace({found}, '{pattern}', '{stand_in}', 'g')"
    return f"SELECT doc_id, substr({found}, 1, 200) AS shown FROM documents"


@query(_redacted_sql())
def redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redacted("text").alias("shown"))


@query("SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')), 1, 160) AS shown FROM pages")
def page_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.excerpt("html").alias("shown"))


@query("""WITH m AS (SELECT DISTINCT p_name AS name, md5('app-project-name:' || lower(trim(p_name, ' '))) AS m FROM part)
    SELECT name, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-4' || substr(m, 14, 3) || '-8' || substr(m, 18, 3) || '-' || substr(m, 21, 12) AS id FROM m""")
def name_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("id", text.name_id("name"))


@query("""SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id, max(octet_length(encode(text)))::INTEGER AS bytes FROM documents
    WHERE octet_length(encode(text)) >= 64 GROUP BY sha256(text) HAVING count(*) >= 2""")
def repeated_result(spark, sf_dir):
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").where(size >= 64).groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max(size).alias("bytes")).where("copies >= 2")


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS bytes FROM documents WHERE octet_length(encode(text)) >= 16384")
def oversized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes")).where("bytes >= 16384")


@query("""SELECT source, CASE WHEN count(quality) = count(*) THEN 'present' WHEN count(quality) = 0 THEN 'absent' ELSE 'partial' END AS quality_state,
        CASE WHEN count(lang) = count(*) THEN 'present' WHEN count(lang) = 0 THEN 'absent' ELSE 'partial' END AS lang_state FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def field_coverage(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return aggregates.field_coverage(joined, ["source"], ["quality", "lang"])


@query("""SELECT source, count(*) AS n, count(toxic) AS labelled, CASE WHEN count(toxic) > 0 THEN CAST(sum(toxic) AS BIGINT) / count(toxic) END AS toxic_share,
    count(toxic) / count(*) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def coverage_ratio(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sums = joined.groupBy("source").agg(F.count("*").alias("n"), F.count("toxic").alias("labelled"), F.sum("toxic").alias("toxic"))
    return sums.select("source", "n", "labelled", aggregates.ratio(F.col("toxic"), F.col("labelled")).alias("toxic_share"), aggregates.ratio(F.col("labelled"), F.col("n")).alias("coverage"))


@query("""SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS depth, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations""")
def turn_chain(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.row_number().over(w) - 1).alias("depth"), F.lag("turn").over(w).alias("parent"))
