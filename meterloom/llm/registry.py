"""Each operator's query over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import bpe_codec, exact_dedup, fill_in_middle, language_id, license_scan, line_dedup, packing, quality, simhash_dedup, source_divergence, token_counts, topk_search, toxicity
from meterloom.llm.common import crc32_of_id, table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def _known(held_out: Column) -> Column:
    """A row without doc_id has no remainder: nothing is learned from it, and it is not held out."""
    return F.coalesce(held_out, F.lit(False))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text, and whether they pass 1,024."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts; a row for each document."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens, a row for each piece."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), size=2048, end=1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose crc32(doc_id) mod 4 is 2 are held out, as for quality."""
    docs, held_out = table(spark, sf_dir, "documents", "doc_id", "text"), crc32_of_id() % 4 == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return toxicity.classify(docs, labels, ~held_out).withColumn("held_out", _known(held_out))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's own licence, or what the nearest directory above grants."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return license_scan.inherit(license_scan.scan(docs.select("doc_id", license_scan.document_path().alias("path"), "text")))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and components of those within 3 bits."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts; rows whose crc32(doc_id) mod 5 is 0 are not learned from."""
    docs, held_out = table(spark, sf_dir, "documents", "doc_id", "text", "lang"), crc32_of_id() % 5 == 0
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs, model).select("doc_id", _known(held_out).alias("held_out"), "lang_pred", "score", "rejected")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to."""
    return bpe_codec.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(BYTE_BPE))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest scores of every hundredth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores; rows whose crc32(doc_id) mod 4 is 2 are not learned from."""
    docs, held_out = table(spark, sf_dir, "documents", "doc_id", "text"), crc32_of_id() % 4 == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return quality.classify(docs, labels, ~held_out, threshold=0.7).select("doc_id", _known(held_out).alias("held_out"), "score", "predicted")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is from the others of its language, and its most telling terms."""
    return source_divergence.audit(table(spark, sf_dir, "documents", "text", "lang", "source"), least_documents=30, smooth=5, terms_shown=50)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that 5 documents share stay in the last of them; a row for each document."""
    found = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents", "doc_id", "text"), least_chars=40, least_documents=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut by lines and put in order for filling in, with digests of that and of the text rebuilt from it."""
    found = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"), seed=7, rate=100, spm_rate=50, unit="line")
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_EXACT_SQL = r"""
    WITH d AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    ), g AS (
        SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

_TOP_SQL = """
    WITH v AS (
        SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
        FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.row <> c.row
    ), r AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

_DIVERGENCE_SQL = r"""
    WITH d AS (
        SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
    c AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, lang_n FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS terms FROM c),
    p AS (
        SELECT lang, source, term, n,
            CAST(1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (total + 5 * terms) AS BIGINT) AS p,
            CAST(1 + (1000000000 * CAST(lang_n + 5 AS HUGEINT)) // (lang_total + 5 * terms) AS BIGINT) AS q
        FROM s
    ), v AS (
        SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(w.value, 0) AS BIGINT) AS value
        FROM g JOIN g AS o ON g.lang = o.lang AND g.source <> o.source
        LEFT JOIN (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ) AS w ON w.lang = g.lang AND w.source = g.source AND w.item = o.source
        UNION ALL
        SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM v)
    SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""

_LINES_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
    k AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM l
    ), shared AS (
        SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT row, doc_id, key FROM k WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5
    ), m AS (SELECT k.*, shared.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS goes FROM k LEFT JOIN shared USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
    FROM m GROUP BY row"""

_MIDDLE_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS draws FROM d),
    c AS (SELECT *, len(units) AS n, draws[1] % (len(units) + 1) AS a, draws[2] % (len(units) + 1) AS b FROM u),
    f AS (
        SELECT *, array_to_string(units[: least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1 : greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1 :], '') AS suffix,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draws[3] % 100 >= 100 THEN 'plain' WHEN draws[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM c
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
        CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM f"""


def queries() -> dict:
    found = (
        op1_token_counts,
        op2_exact_dedup,
        op3_packing,
        op4_toxicity,
        op5_license_scan,
        op6_simhash_dedup,
        op7_language_id,
        op8_bpe_codec,
        op9_topk_search,
        op10_quality,
        op11_source_divergence,
        op12_line_dedup,
        op13_fill_in_middle,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": _EXACT_SQL,
        "op9_topk_search": _TOP_SQL,
        "op11_source_divergence": _DIVERGENCE_SQL,
        "op12_line_dedup": _LINES_SQL,
        "op13_fill_in_middle": _MIDDLE_SQL,
    }
