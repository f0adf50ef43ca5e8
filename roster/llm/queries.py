"""One query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roster.llm import (
    fingerprints, merkle, mixing, ngram_join, oracles, packing, pii, quality_classifier, quality_rules, spelling,
    substring_dedup, toxicity, url_filters, warc,
)
from roster.llm.common import query, table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_ngram_join")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), word_tokenizer())


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_fingerprints")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.against_next(table(spark, folder, "documents"))


@query("op5_pii")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.find(docs, pii.train(docs)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"
    )


@query("op6_quality_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


@query("op7_quality_classifier")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_mixing", """
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
        FROM documents
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
            [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
        FROM sized GROUP BY source
    ), shares AS (
        SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight,
                source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
        FROM sources
    ), level AS (SELECT max(share) AS share FROM shares),
    plan AS (
        SELECT source, source_size, least(3.0::DOUBLE * source_size, level.share * weight) AS target
        FROM shares, level
    ), budgets AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM plan
    ), bars AS (SELECT source, h, sum(size) AS bar FROM sized WHERE size > 0 GROUP BY source, h),
    reach AS (
        SELECT b.source, h, bar, sum(bar) OVER (PARTITION BY b.source ORDER BY h) AS reach,
            target - copies * source_size AS budget
        FROM bars b JOIN budgets p ON b.source IS NOT DISTINCT FROM p.source
    ), ends AS (
        SELECT source, coalesce(min(h) FILTER (reach >= budget), max(h)) AS h FROM reach GROUP BY source
    ), limits AS (
        SELECT r.source, r.h + CASE WHEN r.reach - budget <= budget - (r.reach - bar) THEN 1 ELSE 0 END AS cut
        FROM reach r JOIN ends e ON r.source IS NOT DISTINCT FROM e.source AND r.h = e.h
    )
    SELECT doc_id, size, source_size, target,
        ((copies + CASE WHEN s.h < coalesce(cut, 0) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
    FROM sized s JOIN budgets p ON s.source IS NOT DISTINCT FROM p.source
    LEFT JOIN limits l ON s.source IS NOT DISTINCT FROM l.source
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_warc", """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS digest,
            coalesce(html, '') AS payload
        FROM pages
    ), owners AS (SELECT payload, max(page_id) AS owner FROM p WHERE bytes >= 1000 GROUP BY payload HAVING count(*) > 1)
    SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest,
        CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN owner <> page_id THEN owner END AS refers_to
    FROM p LEFT JOIN owners USING (payload)
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query("op10_substring_dedup", """
    WITH d AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), windows AS (
        SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
    ), firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
    gone AS (
        SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS cut
        FROM windows JOIN firsts USING (h) WHERE doc_id > first GROUP BY doc_id
    ), kept AS (
        SELECT doc_id, len(w) AS n, CASE WHEN cut IS NULL THEN w
            ELSE list_filter(w, lambda x, i: NOT list_contains(cut, i)) END AS k
        FROM d LEFT JOIN gone USING (doc_id)
    )
    SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed,
        sha256(array_to_string(k, ' ')) AS kept_sha256
    FROM kept
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    removed = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return removed.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op11_spelling", oracles.OP11)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query("op12_manifest", oracles.OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    lowered = F.translate("text", merkle.UPPER, merkle.UPPER.lower())
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.verified(table(spark, folder, "documents"), {"text": lowered}, touched)


RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


@query("op13_url_filters", oracles.OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, folder, "pages"), rules)
