"""Queries p3_ to p8_ over training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import canon, leakage, packing, privacy, repair, truncation
from pagemill.plans.base import tuned
from pagemill.sources.tables import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    values = canon.corpus_values(table(spark, sf, "exams"), table(spark, sf, "pages"))
    return canon.unstable_values(values, "value").select("field", "record_id", "block_idx").distinct()


def p3_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles in their consistent form, with the number of exams and of spellings each has."""
    tuned(spark)
    t = canon.canonicalize(table(spark, sf, "exams").select("id", "title").where("title is not null"), "title")
    return t.groupBy("canonical").agg(F.countDistinct("id").alias("n_exams"), F.countDistinct("title").alias("n_spellings"))


def p3_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every block text of `pages` in its consistent form, once: page_id, block_idx, canonical, changed."""
    tuned(spark)
    pages = table(spark, sf, "pages")
    v = canon.canonicalize(canon.corpus_values(table(spark, sf, "exams").limit(0), pages), "value")
    return v.select(F.col("record_id").alias("page_id"), "block_idx", "canonical", (F.col("canonical") != F.col("value")).alias("changed")).distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    return truncation.cut_blocks(table(spark, sf, "pages")).select("page_id", "block_idx")


def p4_sources(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    return truncation.truncation_report(table(spark, sf, "pages"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    return repair.found_noise(table(spark, sf, "pages"))


def p5_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    return repair.continuous_paragraphs(table(spark, sf, "pages"))


def p6_assignment(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    return packing.pack_all(table(spark, sf, "documents"), table(spark, sf, "pack_target"))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    targets = table(spark, sf, "pack_target")
    return packing.pack_report(packing.pack_all(table(spark, sf, "documents"), targets), targets)


def p6_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What every packing must keep: documents, parts and tokens of each target, and no container above its capacity."""
    tuned(spark)
    targets = table(spark, sf, "pack_target")
    return packing.pack_totals(packing.pack_all(table(spark, sf, "documents"), targets), targets)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    return leakage.leaked_pairs(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    return leakage.leak_report(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the documents that stay after removal."""
    tuned(spark)
    return leakage.without_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_item")).select("doc_id", "source")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    return privacy.mentions(table(spark, sf, "documents")).select("doc_id", "kind", "start_pos")


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    return privacy.redact(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "redacted")


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_titles, p3_texts, p4_found, p4_sources, p5_found, p5_paragraphs, p6_assignment, p6_report, p6_totals, p7_found, p7_items, p7_clean, p8_found, p8_redacted)
}
_WORDS = "regexp_extract_all(lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'd')), '[\\p{L}\\p{N}]+')"
_GRAMS = "SELECT {0}, i, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {0}, " + _WORDS + " AS w FROM {1}))"
_LEAKS = f"""WITH d AS ({_GRAMS.replace('{0}', 'doc_id').replace('{1}', 'documents')}), t AS ({_GRAMS.replace('{0}', 'item_id').replace('{1}', 'eval_item')}),
leaks AS (SELECT DISTINCT doc_id, item_id FROM d JOIN t USING (g))"""

SQL: dict[str, str] = {
    "p6_totals": """WITH s AS (SELECT coalesce(CASE WHEN n_tokens >= 0 THEN n_tokens END, strlen(text) + 1, 1)::BIGINT AS size FROM documents)
SELECT target_id, count(*) AS n_docs, sum(greatest(1, ceil(size / capacity_tokens)))::BIGINT AS n_parts, sum(size)::BIGINT AS n_tokens, 0::BIGINT AS n_overfull
FROM s, pack_target WHERE capacity_tokens > 0 GROUP BY target_id""",
    # Common 12-grams at consecutive places of both texts make one match of 11 words more than there are of them.
    "p7_items": f"""{_LEAKS}, m AS (SELECT DISTINCT d.doc_id, t.item_id, d.i, t.i AS j FROM d JOIN t USING (g)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM m),
l AS (SELECT item_id, doc_id, max(n) + 11 AS longest FROM (SELECT item_id, doc_id, i - j, island, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL)
SELECT item_id, split_name, count(*) AS n_docs, max(longest)::INT AS longest, round(max(longest) / len({_WORDS}), 4) AS share FROM l JOIN eval_item USING (item_id) GROUP BY item_id, split_name, text""",
    "p7_found": f"{_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p7_clean": f"{_LEAKS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
}
