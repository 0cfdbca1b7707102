"""Queries p1_ and p2_: nested records and orphan references, with SQL for the checkable ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import nested, orphans
from pagemill.plans.base import tuned
from pagemill.sources.tables import norm_key, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    tuned(spark)
    return nested.found_blocks(table(spark, sf, "pages"), table(spark, sf, "page_payload"))


def _flat(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        tuned(spark)
        return nested.flat_tables(table(spark, sf, "pages"), table(spark, sf, "page_payload"))[name]

    return run


def p1_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The flat block table of both origins with content and the keys of the parent page and exam."""
    return _flat("blocks")(spark, sf)


def p1_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The flat page table of both origins with the key of the parent exam; pages without a result included."""
    return _flat("pages")(spark, sf)


def p1_exams(spark: SparkSession, sf: str) -> DataFrame:
    """The flat exam table of both origins; titles stand in payloads only. Pages without an exam id have the exam null."""
    return _flat("exams")(spark, sf)


def p1_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Every page, ocr result and block of both origins with the kind (and path) of its direct parent, from intervals and depth alone."""
    return _flat("links")(spark, sf)


def _cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans of the graph exams, storage_object <- pages <- page_result -> exams; keys in the form they are compared in."""
    t = lambda name: table(spark, sf, name)
    at = lambda c: F.col(c).cast("timestamp").alias("at")
    cells = ("exam_id", "page_id", "ok", "error", "arrived_at")
    as_text = lambda c: F.coalesce((F.unix_micros(c) if c == "arrived_at" else F.col(c)).cast("string"), F.lit("∅"))
    tables = {
        "exams": t("exams").select(norm_key("id").alias("row_key"), at("uploaded_at")),
        "storage_object": t("storage_object").select(norm_key("name").alias("row_key"), at("created_at")),
        "pages": t("pages").select(F.col("id").alias("row_key"), at("landed_at"), norm_key("exam_id").alias("exam_id"), norm_key("file_path").alias("file_path")),
        "page_result": t("page_result").select(F.concat_ws("|", *[as_text(c) for c in cells]).alias("row_key"), at("arrived_at"), norm_key("exam_id").alias("exam_id"), "page_id"),
    }
    key = orphans.ForeignKey
    keys = [key("pages", "exam_id", "exams", "row_key", "exam"), key("pages", "file_path", "storage_object", "row_key", "object"), key("page_result", "exam_id", "exams", "row_key", "exam"), key("page_result", "page_id", "pages", "row_key")]
    log = t("deletion_log").select(F.lower("entity").alias("entity"), norm_key("key_value").alias("key"))
    return orphans.orphan_cascade(tables, keys, log)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The direct orphans among the references of pages."""
    tuned(spark)
    c = _cascade(spark, sf).where("`table` = 'pages' and kind = 'direct'")
    return c.select(F.col("row_key").alias("page_id"), "field", "state")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Direct and inherited orphans per table, field and month."""
    tuned(spark)
    return orphans.orphan_report(_cascade(spark, sf))


def p2_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Every orphan reference of pages and page results, and every page result below an orphaned page."""
    tuned(spark)
    return _cascade(spark, sf).drop("at")


QUERIES = {f.__name__: f for f in (p1_found, p1_exams, p1_pages, p1_blocks, p1_parents, p2_found, p2_report, p2_cascade)}

_KEY = "lower(regexp_replace({}, '^\\s*/*\\s*|\\s+$', '', 'g'))"
_RESULT_KEY = "concat_ws('|', coalesce(exam_id, '∅'), coalesce(page_id, '∅'), coalesce(CAST(ok AS VARCHAR), '∅'), coalesce(error, '∅'), coalesce(CAST(epoch_us(arrived_at) AS VARCHAR), '∅'))"
_REFS = f"""
refs AS (
  SELECT id AS row_key, 'pages' AS tab, 'exam_id' AS field, 'exams' AS parent, {_KEY.format('exam_id')} AS k, min(landed_at) AS came FROM pages WHERE exam_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT id, 'pages', 'file_path', 'objects', {_KEY.format('file_path')}, min(landed_at) FROM pages WHERE file_path IS NOT NULL GROUP BY ALL
  UNION ALL SELECT {_RESULT_KEY}, 'page_result', 'exam_id', 'exams', {_KEY.format('exam_id')}, min(arrived_at) FROM page_result WHERE exam_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT {_RESULT_KEY}, 'page_result', 'page_id', 'pages', page_id, min(arrived_at) FROM page_result WHERE page_id IS NOT NULL GROUP BY ALL),
there AS (
  SELECT 'exams' AS parent, {_KEY.format('id')} AS k, min(uploaded_at) AS born FROM exams GROUP BY ALL
  UNION ALL SELECT 'objects', {_KEY.format('name')}, min(created_at) FROM storage_object GROUP BY ALL
  UNION ALL SELECT 'pages', id, min(landed_at) FROM pages GROUP BY ALL),
gone AS (SELECT DISTINCT CASE entity WHEN 'exam' THEN 'exams' ELSE 'objects' END AS parent, {_KEY.format('key_value')} AS k FROM deletion_log WHERE entity IN ('exam', 'object')),
direct AS (
  SELECT r.tab, r.row_key, r.field, r.came,
    CASE WHEN t.k IS NOT NULL THEN 'late' WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state
  FROM refs r LEFT JOIN there t USING (parent, k) LEFT JOIN gone g USING (parent, k)
  WHERE t.k IS NULL OR t.born > r.came),
below AS (
  SELECT row_key, min(came) AS came FROM refs r WHERE tab = 'page_result' AND field = 'page_id' AND k IN (SELECT row_key FROM direct WHERE tab = 'pages' AND state <> 'late')
    AND row_key NOT IN (SELECT row_key FROM direct WHERE tab = 'page_result') GROUP BY row_key),
orphans AS (
  SELECT tab AS "table", row_key, field, 'direct' AS kind, state, 0 AS round, came FROM direct
  UNION ALL SELECT 'page_result', row_key, 'page_id', 'inherited', 'inherited', 1, came FROM below)"""

#: A JSON value as a list of entries: a list, the values of a {"1": ...} map, or a lone object.
_LIST = (
    "CASE json_type({0}) WHEN 'ARRAY' THEN from_json({0}, '[\"json\"]') WHEN 'OBJECT' THEN "
    "CASE WHEN len(json_keys({0})) > 0 AND len(list_filter(json_keys({0}), lambda k: NOT regexp_full_match(k, '\\d+'))) = 0 "
    "THEN list_transform(list_sort(json_keys({0}), 'ASC'), lambda k: json_extract({0}, '$.\"' || k || '\"')) ELSE [{0}] END ELSE []::JSON[] END"
)
_OPEN = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid(({0}) ->> '$') THEN (({0}) ->> '$')::JSON ELSE {0} END"
_PAYLOAD = f"""
docs AS (SELECT payload::JSON AS j, (received_at, payload_id) AS d FROM page_payload WHERE json_valid(payload)),
roots AS (SELECT d, unnest(CASE json_type(j) WHEN 'ARRAY' THEN from_json(j, '["json"]') ELSE [j] END) AS j FROM docs),
ex0 AS (SELECT d, coalesce(j -> '$.data.exam', j -> '$.exam', j) AS e FROM roots),
ex AS (SELECT d, e, lower(trim(coalesce(e ->> '$.id', e ->> '$.exam_id', e ->> '$.examId'))) AS exam_id FROM ex0),
pg AS (SELECT d, exam_id, unnest({_LIST.format("(e -> '$.pages')")}) AS p FROM ex),
oc AS (SELECT d, exam_id, coalesce(p ->> '$.id', p ->> '$.page_id', p ->> '$.pageId') AS page_id, p, {_OPEN.format("coalesce(p -> '$.ocr_text', p -> '$.ocrText')")} AS o FROM pg WHERE json_type(p) = 'OBJECT'),
ls AS (SELECT d, exam_id, page_id, {_LIST.format("(o -> '$.layouts')")} AS l FROM oc),
bl AS (
  SELECT d, exam_id, page_id, (i - 1)::VARCHAR AS block_path, NULL::VARCHAR AS parent_path, l[i] AS b FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ls)
  UNION ALL
  SELECT d, exam_id, page_id, block_path || '.' || (i - 1), block_path, k[i] FROM (
    SELECT *, unnest(range(1, len(k) + 1)) AS i FROM (SELECT d, exam_id, page_id, block_path, {_LIST.format("(b -> '$.children')")} AS k FROM bl WHERE json_type(b) = 'OBJECT'))),
pr AS (SELECT DISTINCT {_KEY.format('exam_id')} AS exam_id, id AS page_id, page_order::INT AS page_order, ocr_text FROM pages QUALIFY row_number() OVER (PARTITION BY id) = 1),
pb AS (SELECT exam_id, page_id, unnest(ocr_text.layouts) AS b, (generate_subscripts(ocr_text.layouts, 1) - 1)::VARCHAR AS block_path FROM pr)"""
_INT = "TRY_CAST({0} ->> '$' AS INT)"
_BOX = """CASE json_type(b -> '$.bbox') WHEN 'ARRAY' THEN from_json(b -> '$.bbox', '["double"]') WHEN 'VARCHAR' THEN list_transform(string_split_regex(trim(b ->> '$.bbox'), '\\s+'), lambda x: x::DOUBLE) ELSE []::DOUBLE[] END"""

SQL = {
    "p1_found": f"""WITH RECURSIVE {_PAYLOAD}
SELECT DISTINCT 'page_payload' AS origin, exam_id, page_id, block_path FROM bl WHERE json_type(b) = 'OBJECT'
UNION ALL SELECT DISTINCT 'pages', exam_id, page_id, block_path FROM pb WHERE b IS NOT NULL""",
    "p1_exams": f"""WITH RECURSIVE {_PAYLOAD}
SELECT 'page_payload' AS origin, exam_id, arg_max(e ->> '$.title', d) AS title FROM ex WHERE json_type(e) = 'OBJECT' GROUP BY exam_id
UNION ALL SELECT DISTINCT 'pages', exam_id, NULL FROM pr""",
    "p1_pages": f"""WITH RECURSIVE {_PAYLOAD}
SELECT 'page_payload' AS origin, exam_id, page_id, arg_max({_INT.format("coalesce(p -> '$.page_order', p -> '$.pageOrder', p -> '$.order')")}, d) AS page_order FROM oc GROUP BY exam_id, page_id
UNION ALL SELECT 'pages', exam_id, page_id, page_order FROM pr""",
    "p1_blocks": f"""WITH RECURSIVE {_PAYLOAD},
last AS (SELECT exam_id, page_id, block_path, arg_max(b, d) AS b FROM bl WHERE json_type(b) = 'OBJECT' GROUP BY ALL)
SELECT 'page_payload' AS origin, exam_id, page_id, block_path, b ->> '$.category' AS category, {_INT.format("(b -> '$.level')")} AS level, {_BOX} AS bbox, b ->> '$.text' AS text FROM last
UNION ALL SELECT 'pages', exam_id, page_id, block_path, b.category, b."level", b.bbox, b."text" FROM pb WHERE b IS NOT NULL""",
    "p1_parents": f"""WITH RECURSIVE {_PAYLOAD}
SELECT DISTINCT 'page_payload' AS origin, exam_id, page_id, 'block' AS kind, block_path, CASE WHEN parent_path IS NULL THEN 'ocr' ELSE 'block' END AS parent_kind, parent_path FROM bl WHERE json_type(b) = 'OBJECT'
UNION ALL SELECT DISTINCT 'page_payload', exam_id, page_id, 'ocr', NULL, 'page', NULL FROM oc WHERE json_type(o) = 'OBJECT'
UNION ALL SELECT DISTINCT 'page_payload', exam_id, page_id, 'page', NULL, 'exam', NULL FROM oc
UNION ALL SELECT 'pages', exam_id, page_id, 'page', NULL, 'exam', NULL FROM pr
UNION ALL SELECT 'pages', exam_id, page_id, 'ocr', NULL, 'page', NULL FROM pr WHERE ocr_text IS NOT NULL
UNION ALL SELECT 'pages', exam_id, page_id, 'block', block_path, 'ocr', NULL FROM pb WHERE b IS NOT NULL""",
    "p2_found": f"WITH {_REFS} SELECT row_key AS page_id, field, state FROM orphans WHERE \"table\" = 'pages' AND kind = 'direct'",
    "p2_report": f"WITH {_REFS} SELECT \"table\", field, strftime(came AT TIME ZONE 'UTC', '%Y-%m') AS month, kind, state, count(*) AS n FROM orphans GROUP BY ALL",
    "p2_cascade": f'WITH {_REFS} SELECT "table", row_key, field, kind, state, round FROM orphans',
}
