"""Registered queries for scans, filters, aggregates, mutations, dispatch and geometry, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import markup, text
from pagemill.operators import dispatch, geometry, layout, mutations
from pagemill.plans import render
from pagemill.plans.base import tuned
from pagemill.schema import LABELS, STATUSES
from pagemill.sources.tables import blocks, distinct_pages, latest_exams, norm_key, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2025-12-31 12:00:00"

_KEY = "lower(regexp_replace({}, '^\\s*/*\\s*|\\s+$', '', 'g'))"
_VIEWS = f"""
WITH RECURSIVE e AS (SELECT * FROM exams QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
p AS (SELECT *, {_KEY.format('exam_id')} AS exam FROM pages QUALIFY row_number() OVER (PARTITION BY id) = 1),
u AS (SELECT id AS page_id, exam, page_order::INT AS page_order, ocr_text.origin_width AS ow, ocr_text.origin_height AS oh, ocr_text.input_width AS iw,
  ocr_text.input_height AS ih, unnest(ocr_text.layouts) AS l, (generate_subscripts(ocr_text.layouts, 1) - 1)::INT AS block_idx FROM p),
b AS (SELECT exam AS exam_id, page_id, page_order, ow, oh, iw, ih, block_idx, l.category AS category, l."text" AS text, l."level" AS level, len(l.bbox)::INT AS n_box,
  CASE WHEN len(l.bbox) = 4 THEN l.bbox[1] END AS x1, CASE WHEN len(l.bbox) = 4 THEN l.bbox[2] END AS y1, CASE WHEN len(l.bbox) = 4 THEN l.bbox[3] END AS x2,
  CASE WHEN len(l.bbox) = 4 THEN l.bbox[4] END AS y2 FROM u WHERE l IS NOT NULL),
o AS (SELECT * FROM storage_object QUALIFY row_number() OVER (PARTITION BY bucket_id, name ORDER BY created_at DESC, metadata NULLS LAST) = 1)
"""


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL over the views e, p, b and o."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf: f(_Tables(tuned(spark), sf))
        if sql:
            SQL[f.__name__] = _VIEWS + sql
        return f

    return put


class _Tables:
    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name)

    @property
    def e(self) -> DataFrame:
        return latest_exams(self.exams)

    @property
    def p(self) -> DataFrame:
        return distinct_pages(self.pages).withColumn("exam", norm_key("exam_id"))

    @property
    def b(self) -> DataFrame:
        return blocks(distinct_pages(self.pages))

    @property
    def o(self) -> DataFrame:
        return mutations.latest_by(self.storage_object, ["bucket_id", "name"], [F.desc_nulls_last("created_at"), F.asc_nulls_last("metadata")])


c = F.col

# Scans ------------------------------------------------------------------------------------------


@query("SELECT id, title, uploaded_at FROM e WHERE status = 'finished'")
def exam_list(t):
    """Exams of a status, newest first, id as tiebreak."""
    return t.e.where("status = 'finished'").select("id", "title", "uploaded_at").orderBy(F.desc_nulls_last("uploaded_at"), "id")


@query("SELECT id, title, status FROM e ORDER BY uploaded_at DESC, id LIMIT 1")
def exam_lookup(t):
    """One exam; the newest stands for a given id."""
    return t.e.orderBy(F.desc_nulls_last("uploaded_at"), "id").select("id", "title", "status").limit(1)


@query("SELECT id FROM e")
def exam_ids(t):
    """S3."""
    return t.exams.select("id").distinct()


@query("SELECT exam AS exam_id, id AS page_id, page_order::INT AS page_order FROM p WHERE exam IS NOT NULL")
def exam_pages(t):
    """The pages of every exam in order."""
    return t.p.where("exam is not null").select(c("exam").alias("exam_id"), c("id").alias("page_id"), c("page_order").cast("int").alias("page_order")).orderBy("exam_id", "page_order", "page_id")


@query("SELECT DISTINCT file_path FROM p WHERE file_path IS NOT NULL AND exam IN (SELECT id FROM e WHERE status = 'failed')")
def file_paths(t):
    """Paths of the pages of given exams."""
    return t.p.join(t.e.where("status = 'failed'").select(c("id").alias("exam")), "exam", "left_semi").where("file_path is not null").select("file_path").distinct()


@query("SELECT e.id, e.status, count(p.id) AS n_pages FROM e LEFT JOIN p ON p.exam = e.id GROUP BY ALL")
def exam_page_counts(t):
    """Every exam with its number of pages, zero included."""
    n = t.p.groupBy("exam").agg(F.count(F.lit(1)).alias("n_pages"))
    return t.e.join(n, c("id") == c("exam"), "left").select("id", "status", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


@query("SELECT e.id, e.title, p.id AS page_id, p.page_order::INT AS page_order, CASE WHEN p.id IS NOT NULL THEN p.ocr_text IS NOT NULL END AS done FROM e LEFT JOIN p ON p.exam = e.id WHERE e.status = 'processing'")
def exam_detail(t):
    """Exams with their pages."""
    p = t.p.select("exam", c("id").alias("page_id"), c("page_order").cast("int").alias("page_order"), c("ocr_text").isNotNull().alias("done"))
    return t.e.where("status = 'processing'").join(p, c("id") == c("exam"), "left").select("id", "title", "page_id", "page_order", "done")


@query(
    """SELECT * FROM (
  SELECT page_id, block_idx, CASE WHEN level IS NOT NULL AND category IS DISTINCT FROM 'Section-header' THEN 'level out of place' WHEN level NOT BETWEEN 1 AND 5 THEN 'level out of range'
    WHEN n_box NOT IN (0, 4) THEN 'box' WHEN category IS NULL THEN 'no label' END AS reason FROM b) WHERE reason IS NOT NULL"""
)
def row_validation(t):
    """The quarantine: every block that breaks a rule, with the first rule it breaks."""
    reason = (
        F.when(c("level").isNotNull() & ~c("category").eqNullSafe("Section-header"), "level out of place").when(~c("level").between(1, 5), "level out of range")
        .when(~c("n_box").isin(0, 4), "box").when(c("category").isNull(), "no label")
    )
    return t.b.select("page_id", "block_idx", reason.alias("reason")).where("reason is not null")


@query(f"SELECT id AS page_id FROM p WHERE {_KEY.format('file_path')} IN (SELECT {_KEY.format('name')} FROM o)")
def stored_pages(t):
    """Pages whose object exists."""
    return t.p.withColumn("k", norm_key("file_path")).join(t.o.select(norm_key("name").alias("k")), "k", "left_semi").select(c("id").alias("page_id"))


@query(f"SELECT DISTINCT p.id AS page_id, p.page_order::INT AS page_order, CASE WHEN o.name IS NOT NULL THEN 'object://' || o.name END AS url FROM p LEFT JOIN o ON {_KEY.format('p.file_path')} = {_KEY.format('o.name')}")
def page_urls(t):
    """Every page with the address of its object, null when there is none."""
    o = t.o.select(norm_key("name").alias("k"), F.concat(F.lit("object://"), c("name")).alias("url"))
    return t.p.withColumn("k", norm_key("file_path")).join(o, "k", "left").select(c("id").alias("page_id"), c("page_order").cast("int").alias("page_order"), "url").distinct()


_SIZE = "TRY_CAST(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.size') END AS BIGINT)"


def _size():
    return F.get_json_object("metadata", "$.size").try_cast("bigint")


@query(
    f"""SELECT kind, count(*) AS n_files, count(DISTINCT batch) AS n_batches FROM (
  SELECT kind, CASE kind WHEN 'pdf' THEN name ELSE 'img' END AS batch FROM (
    SELECT name, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS kind, {_SIZE} AS size FROM o) WHERE size <= 52428800 AND kind IN ('pdf', 'jpg', 'jpeg', 'png')) GROUP BY kind"""
)
def upload_groups(t):
    """Accepted files: each pdf its own batch, all images one."""
    f = t.o.select("name", F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), _size().alias("size"))
    f = f.where((c("size") <= 50 << 20) & c("kind").isin("pdf", "jpg", "jpeg", "png"))
    return f.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct(F.when(c("kind") == "pdf", c("name")).otherwise("img")).alias("n_batches"))


@query("SELECT exam AS exam_id, id AS page_id, row_number() OVER (PARTITION BY exam ORDER BY file_path NULLS LAST, id) AS position FROM p WHERE exam IS NOT NULL")
def upload_numbering(t):
    """One running number over the files of an upload."""
    p = t.p.where("exam is not null").select(c("exam").alias("exam_id"), c("id").alias("page_id"), "file_path")
    return mutations.numbered(p, ["exam_id"], [F.asc_nulls_last("file_path"), c("page_id")], "position").drop("file_path")


# Filters and projections ------------------------------------------------------------------------


@query("SELECT CASE WHEN status IN ('processing', 'failed') THEN 'hidden' ELSE 'shown' END AS list, status, id FROM e WHERE status IS NOT NULL")
def status_partition(t):
    """a fetched list by status, for both sides: the user's side hides two of them."""
    hidden = F.when(c("status").isin("processing", "failed"), "hidden").otherwise("shown")
    return t.e.where("status is not null").select(hidden.alias("list"), "status", "id")


@query("SELECT id AS page_id FROM p WHERE EXISTS (SELECT 1 FROM e WHERE e.id = p.exam AND e.status = 'pending')")
def pending_page_guard(t):
    """pages that may be changed: their exam is pending (semi join)."""
    return t.p.join(t.e.where("status = 'pending'").select(c("id").alias("exam")), "exam", "left_semi").select(c("id").alias("page_id"))


@query("SELECT id FROM e WHERE status <> 'processing'")
def deletable_exams(t):
    """F2, K9."""
    return t.e.where("status <> 'processing'").select("id")


@query("SELECT page_id, block_idx, category FROM b WHERE n_box = 4")
def boxed_blocks(t):
    """F3."""
    return t.b.where("n_box = 4").select("page_id", "block_idx", "category")


@query("SELECT CASE category WHEN 'Page-header' THEN 'header' WHEN 'Page-footer' THEN 'footer' ELSE 'main' END AS part, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM b GROUP BY 1")
def header_footer_split(t):
    """F4."""
    part = F.when(c("category") == "Page-header", "header").when(c("category") == "Page-footer", "footer").otherwise("main")
    return t.b.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query("SELECT exam AS exam_id, count(*) FILTER (ocr_text IS NULL) AS todo, count(ocr_text) AS done FROM p GROUP BY exam")
def remaining_work(t):
    """F5."""
    return t.p.groupBy(c("exam").alias("exam_id")).agg(F.count_if(c("ocr_text").isNull()).alias("todo"), F.count("ocr_text").alias("done"))


@query("SELECT page_id, block_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM b WHERE x1 IS NOT NULL")
def block_geometry(t):
    """F8."""
    return t.b.where("x1 is not null").selectExpr("page_id", "block_idx", "(x1 + x2) / 2 as cx", "(y1 + y2) / 2 as cy", "x2 - x1 as w", "y2 - y1 as h")


@query("SELECT page_id, block_idx, round(100 * x1 / iw, 6) AS pl, round(100 * y1 / ih, 6) AS pt FROM b WHERE x1 IS NOT NULL AND iw > 0 AND ih > 0")
def overlay_percent(t):
    """F9."""
    return t.b.where("x1 is not null and iw > 0 and ih > 0").select("page_id", "block_idx", F.round(geometry.overlay(c("x1"), c("iw")), 6).alias("pl"), F.round(geometry.overlay(c("y1"), c("ih")), 6).alias("pt"))


@query(f"SELECT lower(split_part(name, '/', 1)) AS exam_id, count(*) AS n_items, bool_and({_SIZE} IS NOT NULL) AS ready FROM o WHERE name LIKE '%/%' GROUP BY 1")
def ready_exams(t):
    """an upload is ready when it has items and none of them is broken (an object without a readable size)."""
    o = t.o.where("name like '%/%'").select(F.lower(F.split("name", "/")[0]).alias("exam_id"), _size().isNotNull().alias("whole"))
    return o.groupBy("exam_id").agg(F.count(F.lit(1)).alias("n_items"), F.bool_and("whole").alias("ready"))


@query("SELECT DISTINCT exam_id FROM page_result WHERE exam_id IN (SELECT id FROM e WHERE status = 'processing')")
def selection_pruned(t):
    """ids still present in their group."""
    return t.page_result.select("exam_id").distinct().join(t.e.where("status = 'processing'").select(c("id").alias("exam_id")), "exam_id", "left_semi")


# Aggregates -------------------------------------------------------------------------------------


@query("SELECT s.status, count(e.id) AS n FROM (VALUES ('pending'), ('processing'), ('finished'), ('failed')) s(status) LEFT JOIN e USING (status) GROUP BY s.status")
def status_counts(t):
    """A1: all statuses, zero when absent."""
    vocab = t.spark.createDataFrame([(s,) for s in STATUSES], "status string")
    n = t.e.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return vocab.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT count(*) FILTER (status = 'finished') AS finished_today, count(*) FILTER (status = 'failed') AS failed_today FROM e WHERE updated_at >= TIMESTAMPTZ '2025-12-31 00:00:00+00'")
def today_counts(t):
    """A2: changes since midnight (UTC) of a given now."""
    return t.e.where(c("updated_at") >= F.date_trunc("day", F.lit(NOW).cast("timestamp"))).agg(
        F.count_if(c("status") == "finished").alias("finished_today"), F.count_if(c("status") == "failed").alias("failed_today")
    )


@query(f"SELECT bucket_id, count(*) AS n, coalesce(sum({_SIZE}), 0)::BIGINT AS bytes FROM o GROUP BY bucket_id")
def bucket_sizes(t):
    """Objects and bytes per bucket; broken metadata counts as no size."""
    return t.o.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_size()), F.lit(0)).alias("bytes"))


@query(
    f"""SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'finished') AS finished, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'finished' AND updated_at >= TIMESTAMPTZ '2025-12-31 00:00:00+00') AS finished_today, count(*) FILTER (status = 'failed' AND updated_at >= TIMESTAMPTZ '2025-12-31 00:00:00+00') AS failed_today,
  (SELECT count(*) FROM p WHERE ocr_text IS NULL) AS open_pages, (SELECT coalesce(sum({_SIZE}), 0)::BIGINT FROM o) AS storage_bytes,
  (SELECT count(*) FROM p JOIN e e2 ON e2.id = p.exam WHERE e2.status = 'processing') AS processing_pages, 500 AS processing_pages_limit FROM e"""
)
def dashboard(t):
    """One row of scalar aggregates; one scan per table (the size of the tables themselves is `table_bytes`)."""
    today = c("updated_at") >= F.date_trunc("day", F.lit(NOW).cast("timestamp"))
    ex = t.e.agg(*[F.count_if(c("status") == s).alias(s) for s in STATUSES], *[F.count_if((c("status") == s) & today).alias(f"{s}_today") for s in ("finished", "failed")])
    pg = t.p.join(t.e.select(c("id").alias("exam"), "status"), "exam", "left").agg(F.count_if(c("ocr_text").isNull()).alias("open_pages"), F.count_if(c("status") == "processing").alias("processing_pages"))
    # One-row tables on either side.
    return ex.join(pg).join(t.o.agg(F.coalesce(F.sum(_size()), F.lit(0)).alias("storage_bytes"))).withColumn("processing_pages_limit", F.lit(500))


@query()
def table_bytes(t):
    """A5: the size of every table's files."""
    names = ("exams", "pages", "page_result", "storage_object", "deletion_log", "page_payload")
    per = [getattr(t, n).select(F.lit(n).alias("name"), "_metadata.file_path", "_metadata.file_size").distinct().groupBy("name").agg(F.sum("file_size").alias("bytes"), F.count(F.lit(1)).alias("files")) for n in names]
    out = per[0]
    for df in per[1:]:
        out = out.unionByName(df)
    return out


@query("SELECT e.id, count(p.ocr_text) AS done, count(p.id) AS total, CASE WHEN count(p.id) > 0 THEN floor(100.0 * count(p.ocr_text) / count(p.id) + 0.5)::INT END AS percent FROM e LEFT JOIN p ON p.exam = e.id GROUP BY e.id")
def progress_percent(t):
    """A7, A8, F16."""
    g = t.p.groupBy("exam").agg(F.count("ocr_text").alias("done"), F.count(F.lit(1)).alias("total"))
    done, total = F.coalesce("done", F.lit(0)), F.coalesce("total", F.lit(0))
    return t.e.join(g, c("id") == c("exam"), "left").select("id", done.alias("done"), total.alias("total"), text.percent(done, total).alias("percent"))


@query(
    """SELECT page_id, sum(n)::BIGINT AS n_blocks, string_agg(category || '×' || n, ', ' ORDER BY first) AS summary
FROM (SELECT page_id, category, count(*) AS n, min(block_idx) AS first FROM b WHERE category IS NOT NULL GROUP BY ALL) GROUP BY page_id"""
)
def category_summary(t):
    """Blocks per label of a page, in order of first appearance."""
    g = t.b.where("category is not null").groupBy("page_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("block_idx").alias("first"))
    parts = F.array_sort(F.collect_list(F.struct("first", "category", "n")))
    return g.groupBy("page_id").agg(F.sum("n").alias("n_blocks"), F.concat_ws(", ", F.transform(parts, lambda x: F.concat(x["category"], F.lit("×"), x["n"].cast("string")))).alias("summary"))


@query(f"SELECT bucket_id, round(100.0 * sum({_SIZE}) / 524288000, 4) AS percent, sum({_SIZE}) >= 524288000 AS alert FROM o GROUP BY bucket_id")
def usage_bar(t):
    """A10."""
    s = F.sum(_size())
    return t.o.groupBy("bucket_id").agg(F.round(100.0 * s / (500 << 20), 4).alias("percent"), (s >= 500 << 20).alias("alert"))


@query("SELECT page_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM b WHERE x1 IS NOT NULL GROUP BY page_id")
def union_bbox(t):
    """A11."""
    return geometry.union_boxes(t.b, ["page_id"])


@query("SELECT page_id, round(var_pop(x1 / ow), 8) AS var_left, round(var_pop((x1 + x2) / 2 / ow), 8) AS var_mid FROM b WHERE x1 IS NOT NULL AND ow > 0 GROUP BY page_id")
def edge_variance(t):
    """A13."""
    return t.b.where("x1 is not null and ow > 0").groupBy("page_id").agg(F.round(F.var_pop(c("x1") / c("ow")), 8).alias("var_left"), F.round(F.var_pop((c("x1") + c("x2")) / 2 / c("ow")), 8).alias("var_mid"))


@query("SELECT exam_id, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, arg_min(error, (arrived_at, page_id)) FILTER (NOT ok) AS first_error FROM (SELECT DISTINCT * FROM page_result) GROUP BY exam_id")
def batch_outcome(t):
    """Results per exam with the first error."""
    bad = F.when(~c("ok"), F.struct("arrived_at", "page_id", "error"))
    return t.page_result.distinct().groupBy("exam_id").agg(F.count_if("ok").alias("n_ok"), F.count_if(~c("ok")).alias("n_failed"), F.min(bad)["error"].alias("first_error"))


@query("SELECT id, title FROM e ORDER BY uploaded_at DESC, id LIMIT 5")
def recent_top5(t):
    """A top-k report."""
    return t.e.orderBy(F.desc_nulls_last("uploaded_at"), "id").limit(5).select("id", "title")


@query("SELECT DISTINCT school_code FROM documents WHERE school_code IS NOT NULL")
def distinct_codes(t):
    """A16."""
    return t.documents.where("school_code is not null").select("school_code").distinct()


# Mutations --------------------------------------------------------------------------------------


@query(
    """, d AS (SELECT exam_id AS id, max(arrived_at) AS finished_at FROM page_result WHERE ok GROUP BY exam_id)
SELECT e.id, e.status, CASE WHEN d.id IS NOT NULL THEN d.finished_at ELSE e.finished_at END AS finished_at FROM e LEFT JOIN d USING (id)"""
)
def merged_updates(t):
    """K1: a field of matching rows replaced by deltas."""
    deltas = t.page_result.where("ok").groupBy(c("exam_id").alias("id")).agg(F.max("arrived_at").alias("finished_at"))
    return mutations.merge_fields(t.e.select("id", "status", "finished_at"), deltas, "id")


@query("SELECT page_id, ok, error, arrived_at FROM (SELECT DISTINCT page_id, ok, error, arrived_at FROM page_result) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY arrived_at DESC, ok DESC, error NULLS LAST) = 1")
def latest_results(t):
    """K2: the last result per page."""
    rows = t.page_result.select("page_id", "ok", "error", "arrived_at").distinct()
    return mutations.latest_by(rows, ["page_id"], [F.desc("arrived_at"), F.desc("ok"), F.asc_nulls_last("error")])


@query("SELECT id AS page_id, CASE WHEN exam IN (SELECT id FROM e WHERE status = 'pending') THEN false ELSE ocr_text IS NOT NULL END AS has_result FROM p")
def cleared_results(t):
    """K3: results nulled for the pages of pending exams."""
    pend = t.e.where("status = 'pending'").select(c("id").alias("exam"), F.lit(True).alias("hit"))
    p = mutations.clear_where(t.p.join(pend, "exam", "left"), "ocr_text", c("hit"))
    return p.select(c("id").alias("page_id"), c("ocr_text").isNotNull().alias("has_result"))


@query(f", gone AS (SELECT DISTINCT {_KEY.format('key_value')} AS id FROM deletion_log WHERE entity = 'exam') SELECT 'exams' AS name, count(*) AS n FROM e WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'pages', count(*) FROM p WHERE exam IS NULL OR exam NOT IN (SELECT id FROM gone)")
def cascade_delete(t):
    """K4: what is left after deleting logged exams and their pages."""
    ids = t.deletion_log.where("entity = 'exam'").select(norm_key("key_value").alias("id"))
    e, p = mutations.delete_cascade(t.e.select("id"), t.p.select("exam"), ids, "id", "exam")
    one = lambda df, name: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return one(e, "exams").unionByName(one(p, "pages"))


@query("SELECT name, ((row_number() OVER (ORDER BY name) - 1) // 100)::BIGINT AS chunk FROM (SELECT DISTINCT name FROM o)")
def delete_chunks(t):
    """K5: paths in chunks of 100."""
    return mutations.chunks(t.storage_object, "name")


@query(f"SELECT DISTINCT file_path FROM p WHERE file_path IS NOT NULL AND {_KEY.format('file_path')} NOT IN (SELECT {_KEY.format('name')} FROM o)")
def failed_deletes(t):
    """K5: asked for and not there."""
    p = t.p.where("file_path is not null").select("file_path", norm_key("file_path").alias("k"))
    return p.join(t.o.select(norm_key("name").alias("k")), "k", "left_anti").select("file_path").distinct()


@query("SELECT (SELECT count(*) FROM e) AS exams, (SELECT count(*) FROM p) AS pages, (SELECT count(DISTINCT file_path) FROM p) AS paths, (SELECT count(*) FROM o) AS objects")
def reset_report(t):
    """K6: what a reset would remove."""
    one = lambda df, expr, name: df.agg(expr.alias(name))
    e, o = one(t.exams, F.countDistinct("id"), "exams"), one(t.o, F.count(F.lit(1)), "objects")
    p = t.pages.agg(F.countDistinct("id").alias("pages"), F.countDistinct("file_path").alias("paths"))
    return e.join(F.broadcast(p)).join(F.broadcast(o))


def _wanted(t):
    """(pages of exams, the wanted order: pages with a result, last one first)."""
    p = t.p.where("exam is not null").select(c("exam").alias("exam_id"), c("id").alias("page_id"), c("page_order").cast("int").alias("page_order"), c("ocr_text").isNotNull().alias("done"))
    wanted = mutations.numbered(p.where("done").select("exam_id", "page_id", "page_order"), ["exam_id"], [F.desc("page_order"), c("page_id")], "pos").drop("page_order")
    return p.drop("done"), wanted


@query("SELECT exam AS exam_id, id AS page_id, (row_number() OVER (PARTITION BY exam ORDER BY page_order DESC, id))::INT AS page_order FROM p WHERE exam IS NOT NULL AND ocr_text IS NOT NULL")
def reordered_pages(t):
    """Pages in a wanted order, that of the pages with a result from the last; unlisted pages go."""
    return mutations.reorder(*_wanted(t), "page_id", "exam_id", "page_order", keep_unlisted=False)


@query("SELECT exam AS exam_id, id AS page_id, (row_number() OVER (PARTITION BY exam ORDER BY ocr_text IS NULL, CASE WHEN ocr_text IS NULL THEN page_order ELSE -page_order END, id))::INT AS page_order FROM p WHERE exam IS NOT NULL")
def patched_order(t):
    """Listed pages first in the wanted order, the unlisted after them in the old one."""
    return mutations.reorder(*_wanted(t), "page_id", "exam_id", "page_order", keep_unlisted=True)


@query("SELECT bucket_id, count(*) AS n FROM o WHERE created_at < TIMESTAMPTZ '2025-12-31 12:00:00+00' - INTERVAL 7 DAYS GROUP BY bucket_id")
def purge_old(t):
    """Objects older than seven days at a given now."""
    return mutations.older_than(t.o, "created_at", F.lit(NOW).cast("timestamp"), 7).groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"))


# Ordered work -----------------------------------------------------------------------------------


@query(
    """, n AS (SELECT exam, count(*) AS pages FROM p GROUP BY exam),
r AS (SELECT strftime(uploaded_at AT TIME ZONE 'UTC', '%Y-%m') AS run, id, row_number() OVER (PARTITION BY strftime(uploaded_at AT TIME ZONE 'UTC', '%Y-%m') ORDER BY uploaded_at, id) AS pos,
  coalesce(pages, 0) AS pages, status IN ('pending', 'finished') AS ok FROM e LEFT JOIN n ON n.exam = e.id),
s AS (SELECT *, sum(CASE WHEN ok THEN pages ELSE 0 END) OVER (PARTITION BY run ORDER BY pos) AS running FROM r)
SELECT run, id, running::BIGINT AS running, ok AND max((ok AND running > 100)::INT) OVER (PARTITION BY run ORDER BY pos) = 0 AS admitted FROM s"""
)
def budget_admission(t):
    """Q1, Q2: requests of a month taken in order while their pages fit a budget; the first overflow closes it."""
    n = t.p.groupBy("exam").agg(F.count(F.lit(1)).alias("pages"))
    r = t.e.join(n, c("id") == c("exam"), "left").select(F.date_format("uploaded_at", "yyyy-MM").alias("run"), "id", "uploaded_at", F.coalesce("pages", F.lit(0)).alias("pages"), c("status").isin("pending", "finished").alias("ok"))
    r = mutations.numbered(r, ["run"], [c("uploaded_at"), c("id")], "pos")
    return dispatch.admit_under_budget(r, "run", "pos", "pages", "ok", 100).select("run", "id", "running", "admitted")


@query(
    """, q AS (SELECT id AS exam, row_number() OVER (ORDER BY started_at, id) AS queue_pos FROM e WHERE status = 'processing')
SELECT queue_pos, row_number() OVER (PARTITION BY exam ORDER BY page_order NULLS LAST, p.id) AS rank_in_exam, exam AS exam_id, p.id AS page_id FROM q JOIN p USING (exam) WHERE ocr_text IS NULL"""
)
def page_dispatch(t):
    """Q3, Q10: open pages of queued exams in queue order, then page order."""
    q = t.e.where("status = 'processing'").select(c("id").alias("exam_id"), "started_at")
    q = mutations.positions(q, [F.asc_nulls_last("started_at"), c("exam_id")], "_at").select("exam_id", (c("_at") + 1).alias("queue_pos"))
    pages = t.p.select(c("exam").alias("exam_id"), c("id").alias("page_id"), "page_order", "ocr_text")
    return dispatch.page_queue(q, pages)


@query(f"SELECT id FROM e WHERE status = 'processing' AND id NOT IN (SELECT exam_id FROM page_result WHERE ok) AND id NOT IN (SELECT exam FROM p WHERE exam IS NOT NULL AND ocr_text IS NOT NULL)")
def untracked_exams(t):
    """Exams in work that nothing is known of (two anti joins)."""
    return dispatch.not_in_flight(t.e.where("status = 'processing'").select("id"), t.page_result.where("ok").select(c("exam_id").alias("id")), t.p.where("ocr_text is not null and exam is not null").select(c("exam").alias("id")), "id")


@query(
    """SELECT exam_id, greatest(sum(amount), 0)::BIGINT AS charged FROM (SELECT exam AS exam_id, 1 AS amount FROM p WHERE exam IS NOT NULL
  UNION ALL SELECT exam_id, -1 FROM (SELECT DISTINCT exam_id, page_id FROM page_result WHERE ok)) GROUP BY exam_id"""
)
def page_ledger(t):
    """Q4, Q5, Q12: pages charged and released per exam, never below zero."""
    up = t.p.where("exam is not null").select(c("exam").alias("exam_id"), F.lit(1).alias("amount"))
    down = t.page_result.where("ok").select("exam_id", "page_id").distinct().select("exam_id", F.lit(-1).alias("amount"))
    return dispatch.ledger(up.unionByName(down), "exam_id", "amount")


@query(
    """, t AS (SELECT exam AS exam_id, count(*)::INT AS total FROM p WHERE exam IS NOT NULL GROUP BY exam)
SELECT exam_id, n_done::INT AS n_done, total FROM (SELECT exam_id, count(DISTINCT page_id) AS n_done FROM page_result WHERE ok GROUP BY exam_id) JOIN t USING (exam_id) WHERE n_done >= total"""
)
def completion_batch(t):
    """D3: exams whose distinct good pages reach their total."""
    from pagemill.streaming.completion import completed

    totals = t.p.where("exam is not null").groupBy(c("exam").alias("exam_id")).agg(F.count(F.lit(1)).cast("int").alias("total"))
    return completed(t.page_result, totals)


# Geometry ---------------------------------------------------------------------------------------


_CASE_PAPER = ", ".join(f"{{'diff': abs(r - {round(a * 300)} / {round(b * 300)}::DOUBLE), 'name': '{n}', 'pw': {round(a * 300)}, 'ph': {round(b * 300)}}}" for n, (a, b) in geometry.PAPER.items())


@query(
    f"""SELECT page_id, best.name AS paper, round(best.diff, 8) AS diff, CASE WHEN h < w THEN best.ph ELSE best.pw END AS width, CASE WHEN h < w THEN best.pw ELSE best.ph END AS height, best.diff > 0.2 AS rejected
FROM (SELECT *, list_sort([{_CASE_PAPER}])[1] AS best FROM (SELECT id AS page_id, ocr_text.origin_width AS w, ocr_text.origin_height AS h, least(ocr_text.origin_width, ocr_text.origin_height) / greatest(ocr_text.origin_width, ocr_text.origin_height)::DOUBLE AS r
  FROM p WHERE ocr_text.origin_width > 0 AND ocr_text.origin_height > 0))"""
)
def nearest_format(t):
    """Paper and target size per page, and whether the ratio is too far from any paper."""
    w, h = c("ocr_text.origin_width"), c("ocr_text.origin_height")
    n = geometry.nearest_paper(w, h)
    return t.p.select(c("id").alias("page_id"), n.alias("n")).where("n is not null").select("page_id", c("n.name").alias("paper"), F.round("n.diff", 8).alias("diff"), c("n.width").alias("width"), c("n.height").alias("height"), (c("n.diff") > geometry.MAX_RATIO_DIFF).alias("rejected"))


_RESIZE = """, s AS (SELECT DISTINCT ocr_text.origin_width::DOUBLE AS w, ocr_text.origin_height::DOUBLE AS h FROM p WHERE ocr_text.origin_width > 0 AND ocr_text.origin_height > 0),
k AS (SELECT *, greatest(round_even(w / 28, 0)::BIGINT * 28, 28) AS sw, greatest(round_even(h / 28, 0)::BIGINT * 28, 28) AS sh,
  ceil(w * sqrt(1605632 / (w * h)) / 28)::BIGINT * 28 AS gw, ceil(h * sqrt(1605632 / (w * h)) / 28)::BIGINT * 28 AS gh FROM s)
SELECT w::INT AS w, h::INT AS h, CASE WHEN sw * sh > 3211264 THEN greatest(floor(w / sqrt(w * h / 3211264) / 28)::BIGINT * 28, 28)
  WHEN sw * sh < 1605632 AND gw * gh > 3211264 THEN greatest(floor(gw / sqrt(gw::DOUBLE * gh / 3211264) / 28)::BIGINT * 28, 28) WHEN sw * sh < 1605632 THEN gw ELSE sw END AS width,
  CASE WHEN sw * sh > 3211264 THEN greatest(floor(h / sqrt(w * h / 3211264) / 28)::BIGINT * 28, 28)
  WHEN sw * sh < 1605632 AND gw * gh > 3211264 THEN greatest(floor(gh / sqrt(gw::DOUBLE * gh / 3211264) / 28)::BIGINT * 28, 28) WHEN sw * sh < 1605632 THEN gh ELSE sh END AS height FROM k"""


@query(_RESIZE)
def smart_resize_dims(t):
    """G1: target sizes of all page sizes."""
    s = t.p.select(c("ocr_text.origin_width").alias("w"), c("ocr_text.origin_height").alias("h")).where("w > 0 and h > 0").distinct()
    return s.withColumn("r", geometry.resized(c("w"), c("h"))).select("w", "h", c("r.width").alias("width"), c("r.height").alias("height"))


_FIT = f""", n AS (SELECT page_id, CASE WHEN h < w THEN best.ph ELSE best.pw END AS tw, CASE WHEN h < w THEN best.pw ELSE best.ph END AS th
FROM (SELECT *, list_sort([{_CASE_PAPER}])[1] AS best FROM (SELECT id AS page_id, ocr_text.origin_width AS w, ocr_text.origin_height AS h, least(ocr_text.origin_width, ocr_text.origin_height) / greatest(ocr_text.origin_width, ocr_text.origin_height)::DOUBLE AS r
  FROM p WHERE ocr_text.origin_width > 0 AND ocr_text.origin_height > 0)))"""


@query(_FIT + """ SELECT page_id, block_idx, round_even(x1 * tw / ow, 0)::BIGINT AS x1, round_even(y1 * th / oh, 0)::BIGINT AS y1, round_even(x2 * tw / ow, 0)::BIGINT AS x2, round_even(y2 * th / oh, 0)::BIGINT AS y2
FROM b JOIN n USING (page_id) WHERE x1 IS NOT NULL""")
def resize_bbox(t):
    """Boxes moved to the pixels of the page's nearest paper."""
    n = geometry.nearest_paper(c("ow"), c("oh"))
    b = t.b.where("x1 is not null and ow > 0 and oh > 0").withColumn("n", n)
    s = lambda v, target, o: geometry.scaled(c(v), c(target), c(o)).alias(v)
    return b.select("page_id", "block_idx", s("x1", "n.width", "ow"), s("y1", "n.height", "oh"), s("x2", "n.width", "ow"), s("y2", "n.height", "oh"))


@query(
    """, m AS (SELECT page_id, list_sort(list(x1)) AS s, list_sort(list(x2)) AS e, max(ow)::DOUBLE AS w FROM b WHERE x1 IS NOT NULL GROUP BY page_id)
SELECT page_id, least(greatest(s[floor(len(s) * 0.05)::INT + 1], 75.0), 300.0) AS before, least(greatest(w - e[len(e) - floor(len(s) * 0.05)::INT], 75.0), 300.0) AS after FROM m"""
)
def content_margins(t):
    """G6, A12."""
    return geometry.content_margins(t.b, ["page_id"], "x1", "x2", c("ow").cast("double"))


@query(
    """, f AS (SELECT page_id, block_idx, category, x1 + (block_idx % 3) * 40 AS x1, y1 - (block_idx % 2) * 400 AS y1, x2, y2 FROM b WHERE x1 IS NOT NULL)
SELECT page_id, block_idx, category FROM f a WHERE category <> 'Picture' OR NOT EXISTS (SELECT 1 FROM f z WHERE z.page_id = a.page_id AND z.block_idx <> a.block_idx AND a.x1 < z.x2 AND z.x1 < a.x2 AND a.y1 < z.y2 AND z.y1 < a.y2)"""
)
def stamp_antijoin(t):
    """Pictures that overlap another block go; boxes are shifted first so that some do."""
    f = t.b.where("x1 is not null").selectExpr("page_id", "block_idx", "category", "x1 + (block_idx % 3) * 40 as x1", "y1 - (block_idx % 2) * 400 as y1", "x2", "y2")
    return geometry.without_stamps(f).select("page_id", "block_idx", "category")


#: L1, L2 in SQL: the cost of every run of blocks of a page, and the cheapest prefixes one by one; ties go to the longest last column.
_DP = """, mb AS (SELECT page_id, block_idx, ow::DOUBLE AS w, x1, y1, x2, y2, row_number() OVER (PARTITION BY page_id ORDER BY block_idx) AS i FROM b
  WHERE x1 IS NOT NULL AND coalesce(category NOT IN ('Page-header', 'Page-footer'), true) AND ow > 0),
rn AS (SELECT k.page_id, k.i AS hi, j.i AS lo, count(*) AS n, sum(m.x2 - m.x1) AS sw, max(m.x2) - min(m.x1) AS span, var_pop(m.x1 / m.w) AS a, var_pop((m.x1 + m.x2) * 0.5 / m.w) AS v
  FROM mb k JOIN mb j ON j.page_id = k.page_id AND j.i <= k.i JOIN mb m ON m.page_id = k.page_id AND m.i BETWEEN j.i AND k.i GROUP BY ALL),
rc AS (SELECT page_id, hi, list(0.95 * (n - sw / CASE WHEN span > 0 THEN span ELSE 1e-6 END) + 0.05 * 2 * a * v / (a + v + 1e-6) + 0.65 ORDER BY lo) AS run FROM rn GROUP BY page_id, hi),
dp AS (SELECT DISTINCT page_id, 0::BIGINT AS i, [0.0::DOUBLE] AS cost, []::BIGINT[] AS back FROM mb
  UNION ALL SELECT page_id, i + 1, list_append(cost, list_min(total)), list_append(back, list_position(total, list_min(total))::BIGINT) FROM (
    SELECT dp.page_id, dp.i, cost, back, list_transform(range(1, len(cost) + 1), lambda j: round(cost[j] + run[j], 12)) AS total FROM dp JOIN rc ON rc.page_id = dp.page_id AND rc.hi = dp.i + 1)),
full_ AS (SELECT page_id, arg_max(back, i) AS back, max(i) AS n FROM dp GROUP BY page_id),
cut AS (SELECT page_id, back, n AS at, back[n] AS lo, 0 AS k FROM full_ WHERE n > 0 UNION ALL SELECT page_id, back, lo - 1, back[lo - 1], k + 1 FROM cut WHERE lo > 1),
dc AS (SELECT mb.page_id, block_idx, x1, y1, x2, y2, (max(k) OVER (PARTITION BY mb.page_id) - k)::INT AS column_idx FROM mb JOIN cut ON cut.page_id = mb.page_id AND mb.i BETWEEN cut.lo AND cut.at)"""
_COLS = _DP + """, c0 AS (SELECT page_id, column_idx, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM dc GROUP BY ALL)"""


def _cols(t):
    """The boxes of the columns of every page, in pixels of the image."""
    return geometry.union_boxes(layout.with_columns(distinct_pages(t.pages)).join(t.b, ["page_id", "block_idx"]), ["page_id", "column_idx"])


_SECTIONS = """, l AS (SELECT *, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2 FROM c0 WINDOW w AS (PARTITION BY page_id ORDER BY column_idx)),
k AS (SELECT *, CASE WHEN least(a2 - a1, x2 - x1) > 0 THEN greatest(least(a2, x2) - greatest(a1, x1), 0) / least(a2 - a1, x2 - x1) ELSE 0 END AS x, CASE WHEN least(b2 - b1, y2 - y1) > 0 THEN greatest(least(b2, y2) - greatest(b1, y1), 0) / least(b2 - b1, y2 - y1) ELSE 0 END AS y FROM l),
sc AS (SELECT page_id, column_idx, x1, y1, x2, y2, sum(CASE WHEN a1 IS NULL OR (x <= 0.1 AND y >= 0.6) THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY column_idx)::INT AS section_idx FROM k)"""


@query(
    _COLS + _SECTIONS + """, mg AS (SELECT page_id, list_sort(list(x1)) AS s, list_sort(list(x2)) AS e, max(w) AS w FROM mb GROUP BY page_id),
m AS (SELECT page_id, w - least(greatest(s[floor(len(s) * 0.05)::INT + 1], 75.0), 300.0) - least(greatest(w - e[len(e) - floor(len(s) * 0.05)::INT], 75.0), 300.0) AS content FROM mg),
r AS (SELECT *, greatest(x2 - x1, coalesce(lead(x1) OVER w - x1 - 50, x2 - x1)) AS raw FROM sc WINDOW w AS (PARTITION BY page_id, section_idx ORDER BY column_idx))
SELECT page_id, section_idx, column_idx, round(CASE WHEN sum(raw) OVER p > 0 THEN raw / sum(raw) OVER p * greatest(content - 50 * (count(*) OVER p - 1), 1) ELSE raw END, 6) AS width FROM r JOIN m USING (page_id) WINDOW p AS (PARTITION BY page_id, section_idx)"""
)
def column_widths(t):
    """The widths of the columns of every section, filling the width between the page's content margins."""
    main = t.b.where("x1 is not null and ow > 0").where(F.coalesce(~c("category").isin("Page-header", "Page-footer"), F.lit(True)))
    m = geometry.content_margins(main, ["page_id"], "x1", "x2", c("ow").cast("double")).join(main.groupBy("page_id").agg(F.max("ow").alias("ow")), "page_id")
    m = m.select("page_id", (c("ow") - c("before") - c("after")).alias("content"))
    cols = layout.sections_of(_cols(t)).join(m, "page_id")
    return geometry.column_widths(cols, ["page_id", "section_idx"], "column_idx", c("content")).select("page_id", "section_idx", "column_idx", F.round("width", 6).alias("width"))


@query(
    """, g AS (SELECT page_id, list_sort(list(x1)) AS s, list_sort(list(x2)) AS e, max(ow)::DOUBLE AS w FROM b WHERE x1 IS NOT NULL GROUP BY page_id),
h AS (SELECT page_id, least(greatest(s[floor(len(s) * 0.05)::INT + 1], 75.0), 300.0) AS l, w - least(greatest(w - e[len(e) - floor(len(s) * 0.05)::INT], 75.0), 300.0) AS r FROM g),
m AS (SELECT page_id, block_idx, x1 - l AS before, r - x2 AS after, (x2 - x1) / (r - l) AS share, greatest(15, 0.1 * (r - l)) AS near, r - l AS ref FROM b JOIN h USING (page_id) WHERE x1 IS NOT NULL)
SELECT page_id, block_idx, CASE WHEN ref <= 0 THEN 'LEFT' WHEN share <= 0.9 AND abs(before - after) <= near THEN 'CENTER' WHEN share <= 0.9 AND after <= near AND before > near THEN 'RIGHT' ELSE 'LEFT' END AS align FROM m"""
)
def block_alignment(t):
    """Alignment of every block between the page's content margins."""
    b = t.b.where("x1 is not null")
    m = geometry.content_margins(b, ["page_id"], "x1", "x2", c("ow").cast("double"))
    b = b.join(m, "page_id")
    return b.select("page_id", "block_idx", geometry.alignment(c("x1"), c("x2"), c("before"), c("ow") - c("after")).alias("align"))


@query("SELECT page_id, block_idx, round(CASE WHEN sum(x2 - x1) OVER w > 0 THEN (x2 - x1) / sum(x2 - x1) OVER w ELSE 1.0 / count(*) OVER w END, 8) AS share FROM b WHERE x1 IS NOT NULL AND category IN ('Page-header', 'Page-footer') WINDOW w AS (PARTITION BY page_id, category)")
def header_widths(t):
    """Shares of the cells of a header or footer; equal when all are empty."""
    w = Window.partitionBy("page_id", "category")
    width = c("x2") - c("x1")
    total = F.sum(width).over(w)
    share = F.when(total > 0, width / total).otherwise(1.0 / F.count(F.lit(1)).over(w))
    return t.b.where("x1 is not null and category in ('Page-header', 'Page-footer')").select("page_id", "block_idx", F.round(share, 8).alias("share"))


@query("SELECT id AS page_id, page_order, ocr_text.origin_width * 72.0 / 300 AS width_pt, ocr_text.origin_height * 72.0 / 300 AS height_pt, file_path FROM p WHERE ocr_text IS NOT NULL")
def pdf_page_plan(t):
    """G12, K15."""
    return render.pdf_plan(t.pages)


@query("SELECT page_id, trunc(ow * 1440 / 300.0)::BIGINT AS w_twips, trunc(oh * 1440 / 300.0)::BIGINT AS h_twips FROM (SELECT DISTINCT page_id, ow, oh FROM b)")
def page_twips(t):
    """G11, R7."""
    return t.b.select("page_id", "ow", "oh").distinct().select("page_id", geometry.twips(c("ow")).alias("w_twips"), geometry.twips(c("oh")).alias("h_twips"))


# Layout -----------------------------------------------------------------------------------------


@query(_COLS + _SECTIONS + " SELECT page_id, column_idx, section_idx FROM sc")
def sections_islands(t):
    """L3, L4: sections of neighbouring columns."""
    return layout.sections_of(_cols(t)).select("page_id", "column_idx", "section_idx")


@query(
    """, w AS (SELECT page_id, block_idx, CASE WHEN coalesce(lead(category) OVER s IN ('Section-header', 'Title'), false) THEN 'section-break' WHEN coalesce(lead(y1) OVER s < y1, false) THEN 'column-break' ELSE 'no-break' END AS gap FROM b WHERE x1 IS NOT NULL WINDOW s AS (PARTITION BY page_id ORDER BY block_idx)),
l AS (SELECT *, lag(gap) OVER (PARTITION BY page_id ORDER BY block_idx) AS before FROM w),
s AS (SELECT *, count(*) FILTER (before = 'section-break') OVER (PARTITION BY page_id ORDER BY block_idx) AS section_idx FROM l)
SELECT page_id, block_idx, section_idx::INT AS section_idx, (count(*) FILTER (before = 'column-break') OVER (PARTITION BY page_id, section_idx ORDER BY block_idx))::INT AS column_idx FROM s"""
)
def gap_sections(t):
    """L6 (rule-based stand-in), L8, L9: sections and columns from gap labels."""
    b = layout.gap_label(t.b.where("x1 is not null"))
    return layout.sections_from_gaps(b, "gap").select("page_id", "block_idx", "section_idx", "column_idx")


_HOT = ", ".join(f"CASE WHEN category = '{n}' THEN {i} END" for i, n in ((layout.CATEGORIES.index(v), k) for k, v in layout.LABEL_TO_CATEGORY.items()))


@query(
    f"""SELECT page_id, block_idx, list_concat([x1 / ow, x2 / ow, (x1 + x2) / 2 / ow, y1 / oh, y2 / oh, (y1 + y2) / 2 / oh, (x2 - x1) / ow, (y2 - y1) / oh],
  list_transform(range(0, 10), lambda i: CASE WHEN i = coalesce({_HOT}, -1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS features FROM b WHERE x1 IS NOT NULL AND ow > 0 AND oh > 0"""
)
def layout_features(t):
    """L5."""
    return layout.features(t.b)


@query(_DP + " SELECT page_id, block_idx, column_idx FROM dc")
def column_dp(t):
    """L1, L2: the cheapest column split of every page."""
    return layout.with_columns(distinct_pages(t.pages))


# Text -------------------------------------------------------------------------------------------


_SPELLED = "CASE WHEN block_idx % 4 = 0 THEN upper(category) WHEN block_idx % 4 = 1 THEN lower(replace(category, '-', '_')) WHEN block_idx % 4 = 2 THEN replace(category, '-', ' ') ELSE category END"


@query("SELECT page_id, block_idx, coalesce(category, 'Text') AS label FROM b")
def label_normalize(t):
    """H2: the labels of all blocks, written in four ways, come back as they are."""
    return t.b.select("page_id", "block_idx", text.label_of(F.expr(_SPELLED)).alias("label"))


@query(
    """, s AS (SELECT page_id, block_idx, CASE WHEN n_box = 4 THEN concat_ws(' ', floor(x1 / 3)::INT, floor(y1 / 3)::INT, floor(x2 / 3)::INT, floor(y2 / 3)::INT) ELSE '' END AS v, ow, oh FROM b)
SELECT page_id, block_idx, CASE WHEN v = '' THEN []::DOUBLE[] ELSE list_transform([1, 2, 3, 4], lambda i: least(greatest(split_part(v, ' ', i)::INT * (CASE WHEN i % 2 = 1 THEN ow ELSE oh END) / 1000.0::DOUBLE, 0.0), (CASE WHEN i % 2 = 1 THEN ow ELSE oh END)::DOUBLE)) END AS box FROM s"""
)
def bbox_parse(t):
    """H3: boxes written as thousandths."""
    v = F.when(c("n_box") == 4, F.concat_ws(" ", *[F.floor(c(x) / 3).cast("int").cast("string") for x in ("x1", "y1", "x2", "y2")])).otherwise("")
    return t.b.select("page_id", "block_idx", text.box_of(v, c("ow"), c("oh")).alias("box"))


@query("SELECT page_id, block_idx, text AS marked FROM b WHERE text IS NOT NULL")
def inline_markup(t):
    """H4: every text with its bold parts as elements, in both names and letter cases, comes back with the signs."""
    even, odd = "<b>$1</b>", "<STRONG class='x'>$1</STRONG>"
    src = F.when(c("block_idx") % 2 == 0, F.regexp_replace("text", r"(?s)\*\*(.+?)\*\*", even)).otherwise(F.regexp_replace("text", r"(?s)\*\*(.+?)\*\*", odd))
    return t.b.where("text is not null").select("page_id", "block_idx", text.inline_markup(src).alias("marked"))


#: The lines of lists in SQL: entries of ul by their tags, any other text as one line without a marker.
_LINES = """, li AS (SELECT page_id, block_idx, text AS raw, CASE WHEN ltrim(text) LIKE '<ul>%' THEN list_filter(list_transform(regexp_extract_all(text, '<li>([^<]*)', 1), lambda x: trim(x)), lambda x: x <> '') END AS items FROM b WHERE category = 'List-item' AND text IS NOT NULL),
ln AS (SELECT page_id, block_idx, unnest(range(0, len(items)))::INT AS seq, 0 AS level, unnest(items) AS line FROM li WHERE items IS NOT NULL
  UNION ALL SELECT page_id, block_idx, 0, -1, trim(raw) FROM li WHERE items IS NULL AND trim(raw) <> ''),
tk AS (SELECT *, regexp_extract(line, '^(\\S+)\\s', 1) AS token FROM ln),
tp AS (SELECT *, string_split(rtrim(token, '.)'), '.') AS parts, length(token) - length(rtrim(token, '.)')) AS n_end FROM tk),
mk AS (SELECT *, CASE WHEN level < 0 OR token = '' THEN NULL WHEN token IN ('-', '*', '•', '▪', '◦', '‣', '⁃') THEN '-'
  WHEN n_end <= 1 AND len(parts) <= 3 AND list_bool_and(list_transform(range(1, len(parts)), lambda i: length(parts[i]) BETWEEN 1 AND 2 AND TRY_CAST(parts[i] AS INT) IS NOT NULL))
    AND length(rtrim(parts[-1], 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')) BETWEEN 1 AND 2 AND TRY_CAST(rtrim(parts[-1], 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') AS INT) IS NOT NULL
    AND length(parts[-1]) - length(rtrim(parts[-1], 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')) <= 2
    THEN CASE WHEN coalesce(TRY_CAST(array_to_string(parts, '') AS INT), 0) > 100 THEN NULL ELSE token END
  WHEN n_end <= 1 AND len(parts) = 1 AND (length(parts[1]) = 1 AND lower(parts[1]) BETWEEN 'a' AND 'z' OR length(parts[1]) BETWEEN 1 AND 5 AND translate(lower(parts[1]), 'ivxlcdm', '') = '') THEN token END AS own FROM tp)"""


@query(_LINES + " SELECT page_id, block_idx, seq, own AS marker FROM mk WHERE level >= 0")
def list_marker(t):
    """The markers that the entries of all lists carry themselves."""
    rows = t.b.where("category = 'List-item' and text is not null").select("page_id", "block_idx", F.inline(markup.lines_udf("text"))).where("level >= 0")
    return rows.select("page_id", "block_idx", "seq", text.marker(c("text"))["marker"].alias("marker"))


@query("SELECT DISTINCT id, trim(regexp_replace(regexp_replace(title, '\\.[^.]+$', ''), '[_-]+', ' ', 'g')) AS title FROM e WHERE title IS NOT NULL")
def default_title(t):
    """T10."""
    return t.e.where("title is not null").select("id", text.default_title(c("title")).alias("title"))


@query("SELECT id AS page_id, split_part(file_path, '/', -1) AS name FROM p WHERE file_path IS NOT NULL")
def file_basename(t):
    """T16."""
    return t.p.where("file_path is not null").select(c("id").alias("page_id"), text.basename(c("file_path")).alias("name"))


@query(
    """SELECT id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || ' min' WHEN d = DATE '2025-12-31' THEN strftime(t, '%H:%M') || ' today' WHEN d = DATE '2025-12-30' THEN 'yesterday' ELSE strftime(t, '%Y-%m-%d') END AS shown
FROM (SELECT id, uploaded_at AT TIME ZONE 'UTC' AS t, CAST(uploaded_at AT TIME ZONE 'UTC' AS DATE) AS d, floor((epoch_us(TIMESTAMP '2025-12-31 12:00:00') - epoch_us(uploaded_at)) / 60e6)::BIGINT AS m FROM e WHERE uploaded_at <= TIMESTAMPTZ '2025-12-31 12:00:00+00')"""
)
def relative_time(t):
    """T11, T18."""
    now = F.lit(NOW).cast("timestamp")
    return t.e.where(c("uploaded_at") <= now).select("id", text.relative_time(c("uploaded_at"), now).alias("shown"))


@query(
    f"""SELECT DISTINCT n, CASE WHEN n < 1024 THEN n || ' B' ELSE (CASE WHEN v < 10 THEN printf('%.1f', floor(v * 10 + 0.5) / 10) ELSE printf('%.0f', floor(v + 0.5)) END) || unit END AS shown
FROM (SELECT n, CASE WHEN n < 1048576 THEN n / 1024.0::DOUBLE ELSE n / 1048576.0::DOUBLE END AS v, CASE WHEN n < 1048576 THEN ' KB' ELSE ' MB' END AS unit FROM (SELECT {_SIZE} AS n FROM o) WHERE n IS NOT NULL)"""
)
def format_bytes(t):
    """Ties are rounded up."""
    return t.o.select(_size().alias("n")).where("n is not null").distinct().select("n", text.format_bytes(c("n")).alias("shown"))


@query(
    """, tb AS (SELECT page_id, block_idx, list_transform(string_split(text, '<tr>')[2:], lambda x: split_part(x, '</tr>', 1)) AS trs FROM b WHERE category = 'Table' AND text IS NOT NULL),
tr AS (SELECT page_id, block_idx, unnest(range(0, len(trs)))::INT AS "row", unnest(trs) AS tr FROM tb),
td AS (SELECT page_id, block_idx, "row", unnest(range(0, len(c))) AS k, unnest(c) AS cell FROM (SELECT *, regexp_extract_all(tr, '<t[dh](?: [^<>]*)?>[^<]*') AS c FROM tr)),
sp AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(cell, 'colspan="(\\d+)"', 1), '') AS INT), 1) AS across FROM td)
SELECT page_id, block_idx, "row", (sum(across) OVER w - across)::INT AS col, "row" AS end_row, (sum(across) OVER w - 1)::INT AS end_col, trim(regexp_extract(cell, '>([^<]*)$', 1)) AS text
FROM sp WINDOW w AS (PARTITION BY page_id, block_idx, "row" ORDER BY k ROWS UNBOUNDED PRECEDING)"""
)
def table_grid(t):
    """Cells of every table with their place."""
    return t.b.where("category = 'Table' and text is not null").select("page_id", "block_idx", F.inline(markup.grid_udf("text")))


@query(
    _LINES + """ SELECT page_id, block_idx, seq, level, CASE WHEN level >= 0 THEN coalesce(own, '-') END AS marker, CASE WHEN own IS NULL THEN line ELSE ltrim(line[length(token) + 1:]) END AS content,
  CASE WHEN level >= 0 THEN (18 + 2 * least(length(coalesce(own, '-')), 4)) * (level + 1) ELSE 0 END AS indent_pt FROM mk"""
)
def list_lines(t):
    """Lines of every list with marker and indent; a text without list markup is one line as it is (level -1)."""
    rows = t.b.where("category = 'List-item' and text is not null").select("page_id", "block_idx", F.inline(markup.lines_udf("text")))
    m = text.marker(c("text"))
    listed = c("level") >= 0
    mark = F.when(listed, F.coalesce(m["marker"], F.when(c("ordered") & c("position").isNotNull(), F.concat(c("position").cast("string"), F.lit("."))).otherwise("-")))
    content = F.when(listed, m["content"]).otherwise(c("text"))
    return rows.select("page_id", "block_idx", "seq", "level", mark.alias("marker"), content.alias("content"), F.when(listed, text.hang_points(mark, c("level"))).otherwise(0).alias("indent_pt"))


@query(
    """, pt AS (SELECT page_id, block_idx, string_split(text, '**') AS parts FROM b WHERE text IS NOT NULL AND coalesce(category NOT IN ('Table', 'List-item', 'Picture'), true)),
ru AS (SELECT page_id, block_idx, unnest(range(0, len(parts))) AS k, unnest(parts) AS text, len(parts) AS n FROM pt)
SELECT page_id, block_idx, (row_number() OVER (PARTITION BY page_id, block_idx ORDER BY k) - 1)::INT AS run, text, k % 2 = 1 AS bold, false AS italic, false AS underline FROM ru WHERE text <> ''"""
)
def markdown_runs(t):
    """Styled runs of every inline text: all but tables, lists and pictures; a text without any marker is one plain run."""
    inline = t.b.where(c("text").isNotNull() & ~F.coalesce(c("category").isin("Table", "List-item", "Picture"), F.lit(False)))
    marked = c("text").contains("*") | c("text").contains("__")
    no = F.lit(False)
    plain = F.when(c("text") != "", F.array(F.struct(c("text").alias("text"), no.alias("bold"), no.alias("italic"), no.alias("underline"))))
    runs = F.when(marked, markup.runs_udf(F.when(marked, c("text")))).otherwise(plain)
    return inline.select("page_id", "block_idx", F.posexplode(runs).alias("run", "r")).select("page_id", "block_idx", "run", "r.*")


@query("SELECT id, coalesce(nullif(trim(regexp_replace(strip_accents(replace(replace(nfc_normalize(title), 'đ', 'd'), 'Đ', 'D')), '[^A-Za-z0-9 _-]', '', 'g')), ''), 'de-thi') AS name FROM e WHERE title IS NOT NULL")
def ascii_filename(t):
    """T9."""
    return t.e.where("title is not null").select("id", markup.ascii_udf("title").alias("name"))


# Render plans -----------------------------------------------------------------------------------


@query()
def render_plan_layout(t):
    """The flagship: ordered, styled, column-aware content of every page, headers and footers included."""
    return render.whole_plan(t.pages)


@query("""SELECT b.exam_id, page_id, page_order, block_idx, category, coalesce(category IN ('Table', 'List-item'), false) AS structured, CASE WHEN category IN ('Table', 'List-item') THEN text ELSE replace(text, '**', '') END AS content,
  row_number() OVER (PARTITION BY page_id ORDER BY block_idx) = 1 AND page_id <> lead AS page_break
FROM b JOIN (SELECT exam AS exam_id, arg_min(id, (page_order IS NULL, page_order, id)) AS lead FROM p WHERE ocr_text IS NOT NULL GROUP BY exam) z ON z.exam_id IS NOT DISTINCT FROM b.exam_id
WHERE coalesce(category, '') <> 'Picture' AND trim(text) <> ''""")
def render_plan_plain(t):
    """Text rows in order; text loses its inline markup, tables and lists keep theirs."""
    return render.plain_plan(t.pages)


@query(
    _FIT + """ SELECT * FROM (SELECT id AS page_id, page_order::INT AS page_order, CASE WHEN ocr_text IS NULL THEN 'missing result' WHEN coalesce(best.diff > 0.2, true) THEN 'page ratio' END AS reason
FROM p LEFT JOIN (SELECT page_id, list_sort(["""
    + _CASE_PAPER
    + """])[1] AS best FROM (SELECT id AS page_id, least(ocr_text.origin_width, ocr_text.origin_height) / greatest(ocr_text.origin_width, ocr_text.origin_height)::DOUBLE AS r FROM p WHERE ocr_text.origin_width > 0 AND ocr_text.origin_height > 0)) x ON x.page_id = p.id) WHERE reason IS NOT NULL"""
)
def export_errors(t):
    """Pages without a result, and pages whose ratio no paper has."""
    return render.export_errors(t.pages, "layout")


assert set(SQL) <= set(QUERIES) and len(LABELS) == 11
