"""Registered queries around the data: responses, recognition, queue requests, run outcomes, previews, settings and rows for the wire."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemill.functions import markup, text
from pagemill.operators import dispatch, mutations, recognition
from pagemill.plans import relational
from pagemill.plans.relational import _KEY, _SPELLED, _VIEWS, _Tables, c
from pagemill.plans.base import tuned
from pagemill.session import ensure_checkpoint_dir
from pagemill.sources.tables import json_previews, norm_key, preview_pages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL over the views of `relational`."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf: f(_Tables(tuned(spark), sf))
        if sql:
            SQL[f.__name__] = _VIEWS + sql
        return f

    return put


# Responses and recognition ----------------------------------------------------------------------


def _responses(t):
    """page_id, html, ow, oh: the response a page's blocks would have come in.

    Every block is a div with its box in thousandths and its label in one of four spellings; titles and headings stand in h elements, line
    breaks as br, whole tables and lists as they are, other text escaped, a script and an image beside it. Pages without blocks are one paragraph.
    """
    esc = c("text")
    for a, z in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        esc = F.replace(esc, F.lit(a), F.lit(z))
    esc = F.replace(esc, F.lit("\n"), F.lit("<br>"))
    plain = F.coalesce(esc, F.lit(""))
    head = c("category").isin("Title", "Section-header")
    kept = c("category").isin("Table", "List-item")
    whole = c("text").startswith("<") & c("text").endswith(">") & (F.endswith("text", F.lit("</table>")) | F.endswith("text", F.lit("</ul>")))
    depth = F.when(c("category") == "Title", 1).otherwise(F.coalesce("level", F.lit(1)) + 1).cast("string")
    body = (
        F.when(kept, F.when(whole, c("text")).otherwise(F.replace(plain, F.lit("<br>"), F.lit("\n"))))
        .when(head, F.concat(F.lit("<h"), depth, F.lit(">"), plain, F.lit("</h"), depth, F.lit(">"))).otherwise(F.concat(F.lit("<p>"), plain, F.lit("</p>")))
    )
    side = F.when(c("category").isin("Table", "List-item"), "").otherwise("<script>var x = '<p>no</p>';</script><img alt=''>")
    box = F.when(c("n_box") == 4, F.concat_ws(" ", *[F.floor(c(x) / 4).cast("int").cast("string") for x in ("x1", "y1", "x2", "y2")])).otherwise("1 2 three 4")
    div = F.concat(F.lit("<div data-bbox=\""), box, F.lit("\" data-label=\""), F.expr(f"coalesce({_SPELLED}, 'Unknown-Thing')"), F.lit("\">"), side, body, F.lit("</div>"))
    per = t.b.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("block_idx", div.alias("div")))).alias("d"))
    p = t.p.where("ocr_text is not null").select(c("id").alias("page_id"), c("ocr_text.origin_width").alias("ow"), c("ocr_text.origin_height").alias("oh"))
    return p.join(per, "page_id", "left").select("page_id", "ow", "oh", F.coalesce(F.array_join(F.transform("d", lambda x: x["div"]), ""), F.lit("<p>nothing &amp;amp; more</p>")).alias("html"))


_TIDIED = "trim(regexp_replace(regexp_replace(regexp_replace(replace({}, chr(160), ' '), '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]*\\n[ \\t]*', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_PLAIN_TEXT = _TIDIED.format("coalesce(text, '')")


@query(
    f"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY block_idx) - 1)::INT AS seq, coalesce(category, 'Text') AS category,
  CASE WHEN category IN ('Table', 'List-item') THEN trim(CASE WHEN text LIKE '<%</table>' OR text LIKE '<%</ul>' THEN text ELSE replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END, ' ' || chr(9) || chr(10) || chr(13)) ELSE {_PLAIN_TEXT} END AS text, CASE WHEN category = 'Section-header' THEN coalesce(level, 1) END AS level,
  CASE WHEN n_box = 4 THEN [least(floor(x1 / 4)::INT * ow / 1000.0::DOUBLE, ow), least(floor(y1 / 4)::INT * oh / 1000.0::DOUBLE, oh), least(floor(x2 / 4)::INT * ow / 1000.0::DOUBLE, ow), least(floor(y2 / 4)::INT * oh / 1000.0::DOUBLE, oh)] ELSE []::DOUBLE[] END AS bbox FROM b
UNION ALL SELECT id, 0, 'Text', 'nothing & more', NULL, []::DOUBLE[] FROM p WHERE ocr_text IS NOT NULL AND id NOT IN (SELECT page_id FROM b)"""
)
def response_blocks(t):
    """The blocks of every page's response."""
    r = _responses(t)
    return r.select("page_id", F.posexplode(markup.blocks_udf("html", "ow", "oh")).alias("seq", "x")).select("page_id", "seq", "x.category", "x.text", "x.level", "x.bbox")


@query(f"SELECT page_id, block_idx, {_TIDIED.format('text')} AS text FROM b WHERE text IS NOT NULL")
def tidied_texts(t):
    """H9: every block text without signs of no width, with plain blanks and line breaks."""
    return t.b.where("text is not null").select("page_id", "block_idx", text.tidy(c("text")).alias("text"))


@query(
    """SELECT page_id, block_idx, trim(regexp_replace(text, '<[^<>]*>|<[^<>]*$', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM b WHERE text IS NOT NULL AND category IN ('Table', 'List-item', 'Formula')"""
)
def preview_texts(t):
    """The plain text of blocks that hold markup."""
    return t.b.where("text is not null and category in ('Table', 'List-item', 'Formula')").select("page_id", "block_idx", markup.text_udf("text").alias("text"))


@query(
    """SELECT id AS page_id, CASE WHEN ocr_text IS NULL THEN 'bad_request' ELSE 'ok' END AS status, 1 AS attempts,
  CASE WHEN ocr_text IS NULL THEN 0 ELSE greatest(1, (SELECT count(*) FROM b WHERE b.page_id = p.id)) END::INT AS n_blocks FROM p"""
)
def recognition_outcome(t):
    """M1, M2, M3: one call per page, here on stored responses; pages without one are refused."""
    r = t.p.select(c("id").alias("page_id")).join(_responses(t), "page_id", "left").select("page_id", "html", F.coalesce("ow", F.lit(1)).alias("input_width"), F.coalesce("oh", F.lit(1)).alias("input_height"))
    return recognition.recognise(r).select("page_id", "status", "attempts", F.size("blocks").alias("n_blocks"))


@query(
    f"""SELECT exam_id, CASE WHEN bool_or(NOT ok) THEN 'failed' WHEN n_done >= total THEN 'finished' ELSE 'open' END AS outcome, arg_min(error, (arrived_at, page_id)) FILTER (NOT ok) AS error FROM (
  SELECT r.exam_id, r.ok, r.error, r.arrived_at, r.page_id, d.n_done, coalesce(d.total, 0) AS total FROM page_result r LEFT JOIN (
    SELECT x.exam_id, x.n_done, y.total FROM (SELECT exam_id, count(DISTINCT page_id) AS n_done FROM page_result WHERE ok GROUP BY exam_id) x JOIN (SELECT exam, count(*) AS total FROM p GROUP BY exam) y ON y.exam = x.exam_id) d USING (exam_id))
GROUP BY exam_id, n_done, total"""
)
def exam_endings(t):
    """A page error fails its own exam only; an exam with all pages is finished, any other stays open for the next run."""
    r = t.page_result
    bad = F.when(~c("ok"), F.struct("arrived_at", "page_id", "error"))
    g = r.groupBy("exam_id").agg(F.max(~c("ok")).alias("bad"), F.min(bad)["error"].alias("error"))
    done = r.where("ok").select("exam_id", "page_id").distinct().groupBy("exam_id").agg(F.count("page_id").alias("n_done"))
    total = t.p.groupBy(c("exam").alias("exam_id")).agg(F.count(F.lit(1)).alias("total"))
    g = g.join(done, "exam_id", "left").join(total, "exam_id", "left")
    return g.select("exam_id", F.when(c("bad"), "failed").when(c("n_done") >= c("total"), "finished").otherwise("open").alias("outcome"), "error")


@query(
    """, r AS (SELECT DISTINCT exam_id, page_id FROM (SELECT exam AS exam_id, id AS page_id FROM p WHERE ocr_text IS NOT NULL AND exam IS NOT NULL UNION ALL SELECT exam_id, page_id FROM page_result WHERE ok AND page_id IS NOT NULL)),
t AS (SELECT exam AS exam_id, count(*)::INT AS total FROM p WHERE exam IS NOT NULL GROUP BY exam)
SELECT exam_id, count(*)::INT AS n_done, total FROM r JOIN t USING (exam_id) GROUP BY exam_id, total HAVING count(*) >= total"""
)
def completion_resumed(t):
    """Completion that begins with the results that are stored already."""
    from pagemill.streaming.completion import completed, seeded

    totals = t.p.where("exam is not null").groupBy(c("exam").alias("exam_id")).agg(F.count(F.lit(1)).cast("int").alias("total"))
    stored = t.p.where("ocr_text is not null and exam is not null").select(c("exam").alias("exam_id"), c("id").alias("page_id"))
    return completed(seeded(t.page_result, stored), totals)


# Requests ---------------------------------------------------------------------------------------

BUDGET = 60
_REQUESTS = f""", n AS (SELECT exam, count(*) AS pages FROM p GROUP BY exam),
q AS (SELECT DISTINCT {_KEY.format('key_value')} AS exam_id FROM deletion_log UNION ALL SELECT id FROM e UNION ALL SELECT DISTINCT exam_id FROM page_result WHERE exam_id IS NOT NULL),
rq AS (SELECT substr(exam_id, 1, 1) AS run, exam_id, row_number() OVER (PARTITION BY exam_id) AS nth FROM q),
rp AS (SELECT run, exam_id, nth, row_number() OVER (PARTITION BY run ORDER BY nth, exam_id) AS pos FROM rq)"""


def _requests(t):
    """run, pos, exam_id: a request batch for each first letter, holding every known, deleted and reported exam; repeats come after."""
    ids = t.deletion_log.select(norm_key("key_value").alias("exam_id")).distinct().unionAll(t.e.select("id")).unionAll(t.page_result.where("exam_id is not null").select("exam_id").distinct())
    from pyspark.sql import Window

    nth = ids.groupBy("exam_id").agg(F.count(F.lit(1)).alias("n")).select("exam_id", F.explode(F.sequence(F.lit(1), c("n"))).alias("nth"))
    nth = nth.withColumn("run", F.substring("exam_id", 1, 1))
    return nth.withColumn("pos", F.row_number().over(Window.partitionBy("run").orderBy("nth", "exam_id"))).drop("nth")


@query(
    _REQUESTS + f""", x AS (SELECT rp.*, e.id IS NOT NULL AS found, e.status, coalesce(n.pages, 0) AS pages, row_number() OVER (PARTITION BY run, exam_id ORDER BY pos) > 1 AS again FROM rp LEFT JOIN e ON e.id = exam_id LEFT JOIN n ON n.exam = exam_id),
y AS (SELECT *, coalesce(found AND status = 'pending' AND NOT again, false) AS ok FROM x),
z AS (SELECT *, sum(CASE WHEN ok THEN pages ELSE 0 END) OVER (PARTITION BY run ORDER BY pos) AS running FROM y),
f AS (SELECT *, coalesce(bool_or(ok AND running > {BUDGET}) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM z)
SELECT run, pos, exam_id, ok AND running <= {BUDGET} AND NOT closed AS queued, CASE WHEN closed THEN 'queue is full' WHEN NOT found THEN 'not found'
  WHEN NOT ok THEN 'status is ''' || CASE WHEN again AND status = 'pending' THEN 'processing' ELSE status END || ''', expected ''pending''' WHEN running > {BUDGET} THEN 'over capacity {BUDGET}' END AS reason FROM f"""
)
def enqueue_outcome(t):
    """Every request with its outcome and the first reason against it."""
    n = t.p.groupBy("exam").agg(F.count(F.lit(1)).alias("pages"))
    r = _requests(t).join(t.e.select(c("id").alias("exam_id"), "status", F.lit(True).alias("found")), "exam_id", "left").join(n, c("exam") == c("exam_id"), "left")
    r = r.select("run", "pos", "exam_id", "status", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("pages", F.lit(0)).alias("pages"))
    return dispatch.request_reasons(r, "run", "pos", "status", "found", "pages", BUDGET).select("run", "pos", "exam_id", "queued", "reason")


def _changed(t, of: str, wipe: bool):
    """Requests for exams of a status turned back to pending, with the reason where they aren't."""
    r = _requests(t).select("exam_id").distinct().join(t.e.select(c("id").alias("exam_id"), "status"), "exam_id", "left")
    done = F.coalesce(c("status") == of, F.lit(False))
    reason = F.when(c("status").isNull(), "not found").when(~done, F.concat(F.lit("status is '"), c("status"), F.lit(f"', expected '{of}'")))
    n = t.p.groupBy(c("exam").alias("exam_id")).agg(F.count("ocr_text").alias("n_results"))
    kept = F.lit(0) if wipe else F.coalesce("n_results", F.lit(0))
    return r.join(n, "exam_id", "left").select("exam_id", done.alias("done"), reason.alias("reason"), F.when(done, "pending").otherwise(c("status")).alias("status"), F.when(done, kept).otherwise(F.coalesce("n_results", F.lit(0))).alias("n_results"))


_CHANGED = _REQUESTS + """, r AS (SELECT DISTINCT rp.exam_id, e.status, (SELECT count(ocr_text) FROM p WHERE p.exam = rp.exam_id) AS n FROM rp LEFT JOIN e ON e.id = rp.exam_id)
SELECT exam_id, coalesce(status = '{0}', false) AS done, CASE WHEN status IS NULL THEN 'not found' WHEN status <> '{0}' THEN 'status is ''' || status || ''', expected ''{0}''' END AS reason,
  CASE WHEN status = '{0}' THEN 'pending' ELSE status END AS status, CASE WHEN status = '{0}' THEN {1} ELSE n END AS n_results FROM r"""


@query(_CHANGED.format("processing", "0"))
def cancel_outcome(t):
    """Q4, Q7: exams in work back to pending, their results wiped."""
    return _changed(t, "processing", wipe=True)


@query(_CHANGED.format("failed", "n"))
def retry_outcome(t):
    """Q8: failed exams back to pending, their results kept."""
    return _changed(t, "failed", wipe=False)


@query(
    """, n AS (SELECT exam, count(*) AS pages FROM p GROUP BY exam), k AS (SELECT id, started_at, id IN (SELECT exam_id FROM page_result) AS charged FROM e WHERE status = 'processing')
SELECT id, (row_number() OVER (ORDER BY charged DESC, started_at NULLS LAST, id))::BIGINT AS queue_pos, charged, CASE WHEN charged THEN coalesce(pages, 0) ELSE 0 END AS charge FROM k LEFT JOIN n ON n.exam = k.id"""
)
def readmitted_queue(t):
    """Q6: the queue after a restart: exams that nothing is known of are put at its end without a charge."""
    n = t.p.groupBy("exam").agg(F.count(F.lit(1)).alias("pages"))
    known = t.page_result.select(c("exam_id").alias("id")).distinct().withColumn("known", F.lit(True))
    k = t.e.where("status = 'processing'").select("id", "started_at").join(known, "id", "left").select("id", "started_at", F.coalesce("known", F.lit(False)).alias("charged"))
    k = mutations.positions(k, [F.desc("charged"), F.asc_nulls_last("started_at"), c("id")], "_at").join(n, c("exam") == c("id"), "left")
    return k.select("id", (c("_at") + 1).alias("queue_pos"), "charged", F.when(c("charged"), F.coalesce("pages", F.lit(0))).otherwise(0).alias("charge"))


@query(
    """, k AS (SELECT id, id IN (SELECT exam_id FROM page_result) AS charged, (SELECT count(*) FROM p WHERE p.exam = e.id) AS pages FROM e WHERE status = 'processing')
SELECT count(*) AS queued, coalesce(sum(pages) FILTER (charged), 0)::BIGINT AS admitted_pages, 500 AS max_pages, count(*) > 0 AS may_start,
  CASE WHEN count(*) > 0 THEN 'running' WHEN (SELECT arg_max(error, (arrived_at, page_id)) FROM page_result WHERE NOT ok) IS NOT NULL THEN 'error' ELSE 'idle' END AS label FROM k"""
)
def queue_gauges(t):
    """The queue's length, charge and cap, whether a run may start, and the label of the run."""
    n = t.p.groupBy(c("exam").alias("id")).agg(F.count(F.lit(1)).alias("pages"))
    known = t.page_result.select(c("exam_id").alias("id")).distinct().withColumn("charged", F.lit(True))
    k = t.e.where("status = 'processing'").select("id").join(known, "id", "left").join(n, "id", "left")
    g = k.agg(F.count(F.lit(1)).alias("queued"), F.coalesce(F.sum(F.when(c("charged"), c("pages"))), F.lit(0)).alias("admitted_pages"))
    last = t.page_result.where(~c("ok")).agg(F.max_by("error", F.struct("arrived_at", "page_id")).alias("last_error"))
    label = F.when(c("queued") > 0, "running").when(c("last_error").isNotNull(), "error").otherwise("idle")
    # One-row tables on either side.
    return g.join(last).select("queued", "admitted_pages", F.lit(500).alias("max_pages"), (c("queued") > 0).alias("may_start"), label.alias("label"))


# Previews, settings, rows for the wire -----------------------------------------------------------


@query("SELECT exam AS preview_id, id AS page_id, page_order::INT AS page_order, file_path AS file FROM p WHERE exam IS NOT NULL")
def staged_previews(t):
    """Previews of exams written as JSON, read again, and their pages looked up; a preview holds a thousand page numbers, so a long exam has several."""
    pages = F.sort_array(F.collect_list(F.struct(c("page_order").cast("int").alias("order"), c("id").alias("id"), F.lit("upload").alias("source"), c("file_path").alias("file"))))
    staged = t.p.where("exam is not null").groupBy(c("exam").alias("previewId"), F.floor(c("page_order") / 1000).alias("part")).agg(F.lit("").alias("title"), F.lit("").alias("createdAt"), pages.alias("pages")).drop("part")
    folder = f"{ensure_checkpoint_dir(t.spark)}/previews-{uuid.uuid4().hex}"
    staged.write.json(folder)
    return preview_pages(json_previews(t.spark, folder, lines=True)).select(c("previewId").alias("preview_id"), "page_id", "page_order", "file")


@query("SELECT id, coalesce(nullif(trim(title), ''), 'untitled') AS shown, CASE WHEN title = 'untitled' THEN NULL ELSE title END AS stored FROM e")
def effective_settings(t):
    """an explicit value or else the default; a value that is the default shown is stored as none."""
    return t.e.select("id", text.effective(F.nullif(F.trim("title"), F.lit("")), F.lit("untitled")).alias("shown"), text.stored_value(c("title"), F.lit("untitled")).alias("stored"))


_ISO = "strftime({0} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || 'Z'"


@query(f"SELECT id, title, status, coalesce(error_message, '') AS error, {_ISO.format('uploaded_at')} AS uploaded, {_ISO.format('coalesce(finished_at, started_at, uploaded_at)')} AS shown FROM e")
def exam_rows(t):
    """Exams as they go over the wire."""
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.e.select("id", "title", "status", F.coalesce("error_message", F.lit("")).alias("error"), iso(c("uploaded_at")).alias("uploaded"), iso(F.coalesce("finished_at", "started_at", "uploaded_at")).alias("shown"))


@query(
    """SELECT id, 'https://' || split_part(id, '-', 1) || '.example.org/health' AS health, split_part(id, '-', 1) AS ref, coalesce(error_message, 'plain') AS error FROM e"""
)
def service_addresses(t):
    """The health address and project of a service address, and the text of a server's error."""
    host = F.concat(F.lit("https://"), F.split("id", "-")[0], F.lit(".example.org"))
    url = F.concat(host, F.when(F.length("id") % 2 == 0, "/v1/").otherwise("//"))
    body = F.when(c("error_message").isNull(), "plain").when(c("status") == "failed", F.to_json(F.struct(F.struct(c("error_message").alias("message")).alias("error")))).otherwise(F.to_json(F.struct(c("error_message").alias("message"))))
    return t.e.select("id", text.health_url(url).alias("health"), text.project_ref(url).alias("ref"), text.error_text(body).alias("error"))


@query(
    """SELECT 'plain' AS mode, count(*) AS n FROM b WHERE coalesce(category, '') <> 'Picture' AND trim(text) <> '' UNION ALL SELECT 'pdf', count(*) FROM p WHERE ocr_text IS NOT NULL"""
)
def export_modes(t):
    """Rows of the plans by name of the mode (the layout plan is `render_plan_layout`)."""
    from pagemill.plans import render

    count = lambda mode: render.export_plan(t.pages, mode).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"))
    return count("plain").unionByName(count("pdf"))


assert not set(QUERIES) & set(relational.QUERIES)
