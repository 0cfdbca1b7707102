"""The render plan: what an export contains, in order and styled, without a binary format."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import markup, text
from pagemill.operators import geometry, layout
from pagemill.operators.mutations import latest_by
from pagemill.sources.tables import blocks, distinct_pages, norm_key


#: Fixed value: the top and bottom margin, half an inch.
EDGE_TWIPS = 720


def fitted(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` with its boxed blocks moved to the nearest paper (F3, F4, G2-G5, G7): main, edges, w, h, rejected.

    Boxes, header split and stamp removal are array expressions inside the page's row, so a page's
    blocks are neither shuffled nor joined for them.
    """
    p = pages.withColumn("n", geometry.nearest_paper(F.col("ocr_text.origin_width"), F.col("ocr_text.origin_height"))).where("n is not null")
    ow, oh, tw, th = F.col("ocr_text.origin_width"), F.col("ocr_text.origin_height"), F.col("n.width"), F.col("n.height")
    move = lambda b, i: geometry.scaled(b["bbox"][i], th if i % 2 else tw, oh if i % 2 else ow).cast("double")
    boxed = F.filter(F.transform("ocr_text.layouts", lambda b, i: F.struct(i.alias("block_idx"), b.alias("b"))), lambda x: F.size(x["b"]["bbox"]) == 4)
    arr = F.transform(
        boxed,
        lambda x: F.struct(
            x["block_idx"].alias("block_idx"), x["b"]["category"].alias("category"), x["b"]["level"].alias("level"), x["b"]["text"].alias("text"),
            *[move(x["b"], i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        ),
    )
    p = p.select(norm_key("exam_id").alias("exam_id"), F.col("id").alias("page_id"), F.col("page_order").cast("int").alias("page_order"), tw.alias("page_w"), th.alias("page_h"), (F.col("n.diff") > geometry.MAX_RATIO_DIFF).alias("rejected"), arr.alias("all"))
    edge = lambda b: F.coalesce(b["category"].isin("Page-header", "Page-footer"), F.lit(False))
    p = p.withColumns({"body": F.filter("all", lambda b: ~edge(b)), "edges": F.filter("all", edge)}).drop("all")
    hit = lambda a: F.exists("body", lambda z: (z["block_idx"] != a["block_idx"]) & (a["x1"] < z["x2"]) & (z["x1"] < a["x2"]) & (a["y1"] < z["y2"]) & (z["y1"] < a["y2"]))
    return p.withColumn("main", F.filter("body", lambda a: F.coalesce(a["category"] != "Picture", F.lit(True)) | ~hit(a))).drop("body")


def first_pages(pages: DataFrame) -> DataFrame:
    """page_id, _lead (true): the first rendered page of each exam, by an aggregation over keys, so that no exam's rows meet in one window.

    A page with a boxed block that is neither header, footer nor picture is rendered for sure; only the others are fitted first.
    """
    n = geometry.nearest_paper(F.col("ocr_text.origin_width"), F.col("ocr_text.origin_height"))
    body = lambda b: (F.size(b["bbox"]) == 4) & ~F.coalesce(b["category"].isin("Page-header", "Page-footer", "Picture"), F.lit(False))
    sure = F.coalesce(F.exists("ocr_text.layouts", body), F.lit(False))
    good = pages.where(n["diff"] <= geometry.MAX_RATIO_DIFF)
    keys = good.where(sure).select(norm_key("exam_id").alias("exam_id"), F.col("id").alias("page_id"), F.col("page_order").cast("int").alias("page_order"))
    rest = fitted(good.where(~sure)).where("size(main) > 0").select("exam_id", "page_id", "page_order")
    lead = keys.unionByName(rest).groupBy("exam_id").agg(F.min(F.struct(F.col("page_order").isNull(), "page_order", "page_id")).alias("lead"))
    return lead.select("lead.page_id", F.lit(True).alias("_lead"))


def layout_plan(pages: DataFrame) -> DataFrame:
    """The main blocks of `whole_plan`: one row per block in a section's columns."""
    return whole_plan(pages).where("part = 'main'").drop("part", "share")


def whole_plan(pages: DataFrame) -> DataFrame:
    """One row per rendered block: part, place (section, column), style, font, alignment and page break kind.

    Headers and footers (`part`) hang on the page's first section as cells in reading order, outside its columns:
    `share` is a cell's part of the content width (G10). A page without main blocks renders nothing.
    The only shuffle is the one that removes repeated pages: columns are split inside the page's row,
    and all windows are partitioned by page.
    """
    p = fitted(pages).where("not rejected and size(main) > 0")
    xs = lambda c: F.transform("main", lambda b: b[c])
    p = p.withColumn("col", layout.columns_of(xs("x1"), xs("x2"), F.col("page_w").cast("double")))
    p = p.withColumns(geometry.margins_of(xs("x1"), xs("x2"), F.col("page_w").cast("double")))
    # Repeated pages go only now, since a Python function forgets how rows are partitioned: all that follows stays in one shuffle by page.
    p = latest_by(p, ["page_id"], [F.col("page_order")]).join(first_pages(pages), "page_id", "left")
    keep = ["block_idx", "category", "level", "text", "x1", "y1", "x2", "y2"]
    put = lambda b, part, col: F.struct(part.alias("part"), col.cast("int").alias("column_idx"), *[b[c].alias(c) for c in keep])
    main = F.transform("main", lambda b, k: put(b, F.lit("main"), F.element_at("col", k + 1)))
    edges = F.transform("edges", lambda b: put(b, F.when(b["category"] == "Page-header", "header").otherwise("footer"), F.lit(None)))
    z = p.select("exam_id", "page_id", "page_order", "page_w", "page_h", "left", "right", "_lead", F.inline(F.concat(main, edges)))
    is_main = F.col("part") == "main"
    box, page = Window.partitionBy("page_id", "part", "column_idx"), Window.partitionBy("page_id", "part").orderBy("block_idx")
    z = z.withColumns({"cx1": F.min("x1").over(box), "cy1": F.min("y1").over(box), "cx2": F.max("x2").over(box), "cy2": F.max("y2").over(box)})
    prev = {c: F.lag(c).over(page) for c in ("column_idx", "cx1", "cy1", "cx2", "cy2")}
    same = layout.side_by_side(*(prev[c] for c in ("cx1", "cy1", "cx2", "cy2")), *(F.col(c) for c in ("cx1", "cy1", "cx2", "cy2")))
    brk = F.when(~is_main | prev["column_idx"].isNull() | (prev["column_idx"] == F.col("column_idx")) | same, 0).otherwise(1)
    z = z.withColumn("_brk", brk).withColumn("section_idx", F.sum("_brk").over(page.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    sec, cells = Window.partitionBy("page_id", "part", "section_idx"), Window.partitionBy("page_id", "part")
    z = z.withColumn("single", F.min("column_idx").over(sec) == F.max("column_idx").over(sec))
    cat = F.col("category")
    style = F.when(cat == "Title", "Title").when(cat == "Section-header", F.concat(F.lit("Heading "), F.coalesce("level", F.lit(3)).cast("string"))).when(cat == "Picture", "blank").when(~is_main, F.col("part")).otherwise("body")
    ref1 = F.when(F.col("single"), F.col("left")).otherwise(F.col("cx1"))
    ref2 = F.when(F.col("single"), F.col("page_w") - F.col("right")).otherwise(F.col("cx2"))
    align = F.when(cat == "Title", "CENTER").when(~is_main, "LEFT").otherwise(geometry.alignment(F.col("x1"), F.col("x2"), ref1, ref2))
    width = F.col("x2") - F.col("x1")
    share = F.when(~is_main, F.when(F.sum(width).over(cells) > 0, width / F.sum(width).over(cells)).otherwise(1.0 / F.count(F.lit(1)).over(cells)))
    first = is_main & (F.row_number().over(page) == 1)
    # A column reaches to the next one of its section; all of a section fill the content width.
    gap = geometry.GAP_TWIPS / geometry.TWIPS_PER_PX
    head = is_main & (F.row_number().over(Window.partitionBy("page_id", "part", "column_idx").orderBy("block_idx")) == 1)
    heads = Window.partitionBy("page_id", "part", "section_idx", head).orderBy("column_idx")
    of_section = Window.partitionBy("page_id", "part", "section_idx")
    own = F.col("cx2") - F.col("cx1")
    z = z.withColumn("_raw", F.when(head, F.greatest(own, F.coalesce(F.lead("cx1").over(heads) - F.col("cx1") - gap, own))))
    content = F.col("page_w") - F.col("left") - F.col("right")
    total, n_cols = F.sum("_raw").over(of_section), F.count("_raw").over(of_section)
    room = F.greatest(content - gap * (n_cols - 1), F.lit(1.0))
    raw = F.max("_raw").over(box)
    z = z.withColumns({"_content": content, "_raw_col": raw, "_total": total, "_room": room})
    col_width = F.when(is_main, F.when(F.col("_total") > 0, F.col("_raw_col") / F.col("_total") * F.col("_room")).otherwise(F.col("_raw_col")))
    kind = F.when(first & F.col("_lead").isNull(), "NEW_PAGE").when(first, "FIRST").when(F.col("_brk") == 1, "CONTINUOUS").otherwise("")
    return z.select(
        "exam_id", "page_id", "page_order", "part", "section_idx", "column_idx", "block_idx", "category", style.alias("style"), align.alias("align"),
        text.font_points(cat).alias("font_pt"), (cat == "Title").alias("force_bold"), kind.alias("break_type"),
        geometry.twips(F.col("page_w")).alias("page_w_twips"), geometry.twips(F.col("page_h")).alias("page_h_twips"), F.when(F.col("page_h") < F.col("page_w"), "landscape").otherwise("portrait").alias("orientation"),
        F.lit(EDGE_TWIPS).alias("top_twips"), F.lit(EDGE_TWIPS).alias("bottom_twips"), geometry.twips(col_width).alias("col_twips"), geometry.twips(F.col("left")).alias("left_twips"), geometry.twips(F.col("right")).alias("right_twips"), share.alias("share"), "text",
    )


def with_content(plan: DataFrame) -> DataFrame:
    """The plan with styled runs, table cells and list lines in place of raw text."""
    t = F.coalesce("text", F.lit(""))
    return plan.withColumns(
        {
            "runs": F.when(~F.col("category").isin("Table", "List-item", "Picture"), markup.runs_udf(t)),
            "cells": F.when(F.col("category") == "Table", markup.grid_udf(t)),
            "lines": F.when(F.col("category") == "List-item", markup.lines_udf(t)),
        }
    ).drop("text")


def plain_plan(pages: DataFrame) -> DataFrame:
    """Text rows in order; pictures and blank texts go, tables and lists keep structure, other text loses its markup."""
    b = blocks(distinct_pages(pages)).where("coalesce(category, '') <> 'Picture' and trim(text) <> ''")
    structured = F.coalesce(F.col("category").isin("Table", "List-item"), F.lit(False))
    marked = F.col("text").contains("*") | F.col("text").contains("__")
    plain = F.when(structured | ~marked, F.col("text")).otherwise(markup.plain_udf(F.when(marked & ~structured, F.col("text"))))
    at = b.groupBy("page_id").agg(F.min("block_idx").alias("_top"))
    # A page break stands before the first block of every page but the exam's first one with a result, whatever it shows.
    p = distinct_pages(pages).where("ocr_text is not null")
    lead = p.groupBy(norm_key("exam_id").alias("_exam")).agg(F.min(F.struct(F.col("page_order").isNull(), "page_order", "id")).alias("lead")).select("_exam", F.col("lead.id").alias("_lead"))
    b = b.join(at, "page_id").join(lead, F.col("exam_id").eqNullSafe(F.col("_exam")))
    brk = (F.col("block_idx") == F.col("_top")) & (F.col("page_id") != F.col("_lead"))
    return b.select("exam_id", "page_id", "page_order", "block_idx", "category", structured.alias("structured"), plain.alias("content"), brk.alias("page_break"))


def pdf_plan(pages: DataFrame) -> DataFrame:
    """Page sizes in points of the original images, in page order; recognition doesn't matter."""
    p = distinct_pages(pages).where("ocr_text is not null")
    return p.select(
        F.col("id").alias("page_id"), "page_order", geometry.points(F.col("ocr_text.origin_width")).alias("width_pt"), geometry.points(F.col("ocr_text.origin_height")).alias("height_pt"), "file_path"
    )


def export_errors(pages: DataFrame, mode: str) -> DataFrame:
    """page_id, page_order, reason of the pages an export of the mode can't use; a layout also refuses pages of an odd ratio."""
    p = distinct_pages(pages)
    if mode == "pdf":
        reason = F.when(F.col("file_path").isNull(), "missing image")
    else:
        reason = F.when(F.col("ocr_text").isNull(), "missing result")
        if mode != "plain":
            diff = geometry.nearest_paper(F.col("ocr_text.origin_width"), F.col("ocr_text.origin_height"))["diff"]
            reason = reason.when(F.coalesce(diff > geometry.MAX_RATIO_DIFF, F.lit(True)), "page ratio")
    return p.select(F.col("id").alias("page_id"), F.col("page_order").cast("int").alias("page_order"), reason.alias("reason")).where("reason is not null")


def export_plan(pages: DataFrame, mode: str) -> DataFrame:
    """K16: 'plain' and 'pdf' by name, anything else is the layout plan."""
    return {"plain": plain_plan, "pdf": pdf_plan}.get(mode, whole_plan)(pages)
