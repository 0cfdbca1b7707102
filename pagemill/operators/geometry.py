"""Page geometry (inventory F3, F8, F9, A11, A12, G1, G2, G3, G4, G5, G6, G7, G8, G9, G10, G11, G12): column expressions and per-page windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Resolution, paper sizes in inches, limits in pixels.
DPI = 300
PAPER = {"a4": (8.2677, 11.6929), "envelope": (4.33, 8.66), "legal": (8.5, 14.0), "letter": (8.5, 11.0)}
MIN_PIXELS, MAX_PIXELS, FACTOR, MAX_ASPECT = 1_605_632, 3_211_264, 28, 200
MARGIN_LEAST, MARGIN_MOST, TRIM, MAX_RATIO_DIFF = 75, 300, 0.05, 0.2
GAP_TWIPS = 240
TWIPS_PER_PX = 1440 / DPI


def resized(w: Column, h: Column, least: int = MIN_PIXELS, most: int = MAX_PIXELS, f: int = FACTOR) -> Column:
    """G1: struct(width, height) a page image is brought to; null for an aspect above MAX_ASPECT or no size.

    Sides are multiples of f, rounded half to even; too many pixels shrink both sides by one scale
    (rounded down), too few grow them (rounded up), and a growth that overshoots shrinks again.
    """
    snap = lambda v: F.greatest(F.bround(v / f).cast("long") * f, F.lit(f))
    shrink = lambda v, a, b, m: F.greatest(F.floor(v / F.sqrt(a * b / m) / f).cast("long") * f, F.lit(f))
    w0, h0 = w.cast("double"), h.cast("double")
    sw, sh = snap(w0), snap(h0)
    gw, gh = (F.ceil(v * F.sqrt(least / (w0 * h0)) / f).cast("long") * f for v in (w0, h0))
    too_many, too_few, over = sw * sh > most, sw * sh < least, gw * gh > most
    pick = lambda v, s, g: F.when(too_many, shrink(v, w0, h0, most)).when(too_few & over, shrink(g.cast("double"), gw.cast("double"), gh.cast("double"), most)).when(too_few, g).otherwise(s)
    ok = (w > 0) & (h > 0) & (F.greatest(w, h) / F.least(w, h) <= MAX_ASPECT)
    return F.when(ok, F.struct(pick(w0, sw, gw).alias("width"), pick(h0, sh, gh).alias("height")))


def nearest_paper(w: Column, h: Column) -> Column:
    """struct(diff, name, width, height): the paper whose side ratio is nearest (ties by name), turned like the page."""
    ratio = F.least(w, h) / F.greatest(w, h)
    options = []
    for name, (a, b) in PAPER.items():
        pw, ph = round(a * DPI), round(b * DPI)
        options.append(F.struct(F.abs(ratio - F.lit(pw / ph)).alias("diff"), F.lit(name).alias("name"), F.lit(pw).alias("pw"), F.lit(ph).alias("ph")))
    best = F.array_min(F.array(*options))
    wide = h < w
    out = F.struct(best["diff"].alias("diff"), best["name"].alias("name"), F.when(wide, best["ph"]).otherwise(best["pw"]).alias("width"), F.when(wide, best["pw"]).otherwise(best["ph"]).alias("height"))
    return F.when((w > 0) & (h > 0), out)


def scaled(v: Column, target: Column, origin: Column) -> Column:
    """A coordinate moved to the target size, half to even; unchanged when the origin is 0."""
    return F.when(origin > 0, F.bround(v * target / origin).cast("long")).otherwise(v.cast("long"))


def without_stamps(blocks: DataFrame, label: str = "Picture") -> DataFrame:
    """Drops a picture that strictly overlaps any other block of its page (touching edges don't count).

    An anti join with the page as equality key and the overlap as condition; only pictures take part on the left.
    """
    a, b = blocks.alias("a"), blocks.where("x1 is not null").select("page_id", "block_idx", "x1", "y1", "x2", "y2").alias("b")
    cond = (
        (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.block_idx") != F.col("b.block_idx")) & (F.col("a.x1") < F.col("b.x2")) & (F.col("b.x1") < F.col("a.x2"))
        & (F.col("a.y1") < F.col("b.y2")) & (F.col("b.y1") < F.col("a.y2"))
    )
    pictures = a.where(F.col("a.category") == label).join(b, cond, "left_anti")
    return blocks.where(F.coalesce(F.col("category") != label, F.lit(True))).unionByName(pictures.select(*blocks.columns))


def union_boxes(blocks: DataFrame, by: list[str]) -> DataFrame:
    """The box around all boxes of a group; groups without boxes give none."""
    return blocks.where("x1 is not null").groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def content_margins(blocks: DataFrame, by: list[str], start: str, end: str, extent: Column) -> DataFrame:
    """Left and right margins per group: the extremes after trimming a twentieth at either side, clamped."""
    g = blocks.where(F.col(start).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(start)).alias("s"), F.array_sort(F.collect_list(end)).alias("e"), F.max(extent).alias("extent"))
    n, t = F.size("s"), F.floor(F.size("s") * F.lit(TRIM)).cast("int")
    clamp = lambda v: F.least(F.greatest(v, F.lit(float(MARGIN_LEAST))), F.lit(float(MARGIN_MOST)))
    return g.select(*by, clamp(F.element_at("s", t + 1)).alias("before"), clamp(F.col("extent") - F.element_at("e", n - t)).alias("after"))


def margins_of(starts: Column, ends: Column, extent: Column) -> dict[str, Column]:
    """G6 inside a page's row: {left, right} from arrays of block starts and ends."""
    n = F.size(starts)
    t = F.floor(n * F.lit(TRIM)).cast("int")
    clamp = lambda v: F.least(F.greatest(v, F.lit(float(MARGIN_LEAST))), F.lit(float(MARGIN_MOST)))
    return {"left": clamp(F.element_at(F.array_sort(starts), t + 1)), "right": clamp(extent - F.element_at(F.array_sort(ends), n - t))}


def column_widths(columns: DataFrame, by: list[str], order: str, content: Column) -> DataFrame:
    """Widths of the columns of a section, in pixels: each reaches to the next, and all fit the content width."""
    gap = GAP_TWIPS / TWIPS_PER_PX
    w = Window.partitionBy(*by).orderBy(order)
    full = Window.partitionBy(*by)
    own = F.col("x2") - F.col("x1")
    raw = F.greatest(own, F.lead("x1").over(w) - F.col("x1") - gap)
    out = columns.withColumn("raw", F.coalesce(raw, own)).withColumns({"total": F.sum("raw").over(full), "n": F.count(F.lit(1)).over(full)})
    room = F.greatest(content - gap * (F.col("n") - 1), F.lit(1.0))
    return out.withColumn("width", F.when(F.col("total") > 0, F.col("raw") / F.col("total") * room).otherwise(F.col("raw"))).drop("raw", "total", "n")


def alignment(x1: Column, x2: Column, left: Column, right: Column) -> Column:
    """CENTER, RIGHT or LEFT of a box inside a reference span; LEFT when the span is empty."""
    ref = right - left
    near = F.greatest(F.lit(15.0), 0.1 * ref)
    before, after = x1 - left, right - x2
    narrow = (x2 - x1) / ref <= 0.9
    return F.when(ref <= 0, "LEFT").when(narrow & (F.abs(before - after) <= near), "CENTER").when(narrow & (after <= near) & (before > near), "RIGHT").otherwise("LEFT")


def twips(px: Column) -> Column:
    """Pixels as twips, cut off."""
    return (px * 1440 / DPI).cast("long")


def points(px: Column) -> Column:
    """Pixels as points."""
    return px * 72.0 / DPI


def overlay(v: Column, size: Column) -> Column:
    """a coordinate in percent of the input size."""
    return F.when(size > 0, 100.0 * v / size)
