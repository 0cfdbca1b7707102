"""The layout render plan against a plain computation over the same rows, page by page, without Spark."""

import math
import random

import pyarrow.parquet as pq
import pytest

from pagemill.plans import render
from pagemill.schema import OCR

PAGES = f"id string, exam_id string, page_order smallint, file_path string, ocr_text {OCR}"
PAPER = (("a4", 2480, 3508), ("envelope", 1299, 2598), ("legal", 2550, 4200), ("letter", 2550, 3300))
SIZES = {"Title": 22, "Section-header": 15, "Text": 11, "List-item": 11, "Formula": 11}
EDGES = ("Page-header", "Page-footer")


def even(v):
    return float(round(v))


def variance(v):
    m = sum(v) / len(v)
    return sum((x - m) ** 2 for x in v) / len(v)


def columns(blocks, width):
    """The cheapest split into runs, every run costed by itself."""
    n = len(blocks)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for i in range(1, n + 1):
        for j in range(i):
            part = blocks[j:i]
            span = max(b["x2"] for b in part) - min(b["x1"] for b in part)
            a, m = variance([b["x1"] / width for b in part]), variance([(b["x1"] + b["x2"]) / 2 / width for b in part])
            free = sum(1 - (b["x2"] - b["x1"]) / (span if span > 0 else 1e-6) for b in part)
            cost = best[j] + 0.95 * free + 0.05 * 2 * a * m / (a + m + 1e-6) + 0.65
            if cost < best[i] - 1e-9:
                best[i], back[i] = cost, j
    out, i = [], n
    while i:
        out.append(blocks[back[i] : i])
        i = back[i]
    return out[::-1]


def hull(blocks):
    return min(b["x1"] for b in blocks), min(b["y1"] for b in blocks), max(b["x2"] for b in blocks), max(b["y2"] for b in blocks)


def side_by_side(a, b):
    x, y = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    w, h = min(a[2] - a[0], b[2] - b[0]), min(a[3] - a[1], b[3] - b[1])
    return (max(x, 0) / w if w > 0 else 0) <= 0.1 and (max(y, 0) / h if h > 0 else 0) >= 0.6


def clamp(v):
    return min(max(v, 75.0), 300.0)


def page_plan(row):
    """[plan rows] of one page, without its break kind, or None when it renders nothing."""
    o = row["ocr_text"]
    if not o or not o["origin_width"] or not o["origin_height"] or not o["layouts"]:
        return None
    w, h = o["origin_width"], o["origin_height"]
    diff, _, pw, ph = min((abs(min(w, h) / max(w, h) - a / b), n, a, b) for n, a, b in PAPER)
    if diff > 0.2:
        return None
    pw, ph = (ph, pw) if h < w else (pw, ph)
    boxed = []
    for i, b in enumerate(o["layouts"]):
        if b and b["bbox"] is not None and len(b["bbox"]) == 4:
            x1, y1, x2, y2 = b["bbox"]
            boxed.append({"i": i, "category": b["category"], "text": b["text"], "level": b["level"], "x1": even(x1 * pw / w), "y1": even(y1 * ph / h), "x2": even(x2 * pw / w), "y2": even(y2 * ph / h)})
    body = [b for b in boxed if b["category"] not in EDGES]
    meets = lambda a, b: a["x1"] < b["x2"] and b["x1"] < a["x2"] and a["y1"] < b["y2"] and b["y1"] < a["y2"]
    main = [a for a in body if a["category"] != "Picture" or not any(meets(a, b) for b in body if b is not a)]
    if not main:
        return None
    t = int(len(main) * 0.05)
    left, right = clamp(sorted(b["x1"] for b in main)[t]), clamp(pw - sorted(b["x2"] for b in main)[len(main) - 1 - t])
    sections = []
    for k, col in enumerate(columns(main, pw)):
        if sections and side_by_side(hull(sections[-1][-1][1]), hull(col)):
            sections[-1].append((k, col))
        else:
            sections.append([(k, col)])
    twips = lambda px: int(px * 1440 / 300)
    shared = {"page_w_twips": twips(pw), "page_h_twips": twips(ph), "orientation": "landscape" if ph < pw else "portrait", "top_twips": 720, "bottom_twips": 720, "left_twips": twips(left), "right_twips": twips(right)}
    out = []
    for s, cols in enumerate(sections):
        raw = []
        for n, (_, col) in enumerate(cols):
            own = hull(col)[2] - hull(col)[0]
            raw.append(max(own, hull(cols[n + 1][1])[0] - hull(col)[0] - 50) if n + 1 < len(cols) else own)
        room = max(pw - left - right - 50 * (len(cols) - 1), 1.0)
        for (k, col), r in zip(cols, raw):
            width = r / sum(raw) * room if sum(raw) > 0 else r
            for n, b in enumerate(col):
                r1, r2 = (left, pw - right) if len(cols) == 1 else (hull(col)[0], hull(col)[2])
                ref, before, after = r2 - r1, b["x1"] - r1, r2 - b["x2"]
                near, align = max(15.0, 0.1 * ref), "LEFT"
                if b["category"] == "Title":
                    align = "CENTER"
                elif ref > 0 and (b["x2"] - b["x1"]) / ref <= 0.9:
                    align = "CENTER" if abs(before - after) <= near else "RIGHT" if after <= near and before > near else "LEFT"
                style = {"Title": "Title", "Section-header": f"Heading {b['level'] or 3}", "Picture": "blank"}.get(b["category"], "body")
                out.append(shared | {"part": "main", "section_idx": s, "column_idx": k, "block_idx": b["i"], "category": b["category"], "style": style, "align": align, "font_pt": SIZES.get(b["category"], 9 if b["category"] in ("Table", "Caption", "Footnote") else 11),
                            "force_bold": b["category"] == "Title" if b["category"] else None, "break_type": "CONTINUOUS" if n == 0 and s and (k, col) == cols[0] else "", "col_twips": twips(width), "share": None, "text": b["text"]})
    for part, label in (("header", "Page-header"), ("footer", "Page-footer")):
        cells = [b for b in boxed if b["category"] == label]
        total = sum(b["x2"] - b["x1"] for b in cells)
        for b in cells:
            out.append(shared | {"part": part, "section_idx": 0, "column_idx": None, "block_idx": b["i"], "category": label, "style": part, "align": "LEFT", "font_pt": 9, "force_bold": False, "break_type": "", "col_twips": None,
                        "share": (b["x2"] - b["x1"]) / total if total > 0 else 1 / len(cells), "text": b["text"]})
    return out


def plan(rows):
    key = lambda r: None if r["exam_id"] is None else r["exam_id"].strip().lstrip("/").strip().lower()
    pages = {}
    for r in rows:
        pages.setdefault(r["id"], r)
    made = {i: p for i, r in pages.items() if (p := page_plan(r))}
    lead = {}
    for i in made:
        r = pages[i]
        at = (r["page_order"] is None, r["page_order"] or 0, i)
        lead[key(r)] = min(lead.get(key(r), at), at)
    out = []
    for i, p in made.items():
        first = min((x for x in p if x["part"] == "main"), key=lambda x: x["block_idx"])
        first["break_type"] = "FIRST" if lead[key(pages[i])][2] == i else "NEW_PAGE"
        out += [{"exam_id": key(pages[i]), "page_id": i, "page_order": pages[i]["page_order"], **x} for x in p]
    return out


def rounded(r):
    return tuple((k, round(v, 9) if isinstance(v, float) else v) for k, v in sorted(r.items()))


def same(spark, df, rows):
    mine = sorted((rounded(r.asDict()) for r in render.whole_plan(df).collect()), key=repr)
    want = sorted((rounded(r) for r in plan(rows)), key=repr)
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert a == b
    return len(want)


def test_plan_of_the_test_data(spark, sf):
    assert same(spark, spark.read.parquet(f"{sf}/pages.parquet"), pq.read_table(f"{sf}/pages.parquet").to_pylist()) > 300


@pytest.mark.parametrize("seed", range(3))
def test_plan_of_random_pages(spark, seed):
    """Several columns, overlaps, null labels, odd ratios, orders that don't begin at one, repeated rows."""
    rng = random.Random(seed)
    labels = [None, "Text", "Text", "Title", "Section-header", "Picture", "Table", *EDGES]
    rows = []
    for k in range(40):
        w, h = rng.choice([(1654, 2338), (2338, 1654), (1000, 1000), (300, 900), (1240, 1754)])
        blocks = []
        for n in range(rng.randint(0, 9)):
            x = rng.choice([0.05, 0.52]) * w + rng.randint(0, 9)
            y = h * (n % 5) / 6 + rng.randint(0, 20)
            box = rng.choice([[x, y, x + rng.choice([0.2, 0.42, 0.9]) * w, y + rng.randint(0, 300)]] * 7 + [[], [x, y, x, y]])
            blocks.append(None if rng.random() < 0.05 else ([float(v) for v in box], rng.choice(labels), rng.choice(["t", None, ""]), rng.choice([None, 2])))
        rows.append((f"p{k}", rng.choice([None, f"E{k % 7}", f" e{k % 7}"]), rng.choice([None, 3, 4, 5, 9]), "f", rng.choice([None] + [(w, h, w, h, blocks)] * 9)))
    df = spark.createDataFrame(rows + rows[:5], PAGES)
    names = ("bbox", "category", "text", "level")
    plain = [{"id": i, "exam_id": e, "page_order": o, "ocr_text": t and {"origin_width": t[0], "origin_height": t[1], "layouts": [b and dict(zip(names, b)) for b in t[4]]}} for i, e, o, _, t in rows]
    same(spark, df, plain)
