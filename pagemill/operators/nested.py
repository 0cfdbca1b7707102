"""Deeply nested records to flat tables, linked by interval labels.

Every record (a row of `pages`, or one JSON payload) is a tree. A depth-first walk gives each node
a pre-order and a post-order number; node a is an ancestor of node d exactly when
`a.pre < d.pre and a.post > d.post`. The node tables of each type carry those numbers, and the
parent-child links come from them alone:

* the tree of a `pages` row is in the row: its nodes are an array, numbered on the JVM as the walk numbers them (pre by
  the sizes of the subtrees before, `post = pre + size - 1 - depth`), and the enclosing nodes are found in that array
  by containment. No page is shuffled for it;
* raw payloads vary from record to record and are walked once in Python, in Arrow batches, with an explicit stack
  (any depth). Kinds that never nest (exam, page, ocr): the enclosing node is the last one before the child in
  pre-order whose post number is larger, one window over the record. Blocks nest in blocks: nodes of depth d-1 and d
  are put in one window ordered by pre, and the last shallower node before the child encloses it.

No join compares all pairs of a record. Rows are keyed by record, not by delivery: of a record delivered again the latest
delivery counts.

Defined results: null or incomplete JSON gives no node; null entries of a list are no nodes but
keep their position; a lone object in place of a list has position 0; JSON text inside a JSON
string is parsed as if it stood there; each exam, page and block comes once; exam ids are trimmed and lower-case; a page
without an exam belongs to the exam null; extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.sources.tables import norm_key

NODE_DDL = (
    "origin string, tree_id string, kind string, pre int, post int, depth int, position int, "
    "node_key string, path string, title string, page_order int, category string, text string, "
    "level int, bbox array<double>"
)
_COLUMNS = [c.split()[0] for c in NODE_DDL.split(", ")]

# Spellings of the keys in raw payloads.
EXAM_WRAPPERS = ("exam", "data", "exams")
EXAM_KEYS = ("id", "exam_id", "examId")
PAGE_KEYS = ("id", "page_id", "pageId")
PAGE_LISTS = ("pages",)
OCR_KEYS = ("ocr_text", "ocrText")
BLOCK_LISTS = ("layouts", "blocks")
CHILD_LISTS = ("children",)
ORDER_KEYS = ("page_order", "pageOrder", "order")
_NUMBERED = re.compile(r"\d+\Z")


def _get(obj: dict, names: tuple[str, ...]):
    for n in names:
        if obj.get(n) is not None:
            return obj[n]
    return None


def _opened(value):
    """JSON text standing for an object or a list is opened; incomplete text counts as absent."""
    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            return None
    return value


def _entries(value) -> list[tuple[int, dict]]:
    """(position, object) of a list, a lone object or a {"1": ..., "2": ...} map; nulls keep their place."""
    value = _opened(value)
    if isinstance(value, dict):
        if value and all(_NUMBERED.match(k) for k in value):
            value = [value[k] for k in sorted(value, key=int)]
        else:
            value = [value]
    if not isinstance(value, list):
        return []
    return [(i, o) for i, o in ((i, _opened(o)) for i, o in enumerate(value)) if isinstance(o, dict)]


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _int(value) -> int | None:
    try:
        n = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return n if -(2**31) <= n < 2**31 else None


def _box(value) -> list[float]:
    if isinstance(value, str):
        value = value.split()
    try:
        return [float(x) for x in value] if isinstance(value, list) else []
    except (TypeError, ValueError):
        return []


def _exams(root, out: list[tuple[int, dict]]) -> None:
    """The exam objects of a payload, through wrappers and lists, in order."""
    stack = [(0, root)]
    while stack:
        pos, o = stack.pop()
        o = _opened(o)
        if isinstance(o, list):
            stack.extend(reversed([(i, x) for i, x in enumerate(o)]))
        elif isinstance(o, dict):
            if _get(o, PAGE_LISTS) is None and not any(isinstance(o.get(k), str) for k in EXAM_KEYS):
                inner = _get(o, EXAM_WRAPPERS)
                if inner is not None:
                    stack.append((0, inner))
                    continue
            out.append((pos, o))


def walk(tree_id: str, origin: str, payload: str | None) -> list[tuple]:
    """The labelled nodes of one payload, by an iterative depth-first walk."""
    try:
        root = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return []
    found: list[tuple[int, dict]] = []
    _exams(root, found)
    rows: list[list] = []
    pre = post = 0
    # A frame is (row, iterator over its children as (kind, position, object, path)).
    def children(kind: str, obj: dict, path: str) -> Iterator[tuple[str, int, dict, str]]:
        if kind == "exam":
            for i, o in _entries(_get(obj, PAGE_LISTS)):
                yield "page", i, o, str(i)
        elif kind == "page":
            for i, o in _entries(_get(obj, OCR_KEYS)):
                yield "ocr", i, o, str(i)
        else:
            for i, o in _entries(_get(obj, BLOCK_LISTS if kind == "ocr" else CHILD_LISTS)):
                yield "block", i, o, str(i) if kind == "ocr" else f"{path}.{i}"

    def opened(kind: str, pos: int, obj: dict, path: str, depth: int) -> list:
        nonlocal pre
        key = _text(_get(obj, EXAM_KEYS if kind == "exam" else PAGE_KEYS)) if kind in ("exam", "page") else None
        block = kind == "block"
        row = [
            origin, tree_id, kind, pre, -1, depth, pos, key, path,
            _text(obj.get("title")) if kind == "exam" else None,
            _int(_get(obj, ORDER_KEYS)) if kind == "page" else None,
            _text(obj.get("category")) if block else None, _text(obj.get("text")) if block else None,
            _int(obj.get("level")) if block else None, _box(obj.get("bbox")) if block else None,
        ]
        pre += 1
        rows.append(row)
        return row

    for pos, exam in found:
        row = opened("exam", pos, exam, str(pos), 0)
        stack = [(row, children("exam", exam, ""))]
        while stack:
            row, more = stack[-1]
            nxt = next(more, None)
            if nxt is None:
                row[4] = post
                post += 1
                stack.pop()
            else:
                kind, i, obj, path = nxt
                child = opened(kind, i, obj, path, len(stack))
                stack.append((child, children(kind, obj, path)))
    return [tuple(r) for r in rows]


def label_payloads(payloads: DataFrame, id_col: str = "payload_id", payload_col: str = "payload", time_col: str = "received_at", origin: str = "page_payload") -> DataFrame:
    """The labelled nodes of raw JSON payloads, one tree per row; tree ids are in the order of delivery."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for i, p in zip(b["_tree"], b["_payload"]) for r in walk(i, origin, p)]
            for k in range(0, max(1, len(rows)), 20_000):
                yield pd.DataFrame(rows[k : k + 20_000], columns=_COLUMNS).astype({"page_order": "Int32", "level": "Int32"})

    at = F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(0)) if time_col in payloads.columns else F.lit(0)
    tree = F.concat_ws("-", F.lpad(at.cast("string"), 20, "0"), F.lpad(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 20, "0"))
    src = payloads.select(tree.alias("_tree"), F.col(payload_col).alias("_payload"))
    return src.mapInPandas(run, NODE_DDL)


def contains(a: Column, d: Column) -> Column:
    """Node a is an ancestor of node d."""
    return (a["pre"] < d["pre"]) & (a["post"] > d["post"])


def page_trees(pages: DataFrame, with_content: bool = True) -> DataFrame:
    """One row per page: `tree`, the labelled nodes of its record in pre-order.

    A record is exam > page > ocr > blocks, without ocr and blocks while ocr_text is null. `with_content=False` leaves out
    text, category, level and box, so that they are not read.
    """
    lay = F.coalesce("ocr_text.layouts", F.array().cast(pages.select("ocr_text.layouts").schema[0].dataType))
    content = (lambda b: [b[c].alias(c) for c in ("category", "text", "level", "bbox")]) if with_content else (lambda b: [])
    kept = F.filter(F.transform(lay, lambda b, i: F.struct(i.alias("position"), b.isNotNull().alias("there"), *content(b))), lambda x: x["there"])
    base = pages.select(F.col("id").alias("page_id"), norm_key("exam_id").alias("exam_id"), F.col("page_order").cast("int").alias("page_order"), F.col("ocr_text").isNotNull().alias("done"), kept.alias("kept"))
    base = base.dropDuplicates(["page_id"] if with_content else ["exam_id", "page_id", "done", "kept"])
    types = dict(c.split() for c in NODE_DDL.split(", "))
    names = ["kind", "pre", "post", "depth", "position", "node_key", "path", "page_order", *(["category", "text", "level", "bbox"] if with_content else [])]

    def node(kind: str, pre: Column, size: Column, depth: int, **values: Column) -> Column:
        values |= {"kind": F.lit(kind), "pre": pre, "post": pre + size - 1 - depth, "depth": F.lit(depth)}
        return F.struct(*[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in names])

    n, zero = F.size("kept"), F.lit(0)
    ocr_size = F.when(F.col("done"), n + 1).otherwise(0)
    exam = node("exam", zero, ocr_size + 2, 0, position=zero, node_key=F.col("exam_id"))
    page = node("page", F.lit(1), ocr_size + 1, 1, position=zero, node_key=F.col("page_id"), page_order=F.col("page_order"))
    ocr = node("ocr", F.lit(2), n + 1, 2, position=zero)
    block = F.transform("kept", lambda x, k: node("block", k + 3, F.lit(1), 3, path=x["position"].cast("string"), **{c: x[c] for c in ("position", *names[8:])}))
    above = F.when(F.col("done"), F.array(exam, page, ocr)).otherwise(F.array(exam, page))
    return base.select(above.alias("above"), F.when(F.col("done"), block).otherwise(F.array().cast(f"array<{_struct(names, types)}>")).alias("below"))


def _struct(names: list[str], types: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"{c}:{types[c]}" for c in names) + ">"


def page_tables(pages: DataFrame, with_content: bool = True) -> dict[str, DataFrame]:
    """The flat tables `exams`, `pages`, `blocks` and `links` of the rows of `pages`; keys come from the enclosing nodes."""
    trees = page_trees(pages, with_content)
    around = lambda n, kind: F.get(F.filter("above", lambda a: (a["kind"] == kind) & contains(a, n)), F.lit(0))["node_key"]
    parent = lambda n: F.get(F.filter("above", lambda a: (a["depth"] == n["depth"] - 1) & contains(a, n)), F.lit(0))["kind"]
    origin = F.lit("pages").alias("origin")
    own = trees.select("above", F.explode("above").alias("n"))
    n = F.col("n")
    page = own.where("n.kind = 'page'").select(origin, around(n, "exam").alias("exam_id"), F.col("n.node_key").alias("page_id"), "n.page_order")
    rows = trees.select("above", F.explode("below").alias("n"))
    keys = [origin, around(n, "exam").alias("exam_id"), around(n, "page").alias("page_id"), F.col("n.path").alias("block_path")]
    block = rows.select(*keys, *(["n.category", "n.level", "n.bbox", "n.text"] if with_content else []))
    mine = F.when(n["kind"] == "page", n["node_key"]).otherwise(around(n, "page"))
    every = trees.select("above", F.explode(F.concat("above", "below")).alias("n")).where("n.kind <> 'exam'")
    links = every.select(origin, around(n, "exam").alias("exam_id"), mine.alias("page_id"), n["kind"].alias("kind"), n["path"].alias("block_path"), parent(n).alias("parent_kind"), F.lit(None).cast("string").alias("parent_path"))
    return {"exams": page.select("origin", "exam_id", F.lit(None).cast("string").alias("title")).distinct(), "pages": page, "blocks": block, "links": links}


def link_enclosing(nodes: DataFrame, kind: str, columns: dict[str, str]) -> DataFrame:
    """Adds, to every node, columns of the node of `kind` whose interval contains it.

    `columns` maps a column of the enclosing node to the new column's name. Right for kinds that
    don't nest in themselves: the last such node in pre-order either contains the node or none does.
    """
    w = Window.partitionBy("origin", "tree_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == kind, F.struct("post", *columns)), ignorenulls=True).over(w)
    out = nodes.withColumn("_enc", last)
    inside = F.col("_enc.post") > F.col("post")
    return out.withColumns({new: F.when(inside, F.col(f"_enc.{old}")) for old, new in columns.items()}).drop("_enc")


def link_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_pre, the pre number of the direct parent, from intervals and depth alone."""
    as_child = nodes.withColumns({"_d": F.col("depth") - 1, "_child": F.lit(True)})
    as_parent = nodes.select("origin", "tree_id", "pre", "post", F.col("depth").alias("_d"), F.lit(False).alias("_child"))
    w = Window.partitionBy("origin", "tree_id", "_d").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    both = as_child.unionByName(as_parent, allowMissingColumns=True)
    both = both.withColumn("_p", F.last(F.when(~F.col("_child"), F.struct("pre", "post")), ignorenulls=True).over(w))
    both = both.withColumn("parent_pre", F.when(F.col("_p.post") > F.col("post"), F.col("_p.pre")))
    return both.where("_child").drop("_d", "_child", "_p")


def payload_tables(payloads: DataFrame, **columns: str) -> dict[str, DataFrame]:
    """The flat tables `exams`, `pages`, `blocks` and `links` of raw payloads, each row once, by its latest delivery."""
    linked = link_enclosing(link_enclosing(label_payloads(payloads, **columns), "exam", {"node_key": "exam_id"}), "page", {"node_key": "page_id"})
    linked = linked.withColumns({
        "exam_id": F.lower(F.trim(F.coalesce("exam_id", F.when(F.col("kind") == "exam", F.col("node_key"))))),
        "page_id": F.when(F.col("kind") == "page", F.col("node_key")).otherwise(F.col("page_id")),
        "block_path": F.when(F.col("kind") == "block", F.col("path")),
    })

    def latest(kind: str, keys: list[str], values: list[str]) -> DataFrame:
        last = F.max_by(F.struct(*values), F.struct("tree_id", "pre")) if values else F.lit(None)
        out = linked.where(F.col("kind") == kind).groupBy("origin", *keys).agg(last.alias("v"))
        return out.select("origin", *keys, *[F.col(f"v.{c}") for c in values])

    blocks = ["exam_id", "page_id", "block_path"]
    parents = linked.select("origin", "tree_id", F.col("pre").alias("parent_pre"), F.col("kind").alias("parent_kind"), F.col("block_path").alias("parent_path"))
    links = link_parents(linked).join(parents, ["origin", "tree_id", "parent_pre"])
    return {
        "exams": latest("exam", ["exam_id"], ["title"]),
        "pages": latest("page", ["exam_id", "page_id"], ["page_order"]),
        "blocks": latest("block", blocks, ["category", "level", "bbox", "text"]),
        "links": links.select("origin", "exam_id", "page_id", "kind", "block_path", "parent_kind", "parent_path").distinct(),
        "found": linked.where("kind = 'block'").select("origin", *blocks).distinct(),
    }


def flat_tables(pages: DataFrame, payloads: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of both origins."""
    a, b = page_tables(pages), payload_tables(payloads)
    return {k: t.unionByName(b[k]) for k, t in a.items()}


def found_blocks(pages: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row per layout block of both origins: origin, exam_id, page_id, block_path."""
    return page_tables(pages, with_content=False)["blocks"].unionByName(payload_tables(payloads)["found"])
