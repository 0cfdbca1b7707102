"""Text cut off by field limits or broken transfers: cut blocks, and their share per source.

Evidence of a cut, each told apart in the result:

* structure: markup or a formula that begins and never ends, or a broken character at the end;
* trie: the final token is no known word, no misread one, but a proper prefix of known words: an inner
  node of the vocabulary trie (kept as a table of its nodes with what lies below each, so that tokens
  meet it in a join);
* length: the text ends without a mark exactly at a field limit of its source, a length at which texts of that source
  that other evidence speaks for pile up against the lengths beside it;
* closing: the text ends without a mark (or with an omission sign) under a label whose texts end with one by rule,
  which is counted over the corpus.

Structure, or the trie's token decides for every label, a token of less than three letters only together with a limit (a
roman number ends headings too). A limit alone decides nothing: short headings are equally long as well. Cuts between two words leave a known final token, so the trie can't see them: for labels that
close by rule the missing mark decides alone. Exempt are running lines and page numbers (see `scan`), gaps to be
filled in, sentences whose usual ending is an ellipsis, and a paragraph that is the last body text of
its page while the exam's next page opens with its rest (a join on exam and page number, never a window over
an exam).

Every statistic compares counts of like things (a length with its neighbours, a label's texts with one another, an
ending with itself elsewhere), so other text in the corpus changes no verdict.

Defined results: null and empty texts are no cases; repeated page rows count once; pages without an exam or order
are judged alone; of several next pages any that goes on counts; very long texts are looked at as a whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.scan import HYPHENS, _misread, counted, lexicon_of, make_templates, page_body, page_rows, shape_col, shared_templates, template_asks
from pagemill.session import cut_lineage

#: A label closes by rule when at least this share of its texts ends with a mark.
CLOSING_SHARE = 0.5
#: A limit is a length with this many unclosed texts of a source and as many times the mean of the lengths within NEAR.
LIMIT_COUNT, LIMIT_RATIO, NEAR = 5, 8, 10
#: An ellipsis belongs to a sentence that goes on in the middle of texts this often for each time it ends one.
ENDING_SHARE = 0.1
_CLOSED = re.compile(r"[.?!。:;]\W*\Z|[.?!]</?\w+>\W*\Z")
_GAP = re.compile(r"(?:_\s*){2,}\W*\Z|(?:[.…‥]\s*){4,}\Z|(?:…\s*){2,}\W*\Z|(?:\.\s){3,}\W*\Z|-{3,}\W*\Z")
_OMISSION = re.compile(r"\s*(?:\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|…|\.\.\.)\s*\Z")
_HEAD = re.compile(r"\W*([^\W_]+)")
CONTAINERS = ("table", "thead", "tbody", "tr", "td", "th", "ul", "ol", "li", "math", "p", "div", "b", "i", "u", "em", "strong", "span")
_TAGS = re.compile(r"<(/?)(%s)\b[^<>]*?(/?)>" % "|".join(CONTAINERS), re.I)
_OPEN_TAG = re.compile(r"<[/!]?[A-Za-z]*[^<>]*\Z")
_ROW = (
    "kind string, exam_id string, page_id string, page_order int, source string, block_idx int, label string, token string, omitted boolean, context string, "
    "last boolean, word string, low boolean, n_chars int, n long"
)
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]


def open_structure(text: str) -> bool:
    """True when markup or a formula begins and never ends."""
    if text.count("$$") % 2 or "$$" in text and text.endswith("$") and not text.endswith("$$"):
        return True
    if "<" not in text:
        return False
    last = text.rfind("<")
    if last > text.rfind(">") and text.lstrip().startswith("<") and _OPEN_TAG.match(text, last):
        return True
    depth: dict[str, int] = {}
    for close, name, self_closed in _TAGS.findall(text):
        if not self_closed:
            depth[name.lower()] = depth.get(name.lower(), 0) + (-1 if close else 1)
    # p and li may be left unclosed in well-formed pages; containers may not.
    return any(n > 0 for k, n in depth.items() if k not in ("p", "li"))


def ending(text: str) -> str:
    """The final run without a blank, taken from the end of the text, with what stands right before it."""
    i = len(text)
    for _ in range(4):
        j = max(text.rfind(" ", 0, i), text.rfind("\n", 0, i))
        if j < 0:
            return text
        i = j
    return text[i:]


def final_token(text: str) -> str:
    """The lower-case word at the very end of a text, '' when it doesn't end in a letter."""
    i = len(text)
    while i and text[i - 1].isalpha():
        i -= 1
    return text[i:].lower()


def context_of(text: str) -> str:
    """The last three words of a text, numbers as 0."""
    words = text.lower().rsplit(None, 3)[-3:]
    return re.sub(r"\d+", "0", " ".join(words)) if len(words) == 3 else ""


def verdict(text: str) -> tuple[str, str, bool, str]:
    """(kind, final token, an omission sign ends it, context of that sign); kind is 'whole', 'cut' (by structure) or 'unclosed'."""
    t = text.rstrip()
    if not t:
        return "whole", "", False, ""
    if open_structure(t) or t.endswith("�"):
        return "cut", "", False, ""
    if t[-1] == ">" or t.endswith("$$"):
        return "whole", "", False, ""
    tail = ending(t)
    if _GAP.search(tail):
        return "whole", "", False, ""
    m = _OMISSION.search(tail)
    if m:
        before = t[: len(t) - (len(tail) - m.start())]
        return "unclosed", final_token(before), True, context_of(before)
    if _CLOSED.search(tail):
        return "whole", "", False, ""
    return "unclosed", final_token(t), False, ""


def examined(pages: DataFrame, templates) -> DataFrame:
    """One scan: 'cut' and 'unclosed' blocks, 'head' (first body text of a page), and counts per batch: 'label' (texts ending in letters or marks, n of
    them closed in n_chars), 'ending' (contexts of an ellipsis the text goes on after)."""
    rows = page_rows(pages)
    if templates.rows is None:
        rows = rows.dropDuplicates(["page_id"])
    rows = templates.attach(rows, ["page_id"], template_asks, "_tpl")
    known = templates.sender(make_templates, pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, labels, endings = [], Counter(), Counter()
            for exam, page, order, source, texts, cats, tpl in zip(b["exam_id"], b["page_id"], b["page_order"], b["source"], b["texts"], b["labels"], b["_tpl"]):
                order = None if order is None or order != order else int(order)
                real = [x for x in page_body(texts, cats, order, known(tpl)) if not x[3]]
                for j, (i, label, text, _) in enumerate(real):
                    kind, token, omitted, context = verdict(text)
                    if kind != "cut" and text.rstrip()[-1:] != ">":
                        labels[label, kind == "whole"] += 1
                    if "…" in text:
                        endings.update(context_of(text[: m.start()]) for m in re.finditer(r"…(?=\s+\S)", text))
                    if kind == "whole":
                        continue
                    word = token + "-" if text.rstrip()[-1:] in HYPHENS else _last_word(text)
                    out.append((kind, exam, page, order, source, i, label, token, omitted, context, kind == "unclosed" and j == len(real) - 1 and label == "Text" and not omitted, word, False, len(text), 1))
                if real and real[0][1] == "Text":
                    m = _HEAD.match(real[0][2])
                    if m:
                        out.append(("head", exam, page, order, source, real[0][0], "", "", False, "", False, m[1], m[1][0].islower() or m[1][0].isdigit(), len(real[0][2]), 1))
            out += [("label", None, None, None, None, int(closed), label, "", False, "", False, "", False, 0, n) for (label, closed), n in labels.items()]
            out += [("ending", None, None, None, None, 0, "", "", False, c, False, "", False, 0, n) for c, n in endings.items() if c]
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"page_order": "Int32", "block_idx": "Int32"})

    return rows.mapInPandas(run, _ROW)


def _last_word(text: str) -> str:
    """The last word of a text as it is written, signs after it left out."""
    i = len(text)
    while i and not text[i - 1].isalpha():
        i -= 1
    j = i
    while j and text[j - 1].isalpha():
        j -= 1
    return text[j:i]


def trie_nodes(words: DataFrame) -> DataFrame:
    """The inner nodes of the vocabulary trie as a table: prefix, below (uses of the words that go on from it)."""
    inner = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.left("word", i))
    return words.where(F.length("word") > 1).select("n", F.explode(inner).alias("prefix")).groupBy("prefix").agg(F.sum("n").alias("below"))


def cut_tokens(rows: DataFrame, words: DataFrame) -> DataFrame:
    """token: the final tokens that are unknown, no misread word, and inner nodes of the trie. Joins over distinct tokens."""
    tokens = rows.where("kind = 'unclosed' and token <> ''").select("token").distinct()
    odd = tokens.join(words.select(F.col("word").alias("token")), "token", "left_anti").join(trie_nodes(words).select(F.col("prefix").alias("token")), "token", "left_semi")
    like = odd.withColumn("shape", shape_col(F.col("token"))).join(words.where(F.length("word") > 1), "shape")
    misread = like.where(F.length("token") > 1).where(_misread("word", "token")).select("token")
    return odd.join(misread, "token", "left_anti")


def field_limits(rows: DataFrame) -> DataFrame:
    """source, n_chars: lengths at which the texts of a source that other evidence speaks for pile up against the lengths within NEAR."""
    n = rows.select("source", "n_chars", "page_id", "block_idx").distinct().groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per source and length, whatever the number of texts.
    near = Window.partitionBy("source").orderBy("n_chars").rangeBetween(-NEAR, NEAR)
    mean = (F.sum("n").over(near) - F.col("n")) / F.lit(2.0 * NEAR)
    return n.withColumn("mean", mean).where((F.col("n") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_RATIO * F.col("mean"))).select("source", "n_chars")


def capital_pairs(pages: DataFrame, ask: DataFrame) -> DataFrame:
    """(word, next_word) of `ask` that stand side by side in some text; pairs may overlap, so every word is tried."""
    t = pages.select(F.explode("ocr_text.layouts.text").alias("t")).select(F.replace("t", F.lit("\n"), F.lit(" ")).alias("t"))
    pair = F.explode(F.regexp_extract_all("t", F.lit(r"(?<!\p{L})(?=(\p{L}+ \p{Lu}\p{L}*))"), 1))
    p = F.split(F.col("p"), " ")
    pairs = t.select(pair.alias("p")).select(p[0].alias("word"), p[1].alias("next_word"))
    return pairs.join(ask, ["word", "next_word"], "left_semi").groupBy("word", "next_word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


def cut_blocks(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, block_idx, source, n_chars, evidence of every cut block, once; `evidence` lists what spoke for the cut."""
    counts = cut_lineage(counted(pages))
    words = lexicon_of(counts)
    rows = cut_lineage(examined(pages, shared_templates(counts, most)))
    label = rows.where("kind = 'label'").groupBy("label").agg((F.sum(F.when(F.col("block_idx") == 1, F.col("n")).otherwise(0)) >= CLOSING_SHARE * F.sum("n")).alias("closes"))
    ends = rows.where("kind = 'ending'").groupBy("context").agg(F.sum("n").alias("goes_on"))
    asked = rows.where("kind = 'unclosed' and omitted").groupBy("context").agg(F.countDistinct("page_id", "block_idx").alias("ends"))
    # An ellipsis is the usual ending of a sentence whose last words come with it in the middle of texts as well.
    usual = asked.join(ends, "context").where(f"goes_on >= 2 and goes_on >= {ENDING_SHARE} * ends").select("context", F.lit(True).alias("usual"))
    prefix = cut_tokens(rows, words).withColumn("prefix", F.lit(True))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    # Most rows end in no word and in no sign of omission: these don't go through the joins on token and context.
    own = rows.where("kind in ('cut', 'unclosed')").join(label, "label", "left")
    never = F.lit(None).cast("boolean")
    own = own.where("token <> ''").join(prefix, "token", "left").unionByName(own.where("token = ''").withColumn("prefix", never))
    own = own.where("omitted").join(usual, "context", "left").unionByName(own.where("not omitted").withColumn("usual", never))
    own = cut_lineage(own.where(~(F.col("omitted") & no("usual"))))
    sure = (F.col("kind") == "cut") | no("closes") | (no("prefix") & (F.length("token") >= 3))
    limit = field_limits(own.where(sure)).withColumn("at_limit", F.lit(True))
    own = own.join(limit, ["source", "n_chars"], "left")
    trie = no("prefix") & ((F.length("token") >= 3) | no("closes") | no("at_limit"))
    # Without a closing rule an omission sign needs the trie; any length of the token will do then.
    trie = trie | (no("prefix") & F.col("omitted"))
    decided = (F.col("kind") == "cut") | trie | no("closes")
    limited = no("at_limit") & ~F.col("omitted") & decided
    evidence = F.array_compact(F.array(
        F.when(F.col("kind") == "cut", "structure"), F.when(trie, "trie"), F.when(limited, "length"), F.when((F.col("kind") == "unclosed") & no("closes"), "closing")
    ))
    own = own.withColumn("evidence", evidence).where(F.size("evidence") > 0)
    keep = ["page_id", "block_idx", "source", "n_chars", "evidence"]
    opened = own.where("last").withColumn("next_order", F.col("page_order") + 1)
    heads = rows.where("kind = 'head'").select("exam_id", F.col("page_order").alias("next_order"), F.col("word").alias("next_word"), F.col("low").alias("next_low")).distinct()
    both = cut_lineage(opened.join(heads, ["exam_id", "next_order"], "left"))
    ask = both.where("not next_low and next_word is not null").select("word", "next_word").distinct()
    both = both.join(capital_pairs(pages, ask).withColumn("known", F.lit(True)), ["word", "next_word"], "left")
    goes_on = both.groupBy("page_id", "block_idx").agg(F.max(no("next_low") | no("known")).alias("goes_on"), *[F.first(c).alias(c) for c in keep[2:]])
    return own.where("not last").select(*keep).unionByName(goes_on.where("not goes_on").select(*keep)).dropDuplicates(["page_id", "block_idx"])


def truncation_report(pages: DataFrame) -> DataFrame:
    """Per source: blocks with text, cut blocks, their share, and how many each evidence spoke for."""
    cut = cut_lineage(cut_blocks(pages))
    by = lambda e: F.count_if(F.array_contains("evidence", e)).alias(f"n_{e}")
    c = cut.groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"), *[by(e) for e in ("structure", "trie", "length", "closing")])
    n = F.size(F.filter("texts", lambda t: F.trim(t) != ""))
    all_blocks = page_rows(pages).select("page_id", "source", n.alias("n")).dropDuplicates(["page_id"]).groupBy("source").agg(F.sum("n").alias("n_blocks"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return all_blocks.join(c, "source", "left").select(
        "source", "n_blocks", *[zero(x).alias(x) for x in ("n_cut", "n_structure", "n_trie", "n_length", "n_closing")], F.round(zero("n_cut") / F.col("n_blocks"), 6).alias("share")
    )
