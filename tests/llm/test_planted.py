"""Recall and precision on planted cases: pages written from a small vocabulary, with known noise and known cuts."""

import random

from pagemill.llm import repair, truncation
from tests.llm.test_scan import frame, page

SUBJECTS = "the greenhouse staff,our debating club,a retired carpenter,the village baker,the weather station,a small fishing boat,the school librarian,the survey team".split(",")
VERBS = "carefully described,never mentioned,wanted to compare,still preserves,usually measures,tried to explain,began counting,must estimate".split(",")
OBJECTS = "the remaining seedlings,several faded paintings,the weekly duty schedule,a quadratic equation,the length of the kitchen garden,some samples of grey clay,the missing chapters of the notebook,the amount of rainwater".split(",")
ENDS = "before the storm arrived,with homemade instruments,under a yellow lamp,without using a calculator,between the two examinations,when winter was over".split(",")
MISREAD = {"rn": "m", "m": "rn", "e": "c", "l": "1", "o": "0", "n": "ri", "h": "li", "d": "cl", "s": "5", "t": "f", "u": "ii"}
LIMITS = {"jpg": 160, "png": 255}


def sentence(rng):
    s = " ".join((rng.choice(SUBJECTS), rng.choice(VERBS), rng.choice(OBJECTS), rng.choice(ENDS)))
    return s[0].upper() + s[1:] + "."


def paragraph(rng, least=2):
    return " ".join(sentence(rng) for _ in range(rng.randint(least, 5)))


def lines(text, width):
    out = [""]
    for w in text.split():
        if len(out[-1]) + len(w) + 1 > width:
            out.append(w)
        else:
            out[-1] = f"{out[-1]} {w}".strip()
    return out


def misread(rng, text):
    """The text with one word of seven letters or more misread."""
    words = text.split(" ")
    k = rng.choice([i for i, w in enumerate(words) if len(w) >= 7 and w.isalpha() and w.islower()])
    good = rng.choice([g for g in MISREAD if g in words[k]])
    words[k] = words[k].replace(good, MISREAD[good], 1)
    return " ".join(words)


def divided(rng, text):
    """The text over lines, one word divided at a line end."""
    out = lines(text, 60)
    k = rng.choice([i for i in range(1, len(out)) if len(out[i].split()[0]) >= 6 and out[i].split()[0].isalpha() and out[i][0].islower()] or [0])
    if not k:
        return None
    head, rest = out[k][:3], out[k][3:]
    out[k - 1], out[k] = out[k - 1] + " " + head + "-", rest
    return "\n".join(out)


def score(got, want):
    return len(got & want) / len(want), len(got & want) / max(1, len(got))


def test_noise(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for e in range(60):
        head, n = f"Sedge Hall School – Computing {e % 9} – Code {e:08d}", rng.randint(3, 6)
        for o in range(1, n + 1):
            pid, blocks = f"p{e}-{o}", []
            top, own = rng.random() < 0.8, rng.random() < 0.7
            if top or o <= 3:
                blocks.append((rng.choice(["Page-header", "Text", "Caption"]), misread(rng, head) if rng.random() < 0.2 and "School" not in head else head))
                want.add((pid, 0, "running"))
            for _ in range(3):
                text, i, r = paragraph(rng), len(blocks), rng.random()
                if r < 0.15:
                    text = misread(rng, text)
                    want.add((pid, i, "char"))
                elif r < 0.3 and (cut := divided(rng, text)):
                    text = cut
                    want.add((pid, i, "hyphen"))
                elif r < 0.5:
                    text = "\n".join(lines(text, 70))
                blocks.append(("Text", text))
            if own:
                want.add((pid, len(blocks), "page_number"))
                blocks.append(("Page-footer", rng.choice(["Page {}", "- {} -", "{}", "{} / 9"]).format(o)))
            rows.append(page(pid, f"e{e}", o, *blocks))
    got = {(r.page_id, r.block_idx, r.kind) for r in repair.found_noise(frame(spark, rows)).collect()}
    for kind in ("char", "hyphen", "running", "page_number"):
        recall, precision = score({g for g in got if g[2] == kind}, {w for w in want if w[2] == kind})
        assert recall >= 0.95 and precision >= 0.95, (kind, recall, precision, sorted(want - got)[:3], sorted(got - want)[:3])


def test_cuts(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for e in range(300):
        source = rng.choice(list(LIMITS))
        blocks = []
        for i in range(4):
            text, label, r = paragraph(rng, 3), "Text", rng.random()
            if r < 0.06:
                text, want[f"p{e}", i] = text[: LIMITS[source]], "limit"
            elif r < 0.12:
                text, want[f"p{e}", i] = text[: rng.randint(40, len(text) - 8)].rstrip(" ."), "broken"
            elif r < 0.2:
                text, label = f"{rng.choice(OBJECTS)}".capitalize(), "Section-header"
            elif r < 0.24:
                text, label, want[f"p{e}", i] = "<ul><li>A. the map</li><li>B. the ma", "List-item", "markup"
            elif r < 0.28:
                text, label = "12. " + rng.choice(OBJECTS), "List-item"
            blocks.append((label, text))
        blocks.append(("Title", "The weekly duty schedule"))
        rows.append(page(f"p{e}", f"x{e}", 1, *blocks, path=f"a/{e}.{source}"))
    found = {(r.page_id, r.block_idx): set(r.evidence) for r in truncation.cut_blocks(frame(spark, rows)).collect()}
    recall, precision = score(set(found), set(want))
    assert recall >= 0.97 and precision >= 0.97, (recall, precision, [(k, want[k]) for k in sorted(set(want) - set(found))][:5], sorted(set(found) - set(want))[:5])
    at_limit = [k for k, kind in want.items() if kind == "limit" and k in found]
    assert sum("length" in found[k] for k in at_limit) >= 0.9 * len(at_limit) > 20
    assert all("structure" in found[k] for k, kind in want.items() if kind == "markup")
