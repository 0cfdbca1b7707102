import pytest

from pagemill.llm import privacy

STREETS = frozenset(["gio bac"])
FORMS = {
    "mail thea+exam@hoasay.example, now": [("email", 5)], "x a.b [at] mail [dot] example y": [("email", 2)], "follow @club54 on https://a.example/x/123456": [],
    "về t_thach @ hoasay.example trước": [("email", 3)], "to mirela+lop AT hoasay DOT example if": [("email", 3)], "we met at noon. Dot came": [], "x at y.z dot": [],
    "Gọi 060 862 7033 hoặc": [("phone", 4)], "call (212) 555-0183 or 212.555.0116": [("phone", 5), ("phone", 23)], "tel (+84) 602-123-105.": [("phone", 4)], "07700 900733": [("phone", 0)], "Tél. 0199 00 29 49": [("phone", 5)], "+33 6 39\n98 83 08": [("phone", 0)],
    "số 099117039003 và 008591842": [("id_number", 3), ("id_number", 19)], "098 932 988 100": [("id_number", 0)], "097.981.887911": [("id_number", 0)], "QQ 67 78 61 C, QQ201894A": [("id_number", 0), ("id_number", 15)], "911-34-0507": [("id_number", 0)],
    "ZZ4550171": [("id_number", 0)], "9 16 13 99 582 292 52": [("id_number", 0)], "Z0960584": [("id_number", 0)], "913255902911651": [("id_number", 0)],
    "978 0 00 419275 9": [], "9 465 547 340 trees": [], "no. 4111-8221-656": [], "code 4555, room 705, seat 212549": [], "Bài 16 trang 300, câu 5.": [],
    "ở số 67B ngõ 29 Cây Sậy, xã Thượng Sậy": [("address", 5)], "155 Gió Bấc; thư": [("address", 0)], "155 Lá Dong": [], "at 139A Osier St., Flat 8": [("address", 3)], "habitent 97 bis, allée du Galet": [("address", 9)], "12 chemin de la Lanterne, Port-Galet": [("address", 0)],
    "199 sentier de son": [], "": [],
}


@pytest.mark.parametrize("text", list(FORMS))
def test_identifiers(text):
    assert [(k, s) for s, _, k in privacy.identifiers(text, STREETS)] == FORMS[text]


def corpus():
    names = ["Giáp Mộc Vũ", "Tạ Song Ngà", "Giap Moc Vu", "TẠ SONG VŨ", "Petra Hexley", "Oswin Tarrel", "Hexley, Oswin", "Petra J. Tarrel"]
    out = []
    for i in range(60):
        n = names[i % len(names)]
        out.append(f"{n} (ID ZZ45{i:05d}) asked. Tại Mộc Hạ, người ta đi từ Hòn Ngà tới Lá Dong. The inn Silver Finch opens in Upper Sedge.")
        out.append(f"Bài của {n} được chấm. Kim Anh cười. Thuyền Vạn Lộc chở 815 bao thóc ở Mộc Hạ.")
    return out


def test_persons_by_disclosure(spark):
    rows = [(i, t) for i, t in enumerate(corpus())] + [(900, None), (901, ""), (902, "Call 0609590575")]
    docs = spark.createDataFrame([(*r, "c", 3) for r in rows], "doc_id long, text string, kind string, start_pos int")
    got = privacy.mentions(docs).collect()
    people = {}
    for r in got:
        if r.kind == "person":
            people.setdefault(r.doc_id, []).append((r.start_pos, dict(rows)[r.doc_id][r.start_pos : r.end_pos]))
    for i, t in rows[:120]:
        want = t.partition(" (ID")[0] if " (ID" in t else t[len("Bài của ") :].partition(" được")[0]
        assert people[i] == [(t.index(want), want)], (t, people[i])
    red = {r.doc_id: r.redacted for r in privacy.redact(docs).collect()}
    assert red[900] is None and red[901] == "" and red[902] == "Call [PHONE]"
    assert red[0] == "[PERSON] (ID [ID_NUMBER]) asked. Tại Mộc Hạ, người ta đi từ Hòn Ngà tới Lá Dong. The inn Silver Finch opens in Upper Sedge."
    assert privacy.mentions(docs.limit(0)).count() == 0


def planted(k: int) -> list[tuple[str, str]]:
    """Values of every kind, numbered by k: (kind, value)."""
    given, family = ["Petra", "Oswin", "Maud", "Corwin", "Hester"], ["Hexley", "Tarrel", "Dunwick", "Tamblin", "Brindlow"]
    name = f"{given[k % 5]} {family[k // 5 % 5]}"
    return [
        ("person", [name, f"{family[k // 5 % 5]}, {given[k % 5]}", name.upper()][k % 3]), ("id_number", [f"ZZ{4550000 + k}", f"0{99117039000 + k}", f"911-34-{k:04d}"][k % 3]),
        ("phone", [f"060 862 {7000 + k}", f"(+84) 602-123-{k:03d}", f"212.555.{k:04d}"][k % 3]), ("email", [f"a{k}@mail.example", f"a{k} [at] mail [dot] example", f"a{k} @ mail.example", f"a{k} AT mail DOT example"][k % 4]),
        ("address", [f"{k + 1}A Osier St., Flat 8", f"{k + 1} ngõ 29 Cây Sậy", f"{k + 1} chemin de la Lanterne"][k % 3]),
    ]


def test_recall_of_planted_values(spark):
    rows, want = [], set()
    for k in range(300):
        text, kinds = f"Note {k}: at Upper Sedge, the inn Silver Finch opens. ", planted(k)
        for kind, value in kinds:
            want.add((k, kind, len(text)))
            text += value + (" (" if kind == "person" else "; ")
        rows.append((k, text + ") the Silver Finch closes in Upper Sedge."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r)[:3] for r in privacy.mentions(docs).collect()}
    for kind in privacy.KINDS:
        of = {w for w in want if w[1] == kind}
        assert len(of & got) >= 0.99 * len(of), (kind, sorted(of - got)[:3])
    assert len(got - want) <= 0.01 * len(got), sorted(got - want)[:5]
    # Joined tables give the same, and so does other text beside it.
    assert {tuple(r)[:3] for r in privacy.mentions(docs, most=-1).collect()} == got
    other = spark.createDataFrame([(1000 + k, f"Xoru Velmi met Quana Dorb{k % 7} at the ferry. " * 20) for k in range(500)], "doc_id long, text string")
    assert {t for r in privacy.mentions(docs.unionByName(other)).collect() if (t := tuple(r)[:3])[0] < 1000} == got
    a, b = (sorted(tuple(r) for r in privacy.redact(docs, most=m).collect()) for m in (None, -1))
    assert a == b and "[EMAIL]" in a[0][2] and "Osier" not in a[0][2]


def test_shapes_that_stand_with_nobody_are_codes(spark):
    """The same form is an identifier where it stands with persons, and a code where it never does."""
    names = ["Petra Hexley", "Oswin Tarrel", "Maud Dunwick"]
    people = [f"{names[i % 3]}, passport ZZ455{i:04d}; and {names[(i + 1) % 3]} (call 060 862 {1000 + i})." for i in range(60)]
    parts = [f"the crate with the part QP990{i:04d} was weighed and put back on the shelf." for i in range(60)]
    codes = [f"the crate with the part Q990{i:04d} was weighed and put back on the shelf." for i in range(60)]
    got = lambda texts: {(r.doc_id, r.kind) for r in privacy.mentions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = got(people + codes)
    assert {(i, "id_number") for i in range(60)} <= found and not {f for f in found if f[0] >= 60}
    # A shape that stands with persons as well is one everywhere.
    assert {(60 + i, "id_number") for i in range(60)} <= got(people + parts)
    assert privacy.shape_of("email", "a.b [at] mail [dot] example") == "email w [w] w [w] w" and privacy.shape_of("address", "12 chemin de la Lanterne") == "address chemin"


def test_long_text_and_repeats(spark):
    t = "câu hỏi " * 60_000 + "Gọi 0609590575 nhé"
    docs = spark.createDataFrame([(1, t), (2, t)], "doc_id long, text string")
    assert [(r.kind, r.start_pos) for r in privacy.mentions(docs).collect()] == [("phone", t.index("0609"))] * 2
