import hashlib
import random
import re

from ranlens.llm import personal
from ranlens.llm.catalog import op9_personal_data
from tests.conftest import plan_of


def brute_base(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(d) for d in re.sub("[^0-9]", "", m.group())][::-1]
        if 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
            found.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", m.start(), m.end()))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


ODD = [
    "", "a@b.c_d@e.f @x a@b a.b@c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 000000000000001.2.3.4 1.2.3", "x 1-", "+1", "+1 2345678",
    "+1 (988) 555-2485 4041894974608795", "4041 8949 7460 8795 é 4041-8949-7460-8795 4041  8949", "1" * 3_000, "a" * 50_000,
    "+" + "1 " * 3_000, "1." * 5_000, "4 0 4 1 8 9 4 9 7 4 6 0 8 7 9 5", "😀 b.42@mail8.example.com ü 42.144.35.254", "a@" * 3_000,
    "a@b." * 3_000, "1-" * 5_000, "m.m@b.c " * 2_000,
]


def held(rows, texts):
    for row in rows:
        base = brute_base(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), texts[row.doc_id][:80]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [base.count(k) for k in ("email", "ip", "card", "phone")]
        assert set(base.split(",")) <= set(row.spans.split(",")) or not base


def test_the_query_equals_brute_force(spark, folder, texts):
    rows = op9_personal_data(spark, folder).collect()
    assert len(rows) == len(texts)
    held(rows, texts)


def test_odd_and_random_texts_equal_brute_force(spark):
    chance = random.Random(1)
    texts = ODD + ["".join(chance.choice("a1@.+-( )é😀42%_") for _ in range(chance.randint(1, 60))) for _ in range(3_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held(personal.personal_data(docs).collect(), dict(enumerate(texts)))


def kinds_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in personal.personal_data(docs).collect()}


def test_labelers_decide_on_weak_candidates(spark):
    strong = [f"write to m{i}.x@mail.example.com or call +1 (555) 01{i}-2345" for i in range(40)]
    good = [f"Dear Mrs. Anna Smith{chr(97 + i)}, your phone (555) 123-45{i:02d} and m{i}@mail.example.org" for i in range(20)]
    odd = [f"order 000-00-000{0} of version 00.00.0000" for _ in range(20)]
    found = kinds_of(spark, strong + good + odd)
    assert all(found[i] == ["email", "phone"] for i in range(40))
    assert all({"email", "name", "local_phone"} == set(found[i]) for i in range(40, 60))
    assert all(found[i] == [] for i in range(60, 80))


def test_reliable_labelers_outweigh_others():
    votes = lambda **v: {name: v.get(name, 0) for name in personal.LABELERS}
    belief = personal.estimated([(votes(shape=1, cue=1), 100), (votes(shape=1), 50), (votes(odd=-1, cue=-1), 80), (votes(cue=-1), 30)])
    assert belief[0] > 0.9 and belief[1] > 0.5 and belief[2] < 0.1 and belief[3] < 0.5


def test_masks_replace_findings_and_leave_the_rest(spark, odd_documents, documents):
    found = {r.doc_id: r for r in personal.masked(documents).collect()}
    for row in documents.collect():
        if not brute_base(row.text or "") and "<" not in (found[row.doc_id].text or ""):
            assert found[row.doc_id] == row
        assert brute_base(found[row.doc_id].text or "") == ""
    masked = personal.masked(odd_documents)
    assert masked.columns == odd_documents.columns
    texts = sorted((r.doc_id or 0, r.text is None, (r.text or "")[:60], r._size) for r in masked.collect())
    assert texts[0] == (0, False, "a text without an id, but with a mail <EMAIL>", "extra") and len(texts) == odd_documents.count()


def test_odd_rows_and_the_plan(spark, folder, odd_documents, no_documents):
    rows = personal.personal_data(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.spans == "" for r in rows if r.doc_id in (2, 3, 4))
    assert personal.personal_data(no_documents).collect() == [] == personal.masked(no_documents).collect()
    plan = plan_of(op9_personal_data(spark, folder))
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def planted(seed=5):
    """Texts with labelled spans: personal data of every added kind in its usual surroundings, and look-alikes that are none."""
    r = random.Random(seed)
    given = ["Olga", "Tariq", "Ines", "Bjorn", "Keiko", "Luca", "Nadia", "Emil"]
    family = ["Olsen", "Haddad", "Rossi", "Tanaka", "Novak", "Larsen", "Costa", "Weber"]
    filler = "the report was read by all and filed in the usual place".split()
    good = {
        "name": lambda: (r.choice(["Dear ", "signed by ", "contact "]), f"{r.choice(['Mr.', 'Mrs.', 'Dr.'])} {r.choice(given)} {r.choice(family)}"),
        "id_number": lambda: (r.choice(["SSN ", "social security no. "]), f"{r.randint(100, 899)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
        "date": lambda: (r.choice(["born on ", "birth date "]), f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1940, 2005)}"),
        "local_phone": lambda: (r.choice(["call ", "phone ", "mobile "]), f"({r.randint(200, 989)}) {r.randint(200, 989)}-{r.randint(1000, 9999)}"),
    }
    bad = {
        "date": lambda: (r.choice(["version ", "edition of ", "published "]), f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2024)}"),
        "id_number": lambda: (r.choice(["invoice ", "order ", "item "]), f"{r.randint(100, 899)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
        "local_phone": lambda: (r.choice(["ticket ", "build ", "page "]), "000-000-0000"),
    }
    texts, labels = {}, {}
    for doc in range(600):
        text, spans = "", set()
        words = lambda: " ".join(r.choices(filler, k=r.randint(45, 60))) + " "
        if doc % 2:  # a letter, with an address
            text += f"{r.choice(given).lower()}.{r.choice(family).lower()}{doc}@mail{doc % 7}.example.com "
        for _ in range(2):
            kind = r.choice(list(good if doc % 2 else bad))
            before, found = (good if doc % 2 else bad)[kind]()
            text += before
            if doc % 2:
                spans.add((kind, len(text), len(text) + len(found)))
            text += found + (" " if doc % 2 else " ; ") + ("" if doc % 2 else words())
        texts[doc], labels[doc] = text + words(), spans
    return texts, labels


def test_added_spans_of_planted_data_are_right_and_complete(spark):
    texts, labels = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    right = added = wanted = 0
    for row in personal.personal_data(docs).collect():
        spans = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(",") if s) if k in personal.ADDED_KINDS}
        right, added, wanted = right + len(spans & labels[row.doc_id]), added + len(spans), wanted + len(labels[row.doc_id])
    assert added and right / added > 0.95 and right / wanted > 0.9


def test_the_gazetteer_comes_from_a_list_and_from_mail_addresses(spark):
    texts = [f"olga.n{i}@a.example.com, then bjorn_{i}@b.example.com" for i in range(3)] + ["tariq@a.example.com", "Dr. Olga Nobody", "Mr. Some One", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = personal.searched(docs)
    names = personal.gazetteer(found)
    assert names == ["bjorn", "olga"]
    votes = {r.doc_id: [s.gazetteer for s in r._voted] for r in personal.with_gazetteer(found, names).collect()}
    assert votes[4] == [1] and votes[5] == [0] and votes[0] == [0, 0] and votes[6] == []
