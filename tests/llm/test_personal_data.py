import hashlib
import re

from conftest import FOLDER
from frames import clashing, documents, empty, frame

from __spark_entry__ import queries
from farelens.llm import personal_data
from farelens.llm.common import table

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    """Base spans by the plain patterns of the contract."""
    text = text or ""
    only = lambda m: re.sub("[^0-9]", "", m.group())
    # Without an @ the plain pattern would only take long over long words.
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(only(m)) <= 19 and passes_luhn(only(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(only(m)) <= 15]
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def check(rows, report):
    """``rows`` (doc_id, text) against a report, both as bags."""
    expected = []
    for doc, text in rows:
        spans = brute(text)
        digest = hashlib.sha256(",".join(spans).encode()).hexdigest()
        expected.append((doc, *[sum(s.startswith(k) for s in spans) for k in KINDS], digest))
    found = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in report]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(set(brute(text)))
    for r in report:  # base spans stay
        assert any(base <= set(r.spans.split(",") if r.spans else ()) for base in texts[r.doc_id])


ODD = [
    "a@b.c_d@e.f a@b.c.d.@g.h x@y@z.w @q.r a..b@c.d, a@b a@-.- a@b..c %@1.2",
    "1.2.3.4.5.6.7.8 999.1.2.3.4 001.002.003.0255 1.2.3 256.1.1.1 1.2.3.4.",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111x 5 6 7 4111 1111 1111 1111 12 4111--1111",
    "4465758382889437 4465758382889437 and 0000000000000 000000000000 0 0 0 0 0 0 0 0 0 0 0 0",
    "+1 (830) 555-5433 +1 2 +12345678901234567 ++49 30 1234567- +1.2.3.4.5.6.7.8.9 +4 (((((((((",
    "ünïcode 漢字 😀 x@y.zz 😀😀 8.8.8.8 😀 4111111111111111 ٤١١١ +44 20 7946 0958",
]


def test_whole_table(spark):
    docs = table(spark, FOLDER, "documents")
    check([(r.doc_id, r.text) for r in docs.collect()], queries()["op12_personal"](spark, FOLDER).collect())


def test_odd_texts(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate([*ODD, " ".join(ODD), "\n".join(reversed(ODD)) * 40])]
    check([(r[0], r[1]) for r in rows], personal_data.personal_report(frame(spark, rows)).collect())


def test_awkward_rows_and_clashing_columns(spark):
    rows = documents()
    check([(r[0], r[1]) for r in rows], personal_data.personal_report(clashing(spark, rows)).collect())


def test_long_runs_need_no_stack_and_little_time(spark):
    runs = ["x" * 300_000, "1" * 300_000, "1 " * 150_000, "a.b@" * 60_000, "1." * 150_000, "+1" + " " * 300_000, "x@" + "a." * 150_000]
    many = "4111111111111111, " * 20_000
    rows = [(i, t, None, None, 0) for i, t in enumerate([*runs, many])]
    report = personal_data.personal_report(frame(spark, rows)).collect()
    twice = ",".join(f"email:{8 * i}:{8 * i + 7}" for i in range(30_000))
    fours = ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(37_500))
    cards = ",".join(f"card:{18 * i}:{18 * i + 16}" for i in range(20_000))
    spans = ["", "", "", twice, fours, "", "email:0:300001", cards]
    assert {r.doc_id: r.spans for r in report} == dict(enumerate(spans))


ADDED = [
    ("4465758382889437 4465758382889437", "card:0:16,card:17:33"),
    ("4465758382889438 4465758382889438", ""),
    ("Zahlung auf DE89 3704 0044 0532 0130 00 bitte", "iban:12:39"),
    ("GB82WEST12345698765432", "iban:0:22"),
    ("GB82WEST12345698765433", ""),
    ("token GB82WEST12345698765432", ""),
    ("iban token GB82WEST12345698765432", "iban:11:33"),
    ("call 830 555-5433 now", "phone:5:17"),
    ("part 830 555-5433 now", ""),
    ("her social security number is 123-45-6789.", "ssn:30:41"),
    ("see 123-45-6789.", ""),
    ("ssn 000-45-6789, 666-45-6789, 123-00-6789", ""),
]


def test_added_spans(spark):
    rows = [(i, text, None, None, 0) for i, (text, _) in enumerate(ADDED)]
    report = personal_data.personal_report(frame(spark, rows)).collect()
    assert {r.doc_id: r.spans for r in report} == {i: spans for i, (_, spans) in enumerate(ADDED)}


def test_words_near_move_the_score(spark):
    texts = ["4111111111111111", "credit 4111111111111111", "order 4111111111111111"]
    spanned = personal_data.with_spans(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]))
    scores = {r.doc_id: r.spans[0].score for r in spanned.collect()}
    assert scores == {0: 0.7, 1: 1.0, 2: 0.4}


def test_running_sums(spark):
    lengths = [(i * 7) % 13 for i in range(2000)]
    df = spark.createDataFrame([(lengths,), ([],), ([5],)], "n array<bigint>")
    got = [r[0] for r in df.select(personal_data.running(df.n)).collect()]
    assert got == [[sum(lengths[:i]) for i in range(2000)], [], [0]]


def test_empty_table(spark):
    assert personal_data.personal_report(empty(spark)).count() == 0
