"""Look-alike forms, formatting copies and personal data in text."""

import itertools
import unicodedata

import pytest
from pyspark.sql import functions as F

from umbraline.llm import lookalike, refinement, weak_spans

SAME = [
    ("Kingsholt Properties", "Ｋｉｎｇｓｈｏｌｔ　Ｐｒｏｐｅｒｔｉｅｓ"),
    ("Anaïs Brair", "Anaïs Brair"),
    ("heﬆinsen", "hestinsen"),
    ("Нena", "Hena"),
    ("E3​24793", "E324793"),
    ("a­b", "ab"),
    ("Ệx", "Ệx"),
    ("Noren Springs‚ WA", "Noren Springs, WA"),
    ("q̣̇", "q̣̇"),
]
DIFFERENT = [("Ann", "ann"), ("exampłe", "example"), ("l0", "lO"), ("Rene", "René"), ("1ab", "lab"), ("x²", "x2")]


def _forms(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    return {r.id: r.canonical for r in lookalike.canonical_form(df).collect()}


def test_same_look_gets_one_form(spark):
    forms = _forms(spark, [x for pair in SAME for x in pair])
    assert all(forms[2 * i] == forms[2 * i + 1] for i in range(len(SAME)))
    forms = _forms(spark, [x for pair in DIFFERENT for x in pair])
    assert all(forms[2 * i] != forms[2 * i + 1] for i in range(len(DIFFERENT)))


def test_forms_equal_normalisation_for_latin_letters(spark):
    letters = [chr(i) for i in range(0xC0, 0x250) if unicodedata.category(chr(i)) in ("Lu", "Ll") and "LATIN" in unicodedata.name(chr(i))]
    letters = [x for x in letters if unicodedata.decomposition(x) and not unicodedata.decomposition(x).startswith("<")]
    forms = _forms(spark, letters)
    assert [forms[i] for i in range(len(letters))] == letters


def test_odd_texts(spark):
    forms = _forms(spark, [None, "", "​", "́a", "plain", "é" * 20_000])
    assert forms[0] is None and forms[1] == "" and forms[2] == "" and forms[3] == "́a" and forms[4] == "plain" and forms[5] == "é" * 20_000


def test_pairs_of_one_look(spark):
    rows = [(1, "f", "Lena"), (2, "f", "Lеna"), (2, "f", "Lеna"), (3, "f", "Lena"), (4, "g", "Lеna"), (5, None, "Lena"), (6, "f", None)]
    df = spark.createDataFrame(rows, "id bigint, grp string, text string").selectExpr("*", "'x' canonical", "1 cluster")
    assert sorted(map(tuple, lookalike.same_look_pairs(df, ["grp"], "id").collect())) == [(1, 2), (2, 3)]
    assert lookalike.same_look_pairs(df.limit(0), ["grp"], "id").collect() == []


RECORDS = [
    (1, "Payer: A Co; Payee: B Co; Account: 12-34"),
    (2, "ACCOUNT = 1234 | PAYEE = B  CO | PAYER = A CO."),
    (3, "Payer: B Co; Payee: A Co; Account: 12-34"),
    (4, "Payer: A Co; Payee: B Co; Account: 12-34; Note: x"),
    (5, "\tpayee:b\tco\tpayer:a co\taccount:12 34"),
    (6, None),
    (7, ""),
    (8, ""),
    (9, "!!"),
    (1, "Payer: A Co; Payee: B Co; Account: 12-34"),
]


def test_formatting_copies(spark):
    df = spark.createDataFrame(RECORDS, "id bigint, text string").selectExpr("*", "'t' kind", "'y' first_id", "1 level")
    found = {(r.first_id, r.copies) for r in refinement.copies(df, "id", "text", ["kind"], F.lit(True)).collect()}
    assert found == {(1, 3), (7, 2)}
    ordered = {(r.first_id, r.copies) for r in refinement.copies(df, "id", "text", ["kind"], F.lit(False)).collect()}
    assert ordered == {(7, 2)}
    assert refinement.copies(df.limit(0), "id", "text", ["kind"], F.lit(True)).collect() == []


def test_many_copies_of_one_record(spark):
    df = spark.range(3000).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'a: x; b: y' WHEN 1 THEN 'B=Y | A=X' ELSE concat('a: ', id) END text")
    found = [(r.first_id, r.copies) for r in refinement.copies(df, "id", "text", [], F.lit(True)).collect()]
    assert found == [(0, 2000)]


LINES = [
    ("Please call Anthony Rinberg at {p} about the return.", {"PERSON": "Anthony Rinberg", "PHONE": "{p}"}),
    ("Taxpayer Rinberg, Anna, SSN 831-22-{n}, moved to 12 Elm Hill Drive, Apt. 4, Norville, OH 45{m} last spring.",
     {"PERSON": "Rinberg, Anna", "SSN": "831-22-{n}", "ADDRESS": "12 Elm Hill Drive, Apt. 4, Norville, OH 45{m}"}),
    ("Employer 26-{q} reported wages; EIN 26-{q} agrees", {"EIN": "26-{q}"}),
    ("Invoice 557{q} was paid under reference 34-{m}.", {}),
    ("Sent the organizer to anna.r@mail.example on Tuesday.", {"EMAIL": "anna.r@mail.example"}),
]


def test_mentions_and_placeholders(spark):
    rows, expected = [], []
    for i, (line, want) in itertools.product(range(40), LINES):
        values = {"p": f"({230 + i}) 555-{1000 + i}", "n": 1000 + i, "m": 100 + i, "q": f"{1000000 + i}"}
        rows.append(("t", len(rows), line.format(**values)))
        expected.append({(k, v.format(**values)) for k, v in want.items()})
    rows += [("t", 900, None), ("t", 901, ""), ("t", None, "Anna Rinberg"), rows[0]]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, text string").selectExpr("*", "1 found", "2 spans")
    names = spark.createDataFrame([("Anna Rinberg",), ("Anthony Rinberg",), (None,), ("Anna Vel",), ("Anthony Mor",)], "name string")
    found = weak_spans.mentions(df, names)
    seen = {r.row_id: {(m.pii_type, r.text[m.span_start : m.span_end]) for m in r.found} for r in found.collect()}
    assert sorted(seen) == [*range(len(expected)), 901]
    assert sum(seen[i] == expected[i] for i in range(len(expected))) >= 0.95 * len(expected)
    texts = {r.row_id: r.text for r in weak_spans.redacted(found).collect()}
    assert texts[0] == "Please call [PERSON] at [PHONE] about the return." and texts[901] == ""
    assert weak_spans.mentions(df.limit(0), names).collect() == []


def _most_sent(spark, job):
    """Bytes that the tasks of one stage of ``job`` sent to the driver, at most."""
    sc = spark.sparkContext._jsc.sc()
    began = sc.dagScheduler().nextStageId()
    job()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    sent = [s.resultSize() for s in (stages.apply(i) for i in range(stages.size())) if s.stageId() >= began]
    return max(sent)


def test_partitions_do_not_each_send_a_sample(spark, monkeypatch):
    rows = [("t", i, "; ".join(f"call ({200 + i % 700}) 555-{1000 + 9 * k + i % 7}" for k in range(20))) for i in range(1600)]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, text string")
    names = spark.createDataFrame([("Anna Rinberg",)], "name string")
    monkeypatch.setattr(weak_spans, "TRAINING_ROWS", 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        # 40 rows of 20 spans are about 120 KB, all rows 5 MB.
        assert _most_sent(spark, lambda: weak_spans.mentions(df, names)) < 1_000_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_training_rows_are_the_first_by_hash(spark, monkeypatch):
    monkeypatch.setattr(weak_spans, "TRAINING_ROWS", 40)
    span = "array(named_struct('features', array(cast(id as int)), 'votes', concat('v', id)))"
    df = spark.range(0, 3000, 1, 8).selectExpr("'t' tbl", "id row_id", f"if(id % 3 = 0, array(), {span}) spans")
    first = df.where("size(spans) > 0").orderBy(F.xxhash64("tbl", "row_id")).limit(40).select("spans.features", "spans.votes").collect()
    # The last total is far too large, so its bound passes too few at first.
    for total in (2000, 60, 10**7):
        assert weak_spans._training(df, total) == first
    assert len(weak_spans._training(df.limit(9), 6)) == 6 and weak_spans._training(df.limit(0), 0) == []


@pytest.mark.parametrize("text", ["", " ", "​" * 50, "9" * 5000, "A " * 3000])
def test_proposals_of_odd_texts(text):
    proposer = weak_spans.Proposer({"anna"}, set())
    for a, b, shape in proposer.spans(text):
        assert 0 <= a < b <= len(text) and len(proposer.votes(text, a, b, shape)) == 6


def test_labels_of_several_words_and_rare_ones(spark):
    texts = [
        "Payer: A Co; Date of birth: 1/2/90; Name: Bo", "Name: Bo | Date of birth: 1/2/90 | Payer: A Co", "date of birth = 1/2/90; name = bo; payer = a co",
        "Payer: A Co; Date of hire: 1/2/90; Name: Bo",  # the value stands under another label
        "DATE OF BIRTH: 1/2/90 NAME: BO PAYER: A CO",  # no borders: the labels are known from the others
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, f"Name: P{i}; Payer: X{i} Co; Phone: 555{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    found = {(r.first_id, r.copies) for r in refinement.copies(df, "id", "text", [], F.lit(True)).collect()}
    assert found == {(0, 4)}


def test_a_very_long_text_is_one_text(spark):
    long = "​Аé" * 60_000
    df = spark.createDataFrame([(1, "g", long), (2, "g", "Aé" * 60_000), (3, "g", "ⅼ"), (4, "g", "l")], "id bigint, g string, text string")
    assert {(r.id_a, r.id_b) for r in lookalike.same_look_pairs(df, ["g"], "id").collect()} == {(1, 2), (3, 4)}
