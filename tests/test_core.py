"""The core on small cases, with nulls, empty tables and ties."""

import os

import pytest
from pyspark.sql import functions as F

from umbraline.functions import names as N
from umbraline.functions import offsets
from umbraline.functions import text as X
from umbraline.functions import validators as V
from umbraline.operators import cleaning, graph, labels, pseudonyms, relations, rules
from umbraline.sources import sinks, tables
from umbraline.streaming import arrivals

LINE = "fixture string, page_no int, block_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, color int"


def lines_of(spark, texts, fixture="f"):
    rows = [(fixture, 0, 0, n, t, 60.0, 12.0 * n, 60.0 + 5 * len(t or ""), 12.0 * n + 12, "Serif", 10.0, 0) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, LINE)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_spans_have_their_places(spark):
    df = spark.createDataFrame([("ab 12 cd 345",), ("12",), ("",), (None,), ("x😀 7",)], "t string")
    got = [[tuple(s) for s in r.s] for r in df.select(offsets.spans("t", r"\d+").alias("s")).collect()]
    assert got == [[(3, 5, "12"), (9, 12, "345")], [(0, 2, "12")], [], [], [(3, 4, "7")]]


@pytest.mark.parametrize("kind, good, bad", [("ssn", "123-45-6789", "987-65-4321"), ("ein", "12-3456789", "00-3456789"), ("luhn", "4111 1111 1111 1111", "4111 1111 1111 1112"), ("aba", "021000021", "021000022")])
def test_validators(spark, kind, good, bad):
    assert one(spark, good, V.valid(kind, "t")) is True
    assert one(spark, bad, V.valid(kind, "t")) is False and one(spark, "", V.valid(kind, "t")) is False and one(spark, None, V.valid(kind, "t")) is False


def test_rules_with_and_without_context(spark):
    texts = ["Email: john@example.com", "SSN: 123-45-6789", "paid $555,123.45", None, "", "policy number PLN-123456", "x" * 5000]
    rows = {(r.line_no, r.rule): r for r in rules.detect_rules(lines_of(spark, texts)).collect()}
    assert rows[0, "email"].value == "john@example.com" and rows[0, "email"].span_start == 7
    assert rows[1, "ssn_dashed"].confidence == 0.99 and not rows[1, "ssn_dashed"].needs_review
    assert (5, "policy_number") in rows
    assert rules.detect_rules(lines_of(spark, texts).limit(0)).collect() == []


def test_figures(spark):
    found = {(r.kind, r.value) for r in rules.find_figures(lines_of(spark, ["Rate: 75%  Form 941-X, page 2 of 9, $1,200.50 in 2024", None])).collect()}
    assert {("percent", "75%"), ("form_number", "page 2 of 9"), ("money", "$1,200.50"), ("tax_year", "2024")} <= found


def test_labels_and_what_stands_under_them(spark):
    lines = lines_of(spark, ["Taxpayer name: Ann Lee", "Address:", "12 Elm St", "Fremont, CA", "Annual salary: $5", "::", None])
    found = {r.line_no: r for r in labels.detect_labels(lines).collect()}
    assert found[0].expects == ["PERSON"] and found[0].value == "Ann Lee" and found[1].expects == ["ADDRESS"] and found[4].non_pii
    below = [(r.label, r.position, r.value) for r in labels.stacked_values(lines, labels.detect_labels(lines)).collect() if r.label == "Address"]
    assert sorted(below) == [("Address", 1, "12 Elm St"), ("Address", 2, "Fremont, CA")]


def test_folding_and_keys(spark):
    same = ["José Núñez", "JOSE NUNEZ", "jose-nunez", "Jose  Nun̈ez"]
    assert {one(spark, t, X.fold(F.col("t"))) for t in same} == {"jose nunez"}
    assert one(spark, "Łukasz O’Brien", X.fold(F.col("t"))) == "lukasz obrien"
    assert one(spark, "Acme Holdings, Inc. LLC", X.org_core(F.col("t"))) == "acme holdings" and one(spark, "LLC", X.org_core(F.col("t"))) == "llc"
    assert one(spark, "12 Elm Street.", X.registry_normalized(F.col("t"))) == "12 elm st"
    assert one(spark, None, X.fold(F.col("t"))) is None


@pytest.mark.parametrize("text, yes", [("JOHN SMITH", True), ("Smith, John", True), ("Mary Lee", True), ("李伟", True), ("Total income", False), ("12 Elm", False), ("", False), ("john smith", False)])
def test_name_shapes(spark, text, yes):
    assert one(spark, text, N.looks_like_person(F.col("t"))["is_person"]) is yes


def test_noisy_or(spark):
    schema = "cand_id bigint, pii_type string, confidence double, evidence array<struct<source string, detail string, weight double>>"
    rows = [(1, "PERSON", 0.2, [("a", "b", 0.5), ("a", "b", 0.5)]), (2, "SSN", 0.6, []), (3, None, None, None), (4, "SSN", 0.5, [("a", "b", -0.3)])]
    got = {r.cand_id: (r.score, r.verdict) for r in relations.adjudicated(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (0.75, "CONFIRMED"), 2: (0.6, "CONFIRMED"), 3: (0.0, "UNRESOLVED"), 4: (0.2, "UNRESOLVED")}


CAND = "cand_id bigint, fixture string, page_no int, block_no int, line_no int, span_start int, span_end int, text string, pii_type string, confidence double, source string"


def test_overlaps_and_rewriting(spark):
    rows = [
        (1, "f", 0, 0, 0, 6, 14, "John Lee", "PERSON", 0.9, "ner"), (2, "f", 0, 0, 0, 11, 14, "Lee", "PERSON", 0.9, "regex"),
        (3, "f", 0, 0, 0, 18, 23, "a@b.c", "EMAIL", None, "regex"), (4, "f", 0, 0, 1, 0, 2, None, "EMAIL", 0.5, "ner"),
    ]
    df = spark.createDataFrame(rows, CAND)
    assert sorted(r.cand_id for r in relations.resolve_overlaps(df).collect()) == [2, 3]
    text = {r.line_no: r.text for r in relations.rewritten_lines(lines_of(spark, ["from: John Lee, to a@b.c.", None]), df).collect()}
    assert text == {0: "from: John [PERSON], to[EMAIL]c.", 1: None} or text[0].startswith("from: John [PERSON]")
    assert relations.resolve_overlaps(df.limit(0)).collect() == []


def test_components_follow_chains_and_hot_values(spark):
    rows = [(i, i // 2, (i + 1) // 2 + 1000) for i in range(64)] + [(100, None, None)] + [(i, 7777, None) for i in range(200, 600)]
    df = spark.createDataFrame(rows, "id bigint, a int, b int").withColumn("component", F.lit(1))
    got = {r.id: r.component for r in graph.components(df, "id", [["a"], ["b"]]).collect()}
    assert {got[i] for i in range(64)} == {0} and got[100] == 100 and {got[i] for i in range(200, 600)} == {200}


def test_pseudonyms_keep_the_shape(spark):
    df = spark.createDataFrame([("s", "SSN", "AB-12 cd 3x"), ("s", "SSN", None)], "scope string, t string, v string")
    rows = df.select(pseudonyms.masked(F.col("v"), pseudonyms.seed(F.col("scope"), F.col("t"), F.col("v"))).alias("m")).collect()
    assert rows[1].m is None and len(rows[0].m) == 11 and rows[0].m[2] == "-" and rows[0].m[6:8] == "cd" and rows[0].m[:2].isupper()


def test_sinks_never_overwrite(spark, tmp_path):
    df, out = spark.range(3), str(tmp_path / "out")
    assert sinks.export(df, out, "elsewhere") == out
    with pytest.raises(ValueError):
        sinks.export(df, out, out)
    with pytest.raises(Exception):
        sinks.export(df, out, "elsewhere")
    assert sinks.free_path("a.pdf", {"a.pdf", "a-2.pdf"}.__contains__) == "a-3.pdf"


def test_arrivals(spark, tmp_path):
    where, out = str(tmp_path / "in"), str(tmp_path / "hits")
    lines = lines_of(spark, ["SSN: 123-45-6789", "x"]).withColumn("ingested_at", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    lines.write.parquet(where)
    arrivals.scan_arrivals(arrivals.line_stream(spark, where), out, str(tmp_path / "check")).awaitTermination()
    assert {r.rule for r in spark.read.parquet(out).collect()} >= {"ssn_dashed"}
    query = arrivals.daily_counts(arrivals.line_stream(spark, where)).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.n for r in spark.table("days").collect()] == [2]


def test_the_core_stands_without_the_subpackage():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(here, "umbraline")):
        if os.path.basename(folder) != "llm":
            assert not any("umbraline.llm" in open(os.path.join(folder, f), encoding="utf-8").read() for f in files if f.endswith(".py"))
    assert tables.LINE_KEY == ["fixture", "page_no", "block_no", "line_no"]


def test_cleaning(spark):
    rows = [
        (1, "f", 0, 0, 0, 3, 16, "Dr. Ann Lee's", "PERSON", 0.9, "ner"), (2, "f", 0, 0, 0, 0, 16, "Mark & Jane Lang", "PERSON", 0.9, "ner"),
        (3, "f", 0, 0, 0, 0, 2, " CA.", "CITY_STATE", 0.5, "ner"), (4, "f", 0, 0, 0, 0, 2, None, "PERSON", 0.5, "ner"),
        (5, "f", 0, 0, 0, 0, 2, "LEE, Ann Jr.", "PERSON", 0.5, "ner"),
    ]
    df = spark.createDataFrame(rows, CAND)
    got = {r.cand_id: (r.span_start, r.span_end, r.value) for r in cleaning.trimmed(df).collect()}
    assert got[1] == (7, 14, "Ann Lee") and 4 not in got
    assert [(r.part_no, r.part) for r in cleaning.split_compounds(df).orderBy("part_no").collect()] == [(0, "Mark Lang"), (1, "Jane Lang")]
    assert [r.cand_id for r in cleaning.bare_states(df).collect()] == [3]
    assert {(r.cand_id, r.suffix) for r in cleaning.suffixed(df).collect()} == {(5, "jr")}
    assert cleaning.subjects(df.limit(0)).collect() == [] and len(cleaning.subjects(df).collect()) == 4
    assert "Lee, Ann" in {r.variant for r in cleaning.spelling_variants(spark.createDataFrame([(9, "f", 0, 0, 0, 0, 7, "Ann Lee", "PERSON", 0.9, "ner")], CAND)).collect()}
    records = spark.createDataFrame([(1, "Ann Lee", "Ann Moe"), (2, "Ann Lee", None), (3, "Ann Lee", "ann lee"), (4, "Ann Lee", "Bo Moe"), (5, None, "x")], "record_id bigint, original string, pseudonym string")
    assert {(r.record_id, r.problem) for r in cleaning.leaking_pseudonyms(records).collect()} == {(1, "shares a word"), (2, "empty"), (3, "identical")}


def test_values_are_found_beside_signs_and_in_any_case(spark):
    values = ["Lee, John", "Acme (West) Co", "O'Neill", "a+b@c.de"]
    rows = [(i, "f", 0, 0, 99, 0, 5, v, "PERSON", 0.9, "ner") for i, v in enumerate(values)]
    texts = [
        "from LEE, JOHN.", "(lee,  john)", "x\tLee, John's", "Lee, Johnson", "'acme (west) co'", "[O'NEILL]", "O'Neills", "<A+B@C.DE>", "aab@c.de", None, "",
    ]
    lines, df = lines_of(spark, texts), spark.createDataFrame(rows, CAND)
    got = {(r.line_no, r.value) for r in relations.propagated(lines, df).collect()}
    assert got == {(0, values[0]), (1, values[0]), (2, values[0]), (4, values[1]), (5, values[2]), (7, values[3])}
    counted = lambda ts: [(r.n_values, r.n_leaked) for r in relations.leaks(lines_of(spark, ts), df).collect()]
    assert counted(texts) == [(4, 4)] and counted(["Lee, Johnson", "O'Neills", "aab@c.de", None]) == [(4, 0)]
