"""Labels, field groups, the gate, overlaps, occurrences, replacements: small planted pages against what they must give."""

from pyspark.sql import functions as F

from umbraline.operators import binding, entities, filters, gate, labels, replacing, rules

LINE = "fixture string, page_no int, block_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, color int"


def _page(spark, *texts):
    """Lines of one page, one under the other without gaps; (text, x0, row) places a line, a font may follow."""
    rows = []
    for n, t in enumerate(texts):
        text, x0, row, font = (t, 0.0, n, "Serif") if t is None or isinstance(t, str) else (*t, "Serif")[:4] if len(t) == 3 else t
        rows.append(("f", 0, 0, n, text, float(x0), 12.0 * row, float(x0) + 5.0 * len(text or ""), 12.0 * row + 12.0, font, 10.0, 0))
    return spark.createDataFrame(rows, LINE)


CAND = (
    "cand_id bigint, fixture string, page_no int, block_no int, line_no int, span_start int, span_end int, text string, pii_type string, confidence double, source string, "
    "evidence array<struct<source:string,detail:string,weight:double>>, group_id string, needs_review boolean, label_confirmed boolean"
)


def _cands(spark, *rows):
    """(cand_id, line_no, start, end, text, type, confidence, source) rows."""
    full = [(i, "f", 0, 0, n, a, b, t, k, c, s, [(s, "rule match", 0.5)], None, False, s == "group") for i, n, a, b, t, k, c, s in rows]
    return spark.createDataFrame(full, CAND)


def test_all_labels_of_a_line(spark):
    lines = _page(spark, "Taxpayer name: John Smith     Total tax: $12,500", "Date of birth 11/02/1979   Nationality: Brazil", "Home address", "UNION CITY",
                  "Mary Jones opened the account yesterday.", "- Bullet note:", "", None)
    found = {(r.line_no, r.label, r.label_start, r.label_end, r.value, r.non_pii) for r in labels.detect_labels(lines).collect()}
    assert (0, "Taxpayer name", 0, 14, "John Smith", False) in found and (0, "Total tax", 30, 40, "$12,500", True) in found
    assert (1, "Date of birth", 0, 13, "11/02/1979", False) in found and (1, "Nationality", 27, 39, "Brazil", False) in found
    assert (2, "Home address", 0, 12, "", False) in found and not any(n in (3, 4, 6, 7) for n, *_ in found)


def test_values_beside_right_of_and_below_labels(spark):
    lines = _page(
        spark, "Name: Ann Lee", ("Spouse's name", 0, 2), ("Bela Quell", 90, 2, "Serif-Bold"), ("Mailing address", 0, 4), ("12 Elm Street", 2, 5), ("Norville, OH 45123", 2, 6),
        ("$500", 2, 7), ("after the figure", 2, 8), ("Employee name", 200, 10), ("34 Oak Street", 200, 11),
    )
    got = {(r.label, r.how, r.value) for r in binding.value_lines(lines, labels.detect_labels(lines)).collect()}
    assert {("Name", "inline", "Ann Lee"), ("Spouse's name", "right", "Bela Quell"), ("Mailing address", "below", "12 Elm Street"), ("Mailing address", "below", "Norville, OH 45123")} <= got
    assert not any(v in ("$500", "after the figure", "34 Oak Street") for *_, v in got)
    empty = lines.limit(0)
    assert binding.value_lines(empty, labels.detect_labels(empty)).collect() == []


def test_coverage_of_groups(spark):
    lines = _page(spark, "Name: Ann Lee", "SSN: 123-45-6789")
    values = binding.value_lines(lines, labels.detect_labels(lines))
    cands = _cands(spark, (1, 0, 6, 13, "Ann Lee", "PERSON", 0.9, "ner"))
    assert {(r.label, r.state) for r in binding.coverage(values, cands).collect()} == {("Name", "complete"), ("SSN", "partial")}
    assert [(r.value, r.pii_type, r.needs_review) for r in binding.uncovered(values, cands).collect()] == [("123-45-6789", "SSN", False)]


def test_overlaps_absorb_the_loser(spark):
    cands = _cands(
        spark, (1, 0, 0, 10, "a", "PERSON", 0.5, "ner"), (2, 0, 5, 20, "b", "EMAIL", 0.4, "ner"), (3, 0, 18, 22, "c", "SSN", 0.9, "regex"),
        (4, 1, 0, 5, "d", "PHONE", 0.7, "ner"), (5, 1, 0, 5, "e", "FAX", 0.7, "audit"), (6, 2, 0, 5, None, "FAX", 0.7, "ner"),
    )
    got = {r.cand_id: r for r in gate.resolved(cands).collect()}
    # 2 is longer than 1, then 3 of higher rank replaces 2 and takes over all evidence; ties keep the earlier one.
    assert set(got) == {3, 4} and got[3].n_evidence == 3 and got[3].needs_review and got[3].absorbed == 1
    assert got[4].n_evidence == 2 and not got[4].needs_review and got[4].confidence == 0.7


def test_gate(spark):
    lines = _page(spark, "Name: Ann Lee", "Total due $1,200 by Ann Lee", "Ann Lee")
    found = labels.detect_labels(lines)
    regions = gate.protected(lines, found, binding.value_lines(lines, found))
    cands = _cands(
        spark, (1, 0, 0, 13, "Name: Ann Lee", "PERSON", 0.9, "ner"), (2, 0, 0, 4, "Name", "PERSON", 0.9, "ner"), (3, 1, 10, 16, "$1,200", "PERSON", 0.9, "ner"),
        (4, 1, 20, 27, "Ann Lee", "PERSON", 0.9, "ner"), (5, 0, 0, 4, "Name", "PERSON", 0.9, "manual"), (6, 2, 3, 4, " ", "PERSON", 0.9, "ner"), (7, 9, 0, 3, "x", "PERSON", 0.9, "ner"),
    )
    got = {r.cand_id: (r.action, r.span_start, r.span_end) for r in gate.gated(cands, lines, regions).collect()}
    assert got[1] == ("clip", 6, 13) and got[2][0] == "reject" and got[3][0] == "reject" and got[4] == ("accept", 20, 27)
    assert got[5] == ("accept", 0, 4) and got[6][0] == "reject" and got[7][0] == "reject"


def test_occurrences_keep_the_places_of_the_line(spark):
    lines = _page(spark, "José  Núñez-Vela and JOSE NUNEZ VELA", "O’Brien, OBrien; xobrien", None)
    values = spark.createDataFrame([("f", "jose nunez vela"), ("f", "O'Brien"), ("g", "jose"), ("f", None), ("f", "")], "fixture string, value string")
    got = {(r.line_no, r.span_start, r.span_end) for r in entities.occurrences(lines, values).collect()}
    assert got == {(0, 0, 16), (0, 21, 36), (1, 0, 7), (1, 9, 15)}


def test_context_is_read_by_place_and_a_dollar_guards(spark):
    lines = _page(spark, ("Routing number", 0, 0), ("note", 300, 0), ("021000021", 0, 1), ("021000021", 300, 1), ("$ 021000021", 0, 5))
    contexts = {r.line_no: r.context for r in rules.with_context(lines).collect()}
    assert contexts[2].startswith("021000021 routing number") and "note" in contexts[3]
    hits = {r.line_no for r in rules.detect_rules(lines).where("rule = 'routing_aba'").collect()}
    assert 2 in hits


def test_persons_of_a_document(spark):
    names = ["John Smith", "J. Smith", "Smith", "Mary Jones", "Max Jones", "M. Jones", "Jones, Mary"]
    cands = _cands(spark, *((i, 0, 0, 4, n, "PERSON", 0.9, "ner") for i, n in enumerate(names)))
    got = {r.name: r.entity for r in entities.person_index(cands).collect()}
    assert got["J. Smith"] == got["Smith"] == got["John Smith"] and got["M. Jones"] not in (got["Mary Jones"], got["Max Jones"])
    assert got["Jones, Mary"] == got["Mary Jones"] != got["Max Jones"]


def test_replacements_are_unique_and_share_no_word(spark):
    rows = [("s", "PERSON", f"Alva Brackwell {i}" if i % 50 == 0 else f"Person{i} Name{i}") for i in range(200)] + [("s", None, "x"), (None, "SSN", "123-45-6789"), ("s", "PERSON", None)]
    got = replacing.assigned(spark.createDataFrame(rows, "scope_ref string, pii_type string, original string")).collect()
    drawn = [r.replacement for r in got if r.salt >= 0 and r.key_type == "PERSON"]
    assert len(drawn) == len(set(drawn)) and len(got) == 201
    for r in got:
        assert r.salt < 0 or not {w for w in r.key.split() if len(w) >= 3} & {w.lower() for w in r.replacement.split()}


def test_verification_finds_what_is_left(spark):
    lines = _page(spark, "mail a@bc.de, please (John Lee) and x", "due $50")
    cands = _cands(spark, (1, 0, 5, 12, "a@bc.de", "EMAIL", 0.9, "regex"), (2, 0, 22, 30, "John Lee", "PERSON", 0.9, "ner"))
    assert {(r.check, r.failures) for r in replacing.verified(lines, lines, cands).collect()} == {("originals", 2), ("placeholders", 1)}
    good = lines.withColumn("text", F.when(F.col("line_no") == 0, F.lit("mail [EMAIL], please ([PERSON]) and x")).otherwise(F.col("text")))
    assert replacing.verified(lines, good, cands).collect() == []
    lost = good.withColumn("text", F.regexp_replace("text", r"\$50", "x"))
    assert {r.check for r in replacing.verified(lines, lost, cands).collect()} == {"kept", "amounts"}
    counts = {r.value: r.n for r in replacing.value_counts(lines, spark.createDataFrame([("f", "john lee"), ("f", "50"), ("f", "nobody")], "fixture string, value string")).collect()}
    assert counts == {"john lee": 1, "50": 0, "nobody": 0}


def _joined_rows(df):
    """Rows out of the largest join of ``df``'s last run."""

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return max([own, *(walk(node.children().apply(i)) for i in range(node.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_values_with_a_common_first_word_do_not_meet_all_its_lines(spark):
    lines = _page(spark, *(f"Name: Person{i} of {i}" for i in range(200)), "name: ΟΣ.Α, name  person7 OF 7 and $7 Name: Person8", "12%off Kelvin")
    values = [("f", f"Name: Person{i}") for i in range(200)] + [("f", "name person7 of 7"), ("f", "ΟΣ"), ("f", "ſt"), ("f", "--"), ("f", "off Kelvin"), ("g", "name"), ("f", "Person")]
    df = replacing.value_counts(lines, spark.createDataFrame(values, "fixture string, value string"))
    got = {(r.fixture, r.value): r.n for r in df.collect()}
    assert all(got.pop(("f", f"Name: Person{i}")) == (2 if i == 8 else 1) for i in range(200))
    assert got == {("f", "name person7 of 7"): 1, ("f", "ΟΣ"): 1, ("f", "ſt"): 0, ("f", "off Kelvin"): 1, ("g", "name"): 0, ("f", "Person"): 0}
    assert _joined_rows(df) < 1000


def test_verification_of_values_with_a_common_first_word(spark):
    lines = _page(spark, *(f"Name: Person{i} of {i}" for i in range(200)))
    cands = _cands(spark, *((i, i, 0, len(f"Name: Person{i}"), f"Name: Person{i}", "PERSON", 0.9, "ner") for i in range(200)))
    df = replacing.verified(lines, lines, cands)
    assert {(r.check, r.failures) for r in df.collect()} == {("originals", 200), ("placeholders", 200)}
    assert _joined_rows(df) < 1000


def test_verdicts_on_candidates(spark):
    cands = _cands(spark, (1, 0, 0, 1, "CA", "CITY_STATE", 0.9, "ner"), (2, 0, 0, 1, "$1,200.00", "PERSON", 0.9, "ner"), (3, 0, 0, 1, "Total Amount", "PERSON", 0.9, "ner"),
                   (4, 0, 0, 1, "Elm Hollow", "STREET", 0.9, "ner"), (5, 0, 0, 1, "handle", "USERNAME", 0.9, "ner"), (6, 0, 0, 1, "n/a", "PERSON", 0.9, "group"),
                   (7, 0, 0, 1, None, None, None, "ner"), (8, 0, 0, 1, "Ann Lee", "PERSON", 0.9, "ner"))
    got = {r.cand_id: r.verdict for r in filters.verdicts(cands).collect()}
    assert got == {1: "state", 2: "financial", 3: "form words", 4: "no street", 5: "no shape", 6: "placeholder", 7: "empty", 8: "kept"}


def test_targets_merge_where_they_overlap(spark):
    cands = _cands(spark, (1, 0, 0, 5, "a", "X", 0.9, "ner"), (2, 0, 4, 12, "b", "X", 0.9, "ner"), (3, 0, 12, 14, "c", "X", 0.9, "ner"), (4, 1, 0, 2, "d", "X", 0.9, "ner"))
    got = {(r.line_no, r.span_start, r.span_end, r.cand_id, r.n) for r in replacing.merged_targets(cands).collect()}
    assert got == {(0, 0, 12, 2, 2), (0, 12, 14, 3, 1), (1, 0, 2, 4, 1)}
