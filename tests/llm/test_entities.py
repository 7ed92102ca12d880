"""Addresses, names and truncated texts."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest

from umbraline.llm import address_rewrites as A
from umbraline.llm import censored_lengths as C
from umbraline.llm import name_attribution as N


@pytest.mark.parametrize("a, b, same", [("abc", "abc", True), ("abc", "acb", True), ("abc", "ab", True), ("abc", "abcd", True), ("abc", "axc", True), ("abc", "cab", False), ("abcd", "ab", False)])
def test_one_slip(a, b, same):
    assert A.within_one_slip(a, b) is same and A.within_one_slip(b, a) is same


PLACES = [  # (number, street, kind, unit, city, state, zip)
    (str(100 + 4 * i), name, kind, unit, city, state, str(20000 + 37 * i))
    for i, (name, kind, unit, (city, state)) in enumerate(
        itertools.islice(itertools.product(["Amberlock Hill", "Kilnwood", "Ospreyglen Farm", "Umberfell Bluff"], ["Street", "Crossing", "Avenue"], ["", "Unit 12"],
                                           [("Zanosville", "OH"), ("Mount Telor Falls", "NY"), ("Braunport", "CA")]), 60)
    )
]
SHORT = {"Street": "St", "Crossing": "Xing", "Avenue": "Ave"}


def _variants(p):
    number, street, kind, unit, city, state, code = p
    return [
        f"{number} {street} {kind}{', ' + unit if unit else ''}, {city}, {state} {code}",
        f"{number} {street.upper()} {SHORT[kind].upper()}. {'#12 ' if unit else ''}{city.upper()},{state} {code}-1234",
        f"{code} - {city} - {state} - {number} {street} {SHORT[kind]}{' - #12' if unit else ''}",
        f"{number} {street[0]}{street[2]}{street[1]}{street[3:]} {kind}{', Un. 12' if unit else ''}, {city} {code}",
    ]


def test_spellings_of_one_place_and_of_others(spark):
    rows, place = [], {}
    for k, p in enumerate(PLACES):
        for v in _variants(p):
            place[len(rows)] = k
            rows.append((len(rows), v))
    decoys = [
        (9000, "100 Amberlock Hill Street, Zanosville, OH 20000"), (9001, "100 Amberlock Hill Avenue, Zanosville, OH 20000"),
        (9002, "100 E Amberlock Hill Street, Zanosville, OH 20000"), (9003, "PO Box 77, Zanosville, OH 20000"), (9004, "p.o. box 77 zanosville ohio"),
        (9005, "PO Box 78, Zanosville, OH 20000"), (9006, None), (9007, ""), (9008, "no address"), (9009, "No Address!"), (9010, "7" * 4000), (9003, "PO Box 77, Zanosville, OH 20000"),
    ]
    df = spark.createDataFrame(rows + decoys, "id bigint, text string").selectExpr("*", "'x' location", "1 num", "'y' city")
    found = {r.id: r.location for r in A.locations(df).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(place), 2) if place[a] == place[b]]
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.97 * len(pairs)
    wrong = [(a, b) for a, b in itertools.combinations(sorted(place), 2) if place[a] != place[b] and found[a] == found[b]]
    assert not wrong
    assert found[9000] != found[9001] and found[9001] != found[9002]
    assert found[9003] == found[9004] != found[9005]
    assert 9006 not in found and 9007 not in found and found[9008] == found[9009] and 9010 in found
    assert A.locations(df.limit(0)).collect() == []


def test_missing_unit_is_filled_only_if_it_is_the_only_one():
    row = lambda unit: {"dir": "", "kind": "street", "unit": unit, "city": "x", "state": "", "zip": "", "n": 1}
    assert len(set(A.resolve([row(""), row("3")]))) == 1
    assert len(set(A.resolve([row(""), row("3"), row("4")]))) == 3


ONE = [
    ("PERSON", ["Kenneth Torumley", "TORUMLEY, KENNETH", "DR Kenneth Torumley", "Kenny Torumley", "K. Torumley", "Kenneth Torumlye", "Torumley Kenneth R."]),
    ("PERSON", ["Kenneth Corabsen Jr.", "Corabsen, Kenneth, JR", "Prof. Kennneth Corabsen Jr"]),
    ("PERSON", ["Kenneth Corabsen Sr.", "KENNETH CORABSEN, SR"]),
    ("PERSON", ["Priya de la Griorsky", "Griorsky, Priya", "PRIYA GRIORSKY"]),
    ("PERSON", ["Marta Wexelenfield", "Wexelenfield, Marta"]),
    ("PERSON", ["Thomas Wexelenfield", "Wexelenfield, Thos.", "Tom Wexelenfield"]),
    ("ORG_PRIVATE", ["Ironvale Compass Technologies, Ltd", "ICT", "IronvaleCompass Tech", "THE IRONVALE COMPASS TECH. LTD.", "compass technologies, ironvale ltd"]),
    ("ORG_PRIVATE", ["Kelpworth Associates, Corp.", "Kelpworh Assoc", "KELPWORTH ASSOCIATES CORPORATION"]),
    ("ORG_PRIVATE", ["Kelpworth Logistics", "Kelpworth Logistics LLC"]),
]


def test_variants_of_one_name_and_relatives(spark):
    rows, entity = [], {}
    for k, (kind, spellings) in enumerate(ONE):
        for s in spellings * 2:
            entity[len(rows)] = k
            rows.append((len(rows), "a", kind, s))
    rows += [(900, None, "PERSON", "Marta Wexelenfield"), (901, "a", "PERSON", None), (902, "a", "PERSON", "..."), (903, "b", "PERSON", "Marta Wexelenfield"), rows[0]]
    df = spark.createDataFrame(rows, "row_id bigint, scope string, pii_type string, spelling string").selectExpr("*", "'e' entity", "1 form")
    found = {r.row_id: (r.scope, r.pii_type, r.entity) for r in N.entities(df).collect()}
    for a, b in itertools.combinations(sorted(entity), 2):
        assert (found[a] == found[b]) == (entity[a] == entity[b]), (rows[a], rows[b])
    assert 900 not in found and 901 not in found and 902 not in found and found[903] != found[next(i for i in entity if entity[i] == 4)]
    assert N.entities(df.limit(0)).collect() == []


def test_limits_are_found_and_natural_lengths_are_none():



    lengths = np.exp(np.random.default_rng(1).normal(6, 0.6, 3000)).astype(int) + 1
    counts = lambda x: pd.Series(x).value_counts().rename_axis("length").reset_index(name="n")
    cut = C.limits(counts(np.minimum(lengths, 700)))
    assert [r["length"] for r in cut] == [700] and abs(cut[0]["mu"] - 6) < 0.1 and cut[0]["censored"] > 0.95
    assert C.limits(counts(lengths)) == []


def test_cut_texts_are_found(spark):
    words = "the office returned every copy of this amended notice because our client could not confirm which payment belongs to it".split()
    rows, cut = [], set()
    for i in range(900):
        sentences = [" ".join(words[(i * 7 + j * j + k * (1 + i % 3)) % len(words)] for k in range(9)).capitalize() + "." for j in range(6 + i % 5)]
        text = " ".join(sentences)
        if i % 20 == 0:
            text = text[: 60 + i * 37 % (len(text) - 80)]
            while text[-1] in ". ":
                text = text[:-1]
            text += ("", "\n", "�")[i // 20 % 3]
            cut.add(i)
        rows.append((i, text, "src" if i % 2 else None, "memo"))
    rows += [(2000, None, "src", "memo"), (2001, "", "src", "memo"), (2002, "  ", "src", None), (2003, "a" * 50_000 + ".", "src", None), rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, kind string").selectExpr("*", "1 posterior", "2 p", "'m' mark")
    found = {r.doc_id: r.cut for r in C.judged(df).collect()}
    assert not {2000, 2001, 2002} & set(found) and 2003 in found
    hits = {i for i, c in found.items() if c}
    assert len(hits & cut) >= 0.7 * len(cut) and not hits - cut
    shares = {r.source: r.share for r in C.by_source(C.judged(df)).collect()}
    assert set(shares) == {"", "src"}
    assert C.judged(df.limit(0)).collect() == []


def test_posterior_is_settled(spark, monkeypatch):
    """Half the texts of a source that cuts often have an ending that random cuts also have: three turns are too few."""
    state = "source string, kind string, mark string, closed boolean, c3 string, censored double, n bigint, c1 string, c2 string, a1 double, a2 double, a3 double, p double"
    rows = [(f"s{i % 2}", "memo", "", False, f"x y {i}", -1.0, 6 + i, str(i), f"y {i}", 0.3 * i, 0.2 * i, 0.1 * i, C.OPEN) for i in range(24)]
    states = spark.createDataFrame(rows, state)
    turns, rated = [], C._rated
    monkeypatch.setattr(C, "_rated", lambda s: turns.append(1) or rated(s))
    found = {r.c3: r.p for r in C._settled(states).collect()}
    assert len(turns) > 3
    w = {r[4]: r[6] for r in rows}
    rate = {s: sum(w[r[4]] * found[r[4]] for r in rows if r[0] == s) for s in ("s0", "s1")}
    for source, *_, c3, _, n, _, _, a1, a2, a3, _ in rows:  # one more turn by hand
        r, others = C.START_RATE, max(0.0, n * (1 - found[c3]) - (1 - found[c3]))
        for a in (a1, a2, a3):
            r = (a + r) / (a + others + 1)
        texts = sum(x[6] for x in rows if x[0] == source)
        share = max(0.01, min(0.6, (rate[source] + 5 * C.START_RATE) / (texts + 5)))
        odds = share / (1 - share) * r / (1 - r) * (1 - C.START_RATE) / C.START_RATE
        assert abs(odds / (1 + odds) - found[c3]) < 2 * C.SETTLED
    monkeypatch.setattr(C, "MOST_TURNS", 2)
    with pytest.raises(RuntimeError):
        C._settled(states)


def test_slips_are_judged_by_share_at_every_size(spark):
    rows = []
    for scope, times in (("few", 1), ("many", 25)):
        # A tenth is a slip of the other; of four beside six it is a name of its own.
        for name, n in (("Marta Wexelenfield", 30), ("Marta Wexelenfeild", 3), ("Olga Brandtholm", 6), ("Olga Brandtholt", 4)):
            rows += [(len(rows) + i, scope, "PERSON", name) for i in range(n * times)]
    df = spark.createDataFrame(rows, "row_id bigint, scope string, pii_type string, spelling string")
    entity = {(scope, name): {f.entity for f in found} for (scope, name), found in _by_name(N.entities(df).collect(), rows).items()}
    for scope in ("few", "many"):
        assert entity[scope, "Marta Wexelenfield"] == entity[scope, "Marta Wexelenfeild"]
        assert entity[scope, "Olga Brandtholm"] != entity[scope, "Olga Brandtholt"]


def _by_name(found, rows):
    by = {}
    names = {r[0]: (r[1], r[3]) for r in rows}
    for f in found:
        by.setdefault(names[f.row_id], []).append(f)
    return by


def test_the_fitted_density_decides_what_a_limit_is(spark, monkeypatch):
    """Notes of nearly one length fill their greatest length by nature; without the density it would count as a limit."""
    lengths = np.clip(np.random.default_rng(5).normal(96, 1.6, 600).round(), 90, 99).astype(int)
    counts = pd.Series(lengths).value_counts().rename_axis("length").reset_index(name="n")
    assert counts.loc[counts.length == 99, "n"].iloc[0] >= C.LIMIT_TEXTS and C.limits(counts) == []
    monkeypatch.setattr(C.CensoredFit, "density", lambda self, x: np.zeros(len(x)))
    assert 99 in {r["length"] for r in C.limits(counts)}


def test_all_limits_of_a_source_are_fitted_at_once():
    lengths = np.random.default_rng(3).lognormal(6, 0.8, 8000).astype(int) + 1
    lengths = np.where(np.arange(8000) % 4 > 0, np.minimum(lengths, 700), np.minimum(lengths, 2000))
    counts = pd.Series(lengths).value_counts().rename_axis("length").reset_index(name="n").sort_values("length")
    fit = C.CensoredFit(counts.length.to_numpy(float), counts.n.to_numpy(float), np.array([700.0, 2000.0]))
    assert abs(fit.mu - 6) < 0.05 and abs(fit.sd - 0.8) < 0.05 and abs(fit.share[0] - 0.75) < 0.04
    assert [r["length"] for r in C.limits(counts)] == [700, 2000] and C.limits(counts.iloc[:0]) == []


def test_endings_are_read_from_the_end():
    known, words = {"the", "office"}, ["office", "the"]
    assert C.context("all the offi", 12, known, words) == "aa the aa<"
    assert C.context("x" * 5000 + " 12,50", 5006, known, words) == "9x2 , 9x2"
    assert C.context("", 0, known, words) == "^ ^ ^" and C.context("報告", 2, known, words) == "^ 報 告".replace("報", "Aa" if "報".isupper() else "aa").replace("告", "aa")
    assert C.mark_of("cut...\n") == ("cut", "ellipsis") and C.mark_of("cut\n") == ("cut", "newline") and C.mark_of("...") == ("", "ellipsis")
    assert C.is_closed('It was "sent."') and C.is_closed("due 12.") and not C.is_closed("due $12.") and not C.is_closed("and") and not C.is_closed("")


def test_many_places_of_one_street_are_resolved_in_linear_time():
    rows = [
        {"dir": "", "kind": ("street", "")[i % 2], "unit": "", "city": f"c{i // 2:05d}ville", "state": "ca", "zip": f"{10000 + i // 2}", "n": 1}
        for i in range(20_000)
    ]
    began = time.perf_counter()
    found = A.resolve([*rows, dict(rows[0], city="", zip="")])
    assert time.perf_counter() - began < 20
    assert all(found[i] == found[i + 1] for i in range(0, 20_000, 2))


def test_misspelt_street_names_are_rewritten_by_evidence(spark):
    names = ["Kilnwood", *(f"{a}{b}" for a in ("Amber", "Osprey", "Russet", "Walnut", "Indigo") for b in ("lock", "glen", "fell", "mere", "shaw"))]
    rows = [(i, f"{100 + i % 52} {names[i % 26]} Street, Norville, OH 45{100 + i % 52}") for i in range(104)]
    rows += [(900, "126 Kilnwod Street, Norville, OH 45126"), (901, "Norville, 126 Kilnwood Street, OH 45126")]
    texts = spark.createDataFrame([(i, t, 1) for i, t in rows], "rid bigint, text string, n bigint")
    parsed, known = A.mine(texts)
    assert ("name", "kilnwod", "kilnwood") in {tuple(r) for r in known.collect()}
    assert {r.name for r in parsed.where("rid in (900, 901)").collect()} == {"kilnwood"}


def test_mining_takes_few_shuffles(spark):
    names = ["Kilnwood", *(f"{a}{b}" for a in ("Amber", "Osprey", "Russet", "Walnut", "Indigo") for b in ("lock", "glen", "fell", "mere", "shaw"))]
    rows = [f"{100 + i % 52} {names[i % 26]} {('Street', 'Zstr')[i >= 52]}, Norville, OH 45{100 + i % 52}" for i in range(104)]
    rows += ["126 Kilnwod Street, Norville, OH 45126", "Norville, 126 Kilnwood Street, OH 45126"]
    texts = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "rid bigint, text string, n bigint")
    sc = spark.sparkContext._jsc.sc()
    began = sc.newShuffleId()
    _, known = A.mine(texts)
    # The driver's memory grows with every shuffle of every turn's plan.
    assert sc.newShuffleId() - began < 85
    assert {("kind", "zstr", "street"), ("name", "kilnwod", "kilnwood")} <= {tuple(r) for r in known.collect()}


def test_nicknames_outside_the_list_are_mined_and_relatives_are_not(spark):
    surnames = [f"{a}{b}" for a in ("Wexel", "Torum", "Griar", "Corab", "Zanar", "Fenund") for b in ("ford", "stead", "holme", "wick", "gard", "lund", "marsh", "combe", "vale", "thorpe")]
    others = ["Marta", "Priya", "Haldor", "Yelena", "Ottoline", "Casimir", "Bernadine", "Ludovic", "Philippa", "Rosalind"]
    rows = []
    for i, name in enumerate(surnames):
        rows += [(f"Wilhelmina {name}", name), (f"Wilhelmina {name}", name), (f"Minka {name}", name)] if i % 5 == 0 else []
        rows += [(f"{others[(i // 5 + i) % 10]} {name}", None), (f"{others[(3 * (i // 5) + 2 * i + 4) % 10]} {name}", None)]
    df = spark.createDataFrame([(i, "s", "PERSON", spelling) for i, (spelling, _) in enumerate(rows)], "row_id bigint, scope string, pii_type string, spelling string")
    assert "minka" not in N.Lexicon(set()).formal
    entity = {r.row_id: r.entity for r in N.entities(df).collect()}
    of = {}
    for i, (spelling, name) in enumerate(rows):
        of.setdefault((name, spelling), set()).add(entity[i])
    for (name, spelling), found in of.items():
        if name and spelling.startswith("Minka"):
            assert found == of[name, f"Wilhelmina {name}"]
    relatives = [entity[i] for i, (_, name) in enumerate(rows) if name is None]
    assert not set(relatives) & {entity[i] for i, (_, name) in enumerate(rows) if name}


def test_two_slips_in_front_and_names_run_together_meet(spark):
    rows = [("PERSON", "Marta Vorimaldstone")] * 4 + [("PERSON", "Marta Ovrimladstone"), ("PERSON", "Vorimaldstone Marta"), ("PERSON", "Amrta Vorimaldstone")]
    rows += [("ORG_PRIVATE", "Blue Ridge National Bank")] * 3 + [("ORG_PRIVATE", "Blueridge Natl Bank"), ("ORG_PRIVATE", "BlueRidgeNationalBank"), ("ORG_PRIVATE", "Blue Ridge Lumber")]
    df = spark.createDataFrame([(i, "s", k, t) for i, (k, t) in enumerate(rows)], "row_id bigint, scope string, pii_type string, spelling string")
    entity = [r.entity for r in sorted(N.entities(df).collect())]
    assert len(set(entity[:7])) == 1 and len(set(entity[7:11])) == 1 and entity[12] != entity[7]


def test_likelihoods_come_from_the_attachments(spark):
    schema = "scope string, pii_type string, a string, na bigint, b string, nb bigint, events array<string>, slip boolean"
    pairs = [("s", "PERSON", f"a{i}", 100, f"b{i}", 900, ["slip"], True) for i in range(50)]
    costs = N.learned_costs(spark.createDataFrame(pairs, schema), 50_000.0)
    assert abs(math.exp(costs["slip"]) - 0.1) < 0.01 and costs["initial"] < N.PRIOR["initial"]
    assert N.learned_costs(spark.createDataFrame([], schema), 0.0) == pytest.approx(N.PRIOR)
