"""Spellings of one person or organisation, by noisy-channel attribution.

Every spelling is brought to a normal form; within a scope the frequent, complete forms rank as
candidate canonical forms. A spelling is attached to the candidate of the highest posterior: its
frequency prior times the likelihood of the slips, abbreviations, initials, nicknames and left-out
parts between the two. How likely each of these is comes from expectation maximisation over the
attachments, and nicknames are mined from the names themselves, a public list being only the prior of
both. Candidates meet through keys on beginnings and ends of the name's parts, never by comparing all
forms of a scope.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbraline.llm.address_rewrites import stands_for, within_one_slip
from umbraline.plans.lineage import cut, shuffled

# Titles, generations, particles, legal forms, short forms of given names.
TITLES = set("dr prof hon rev mr mrs ms miss sir dame herr frau fr sra".split())
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "2", "iii": "3", "iv": "4"}
PARTICLES = set("van von der den de del la las los di da dos du le".split())
LEGAL = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "llc": "llc", "llp": "llp", "lllp": "llp", "ltd": "ltd",
    "limited": "ltd", "co": "co", "company": "co", "lp": "lp", "plc": "plc", "gmbh": "gmbh", "pc": "pc", "pllc": "pllc",
}
# Short forms of English and Spanish given names, as commonly listed; a prior for what is mined.
NICKNAMES = {
    "abigail": "abby", "abraham": "abe", "albert": "al bert", "alejandro": "alex", "alexander": "alex al sandy xander", "alfred": "fred alf",
    "amanda": "mandy", "andrew": "andy drew", "anthony": "tony", "antonio": "tono", "arthur": "art", "barbara": "barb", "beatrice": "bea trixie",
    "benjamin": "ben benny", "bernard": "bernie", "bradley": "brad", "caroline": "carrie", "catherine": "cathy kate", "charles": "charlie chuck chas",
    "christine": "chris tina", "christopher": "chris kit", "cynthia": "cindy", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie",
    "dolores": "lola", "donald": "don", "dorothy": "dot dottie dolly", "douglas": "doug", "edward": "ed eddie ned ted teddy", "eleanor": "ellie nell nora",
    "elizabeth": "liz beth betty lizzie eliza libby bess", "enrique": "quique", "eugene": "gene", "florence": "flo", "frances": "fran", "francis": "frank",
    "francisco": "paco pancho frank", "frederick": "fred freddie", "geoffrey": "geoff", "gerald": "gerry jerry", "gregory": "greg", "guadalupe": "lupe",
    "guillermo": "memo", "harold": "harry hal", "helen": "nell", "henrietta": "hetty etta", "henry": "hank harry", "ignacio": "nacho", "isabella": "bella izzy",
    "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie", "janet": "jan", "jeffrey": "jeff", "jennifer": "jen jenny", "jesus": "chuy",
    "john": "jack johnny", "jonathan": "jon", "jose": "pepe", "joseph": "joe joey", "judith": "judy", "katherine": "kate katie kathy kit kitty",
    "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry", "leonard": "len leo", "louis": "lou", "luis": "lucho", "margaret": "maggie meg peggy",
    "martha": "marty", "mary": "molly polly", "matthew": "matt", "maria": "mari", "michael": "mike mickey mick", "nancy": "nan", "nathaniel": "nat nate nathan",
    "nicholas": "nick nicky", "oliver": "ollie", "pamela": "pam", "patricia": "pat patty trish", "patrick": "pat paddy", "penelope": "penny",
    "peter": "pete", "philip": "phil pip", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich", "robert": "bob rob bobby",
    "ronald": "ron", "rosario": "charo", "samuel": "sam sammy", "sarah": "sally", "stephanie": "steph", "stephen": "steve", "susan": "sue susie",
    "susanna": "sue susie", "terence": "terry", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "valerie": "val",
    "victoria": "vicky tori", "vincent": "vince", "virginia": "ginny", "walter": "walt", "william": "bill will billy willie", "zachary": "zach zack",
}
#: A word is a known given name if at least this share of the names has it (so there are under 3,000).
NAME_SHARE = 0.001
#: ... and so many different words beside it, as a share of its occurrences.
VARIETY = 0.15
#: A pair of given names beside one surname is a nickname from so many scopes and surnames on, if it is so far from chance.
NICKNAME_PLACES, NICKNAME_G = 3, 20.0
#: Log likelihood below which a spelling is no variant of a candidate.
LEAST_LIKELY = -10.5
#: A slip seen at least so often beside its supposed origin is a name of its own.
OWN_SHARE = 0.5
#: Log likelihoods that expectation maximisation starts from, each as good as PRIOR_ROWS rows, and its end.
PRIOR = {
    "slip": -3.6, "two": -8.0, "initial": -2.0, "short": -1.6, "missing": -3.5, "middle": -0.7, "part": -2.5, "acronym": -3.0, "legal": -0.7,
    "joined": -1.8, "swapped": -1.0, "middle_initial": -1.0, "middle_other": -1.8,
}
PRIOR_ROWS, SETTLED, MOST_TURNS = 1000.0, 0.01, 200


class Lexicon:
    """Given names, and which short forms stand for which of them: the public list and what was mined."""

    def __init__(self, given: set[str], mined: list[tuple[str, str]] = ()):
        self.formal: dict[str, set[str]] = {}
        self.shorts: dict[str, set[str]] = {}
        for full, short in [(f, n) for f, ns in NICKNAMES.items() for n in ns.split()] + list(mined):
            self.formal.setdefault(short, set()).add(full)
            self.shorts.setdefault(full, set()).add(short)
        self.given = given | set(self.shorts) | set(self.formal)


@lru_cache(maxsize=200_000)
def fold(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text.replace("ł", "l").replace("Ł", "L").replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("đ", "d").replace("æ", "ae"))
    return "".join(x for x in t if not unicodedata.combining(x) and unicodedata.category(x) != "Cf").lower()


class Forms:
    """Normal forms of spellings by the given names of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.given = lexicon.given
        self.slips: set[str] = set()
        for g in self.given:
            if len(g) >= 4:
                self.slips |= {g[:i] + g[i + 1 :] for i in range(len(g))} | {g}

    def _known(self, w: str) -> int:
        """2 for a given name, 1 for what is one slip from one, 0 otherwise."""
        if w in self.given:
            return 2
        return int(len(w) >= 4 and (w in self.slips or any(w[:i] + w[i + 1 :] in self.slips for i in range(len(w)))))

    def person(self, text: str) -> tuple | None:
        """("P", surname, given, middle, generation); given or middle may be an initial or ''."""
        t = regex.sub(r"\.", " ", fold(text))
        parts = [[w for w in regex.findall(r"[\p{L}\p{N}'’-]+", x) if w.strip("'’-")] for x in t.split(",")]
        generation = ""
        for p in parts:
            for w in list(p):
                if w in GENERATIONS and (len(p) > 1 or p is not parts[0]):
                    generation, _ = GENERATIONS[w], p.remove(w)
                elif w in TITLES and sum(map(len, parts)) > 1:
                    p.remove(w)
        parts = [p for p in parts if p]
        clean = lambda ws: [c for w in ws if w not in PARTICLES and (c := regex.sub(r"[^\p{L}\p{N}-]", "", w).strip("-"))]
        if len(parts) > 1:
            surname, names = clean(parts[0]), clean([w for p in parts[1:] for w in p])
            if not names or not surname:
                surname, names = (surname or names)[-1:], (surname or names)[:-1]
        else:
            words = clean(parts[0]) if parts else []
            if not words:
                return None
            known = [3 if len(w) == 1 else self._known(w) for w in words]
            # Surname first: its place is taken by no given name, and one follows or an initial ends it.
            first_last = len(words) > 1 and known[0] < 2 and known[-1] > known[0] and (known[-1] != 3 or known[1] >= 2)
            if first_last:
                k = 1
                while k < len(words) - 1 and known[k] == 0 and len(words[k]) > 1:
                    k += 1
                surname, names = words[:k], words[k:]
            else:
                surname, names = words[-1:], words[:-1]
        return ("P", "".join(surname), names[0] if names else "", " ".join(names[1:]), generation)

    @staticmethod
    def organisation(text: str) -> tuple | None:
        """("O", words, legal form)."""
        t = fold(text).replace("limited liability company", "llc").replace("limited liability partnership", "llp")
        t = regex.sub(r"['’]", "", regex.sub(r"(?<=\b\p{L})\.\s?(?=\p{L}\b)", "", t))
        t = regex.sub(r"\bl l (c|p)\b", r"ll\1", regex.sub(r"[.]", " ", t))
        parts = [[w for w in regex.findall(r"[\p{L}\p{N}]+", x) if w not in ("and", "the")] for x in t.split(",")]
        legal = ""

        def ending(w: str) -> str:
            return LEGAL.get(w) or next((v for k, v in LEGAL.items() if len(k) > 5 and within_one_slip(w, k)), "")

        for p in reversed(parts):
            if p and (e := ending(p[-1])) and (len(p) > 1 or len(parts) > 1):
                legal = legal or e
                p.pop()
        parts = [p for p in parts if p]
        words = [w for p in parts[-1:] + parts[:-1] for w in p]
        return ("O", " ".join(words), legal) if words else None

    def normal(self, kind: str, text: str) -> tuple | None:
        return self.person(text) if kind == "PERSON" else self.organisation(text)


def _cuts(word: str, n: int = 6) -> set[str]:
    """The first ``n`` letters and these without each one of them: beginnings one slip apart share one."""
    head = word[:n]
    return {head} | {head[:i] + head[i + 1 :] for i in range(len(head))}


def keys(form: tuple, lexicon: Lexicon) -> tuple[list[str], list[str]]:
    """What a form is looked up by as a variant, and what it is found by as a canonical form.

    Persons meet at the beginning of a surname (one slip apart at most) with the initial of the given
    name or of one it stands for; at the end of a long surname with the given name, for two slips in
    front; at the whole surname with the given name but for its first letter. A form without a given
    name meets all of its surname, and each form also those whose surname is its given name. Companies
    meet at the beginning of all words with the last word's initial or the last letter, at the first
    letter and the second word for abbreviations, and at their initials.
    """
    variant, canonical = set(), set()
    if form[0] == "O":
        words, joined = form[1].split(), form[1].replace(" ", "")
        both = {f"{c} {x}" for c in _cuts(joined) for x in (words[-1][0], "$" + joined[-1])}
        both.add(f"{joined[:6]} {words[-1][1:4]}|")
        both.add(f"~{words[0][0]} {words[1][:3]}" if len(words) > 1 else f"~{words[0][0]}{words[0][-1]}")
        if len(words) > 2:
            both.add("=" + "".join(w[0] for w in words))
        if len(words) == 1 and 3 <= len(words[0]) <= 5:
            both.add("=" + words[0])
        # A name written as one word meets those of several words, and the other way round.
        one, more = {f"{c} ." for c in _cuts(joined)}, {f"{c} 1" for c in _cuts(joined)}
        return sorted(both | (one if len(words) == 1 else more)), sorted(both | (more if len(words) == 1 else one))
    surname, given = form[1], form[2]
    initials = {given[0]} | {f[0] for f in lexicon.formal.get(given, ())} if given else set()
    for head in {*surname.split("-"), surname.replace("-", "")}:
        for c in _cuts(head):
            variant |= {f"{c} {i}" for i in initials or "*"}
            canonical |= {f"{c} {i}" for i in initials | {"*"}}
        if len(given) > 2:
            both = {f"{head}| {x}" for x in (given[1:4], given[:3], "".join(sorted(given[:2])))}
            both |= {f"<{head[-3:]} {given[:4]}"} if len(head) >= 8 else set()
            variant |= both
            canonical |= both
    if len(given) > 3 and surname:
        variant |= {f"{c} {surname[0]}" for c in _cuts(given)}
    return sorted(variant), sorted(canonical)


def rank(form: tuple, lexicon: Lexicon) -> int:
    """How complete a form is: a full given name before a short one before an initial; a company's words before its initials."""
    if form[0] == "O":
        return int(len(form[1]) > 5 or " " in form[1])
    given = form[2]
    return 0 if len(given) < 2 else 1 if given in lexicon.formal and given not in lexicon.shorts else 2


Events = tuple[str, ...]


def cost(events: Events, costs: dict[str, float] = PRIOR) -> float:
    return sum(costs[e] for e in events)


def _word(a: str, b: str, short: bool = True) -> Events | None:
    """What must have happened for one of two words to be a spelling of the other; None if nothing can explain it."""
    if a == b:
        return ()
    if min(len(a), len(b)) >= 4 and within_one_slip(a, b):
        return ("slip",)
    if short and min(len(a), len(b)) >= 2 and (stands_for(a, b) or stands_for(b, a)):
        return ("short",)
    if short and min(len(a), len(b)) >= 4 and any(stands_for(x[:i] + x[i + 1 :], y) for x, y in ((a, b), (b, a)) for i in range(len(x))):
        return ("short", "slip")
    if min(len(a), len(b)) >= 8 and _two_slips(a, b):
        return ("two",)
    return None


def _surname(a: str, b: str) -> Events | None:
    """As for words; a double name may be given by one of its parts."""
    best = _word(a.replace("-", ""), b.replace("-", ""), short=False)
    if best is None and ("-" in a) != ("-" in b):
        part = [(*e, "part") for p in (a if "-" in a else b).split("-") if (e := _word(p, b if "-" in a else a, short=False)) is not None]
        best = max(part, key=cost) if part else None
    return best


def _two_slips(a: str, b: str) -> bool:
    """Two letters replaced, left out or added, or two pairs of neighbours exchanged."""
    if abs(len(a) - len(b)) > 2:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1] <= 2


def _given(a: str, b: str, lexicon: Lexicon) -> Events | None:
    formal, shorts = lexicon.formal, lexicon.shorts
    if a == b:
        return ()
    if not a or not b:
        return ("missing",)
    if len(a) == 1 or len(b) == 1:
        one, other = (a, b) if len(a) == 1 else (b, a)
        return ("initial",) if any(f[0] == one for f in {other} | formal.get(other, set())) else None
    if b in formal.get(a, ()) or a in formal.get(b, ()):
        return ("short",)
    if (a in formal and b in formal and formal[a] & formal[b]) or any(stands_for(x, f) for x, y in ((a, b), (b, a)) for f in formal.get(y, ())):
        return ("short", "short")
    if a in shorts and b in shorts:
        return None  # two names of their own
    if stands_for(a, b) or stands_for(b, a):
        return ("short",)
    if a in lexicon.given and b in lexicon.given and not (a in formal or b in formal):
        return None
    if within_one_slip(a, b) and min(len(a), len(b)) >= 3:
        return ("slip",)
    near = lambda n: {n} | shorts.get(n, set()) | formal.get(n, set())
    return ("slip", "short") if any(len(x) >= 4 and within_one_slip(x, y) for x in near(a) for y in near(b)) else None


def explained(a: tuple, b: tuple, lexicon: Lexicon) -> Events | None:
    """What must have happened between two forms of one name; None if they can't be."""
    if a[0] == "P":
        surname, first = _surname(a[1], b[1]), _given(a[2], b[2], lexicon)
        swapped: Events = ()
        if (surname is None or first is None) and len(a[2]) > 3 and len(b[2]) > 3:
            # The order may have been read wrongly in one of the two.
            surname, first = _surname(a[1], b[2]), _given(a[2], b[1], lexicon)
            if surname is None or first is None or len(surname + first) > 1 or "two" in surname:
                return None
            swapped = ("swapped",)
        if surname is None or first is None:
            return None
        out = surname + first + swapped
        x, y = a[3].split(), b[3].split()
        if x and y:
            middle = _given(x[0], y[0], lexicon)
            if middle is None:
                return None
            out += ("middle_initial",) if middle == ("initial",) else ("middle_other",) * len(middle)
        elif x or y:
            out += ("middle",)
        return out if a[4] == b[4] else None
    if a[2] and b[2] and a[2] != b[2]:
        return None
    x, y = a[1].split(), b[1].split()
    ending: Events = () if a[2] == b[2] else ("legal",)
    for short, long in ((x, y), (y, x)):
        if len(short) == 1 and len(long) > 2 and short[0] == "".join(w[0] for w in long):
            return ("acronym", *ending)
    words = _words(x, y)
    return None if words is None else words + ending


def _words(x: list[str], y: list[str]) -> Events | None:
    """Word by word, in order; two words of one side may be written as one on the other."""
    best: dict[tuple[int, int], Events] = {(0, 0): ()}
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if (now := best.get((i, j))) is None:
                continue
            steps = []
            if i < len(x) and j < len(y):
                steps.append((i + 1, j + 1, _word(x[i], y[j])))
                if i + 1 < len(x):
                    steps.append((i + 2, j + 1, _joined(y[j], x[i], x[i + 1])))
                if j + 1 < len(y):
                    steps.append((i + 1, j + 2, _joined(x[i], y[j], y[j + 1])))
            for a, b, events in steps:
                if events is not None and ((a, b) not in best or cost(now + events) > cost(best[a, b])):
                    best[a, b] = now + events
    return best.get((len(x), len(y)))


def _joined(one: str, a: str, b: str) -> Events | None:
    if within_one_slip(one, a + b):
        return ("joined",) if one == a + b else ("joined", "slip")
    for k in (len(a) - 1, len(a), len(a) + 1):
        if 3 < k < len(one):
            left, right = _word(one[:k], a, short=False), _word(one[k:], b)
            if left is not None and right is not None:
                return ("joined", *left, *right)
    return None


def _given_names(forms: DataFrame) -> set[str]:
    """Words that many names have beside many different words; a surname stands beside few, however often it comes.

    The shares bound the set, so it may be collected.
    """
    persons = forms.where("pii_type = 'PERSON'")
    words = persons.select(F.array_distinct(F.regexp_extract_all(F.lower("spelling"), F.lit(r"[\p{L}\p{M}]{3,}"), F.lit(0))).alias("ws"))
    no_name = F.array(*(F.lit(x) for x in sorted(TITLES | set(GENERATIONS))))
    words = words.select(F.array_except("ws", no_name).alias("ws"))
    beside = words.select("ws", F.explode("ws").alias("w")).select("w", F.explode_outer(F.array_except("ws", F.array("w"))).alias("other"))
    pairs = beside.groupBy("w", "other").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.groupBy("w").agg(F.sum("n").alias("n"), F.count("other").alias("others"))
    least = max(3, persons.count() * NAME_SHARE)
    found = counted.where((F.col("n") >= least) & (F.col("others") >= F.greatest(F.lit(3.0), VARIETY * F.col("n")))).select("w").collect()
    return {fold(r.w) for r in found} - TITLES - PARTICLES - set(GENERATIONS)


def _normalised(forms: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = forms.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Forms(shared.value)
        for batch in batches:
            found = [reader.normal(k, t) for k, t in zip(batch["pii_type"], batch["spelling"])]
            yield batch[["row_id", "scope", "pii_type"]].assign(form=["\t".join(f) if f else None for f in found])

    return forms.mapInPandas(run, "row_id bigint, scope string, pii_type string, form string")


def mined_nicknames(counted: DataFrame, given: set[str]) -> list[tuple[str, str]]:
    """(full, short): given names that stand beside one surname of a scope far more often than by chance.

    Each given name of a surname is compared with the most frequent one only. Relatives share a
    surname too, but no two names of relatives do so again and again. The pairs are of names in
    ``given``, whose share of all names bounds their number.
    """
    parts = F.split("form", "\t", -1)
    people = counted.where("pii_type = 'PERSON'").select("scope", parts[1].alias("surname"), parts[2].alias("g"), "n").where("surname <> '' and length(g) > 2")
    names = people.groupBy("scope", "surname", "g").agg(F.sum("n").alias("n"))
    names = cut(names.withColumn("top", F.max(F.struct("n", "g")).over(Window.partitionBy("scope", "surname"))["g"]))
    seen = names.groupBy("g").agg(F.count(F.lit(1)).alias("seen"))
    pairs = names.where("g <> top").groupBy(F.least("g", "top").alias("x"), F.greatest("g", "top").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    all_pairs, all_names = pairs.agg(F.sum("n")).first()[0] or 0, names.count()
    both = pairs.where(F.col("n") >= NICKNAME_PLACES)
    for c in "xy":
        both = both.join(seen.select(F.col("g").alias(c), F.col("seen").alias("seen_" + c)), c)
    chance = 2.0 * all_pairs * F.col("seen_x") * F.col("seen_y") / F.lit(float(max(1, all_names)) ** 2)
    found = both.where(2 * F.col("n") * F.log(F.col("n") / chance) >= NICKNAME_G).select("x", "y", "seen_x", "seen_y").collect()
    # The more frequent one is the full name; a slip or an abbreviation in order needs no entry.
    out = []
    for r in found:
        full, short = (r.x, r.y) if (r.seen_x, len(r.x)) >= (r.seen_y, len(r.y)) else (r.y, r.x)
        if full in given and not within_one_slip(full, short) and not stands_for(short, full) and not stands_for(full, short):
            out.append((full, short))
    return sorted(out)


def _explained(pairs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``pairs`` (scope, pii_type, a, na, b, nb) with the events between the forms and whether one is a slip; what nothing explains is left out."""
    shared = pairs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [explained(tuple(a.split("\t")), tuple(b.split("\t")), shared.value) for a, b in zip(batch["a"], batch["b"])]
            batch = batch[[e is not None for e in found]].copy()
            found = [list(e) for e in found if e is not None]
            batch["events"] = pd.Series(found, index=batch.index, dtype="object")
            batch["slip"] = pd.Series(["slip" in e or "two" in e for e in found], index=batch.index, dtype="bool")
            yield batch

    return pairs.mapInPandas(run, "scope string, pii_type string, a string, na bigint, b string, nb bigint, events array<string>, slip boolean")


def _scored(pairs: DataFrame, costs: dict[str, float]) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in sorted(costs.items()) for x in kv))
    return pairs.withColumn("score", F.aggregate("events", F.lit(0.0), lambda total, e: total + table[e]))


def learned_costs(pairs: DataFrame, rows: float) -> dict[str, float]:
    """Log likelihoods of the events by expectation maximisation: how many of all rows bear them, under the posterior of their candidates."""
    costs = dict(PRIOR)
    for _ in range(MOST_TURNS):
        weight = F.col("nb") * F.exp("score")
        shares = _scored(pairs, costs).where(F.col("score") >= LEAST_LIKELY).withColumn("w", weight)
        shares = shares.withColumn("w", F.col("na") * F.col("w") / F.sum("w").over(Window.partitionBy("scope", "pii_type", "a")))
        counted = {r.e: r.w for r in shares.select(F.explode("events").alias("e"), "w").groupBy("e").agg(F.sum("w").alias("w")).collect()}
        new = {e: math.log((PRIOR_ROWS * math.exp(p) + counted.get(e, 0.0)) / (PRIOR_ROWS + rows)) for e, p in PRIOR.items()}
        moved = max(abs(new[e] - costs[e]) for e in new)
        costs = new
        if moved <= SETTLED:
            return costs
    raise RuntimeError(f"the likelihoods still move by {moved} after {MOST_TURNS} turns")


def entities(spellings: DataFrame) -> DataFrame:
    """(row_id, scope, pii_type, entity): rows of one entity of a scope have equal ``entity``.

    ``spellings``: row_id, scope, pii_type, spelling; a row may have several spellings and counts by
    its most complete one. Rows with null id, scope or spelling, and spellings without letters, are in
    no entity; a repeated row is one record. Equal forms of a scope are collapsed before anything
    is compared, so an entity that holds a third of all rows is a few forms.
    """
    forms = spellings.where("row_id is not null and scope is not null and spelling is not null").select("row_id", "scope", "pii_type", "spelling")
    forms = shuffled(forms, "row_id").distinct()
    forms = cut(forms)
    given = _given_names(forms)
    normal = cut(_normalised(forms, Lexicon(given)).where("form is not null"))
    counted = normal.groupBy("scope", "pii_type", "form").agg(F.count_distinct("row_id").alias("n"))
    lexicon = Lexicon(given, mined_nicknames(counted, given))
    shared = forms.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("struct<variant:array<string>,canonical:array<string>,rank:int>")
    def described(form: pd.Series) -> pd.DataFrame:
        tuples = [tuple(f.split("\t")) for f in form]
        found = [keys(t, shared.value) for t in tuples]
        return pd.DataFrame({"variant": [v for v, _ in found], "canonical": [c for _, c in found], "rank": [rank(t, shared.value) for t in tuples]})

    ranked = cut(counted.withColumn("d", described("form")).select("scope", "pii_type", "form", "n", "d.rank", "d.variant", "d.canonical"))
    left = ranked.select("scope", "pii_type", F.col("form").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.explode("variant").alias("key"))
    right = ranked.select("scope", "pii_type", F.col("form").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), F.explode("canonical").alias("key"))
    above = F.struct("rb", "nb", F.length("b"), "b") > F.struct("ra", "na", F.length("a"), "a")
    pairs = left.join(right, ["scope", "pii_type", "key"]).where(above).select("scope", "pii_type", "a", "na", "b", "nb").distinct()
    told = cut(_explained(shuffled(pairs), lexicon))
    costs = learned_costs(told, float(counted.agg(F.sum("n")).first()[0] or 0))
    scored = _scored(told, costs).where(F.col("score") >= LEAST_LIKELY)
    # A slip that is seen as often as its supposed origin is a name of its own, be there few rows or many.
    own = F.col("slip") & (F.col("na") >= 3) & (F.col("na") >= OWN_SHARE * F.col("nb"))
    posterior = F.log("nb") + F.col("score")
    attached = scored.where(~own).withColumn("posterior", posterior).groupBy("scope", "pii_type", "a").agg(F.max_by("b", F.struct("posterior", "b")).alias("b"))
    parents = ranked.select("scope", "pii_type", F.col("form").alias("a")).join(attached, ["scope", "pii_type", "a"], "left")
    parents = cut(parents.select("scope", "pii_type", "a", F.coalesce("b", "a").alias("root")))
    while True:  # parents rank higher, so chains end; each turn doubles the reach
        up = parents.select("scope", "pii_type", F.col("a").alias("root"), F.col("root").alias("further"))
        nearer = cut(parents.join(up, ["scope", "pii_type", "root"]).select("scope", "pii_type", "a", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
        parents = nearer.drop("moved")
        if nearer.where("moved").isEmpty():
            break
    of_rows = normal.join(ranked.select("scope", "pii_type", "form", "n", "rank"), ["scope", "pii_type", "form"]).groupBy("row_id", "scope", "pii_type").agg(
        F.max_by("form", F.struct("rank", "n", "form")).alias("a")
    )
    return of_rows.join(parents, ["scope", "pii_type", "a"]).select("row_id", "scope", "pii_type", F.col("root").alias("entity"))


def same_entity_pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs of rows of one entity, the smaller id first."""
    on: list[str | Column] = ["scope", "pii_type", "entity"]
    several = found.groupBy(*on).count().where("count > 1").select(*on)
    members = found.join(several, on, "left_semi").select(*on, "row_id")
    a, b = members.withColumnRenamed("row_id", "id_a"), members.withColumnRenamed("row_id", "id_b")
    return a.join(b, on).where("id_a < id_b").select("id_a", "id_b").distinct()
