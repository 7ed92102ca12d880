"""One location behind many spellings of a postal address.

Each distinct text is parsed into number, direction, street name, kind of street, unit or box, city,
state and postal code. Addresses that agree elsewhere show which kinds, cities and street names stand
for each other; the statistically significant pairs become rewrites, the texts that hold one are parsed
again, and this goes on until no new rewrite appears. The rewrites are a table that is joined to the
tokens of the texts, so neither their number nor their evidence is bounded by the driver. Within one
number and street the parts a record leaves out are then filled from the records that have them.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbraline.plans.lineage import cut, cut_plain, shuffled

# States, directions, words before a unit, kinds of streets in full.
STATES = dict(
    x.rsplit(" ", 1)
    for x in (
        "alabama al,alaska ak,arizona az,arkansas ar,california ca,colorado co,connecticut ct,delaware de,florida fl,georgia ga,"
        "hawaii hi,idaho id,illinois il,indiana in,iowa ia,kansas ks,kentucky ky,louisiana la,maine me,maryland md,massachusetts ma,"
        "michigan mi,minnesota mn,mississippi ms,missouri mo,montana mt,nebraska ne,nevada nv,new hampshire nh,new jersey nj,"
        "new mexico nm,new york ny,north carolina nc,north dakota nd,ohio oh,oklahoma ok,oregon or,pennsylvania pa,rhode island ri,"
        "south carolina sc,south dakota sd,tennessee tn,texas tx,utah ut,vermont vt,virginia va,washington wa,west virginia wv,"
        "wisconsin wi,wyoming wy,district of columbia dc"
    ).split(",")
)
CODES = set(STATES.values())
DIRECTIONS = {
    "n": "n", "no": "n", "north": "n", "s": "s", "so": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w",
    "ne": "ne", "northeast": "ne", "nw": "nw", "northwest": "nw", "se": "se", "southeast": "se", "sw": "sw", "southwest": "sw",
}
UNITS = set("unit un apt apartment suite ste building bldg bld floor flr fl room rm lot # no".split())
KINDS = set(
    "alley avenue boulevard circle common court crescent crossing drive expressway freeway highway lane loop parkway path place plaza "
    "road row square street terrace trail turnpike walk way".split()
)
#: Significance of a rewrite: likelihood ratio statistic of the pair against chance, for tokens and for whole street
#: names, of which one sighting can be enough where hardly two streets ever share a number and a place.
LEAST_G, LEAST_NAME_G = 15.0, 9.0
#: Share of the streets that have a word before their kind; so there are at most a hundred such words.
SECOND_SHARE = 0.01

Rewrites = dict[tuple[str, str], str]


def within_one_slip(a: str, b: str) -> bool:
    """Equal, or one letter replaced, left out, added or two neighbours exchanged."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def stands_for(short: str, full: str) -> bool:
    """Whether ``short`` can be an abbreviation of ``full``: same first letter, letters in order."""
    if len(short) >= len(full) or short[0] != full[0]:
        return False
    rest = iter(full)
    return all(x in rest for x in short)


@lru_cache(maxsize=100_000)
def _slipped_kind(token: str) -> str:
    if len(token) < 5:
        return ""
    near = [k for k in KINDS if len(k) > 4 and within_one_slip(token, k)]
    return near[0] if len(near) == 1 else ""


def is_word(token: str) -> bool:
    """Whether a token is a word of a name, be it an ordinal or one with digits for letters."""
    return token[0].isalpha() or sum(x.isalpha() for x in token) > 1


_SPLIT = regex.compile(r"\s*[,;|\t\n/]\s*|\s+-\s+|\s{2,}").split
_ZIP = regex.compile(r"\d{5}(?:-?\d{4})?").fullmatch
_NUMBER = regex.compile(r"\d{1,6}[a-z]?").fullmatch
_UNIT_ID = regex.compile(r"\d{1,4}-?[a-z]?|[a-z]-?\d{1,4}|[a-z](?!\w)").fullmatch
_LEADING_UNIT = regex.compile(r"(\d+[a-z]?)\s*/\s*(?=\d+\s+\p{L})").match
_DOTTED = regex.compile(r"(?<=\b\p{L})\.(?=\p{L}\b)").sub
_RUN_ON = regex.compile(r"\p{L}\.\p{L}{2}").search


class Parser:
    """Parts of an address text under a set of rewrites; ``second``: words that often stand before the kind."""

    def __init__(self, rewrites: Rewrites, second: set[str]):
        self.rewrites, self.second = rewrites, second

    def kind(self, token: str) -> str:
        """The kind of street in full: the word itself, a mined rewrite, or a longer kind that is one slip away."""
        return token if token in KINDS else self.rewrites.get(("kind", token)) or _slipped_kind(token)

    def parse(self, text: str) -> dict | None:
        """The parts, or None if there is neither a house number nor a box."""
        t = unicodedata.normalize("NFKC", text).lower()
        t = _DOTTED("", t).replace(".", " " if _RUN_ON(t) else "")
        t = t.strip()
        unit = ""
        if m := _LEADING_UNIT(t):
            unit, t = m.group(1), t[m.end() :]
        parts = [x for x in _SPLIT(" # ".join(x.strip() for x in t.split("#")).strip()) if x]
        toks = [(w.strip("'\"()"), k) for k, x in enumerate(parts) for w in x.split() if w.strip("'\"()-")]
        held = sorted({w for w, _ in toks})
        toks, box = self._box(toks)
        toks, found = self._unit(toks)
        unit = unit or found
        zips = [i for i, (w, _) in enumerate(toks) if _ZIP(w)]
        number = None if box else self._number(toks)
        if not box and number is None:
            return None
        rest, name, kind, direction, tentative = toks, [], "", "", False
        if number is not None:
            seg, at = toks[number][1], number + 1
            end = at
            while end < len(toks) and toks[end][1] == seg and is_word(toks[end][0]):
                end += 1
            words = [w for w, _ in toks[at:end]]
            separated = end == len(toks) or toks[end][1] != seg or end - at <= 1
            name, kind, direction, left, tentative = self._street(words, separated)
            rest = toks[:number] + [(w, seg + 0.5) for w in left] + toks[end:]
            zips = [i for i, (w, _) in enumerate(rest) if _ZIP(w)]
        code = rest[zips[0]][0][:5] if zips else ""
        state, city = self._place(rest, set(zips))
        if number is not None and not direction and city and city[-1] in DIRECTIONS and len(city) > 1:
            direction, city = DIRECTIONS[city[-1]], city[:-1]
        return {
            "num": f"box {box}" if box else toks[number][0].lstrip("0") or "0", "dir": direction, "name": " ".join(name), "kind": kind,
            "tentative": tentative, "unit": unit.replace("-", ""), "city": " ".join(city), "state": state, "zip": code, "words": held,
        }

    @staticmethod
    def _box(toks: list) -> tuple[list, str]:
        for i, (w, _) in enumerate(toks):
            if w in ("box", "pob", "pobox") and i + 1 < len(toks) and regex.fullmatch(r"\d+[a-z]?", toks[i + 1][0]):
                a = i
                while a and toks[a - 1][0] in ("po", "p", "o", "post", "office"):
                    a -= 1
                return toks[:a] + toks[i + 2 :], toks[i + 1][0]
        return toks, ""

    @staticmethod
    def _unit(toks: list) -> tuple[list, str]:
        for i, (w, _) in enumerate(toks):
            if w in UNITS:
                j = i + 1
                while j < len(toks) and toks[j][0] in UNITS:
                    j += 1
                if j < len(toks) and _UNIT_ID(toks[j][0]):
                    if len(toks[j][0]) == 1 and not toks[j][0].isdigit() and w in ("no", "fl"):
                        continue
                    return toks[:i] + toks[j + 1 :], toks[j][0]
        return toks, ""

    def _number(self, toks: list) -> int | None:
        able = []
        for i, (w, seg) in enumerate(toks):
            if _NUMBER(w) and i + 1 < len(toks) and toks[i + 1][1] == seg and is_word(toks[i + 1][0]):
                follow = []
                for x, k in toks[i + 1 :]:
                    if k != seg or not is_word(x):
                        break
                    follow.append(x)
                if len(follow) == 1 and follow[0] in CODES:
                    continue
                able.append((any(self.kind(x) for x in follow[1:]), len(w) < 5, i))
        return max(able)[2] if able else None

    def _street(self, words: list[str], separated: bool) -> tuple[list[str], str, str, list[str], bool]:
        direction = ""
        if len(words) > 1 and words[0] in DIRECTIONS and not self.kind(words[1]):
            direction, words = DIRECTIONS[words[0]], words[1:]
        at = next((j for j in range(1, len(words)) if self.kind(words[j])), None)
        if at is not None:
            left = words[at + 1 :]
            if left and not direction and left[0] in DIRECTIONS:
                direction, left = DIRECTIONS[left[0]], left[1:]
            return words[:at], self.kind(words[at]), direction, left, False
        if separated and len(words) > 1 and words[-1] in DIRECTIONS and not direction:
            direction, words = DIRECTIONS[words[-1]], words[:-1]
        second = next((j for j in range(1, len(words)) if words[j] in self.second), None)
        if second is not None:
            last = words[second + 1 :]
            if separated and len(last) == 1 and last[0] not in CODES:
                return words[: second + 1], last[0], direction, [], True
            return words[: second + 1], "", direction, last, False
        if separated and len(words) == 2:
            return words[:1], words[1], direction, [], True
        return (words, "", direction, [], False) if separated else (words[:1], "", direction, words[1:], False)

    def _place(self, rest: list, zips: set[int]) -> tuple[str, list[str]]:
        words = [(w, k) for i, (w, k) in enumerate(rest) if i not in zips and is_word(w)]
        state, plain = "", [w for w, _ in words]
        for i in range(len(plain) - 1, -1, -1):
            two = " ".join(plain[i : i + 2])
            if two in STATES:
                state, words = STATES[two], words[:i] + words[i + 2 :]
                break
        if not state:
            for i in range(len(plain) - 1, -1, -1):
                last = i + 1 == len(words) or words[i + 1][1] != words[i][1]
                if plain[i] in STATES and (i or len(plain) == 1):
                    state, words = STATES[plain[i]], words[:i] + words[i + 1 :]
                    break
                if plain[i] in CODES and last:
                    state, words = plain[i], words[:i] + words[i + 1 :]
                    break
        return state, [self.rewrites.get(("city", w), w) for w, _ in words]


_FIELDS = "num string, dir string, name string, kind string, tentative boolean, unit string, city string, state string, zip string, words array<string>"
PARTS = ["num", "dir", "name", "kind", "tentative", "unit", "city", "state", "zip", "words"]
_REWRITES = "array<struct<role:string,a:string,b:string>>"


def _parsed(texts: DataFrame) -> DataFrame:
    """``texts`` (rid, text, n, told) with the parts of each; ``told`` are the rewrites of the text's own tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = dict.fromkeys(PARTS, "") | {"tentative": False, "num": None, "words": []}
        for batch in batches:
            rows = []
            for text, told in zip(batch["text"], batch["told"]):
                told = [] if told is None else list(told)
                parser = Parser({(t["role"], t["a"]): t["b"] for t in told}, {t["a"] for t in told if t["role"] == "second"})
                rows.append(parser.parse(text) or none)
            yield pd.concat([batch[["rid", "text", "n"]].reset_index(drop=True), pd.DataFrame(rows, columns=PARTS)], axis=1)

    return texts.mapInPandas(run, f"rid bigint, text string, n bigint, {_FIELDS}")


def _variant(a: Column, b: Column) -> Column:
    """Whether ``a`` can be an abbreviation of ``b``: same first letter, letters in order."""
    in_order = F.concat(F.lit("^"), F.regexp_replace(a, "(.)", r"\\Q$1\\E.*"))
    return (F.length(a) < F.length(b)) & F.regexp_like(b, in_order)


def _settled_kinds(parsed: DataFrame) -> DataFrame:
    """A tentative kind that no rewrite explains was the city, or else part of the name."""
    lost, placeless = F.col("tentative"), F.col("city") == ""
    return parsed.withColumns({
        "name": F.when(lost & ~placeless, F.concat_ws(" ", "name", "kind")).otherwise(F.col("name")),
        "city": F.when(lost & placeless, F.col("kind")).otherwise(F.col("city")),
        "kind": F.when(lost, "").otherwise(F.col("kind")),
    })


def _second_words(parsed: DataFrame, total: int) -> DataFrame:
    """(role, a, b): words right before the kind in at least SECOND_SHARE of the ``total`` streets."""
    last = parsed.where("kind <> '' and not tentative and name like '% %'").select(F.element_at(F.split("name", " "), -1).alias("a"))
    counted = last.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= max(2.0, total * SECOND_SHARE)).select(F.lit("second").alias("role"), "a", F.col("a").alias("b"))


def _evidence(parsed: DataFrame) -> DataFrame:
    """(role, a, b, n): tokens that fill the same place in addresses that agree elsewhere, and how often.

    Each distinct address is compared with the usual filling of its place only, never with all others.
    """
    known = parsed.where("num is not null and (zip <> '' or city <> '')")
    where = F.when(F.col("zip") != "", F.col("zip")).otherwise(F.col("city"))
    areas = shuffled(known.where("kind <> ''").select("num", "name", where.alias("area"), "kind", "tentative", "n"), "num", "name", "area")
    fills = areas.groupBy("num", "name", "area", "kind").agg(F.max("tentative").alias("t"), F.sum("n").alias("n"))
    place = Window.partitionBy("num", "name", "area")
    top = F.max(F.when(~F.col("t"), F.struct("n", "kind"))).over(place)
    kinds = fills.withColumn("b", top["kind"]).where("t and b is not null and kind <> b").select(F.lit("kind").alias("role"), F.col("kind").alias("a"), "b")
    coded = shuffled(known.where("zip <> '' and city <> ''").select("num", "name", "zip", "city", "n"), "num", "name", "zip")
    cities = coded.groupBy("num", "name", "zip", "city").agg(F.sum("n").alias("n"))
    usual = F.max(F.struct("n", "city")).over(Window.partitionBy("num", "name", "zip"))["city"]
    pairs = cities.withColumn("usual", usual).where("city <> usual").select(F.split("city", " ").alias("x"), F.split("usual", " ").alias("y"))
    diff = F.filter(F.arrays_zip("x", "y"), lambda p: p["x"] != p["y"])
    tokens = pairs.where(F.size("x") == F.size("y")).withColumn("d", diff).where(F.size("d") == 1)
    tokens = tokens.select(F.lit("city").alias("role"), F.get("d", F.lit(0))["x"].alias("a"), F.get("d", F.lit(0))["y"].alias("b"))
    return kinds.unionByName(tokens).groupBy("role", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def _g(n: Column, chance: Column) -> Column:
    return 2 * n * F.log(n / F.greatest(chance, F.lit(1e-12)))


def token_rewrites(parsed: DataFrame, total: int) -> DataFrame:
    """(role, a, b): one rewrite for each token, to where it stands most often, if the pair beats chance and looks like a variant."""
    placed = parsed.where("num is not null")
    item = lambda role, w: F.struct(F.lit(role).alias("role"), w.alias("w"))
    tokens = placed.select(F.explode(F.concat(F.array(item("kind", F.col("kind"))), F.transform(F.split("city", " "), lambda w: item("city", w)))).alias("t"))
    seen = tokens.where("t.w <> ''").groupBy("t.role", "t.w").agg(F.count(F.lit(1)).alias("seen"))
    evidence = cut_plain(_evidence(parsed).where("n >= 2")).withColumn("stands", F.sum("n").over(Window.partitionBy("role", "a")))
    pairs = evidence.join(seen.withColumnsRenamed({"w": "a", "seen": "seen_a"}), ["role", "a"]).join(seen.withColumnsRenamed({"w": "b", "seen": "seen_b"}), ["role", "b"])
    chance = F.greatest("seen_a", "n") * F.greatest("seen_b", "n") / F.lit(float(max(1, total)))
    # The stated abbreviations are of any frequency, a misspelling is rare beside its word.
    variant = _variant(F.col("a"), F.col("b")) | (_one_slip(F.col("a"), F.col("b")) & (F.col("seen_a") * 5 <= F.col("seen_b")))
    # A kind may be written in ways that share no letters, if it hardly ever stands for anything else.
    variant = variant | ((F.col("role") == "kind") & (F.col("n") >= 4) & (F.col("n") >= 0.8 * F.col("stands")))
    good = pairs.where(variant & ~F.col("a").isin(sorted(KINDS)) & (_g(F.col("n"), chance) >= LEAST_G))
    best = good.groupBy("role", "a").agg(F.max(F.struct("n", "b")).alias("x")).select("role", "a", "x.b")
    # Of two that stand for each other the one that comes later in the alphabet gives way.
    either = best.groupBy("role", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.max("a").alias("a"))
    return either.select("role", "a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


def _deletions(word: Column) -> Column:
    """The word itself and the word without each of its letters: words one slip apart share one of them."""
    return F.array_distinct(
        F.concat(
            F.array(word),
            F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))),
        )
    )


def _one_slip(a: Column, b: Column) -> Column:
    same_letters = F.array_join(F.array_sort(F.split(a, "")), "") == F.array_join(F.array_sort(F.split(b, "")), "")
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & same_letters)


def name_rewrites(parsed: DataFrame) -> DataFrame:
    """(a, b): street names that are one slip from another at the same number and place, more often than by chance.

    By chance two names meet as often as different streets share a number and a place at all, times
    how frequent both are. A name is rewritten to a more frequent one (the first of the alphabet on
    a tie) if it stands beside it in at least half of its places. Records without a place meet all
    names of their number, where chance is greater, and take the only one that fits.
    """
    squeezed = F.regexp_replace("name", " ", "")
    base = parsed.where("num is not null and name <> ''").select("num", "name", squeezed.alias("s"), "zip", "city", "n")
    seen = base.groupBy("name").agg(F.count_distinct("num").alias("places"), F.sum("n").alias("n"))
    # Every name stands in its areas and, wherever it is, among all names of its number (bare); lone: some record has no area.
    lone = F.greatest("zip", "city") == ""
    spots = F.array(*(F.struct(F.lit(bare).alias("bare"), area.alias("area")) for bare, area in ((False, F.col("zip")), (False, F.col("city")), (True, F.lit("")))))
    spots = F.explode(F.filter(spots, lambda x: x["bare"] | (x["area"] != ""))).alias("x")
    placed = base.select("num", "name", "s", lone.alias("lone"), spots).groupBy("num", "name", "s", "x.bare", "x.area")
    placed = cut_plain(placed.agg(F.max("lone").alias("lone")))
    blocks = placed.groupBy("bare", "num", "area").agg(F.count(F.lit(1)).alias("k"))
    sums = blocks.groupBy("bare").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("meets"), F.sum("k").alias("k")).collect()
    meets = {r.bare: r.meets for r in sums}
    near_meets, far_meets, total = meets.get(False, 0.0), meets.get(True, 0.0), float(sum(r.k for r in sums if r.bare) or 1.0)

    b = placed.where(F.length("s") >= 4).select("num", "bare", "area", "lone", F.col("name").alias("b"), F.col("s").alias("sb"), F.explode(_deletions(F.col("s"))).alias("v"))
    asked = b.where("not bare or lone").drop("lone").withColumnsRenamed({"b": "a", "sb": "sa"})
    b = b.drop("lone")
    slip = _one_slip(F.col("sa"), F.col("sb")) & (F.col("a") != F.col("b"))
    met = asked.join(b, ["num", "bare", "area", "v"]).where(slip)
    # The names one slip from another are bounded by its letters.
    mates = met.groupBy("bare", "num", "a").agg(F.collect_set("b").alias("bs")).where("not bare or size(bs) = 1").withColumn("b", F.explode("bs"))
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    mates = mates.withColumn("x", F.explode(F.when(F.col("bare"), F.array(there, back)).otherwise(F.array(there))))  # either may be the slip
    counted = cut_plain(mates.groupBy("bare", "x.a", "x.b").agg(F.count_distinct("num").alias("k")))
    pairs = counted.join(seen.select(F.col("name").alias("b"), F.col("places").alias("pb"), F.col("n").alias("nb")), "b")
    pairs = pairs.join(seen.select(F.col("name").alias("a"), F.col("places").alias("pa"), F.col("n").alias("na")), "a")
    chance = F.when(F.col("bare"), far_meets).otherwise(near_meets) * 2 * F.col("pa") * F.col("pb") / total / total
    good = pairs.where((F.col("k") * 2 >= F.col("pa")) & ((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))))
    good = good.where(_g(F.col("k"), chance) >= LEAST_NAME_G)
    return good.groupBy("a").agg(F.max(F.struct("k", "nb", "b")).alias("x")).select("a", "x.b")


def _extended(known: DataFrame | None, new: DataFrame) -> DataFrame:
    """``known`` and ``new`` (role, a, b), each led on where its result is itself rewritten."""
    both = new if known is None else known.unionByName(new)
    on = both.select("role", F.col("a").alias("b"), F.col("b").alias("further"))
    return cut_plain(both.join(on, ["role", "b"], "left").select("role", "a", F.coalesce("further", "b").alias("b")))


#: The columns that mining reads.
_READ = ["num", "name", "kind", "tentative", "city", "zip", "n"]


def _respelt(parsed: DataFrame, known: DataFrame | None, named: bool) -> DataFrame:
    """``parsed`` with street names rewritten; ``named``: whether ``known`` holds any."""
    if not named:
        return parsed
    led = known.where("role = 'name'").select(F.col("a").alias("name"), F.col("b").alias("__right"))
    return parsed.join(led, "name", "left").withColumn("name", F.coalesce("__right", "name")).drop("__right")


def _spelt(parsed: DataFrame, known: DataFrame | None, named: bool) -> DataFrame:
    """As ``_respelt``, cut if there is anything to rewrite, since a turn reads it several times."""
    return cut_plain(_respelt(parsed, known, named)) if named else parsed


def mine(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``texts`` (rid, text, n) parsed and spelt with all rewrites, and the rewrites (role, a, b), mined until no new one appears.

    Every token and every name is rewritten once at most, so this ends.
    """
    known, named, settled = None, False, False
    parsed = cut_plain(_parsed(texts.withColumn("told", F.lit(None).cast(_REWRITES))))
    total = parsed.where("num is not null").count()
    while True:
        read = _spelt(parsed.select(*_READ), known, named)
        new = token_rewrites(read, total).unionByName(_second_words(parsed, total))
        new = cut_plain(new if known is None else new.join(known, ["role", "a"], "left_anti"))
        if not new.isEmpty():
            known, settled = _extended(known, new), False
            fresh = new.select("a").distinct().withColumn("fresh", F.lit(True))
            tokens = parsed.where("num is not null").select("rid", F.explode("words").alias("a"))
            told = tokens.join(known.where("role <> 'name'").join(fresh, "a", "left"), "a")
            told = told.groupBy("rid").agg(F.collect_set(F.struct("role", "a", "b")).alias("told"), F.max("fresh").alias("fresh"))
            told = cut_plain(told.where("fresh").drop("fresh"))
            again = _parsed(shuffled(parsed.select("rid", "text", "n").join(told, "rid")))
            parsed = cut_plain(parsed.join(told, "rid", "left_anti").unionByName(again))
            continue
        # Names are mined until none is new, then tokens are looked at once more.
        turns = 0
        while not settled:
            spelt = _spelt(_settled_kinds(parsed.select(*_READ)), known, named)
            found = name_rewrites(spelt).select(F.lit("name").alias("role"), "a", "b")
            if named:
                found = found.join(known.where("role = 'name'").select("a"), "a", "left_anti").select("role", "a", "b")
            found = cut_plain(found)
            if found.isEmpty():
                break
            known, named, turns = _extended(known, found), True, turns + 1
        if not turns:
            known = texts.sparkSession.createDataFrame([], "role string, a string, b string") if known is None else known
            return cut_plain(_respelt(_settled_kinds(parsed), known, named)), known
        settled = True


def _only(t: list, p: int, others: list[list]) -> object | None:
    """The value of part ``p`` in the rows that fit ``t`` elsewhere, if there is only one."""
    found = None
    for u in others:
        if u[p] in ("", None) or u[p] == found:
            continue
        if all(q == p or u[q] == t[q] or u[q] in ("", None) or t[q] in ("", None) for q in range(4)):
            if found is not None:
                return None
            found = u[p]
    return found


def resolve(rows: list[dict]) -> list[int]:
    """The location of each row (dir, kind, unit, city, state, zip, n) of one number and street.

    A part that is missing is filled if the rows that fit elsewhere have only one value for it, until
    nothing is filled any more. Rows of a place are compared with those of that place and of none.
    """
    areas = _areas(rows)
    filled = [(areas[i], r["kind"], r["dir"], r["unit"]) for i, r in enumerate(rows)]
    distinct = list(dict.fromkeys(filled))
    while True:
        known = [list(t) for t in distinct]
        by_area: dict = {}
        for t in known:
            by_area.setdefault(t[0], []).append(t)
        nowhere, changed = by_area.get(None, []), {}
        for t, old in zip(known, distinct):
            for p in range(4):
                if t[p] in ("", None):
                    others = known if t[0] is None else by_area[t[0]] + (nowhere if by_area[t[0]] is not nowhere else [])
                    value = _only(t, p, others)
                    t[p] = t[p] if value is None else value
            changed[old] = tuple(t)
        filled = [changed[t] for t in filled]
        if all(k == v for k, v in changed.items()):
            break
        distinct = list(dict.fromkeys(changed.values()))
    numbers: dict[tuple, int] = {}
    return [numbers.setdefault(t, len(numbers)) for t in filled]


def _short(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def _areas(rows: list[dict]) -> list[int | None]:
    """The city of each row as a number: equal, one slip apart or the end of the other; rows without a city go by postal code.

    Cities and codes meet in an index of their deletion variants and endings, so the time is linear in the rows.
    """
    weight: Counter = Counter()
    zips: dict[str, set[str]] = {}
    for r in rows:
        if r["city"]:
            weight[r["city"]] += r["n"]
            zips.setdefault(r["city"], set())
            if r["zip"]:
                zips[r["city"]].add(r["zip"])
    area: dict[str, int] = {}
    place: dict[str, int] = {}
    index: dict[tuple[str, str], list[str]] = {}
    areas = 0
    for city in sorted(weight, key=lambda c: (-weight[c], c)):
        plain, words = city.replace(" ", ""), city.split()
        ends = [" ".join(words[i:]) for i in range(len(words))]
        met = {o for v in _short(plain) for o in index.get(("slip", v), ()) if within_one_slip(plain, o.replace(" ", ""))}
        met.update(index.get(("ends", city), ()))
        met.update(o for e in ends for o in index.get(("is", e), ()))
        near = {z for x in zips[city] for z in _short(x)}
        fits = [o for o in met if not zips[city] or not zips[o] or any(within_one_slip(x, y) for y in zips[o] if _short(y) & near for x in zips[city])]
        if fits:
            area[city] = area[min(fits, key=place.get)]
        else:
            area[city] = areas
            areas += 1
        place[city] = len(place)
        for key in [("slip", v) for v in _short(plain)] + [("ends", e) for e in ends] + [("is", city)]:
            index.setdefault(key, []).append(city)
    by_zip: dict[str, set[int]] = {}
    by_short: dict[str, set[str]] = {}
    for r in rows:
        if r["city"] and r["zip"]:
            by_zip.setdefault(r["zip"], set()).add(area[r["city"]])
    for z in by_zip:
        for v in _short(z):
            by_short.setdefault(v, set()).add(z)
    out: list[int | None] = []
    lone: dict[str, int] = {}
    for r in rows:
        if r["city"]:
            out.append(area[r["city"]])
        elif r["zip"]:
            ks = by_zip.get(r["zip"]) or {k for v in _short(r["zip"]) for z in by_short.get(v, ()) if within_one_slip(z, r["zip"]) for k in by_zip[z]}
            if len(ks) == 1:
                out.append(next(iter(ks)))
            else:
                out.append(lone.setdefault(r["zip"], areas + len(lone)))
        else:
            out.append(None)
    return out


def locations(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_col, location) of every row with an address: rows of one location have equal values.

    Texts without a house number or box are one location only with texts of the same letters and
    digits. Rows with null id or text, or texts without any letter or digit, are left out; rows repeated
    under one id are one record (its least text counts). Copies of one text are parsed and resolved
    once, so a location that holds a third of all rows is one small group.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = rows.groupBy("id").agg(F.min("text").alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    # Numbered and cut: the numbers must not change when a task runs again.
    texts = cut(shuffled(rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))).withColumn("rid", F.monotonically_increasing_id()))
    parsed, _ = mine(texts)
    shape = ["dir", "kind", "unit", "city", "state", "zip"]
    named = parsed.where("num is not null").withColumnRenamed("name", "street")
    tuples = named.groupBy("num", "street", *shape).agg(F.sum("n").alias("n"))
    resolved = _resolved(tuples, shape)
    located = named.join(resolved, ["num", "street", *shape]).select("text", F.concat_ws("|", "num", "street", F.col("location").cast("string")).alias("location"))
    other = parsed.where("num is null").select("text", F.concat(F.lit("="), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")).alias("location"))
    return rows.join(located.unionByName(other), "text").select(F.col("id").alias(id_col), "location")


def _resolved(tuples: DataFrame, shape: list[str]) -> DataFrame:
    """``tuples`` with their location within a number and street.

    A group is one number and street: its distinct part tuples, not its rows. The partitions are
    sorted, so a task goes from group to group without a frame for each.
    """
    fields = ["num", "street", *shape, "n"]
    out = ["num", "street", *shape, "location"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, done = None, [], []

        def settle() -> None:
            rows = [dict(zip(fields, r)) for r in group]
            done.extend((*r[:-1], k) for r, k in zip(group, resolve(rows)))

        for batch in batches:
            for row in batch[fields].itertuples(index=False, name=None):
                if row[:2] != key:
                    if group:
                        settle()
                    key, group = row[:2], []
                group.append(row)
            if done:
                yield pd.DataFrame(done, columns=out)
                done = []
        if group:
            settle()
        if done:
            yield pd.DataFrame(done, columns=out)

    placed = shuffled(tuples, "num", "street").sortWithinPartitions("num", "street", *shape)
    return placed.mapInPandas(run, f"num string, street string, {', '.join(f'{c} string' for c in shape)}, location int")


def same_location_pairs(located: DataFrame, id_col: str = "id") -> DataFrame:
    """(id_a, id_b): all pairs of one location, the smaller id first."""
    several = located.groupBy("location").count().where("count > 1").select("location")
    members = located.join(several, "location", "left_semi")
    a = members.select("location", F.col(id_col).alias("id_a"))
    return a.join(members.select("location", F.col(id_col).alias("id_b")), "location").where("id_a < id_b").select("id_a", "id_b")
