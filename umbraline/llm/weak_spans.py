"""Personal data in free text, by aggregation of weak labelers.

Broad patterns propose spans. Regex, gazetteer and context labelers vote on each; expectation
maximisation over the counted vote patterns estimates how reliable each labeler is and what each
pattern means; a softmax classifier over span and context features is trained on these posteriors
and decides every span. Overlapping spans are settled within their row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraline.plans.lineage import cut, shuffled

TYPES = ["PERSON", "EMAIL", "PHONE", "SSN", "EIN", "PASSPORT", "DRIVERS_LICENSE", "ADDRESS"]
CLASSES = [*TYPES, "NONE"]
#: Rows (with all their spans) that the final classifier is trained on at most; nothing else is sampled.
TRAINING_ROWS = 12_000
BUCKETS = 1 << 13
#: A word belongs to the gazetteer of given names if at least this share of the names has it (so it has under 2,000 words).
NAME_SHARE = 0.0015
TITLES = set("dr prof hon rev mr mrs ms herr frau".split())
NOT_NAMES = set("dr prof hon rev mr mrs ms herr frau jr sr ii iii iv van von der den de la del di da dos mac the and of llc inc".split())

# Kinds of streets and their abbreviations, and words that stand before a value.
KINDS = (
    "alley avenue ave av boulevard blvd boul circle cir circ common cmn court ct crt cres crescent crossing crossg xing "
    "drive dr drv freeway highway hwy lane ln la loop parkway pkwy pky place pl plaza plz road rd row square sq street st str "
    "terrace ter terr trail trl tr turnpike way walk"
).split()
CUES = {
    "SSN": ["ssn", "social security", "tax id"],
    "EIN": ["ein", "tin", "employer"],
    "PASSPORT": ["passport"],
    "DRIVERS_LICENSE": ["licence", "license", "dl", "driver"],
    "PHONE": ["phone", "tel", "telefon", "fax", "text", "call", "cell", "reached", "number"],
    "NONE": [
        "serial", "batch", "invoice", "tracking", "control", "reference", "order", "part", "vendor", "build", "code",
        "publication", "section", "schedule", "confirmation", "case", "ticket", "docket", "meter", "ref",
    ],
    "PERSON": [
        "dear", "contact", "holder", "per", "for", "attn", "taxpayer", "trustee", "herr", "ms", "beneficiary", "by",
        "por", "note", "ask", "of", "to", "with", "met", "call", "and", "frau", "mr", "mrs",
    ],
    "ADDRESS": ["address", "lives at", "property at", "es", "to", "from", "at", "is"],
    "EMAIL": ["email", "correo", "cc", "or", "try", "contact"],
}
_CUE = {k: regex.compile(r"\b(?:" + "|".join(v) + r")\b", regex.I) for k, v in CUES.items()}

_LOCAL = r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*"
EMAIL = regex.compile(
    _LOCAL
    + r"(?: ?@ ?[\w-]+(?:\.[\w-]+)+"
    + r"| ?(?:\[at\]|\(at\)) ?[\w-]+(?: ?(?:\[dot\]|\(dot\)|\bdot\b) ?[\w-]+|\.[\w-]+)+"
    + r"| at [\w-]+(?: ?(?:\[dot\]|\(dot\)|\bdot\b) ?[\w-]+)+)",
    regex.I,
)
DIGITS = regex.compile(r"(?<![\w$#+/.(-])(?<!\d[,:])(?:\+|\()?\d(?:[ .()-]{0,2}\d){8,14}(?![\w/%]|-\w|[.,]\d)")
CODE = regex.compile(r"(?<![\w-])[A-Z]{1,3}-?\d{6,10}(?![\w-])", regex.I)
_UNIT_WORD = r"(?:[Aa]pt|APT|[Aa]partment|[Uu]nit|[Uu]n|[Ss]uite|[Ss]te|[Bb]uilding|[Bb]ldg|[Ff]loor|[Ff]l|[Ff]lr)\b"
_PLACE = r"(?!" + _UNIT_WORD + r")\p{Lu}[\p{L}\p{M}'’-]+"
_STATE = r"[A-Z]{2}\b"
_ZIP = r"\d{5}(?:-\d{4})?\b"
_CITY = rf"(?:, {_PLACE}(?: {_PLACE}){{0,2}}(?:,? {_STATE})?(?:,? {_ZIP})?|,? {_STATE} {_ZIP}|,? {_ZIP})"
_UNIT = rf"(?:,? (?:#|{_UNIT_WORD}\.? ?#?) ?\d+-?[A-Za-z]?\b)"
_KIND = "|".join(sorted(KINDS, key=len, reverse=True))
STREET = regex.compile(
    r"(?<![\w$#.,/-])(?<!\d )\d{1,5}(?: (?:[NSEW]{1,2}|[Nn]orth|[Ss]outh|[Ee]ast|[Ww]est|[Nn]orth[ew]e?a?st|[Ss]outh[ew]e?a?st)\.?)?"
    rf"(?: {_PLACE}){{1,4}}\.?{_UNIT}?{_CITY}?{_UNIT}?"
)
ANY_CASE_STREET = regex.compile(
    r"(?<![\w$#.,/-])\d{1,5}(?: [\p{L}\p{M}'’-]+){1,4}? (?:" + _KIND + r")\b\.?" + _UNIT + r"?(?:, [\p{L}'’-]+(?: [\p{L}'’-]+){0,2}, [a-z]{2} \d{5}(?:-\d{4})?)?", regex.I
)
BOX = regex.compile(r"(?<!\w)(?:p\.? ?o\.? ?box|pob|post office box) \d+(?:(?-i:" + _CITY + "))?", regex.I)

_PARTICLE = r"(?:van der|van den|van|von|de la|de los|del|de|di|da|dos|la|le)"
_WORD = r"\p{L}[\p{L}\p{M}]*(?:['’]\p{Lu}[\p{L}\p{M}]+)?(?:-\p{L}[\p{L}\p{M}]+(?:['’]\p{Lu}[\p{L}\p{M}]+)?)*"
_LONG = r"(?:\p{L}['’])?\p{L}[\p{L}\p{M}]+(?:-(?:\p{L}['’])?\p{L}[\p{L}\p{M}]+)*"
_CAPITAL = r"(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]+(?:-(?:\p{Lu}['’])?\p{L}[\p{L}\p{M}]+)*"
_INIT = r"\p{L}\b\.?"
NAME_TOKEN = regex.compile(_WORD)


def _name_patterns(given: set[str]) -> list[tuple[str, regex.Pattern]]:
    names = "|".join(sorted(map(regex.escape, given), key=len, reverse=True)) or r"(?!)"
    g, sur = rf"(?:{names})\b", rf"(?:{_PARTICLE} )?{_LONG}"
    left, right = r"(?<![\p{L}\p{M}\w@.'’-])", r"(?![\p{L}\p{M}\w@]|\.[\p{L}\d]|-\p{L})"
    return [
        ("given", regex.compile(rf"{left}{g}(?: (?:{_INIT}|{g}))?(?: {_INIT})? {sur}{right}", regex.I)),
        ("turned", regex.compile(rf"{left}{sur}, ?{g}(?: (?:{_INIT}|{g})(?![\p{{L}}\w@]))?{right}", regex.I)),
        ("initial", regex.compile(rf"{left}\p{{Lu}}\.(?: \p{{Lu}}\.)? (?:{_PARTICLE} )?{_CAPITAL}{right}")),
        ("turned_initial", regex.compile(rf"{left}(?:{_PARTICLE} )?{_CAPITAL}, \p{{Lu}}\.(?![\p{{L}}\w])")),
        ("capitals", regex.compile(rf"{left}{_CAPITAL}(?: \p{{Lu}}\.?(?= ))?(?: {_PARTICLE})? {_CAPITAL}{right}")),
        ("turned_capitals", regex.compile(rf"{left}(?:{_PARTICLE} )?{_CAPITAL}, {_CAPITAL}(?: \p{{Lu}}\.)?{right}")),
    ]


class Proposer:
    """Spans of a text with the votes of the labelers and the features of the classifier."""

    def __init__(self, given: set[str], common: set[str]):
        self.given, self.common = given, common
        self.names = _name_patterns(given)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, shape); a span is proposed once per shape."""
        out = {(m.start(), m.end(), "email") for m in EMAIL.finditer(text)}
        for m in DIGITS.finditer(text):
            a, b = m.span()
            value = text[a:b]
            if value[0] == "(" and ")" not in value:
                a += 1
            out.add((a, b, "digits"))
        out |= {(m.start(), m.end(), "code") for m in CODE.finditer(text)}
        for pattern, shape in ((STREET, "street"), (ANY_CASE_STREET, "street"), (BOX, "box")):
            out |= {(*self._trimmed(text, *m.span()), shape) for m in pattern.finditer(text)}
        for shape, pattern in self.names:
            for m in pattern.finditer(text, overlapped=True):
                if (a := m.start()) is not None and self._looks_like_a_name(m.group(), shape):
                    out.add((a, m.end(), "name_" + shape))
        return sorted(out)

    @staticmethod
    def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
        while b > a and text[b - 1] in " .,;":
            b -= 1
        return a, b

    def _looks_like_a_name(self, value: str, shape: str) -> bool:
        """One style of writing throughout, and no word of the common vocabulary beside the name."""
        words = [w for w in NAME_TOKEN.findall(value) if len(w) > 1 and w.lower() not in NOT_NAMES]
        if not words or NAME_TOKEN.match(value).group().lower() in TITLES:
            return False
        small = [w for w in words if w[0].islower()]
        if small and len(small) < len(words):
            return False
        return not any(w.lower() in self.common and w.lower() not in self.given for w in words)

    def votes(self, text: str, a: int, b: int, shape: str) -> tuple[str, ...]:
        """A class or '' (no vote) from each labeler: two shapes, gazetteer, context before, context around."""
        value, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 24]
        digits = regex.sub(r"\D", "", value)
        kind = shape.split("_")[0]
        form, strict, gazetteer = "", "", ""
        if kind == "email":
            form = "EMAIL"
            strict = "EMAIL" if regex.search(r"@|\[|\(|\bdot\b", value) else "NONE"
        elif kind == "digits":
            groups = [len(x) for x in regex.findall(r"\d+", value)]
            seps = set(regex.findall(r"[^\d()+]", value))
            if value[0] in "+(" or digits[:2] == "00":
                form = "PHONE"
            elif groups in ([3, 3, 4], [10], [1, 3, 3, 4]):
                form = "PHONE"
            elif groups in ([3, 2, 4], [9]):
                form = "SSN"
            elif groups == [2, 7]:
                form = "EIN"
            else:
                form = "NONE"
            strict = form if len(seps) == 1 or value[0] in "+(" else ""
        elif kind == "code":
            form = ""
            strict = "PASSPORT" if regex.fullmatch(r"(?:[CKX]|PA)\d{7}", value) else "DRIVERS_LICENSE" if regex.fullmatch(r"[A-Z]\d{7,9}", value) else "NONE"
        elif kind in ("street", "box"):
            head = regex.split(r",|#", value)[0].lower()
            words = regex.findall(r"[\p{L}\p{M}]+", head)
            form = "ADDRESS"
            gazetteer = "ADDRESS" if kind == "box" or any(w in KINDS for w in words[1:]) else "NONE"
            strict = "ADDRESS" if regex.search(r"[A-Z]{2} \d{5}(?:-\d{4})?$", value) else ""
        else:
            form = "PERSON"
            first = {w.lower() for w in NAME_TOKEN.findall(value)}
            gazetteer = "PERSON" if first & self.given else ""
            strict = "PERSON" if "initial" in shape or first & self.given else ""
        near = self._nearest(before, kind)
        around = "NONE" if kind in ("digits", "code") and _CUE["NONE"].search(before) else ""
        if kind.startswith("name") and regex.match(r"\s*(?:inc|llc|ltd|corp|program|springs|falls)\b", after, regex.I):
            around = "NONE"
        return kind, form, strict, gazetteer, near, around

    def _nearest(self, before: str, kind: str) -> str:
        """The class of the cue that ends last before the span, among those the shape may have."""
        able = {
            "email": ("EMAIL",), "digits": ("SSN", "EIN", "PHONE", "NONE"), "code": ("PASSPORT", "DRIVERS_LICENSE", "NONE"),
            "street": ("ADDRESS",), "box": ("ADDRESS",),
        }.get(kind, ("PERSON",))
        best, at = "", -1
        for label in able:
            for m in _CUE[label].finditer(before):
                if m.end() > at:
                    best, at = label, m.end()
        return best

    def features(self, text: str, a: int, b: int, shape: str, votes: tuple[str, ...]) -> list[int]:
        value = text[a:b]
        before = regex.findall(r"[\p{L}\p{M}]+|[^\s\w]", text[max(0, a - 40) : a].lower())[-3:]
        after = regex.findall(r"[\p{L}\p{M}]+|[^\s\w]", text[b : b + 24].lower())[:2]
        look = regex.sub(r"a+", "a", regex.sub(r"A+", "A", regex.sub(r"\p{Ll}", "a", regex.sub(r"\p{Lu}", "A", regex.sub(r"\d", "9", value)))))
        if shape.split("_")[0] in ("name", "street", "box", "email"):
            look = look[:3]
        kind = shape.split("_")[0]
        said = [f"v{i}={v}" for i, v in enumerate(votes)] + ["p=" + "|".join(votes)]
        words = [f"b1={kind}{before[-1] if before else '^'}", f"b2={kind}{'_'.join(before[-2:])}", f"b3={kind}{'_'.join(before)}"]
        words += [f"a1={kind}{after[0] if after else '$'}", f"look={look}", f"shape={shape}", f"n={kind}{len(regex.findall(r'[0-9]', value))}"]
        return [zlib.crc32(x.encode()) % BUCKETS for x in said + words]


def given_names(names: DataFrame) -> set[str]:
    """Words that many names have; the share bounds the set, so it may be collected."""
    words = names.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{M}]{2,}"), F.lit(0)))).alias("w"))
    total = names.where("name is not null").count()
    found = words.groupBy("w").count().where(F.col("count") >= max(2, total * NAME_SHARE)).collect()
    return {r.w for r in found} - NOT_NAMES


def common_words(rows: DataFrame, names: DataFrame) -> set[str]:
    """Words in at least 0.2 % of the lines, in whatever case, that are no usual part of a name.

    This is the vocabulary of the sentences; the share bounds it to a few thousand words. A surname
    that many lines hold is found among the names and left out.
    """
    every = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}]{2,}"), F.lit(0)))).alias("w")
    total = rows.count()
    frequent = rows.select(every("text")).groupBy("w").count().where(F.col("count") >= max(3, total * 0.002)).select("w")
    named = names.select(every("name")).join(F.broadcast(frequent), "w", "left_semi").groupBy("w").count()
    of_names = {r.w for r in named.where(F.col("count") >= max(2, names.where("name is not null").count() * NAME_SHARE / 10)).collect()}
    return {r.w for r in frequent.collect()} - of_names


def reliabilities(patterns: list[tuple[tuple[str, ...], int]], rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern over CLASSES, and the class prior, by expectation maximisation.

    Each labeler has, for each shape, a table of the votes it casts given the class; it starts
    from the votes' own majority.
    """
    n = np.array([c for _, c in patterns], dtype=float)
    votes = [v for v, _ in patterns]
    post = np.full((len(votes), len(CLASSES)), 0.02)
    for i, v in enumerate(votes):
        for x, weight in zip(v[1:], (1.0, 1.2, 1.5, 1.6, 2.5)):
            if x:
                post[i, CLASSES.index(x)] += weight
    post /= post.sum(1, keepdims=True)
    if not votes:
        return post, np.ones(len(CLASSES)) / len(CLASSES)
    labels = [{x: k for k, x in enumerate(sorted({v[j] for v in votes}))} for j in range(len(votes[0]))]
    prior = np.ones(len(CLASSES)) / len(CLASSES)
    for _ in range(rounds):
        weighted = post * n[:, None]
        prior = (weighted.sum(0) + 1) / (n.sum() + len(CLASSES))
        log = np.tile(np.log(prior), (len(votes), 1))
        for j, known in enumerate(labels):
            index = np.array([known[v[j]] for v in votes])
            counts = np.full((len(CLASSES), len(known)), 0.1)
            np.add.at(counts.T, index, weighted)
            log += np.log(counts / counts.sum(1, keepdims=True))[:, index].T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - post).max() < 1e-4:
            post = new
            break
        post = 0.5 * post + 0.5 * new
    return post, prior


def train(features: list[list[int]], targets: np.ndarray, epochs: int = 60, rate: float = 0.5) -> np.ndarray:
    """Weights (BUCKETS, classes) of a softmax over hashed features, fitted to soft targets by adaptive steps."""
    weights = np.zeros((BUCKETS, len(CLASSES)), dtype="float32")
    if not features:
        return weights
    memory = np.full_like(weights, 1e-6)
    x = np.array([f for f in features], dtype="int64")
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(x)), max(1, len(x) // 2048)):
            scores = weights[x[part]].sum(1)
            p = np.exp(scores - scores.max(1, keepdims=True))
            gap = p / p.sum(1, keepdims=True) - targets[part]
            grad = np.zeros_like(weights)
            np.add.at(grad, x[part].ravel(), np.repeat(gap, x.shape[1], axis=0))
            grad = grad / len(part) + 1e-6 * weights
            memory += grad**2
            weights -= rate * grad / np.sqrt(memory)
    return weights


_SPANS = "array<struct<a:int,b:int,shape:string,votes:string,features:array<int>>>"


def _proposed(rows: DataFrame, given: set[str], common: set[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((given, common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        proposer = Proposer(*shared.value)
        for batch in batches:
            found = []
            for text in batch["text"]:
                line = []
                for a, b, shape in proposer.spans(text):
                    votes = proposer.votes(text, a, b, shape)
                    line.append({"a": a, "b": b, "shape": shape, "votes": "|".join(votes), "features": proposer.features(text, a, b, shape, votes)})
                found.append(line)
            yield batch[["tbl", "row_id", "text"]].assign(spans=found)

    return rows.mapInPandas(run, f"tbl string, row_id bigint, text string, spans {_SPANS}")


def _training(proposed: DataFrame, total: int) -> list:
    """(features, votes) of the TRAINING_ROWS rows that come first by the hash of their id, of the ``total`` with spans.

    A limit behind a sort would send that many rows from each partition to the driver. So only rows
    under a bound of the hash are sorted, of which there are hardly more in all; should there be too
    few, the bound is raised.
    """
    keys = F.xxhash64("tbl", "row_id").alias("h"), "tbl", "row_id"
    keyed = proposed.where(F.size("spans") > 0).select(*keys, "spans.features", "spans.votes")
    share = (TRAINING_ROWS + 10 * TRAINING_ROWS**0.5) / max(1, total)
    while True:
        able = keyed.where(F.col("h") < int(share * 2**64) - 2**63) if share < 1 else keyed
        sample = able.orderBy("h", "tbl", "row_id").limit(TRAINING_ROWS).select("features", "votes").collect()
        if share >= 1 or len(sample) == TRAINING_ROWS:
            return sample
        share *= 2


def _decided(proposed: DataFrame, weights: np.ndarray) -> DataFrame:
    """(tbl, row_id, text, found): the spans that are personal data; of overlapping ones the surer, then the longer."""
    shared = proposed.sparkSession.sparkContext.broadcast(weights)

    def settle(spans) -> list[dict]:
        if len(spans) == 0:
            return []
        scores = shared.value[np.array([s["features"] for s in spans])].sum(1)
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        able = [(b - a, -a, float(p[i, best[i]]), CLASSES[best[i]]) for i, (a, b) in enumerate((s["a"], s["b"]) for s in spans) if CLASSES[best[i]] != "NONE"]
        able.sort(key=lambda x: (x[3] in ("ADDRESS", "EMAIL"), x[3] in ("ADDRESS", "EMAIL") or round(x[2], 1), x[0], x[1]), reverse=True)
        taken: list[dict] = []
        for n, minus_a, _, label in able:
            a, b = -minus_a, -minus_a + n
            if all(b <= t["span_start"] or a >= t["span_end"] for t in taken):
                taken.append({"pii_type": label, "span_start": a, "span_end": b})
        return sorted(taken, key=lambda t: t["span_start"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["tbl", "row_id", "text"]].assign(found=[settle(s) for s in batch["spans"]])

    found = "array<struct<pii_type:string,span_start:int,span_end:int>>"
    return proposed.mapInPandas(run, f"tbl string, row_id bigint, text string, found {found}")


def mentions(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(tbl, row_id, text, found) for each row of ``rows`` (tbl, row_id, text).

    ``names`` (name) gives the gazetteer. Rows repeated under one id are one record (the least text
    of an id stands for it), rows with null text or id are left out, empty texts have no spans.
    """
    rows = shuffled(rows.where("row_id is not null and text is not null"), "tbl", "row_id").groupBy("tbl", "row_id").agg(F.min("text").alias("text"))
    given, common = given_names(names), common_words(rows, names)
    proposed = cut(_proposed(rows, given, common))
    patterns = proposed.select(F.posexplode("spans.votes").alias("at", "votes")).groupBy("votes")
    patterns = patterns.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") == 0).alias("rows")).orderBy("votes").collect()  # bounded by the labelers' votes
    counted = [(tuple(r.votes.split("|")), r.n) for r in patterns]
    post, _ = reliabilities(counted)
    meaning = {"|".join(v): post[i] for i, (v, _) in enumerate(counted)}
    sample = _training(proposed, sum(r.rows for r in patterns))
    targets = np.array([meaning[v] for r in sample for v in r.votes], dtype="float32")
    return _decided(proposed, train([f for r in sample for f in r.features], targets))


def redacted(found: DataFrame) -> DataFrame:
    """(tbl, row_id, text): the text with ``[TYPE]`` instead of each mention, the rest unchanged."""
    pieces = F.aggregate(
        "found",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["span_start"] - acc["at"]), F.lit("["), s["pii_type"], F.lit("]")).alias("out"),
            s["span_end"].alias("at"),
        ),
    )
    done = found.withColumn("p", pieces)
    return done.select("tbl", "row_id", F.concat("p.out", F.substring("text", F.col("p.at") + 1, F.length("text"))).alias("text"))
