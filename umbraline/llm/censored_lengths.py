"""Texts that were cut short, and how often each source cuts.

Per source, one length distribution is fitted by maximum likelihood, right-censored at all limits of
the source at once. A length becomes a limit if far more texts end there than the fitted density
explains and most texts that come so far stop there; what a text at a limit is held to be cut by is
the spike's share beside that density. The ending gives the other evidence: how texts of a kind really
end, against how they end when every text is cut at random places. Marks behind the cut are learned
from the texts that bear them.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbraline.plans.lineage import cut, cut_plain, shuffled

#: Random cuts of each text; all texts are cut.
TRIALS = 12
#: A word is known if at least this share of the texts has it (three at least).
WORD_SHARE = 0.0003
#: Evidence that a rarer context borrows from the shorter one.
BORROWED = 1.0
START_RATE = 0.08
#: The posterior is settled when no text's moves by more than SETTLED in a turn. Turns only bring it nearer, by about
#: a third of what is left each; what needs more than MOST_TURNS is an error, not a result.
SETTLED, MOST_TURNS = 0.001, 200
#: How surely a text is held to be cut before anything is known, with an open ending and with a closed one.
#: The high start leaves endings that only cuts account for where they are; real endings come down at once.
OPEN, CLOSED = 0.9, 0.02
#: A limit holds at least so many texts, so many times what the fitted density explains, and this share of all
#: texts that come so far; all texts of its source being of the density, so full a length is rarer than RARE.
LIMIT_TEXTS, LIMIT_TIMES, LIMIT_SHARE, RARE = 3, 5.0, 0.5, 1e-3

# Read from the end, so that the last tokens are found without the rest of the text.
_TOKEN = regex.compile(r"(?rV1)\p{Han}|[[\p{L}\p{M}]--\p{Han}]+|\p{N}+|\n|[^\s\p{L}\p{N}]")
_CLOSED = regex.compile(r"(?<![$\d])[\p{L}\p{M}\d%)\"»”']*[.!?。？！][\"”»')]*$|\(\d{4}\)$")


def mark_of(text: str) -> tuple[str, str]:
    """The text without what stands behind its end, and the name of that mark."""
    body = text
    while True:
        rest = body.rstrip()
        rest = rest[:-1] if rest.endswith(("…", "�")) else rest[:-3] if rest.endswith("...") else rest
        if len(rest) == len(body):
            break
        body = rest
    tail = text[len(body) :]
    if not tail:
        return text, ""
    name = "replacement" if "�" in tail else "ellipsis" if "…" in tail or "..." in tail else "newline" if regex.fullmatch(r"\r?\n", tail) else "space"
    return body, name


def is_closed(body: str) -> bool:
    """Whether the last run without blanks ends a sentence; an amount with a point behind it does not."""
    last = body.rsplit(None, 1)[-1:]
    return bool(last) and bool(_CLOSED.search(" " + last[0]))


def begins(token: str, words: list[str]) -> bool:
    """Whether ``token`` is the beginning of one of the sorted ``words``, and not the word itself."""
    at = bisect_right(words, token)
    return at < len(words) and words[at].startswith(token)


def context(text: str, end: int, known: set[str], words: list[str]) -> str:
    """The last three tokens of ``text[:end]``: numbers by length, unknown words by case; ``^`` where there are fewer.

    An unknown last word that begins a known one is marked as such.
    """
    tokens = [m.group() for m in islice(_TOKEN.finditer(text, 0, end), 3)]
    shapes = []
    for t in tokens:
        if t[0].isdigit():
            shapes.append(f"9x{min(len(t), 6)}")
        elif t[0].isalpha():
            low = t.lower()
            shapes.append(low if low in known else "Aa" if t[0].isupper() else "aa")
        else:
            shapes.append(t)
    if tokens and shapes[0] in ("Aa", "aa") and begins(tokens[0].lower(), words):
        shapes[0] += "<"
    return " ".join(["^"] * (3 - len(shapes)) + shapes[::-1])


def _upper_tail(z: np.ndarray) -> np.ndarray:
    return np.maximum(1e-300, 0.5 * np.vectorize(math.erfc, otypes=[float])(z / math.sqrt(2)))


class CensoredFit:
    """Log-normal lengths of one source, right-censored at ``at`` (ascending), by maximum likelihood.

    A text comes under the limit ``at[j]`` with probability ``share[j]``, or under none (the last share); it is seen
    at its own length, or at its limit if it is longer. Both the density and the shares come from expectation
    maximisation over the histogram.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, at: np.ndarray, rounds: int = 500):
        self.lengths, self.at, n = lengths, at, counts.astype(float)
        x = np.log(lengths)
        k, total = len(at), n.sum()
        place = np.searchsorted(lengths, at)
        self.share = np.full(k + 1, 1.0 / (k + 1))
        # ahead[j, i]: whether a whole text of length i may come under limit j.
        ahead = np.vstack([lengths[None, :] <= at[:, None], np.ones((1, len(lengths)), bool)]) if k else np.ones((1, len(lengths)), bool)
        self.mu = float(np.average(x, weights=n))
        self.sd = max(0.05, math.sqrt(float(np.average((x - self.mu) ** 2, weights=n))))
        for _ in range(rounds):
            cut_mass = self.spike() if k else np.zeros(0)
            whole_mass = self.density(at) * self.reach(at) if k else np.zeros(0)
            held = n[place] * cut_mass / np.maximum(cut_mass + whole_mass, 1e-300)
            whole = n.copy()
            whole[place] -= held
            z = (np.log(at) - self.mu) / self.sd if k else np.zeros(0)
            hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / _upper_tail(z) if k else np.zeros(0)
            first = self.mu + self.sd * hazard
            second = self.sd**2 * (1 + z * hazard) + self.mu**2 + 2 * self.sd * self.mu * hazard
            m1 = ((whole * x).sum() + (held * first).sum()) / total
            m2 = ((whole * x * x).sum() + (held * second).sum()) / total
            weight = self.share[:, None] * ahead
            of_limit = (weight / np.maximum(weight.sum(0), 1e-300) * whole).sum(1)
            of_limit[:k] += held
            settled = abs(m1 - self.mu) < 1e-6 and np.abs(of_limit / total - self.share).max() < 1e-6
            self.mu, self.sd, self.share = float(m1), math.sqrt(max(0.0025, m2 - m1 * m1)), of_limit / total
            if settled:
                break

    def density(self, lengths: np.ndarray) -> np.ndarray:
        """The probability of each length as such."""
        z = (np.log(lengths) - self.mu) / self.sd
        return np.exp(-z * z / 2) / (lengths * self.sd * math.sqrt(2 * math.pi))

    def reach(self, lengths: np.ndarray) -> np.ndarray:
        """The share of texts that are seen whole at each length, if they have it."""
        return self.share[-1] + (self.share[:-1, None] * (self.at[:, None] >= lengths[None, :])).sum(0)

    def spike(self) -> np.ndarray:
        """The probability of being cut at each limit."""
        return self.share[:-1] * _upper_tail((np.log(self.at) - self.mu) / self.sd)

    def censored(self) -> np.ndarray:
        """For a text at each limit, the posterior of being cut there."""
        cut_mass, whole = self.spike(), self.density(self.at) * self.reach(self.at)
        return cut_mass / np.maximum(cut_mass + whole, 1e-300)


def limits(sizes: pd.DataFrame) -> list[dict]:
    """The limits of one source and measure, from its lengths and their counts.

    The length that stands out most from the fit becomes a limit and the fit is repeated with it, until none stands out.
    """
    sizes = sizes[sizes["length"] > 0].sort_values("length")
    lengths, counts = sizes["length"].to_numpy(float), sizes["n"].to_numpy(float)
    if not len(lengths):
        return []
    total, at = counts.sum(), np.zeros(0)
    stays = counts / np.cumsum(counts[::-1])[::-1]
    able = (counts >= LIMIT_TEXTS) & (stays >= LIMIT_SHARE)
    while True:
        fit = CensoredFit(lengths, counts, at)
        expected = np.maximum(total * fit.density(lengths) * fit.reach(lengths), 1e-12)
        # The bound of Chernoff on so many texts at one length, for all lengths of the histogram.
        log_tail = counts - expected - counts * np.log(counts / expected)
        out = able & (counts >= LIMIT_TIMES * expected) & (log_tail < math.log(RARE / len(lengths))) & ~np.isin(lengths, at)
        if not out.any():
            break
        at = np.sort(np.append(at, lengths[out][np.argmin(log_tail[out])]))
    seen = counts[np.searchsorted(lengths, at)]
    explained = total * fit.density(at) * fit.reach(at)
    return [
        {"length": int(a), "seen": int(n), "expected": float(e), "censored": float(min(0.995, c)), "mu": fit.mu, "sd": fit.sd}
        for a, n, e, c in zip(at, seen, explained, fit.censored())
    ]


def field_limits(texts: DataFrame) -> DataFrame:
    """(source, measure, length, seen, expected, censored, mu, sd) of the limits of every source.

    ``texts``: source, text. Lengths are measured in characters and in bytes of UTF-8; one task
    handles the histogram of one source and measure, whose size is bounded by its distinct lengths.
    """
    measures = F.array(
        F.struct(F.lit("chars").alias("measure"), F.length("text").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.octet_length("text").alias("length"))
    )
    # Copies of one text say nothing about a limit: each text of a source counts once.
    once = texts.select("source", F.xxhash64("text").alias("h"), F.explode(measures).alias("m")).select("source", "h", "m.measure", "m.length").distinct()
    sizes = once.groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = limits(group)
        columns = ["length", "seen", "expected", "censored", "mu", "sd"]
        return pd.DataFrame(found, columns=columns).assign(source=group["source"].iloc[0], measure=group["measure"].iloc[0])[["source", "measure", *columns]]

    return sizes.groupBy("source", "measure").applyInPandas(run, "source string, measure string, length int, seen bigint, expected double, censored double, mu double, sd double")


def known_words(texts: DataFrame) -> set[str]:
    """Words that many texts have elsewhere than at their end; WORD_SHARE bounds them by the texts' mean length."""
    inner = F.regexp_replace(F.lower("text"), r"[\p{L}\p{M}]+[^\p{L}\p{M}]*$", "")
    words = r"\p{IsHan}|[\p{L}\p{M}&&[^\p{IsHan}]]{1,40}"
    counted = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(inner, F.lit(words), F.lit(0)))).alias("w"))
    total = texts.count()
    return {r.w for r in counted.groupBy("w").count().where(F.col("count") >= max(3.0, total * WORD_SHARE)).select("w").collect()}


def _endings(texts: DataFrame, known: set[str]) -> DataFrame:
    """For each text its real ending, and counted for each batch how TRIALS random cuts of every text end.

    (id, source, kind, mark, c3, closed, chars, bytes, n): trials have a null id.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sorted(known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        own = set(words)
        for batch in batches:
            rows, trials = [], Counter()
            for i, source, kind, text, chars, octets in zip(*(batch[c] for c in ("id", "source", "kind", "text", "chars", "bytes"))):
                body, mark = mark_of(text)
                rows.append((i, source, kind, mark, context(body, len(body), own, words), is_closed(body) and mark != "ellipsis", chars, octets, 1))
                seed = zlib.crc32(f"{i} {len(text)}".encode())
                for _ in range(TRIALS):
                    seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
                    trials[kind, context(body, 1 + seed % max(1, len(body)), own, words)] += 1
            rows += [(None, None, kind, None, c3, None, None, None, n) for (kind, c3), n in trials.items()]
            out = pd.DataFrame(rows, columns=["id", "source", "kind", "mark", "c3", "closed", "chars", "bytes", "n"])
            yield out.astype({"id": "Int64", "closed": "boolean", "chars": "Int32", "bytes": "Int32"})

    return texts.mapInPandas(run, "id bigint, source string, kind string, mark string, c3 string, closed boolean, chars int, bytes int, n bigint")


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _shorter(endings: DataFrame) -> DataFrame:
    """``endings`` with the last token ``c1`` and the last two ``c2`` of the context."""
    tokens = F.split("c3", " ")
    return endings.withColumns({"c1": F.element_at(tokens, -1), "c2": F.array_join(F.slice(tokens, 2, 2), " ")})


def _expected(endings: DataFrame) -> DataFrame:
    """(kind, c1, c2, c3, a1, a2, a3): for the contexts that end texts, how many cuts at START_RATE end so."""
    trials = endings.where("id is null").groupBy("kind", "c3").agg((F.sum("n") * (START_RATE / TRIALS)).alias("a"))
    trials = cut(_shorter(trials))
    contexts = _shorter(endings.where("id is not null").select("kind", "c3").distinct())
    for k in (3, 2, 1):
        of = trials.groupBy("kind", f"c{k}").agg(F.sum("a").alias(f"a{k}"))
        contexts = contexts.join(of, ["kind", f"c{k}"], "left")
    return contexts.na.fill(0.0, ["a1", "a2", "a3"])


def _rated(states: DataFrame) -> DataFrame:
    """``states`` with ``r``: of all texts that end so, the share that random cuts account for.

    ``p`` is what each text is held to be cut by so far; only the rest of it counts as a whole text,
    and a text never counts for itself. Rare contexts borrow from the shorter ones.
    """
    whole = states.groupBy("kind", "c1", "c2", "c3").agg(F.sum(F.col("n") * (1 - F.col("p"))).alias("w3"))
    # The windows run over contexts, not over texts.
    for k in (2, 1):
        whole = whole.withColumn(f"w{k}", F.sum("w3").over(Window.partitionBy("kind", f"c{k}")))
    found = states.join(whole.drop("c1", "c2"), ["kind", "c3"])
    r = F.lit(START_RATE)
    for k in (1, 2, 3):
        others = F.greatest(F.lit(0.0), F.col(f"w{k}") - (1 - F.col("p")))
        r = (F.col(f"a{k}") + BORROWED * r) / (F.col(f"a{k}") + others + BORROWED)
    return found.withColumn("r", r).drop("w1", "w2", "w3")


def _settled(states: DataFrame) -> DataFrame:
    """``states`` with the posterior ``p`` and the rating ``r``, by turns until no posterior moves."""
    names = [c for c in states.columns if c not in ("p", "r")]
    moved = None
    for turn in range(MOST_TURNS):
        rated = _rated(states.select(*names, "p")).withColumn("ending", _logit(F.col("r")) - _logit(F.lit(START_RATE)))
        # What a mark says, and how often a source cuts elsewhere than at its limits.
        marks = rated.where("mark <> ''").groupBy("mark").agg(F.sum(F.col("r") * F.col("n")).alias("m"), F.sum("n").alias("n"))
        marks = marks.select("mark", (_logit((F.col("m") + 2 * START_RATE) / (F.col("n") + 2)) - _logit(F.lit(START_RATE))).alias("says"))
        guess = F.sum(F.col("p") * F.col("n")) if turn else F.sum("n") * START_RATE
        free = states.where("censored < 0").groupBy("source").agg(((guess + 5 * START_RATE) / (F.sum("n") + 5)).alias("rate"))
        rate = F.greatest(F.lit(0.01), F.least(F.lit(0.6), F.coalesce("rate", F.lit(START_RATE))))
        odds = _logit(F.when(F.col("censored") < 0, rate).otherwise(F.col("censored"))) + F.col("ending") + F.coalesce("says", F.lit(0.0))
        # There are only four marks; sources may be many and are joined.
        told = rated.join(F.broadcast(marks), "mark", "left").join(free, "source", "left").withColumn("new", 1 / (1 + F.exp(-odds)))
        states = cut_plain(told.select(*names, F.col("new").alias("p"), "r", F.abs(F.col("new") - F.col("p")).alias("moved")))
        moved = states.agg(F.max("moved")).first()[0]
        states = states.drop("moved")
        if moved is None or moved <= SETTLED:
            return states
    raise RuntimeError(f"the posterior still moves by {moved} after {MOST_TURNS} turns")


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", kind_col: str = "kind") -> DataFrame:
    """(id_col, source, posterior, cut) for every text that is not null or blank.

    Null sources and kinds are classes of their own; a repeated id is one record (its least text
    counts); empty and blank texts cannot have been seen to be cut and give no row.
    """
    texts = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.col(kind_col), F.lit("")).alias("kind"),
        F.col(text_col).alias("text"),
    ).where(F.col("id").isNotNull() & F.col("text").rlike(r"\S"))
    texts = shuffled(texts, "id").groupBy("id").agg(F.min(F.struct("text", "source", "kind")).alias("t")).select("id", "t.*")
    texts = texts.withColumns({"chars": F.length("text"), "bytes": F.octet_length("text")})
    bounds = field_limits(texts).select("source", "measure", "length", "censored")
    endings = cut(_endings(texts, known_words(texts)))
    expected = cut(_expected(endings))

    at = lambda m: bounds.where(F.col("measure") == m).select("source", F.col("length").alias(m), F.col("censored").alias(f"at_{m}"))
    real = endings.where("id is not null").drop("n").join(at("chars"), ["source", "chars"], "left").join(at("bytes"), ["source", "bytes"], "left")
    # Texts of one state are alike in all that bears on the posterior; -1 is no limit.
    state = ["source", "kind", "mark", "closed", "c3", "censored"]
    held = cut(real.withColumn("censored", F.coalesce(F.greatest("at_chars", "at_bytes"), F.lit(-1.0))).select("id", *state))
    counted = held.groupBy(*state).agg(F.count(F.lit(1)).alias("n")).join(expected, ["kind", "c3"])
    start = F.when(F.col("censored") >= 0, F.col("censored")).when(F.col("closed"), CLOSED).otherwise(OPEN)
    held = held.join(_settled(cut_plain(counted.withColumn("p", start))).select(*state, "p", "r"), state)
    # A text that ends with a whole sentence or list item stops nowhere inside, even at a limit.
    complete = F.col("closed") & (F.col("r") < 0.5 * START_RATE)
    return held.select(F.col("id").alias(id_col), "source", F.col("p").alias("posterior"), ((F.col("p") >= 0.5) & ~complete).alias("cut"))


def by_source(found: DataFrame) -> DataFrame:
    """(source, documents, truncated, share): how often each source cuts."""
    counted = found.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("cut").cast("bigint")).alias("truncated"))
    return counted.withColumn("share", F.round(F.col("truncated") / F.col("documents"), 4))
