"""Joins, aggregations and windows over candidates, lines and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbraline.functions.text import fold, normalized
from umbraline.operators.rule_tables import OTHER_THRESHOLDS, THRESHOLDS
from umbraline.sources.tables import LINE_KEY

# Of overlapping candidates the higher rank wins.
SOURCE_RANK = {"manual": 4, "group": 3, "regex": 2}


def aggregate_confidence(evidence: Column, confidence: Column) -> Column:
    """Noisy-or of the positive weights plus the sum of the negative ones, within 0 and 1.

    Without evidence, or without any positive weight, the candidate's own confidence stands for the
    positive part; null confidence counts as 0.
    """
    own = F.coalesce(confidence, F.lit(0.0))
    weights = F.coalesce(F.transform(evidence, lambda e: e["weight"]), F.array().cast("array<double>"))
    product = F.aggregate(F.filter(weights, lambda w: w > 0), F.lit(1.0), lambda a, w: a * (1 - F.least(w, F.lit(0.99))))
    minus = F.aggregate(F.filter(weights, lambda w: w < 0), F.lit(0.0), lambda a, w: a + w)
    positive = F.when(product < 1, 1 - product).otherwise(own)
    return F.when(F.size(weights) == 0, own).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), positive + minus)))


def adjudication(pii_type: Column, score: Column) -> Column:
    """CONFIRMED, PROBABLE or UNRESOLVED by the thresholds of the type."""
    table = F.create_map(*(F.lit(x) for t, (high, low) in THRESHOLDS.items() for x in (t, [high, low])))
    bounds = F.coalesce(table[pii_type], F.lit(list(OTHER_THRESHOLDS)))
    confirmed, probable = bounds[0], bounds[1]
    return F.when(score >= confirmed, "CONFIRMED").when(score >= probable, "PROBABLE").otherwise("UNRESOLVED")


def adjudicated(candidates: DataFrame) -> DataFrame:
    score = F.round(aggregate_confidence(F.col("evidence"), F.col("confidence")), 6)
    return candidates.withColumn("score", score).withColumn("verdict", adjudication(F.col("pii_type"), F.col("score")))


def occurrence_groups(candidates: DataFrame) -> DataFrame:
    """(pii_type, value, occurrences, needs_review): candidates of one type and normalized value."""
    value = F.lower(normalized(F.col("text")))
    return candidates.where("text is not null and pii_type is not null").groupBy("pii_type", value.alias("value")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.bool_or("needs_review").alias("needs_review")
    )


def changes(candidates: DataFrame) -> DataFrame:
    """(fixture, pii_type, text, occurrences, pages): what a document holds, and on which pages."""
    return candidates.where("text is not null and pii_type is not null").groupBy("fixture", "pii_type", "text").agg(
        F.count(F.lit(1)).alias("occurrences"), F.array_join(F.array_sort(F.collect_set(F.col("page_no") + 1)), ",").alias("pages")
    )


def repeated_text(lines: DataFrame, pages: int = 3) -> DataFrame:
    """(fixture, value, band, n_pages, n_lines): text at the same height of at least ``pages`` pages of a document."""
    value = F.lower(normalized(F.col("text")))
    rows = lines.where("text is not null").select("fixture", "page_no", value.alias("value"), F.floor(F.col("y0") / 6).alias("band"))
    found = rows.where(F.length("value") >= 4).groupBy("fixture", "value", "band").agg(F.count_distinct("page_no").alias("n_pages"), F.count(F.lit(1)).alias("n_lines"))
    return found.where(F.col("n_pages") >= pages)


def form_styles(labels: DataFrame, lines: DataFrame, least: int = 5) -> DataFrame:
    """(font, color, label_uses, value_uses): styles that labels are printed in, and values hardly ever."""
    style = ["font", "color"]
    named = labels.where("font is not null").groupBy(*style).agg(F.count(F.lit(1)).alias("label_uses"))
    plain = lines.join(labels.select(*LINE_KEY), LINE_KEY, "left_anti").where("font is not null")
    used = plain.groupBy(*style).agg(F.count(F.lit(1)).alias("value_uses"))
    both = named.join(used, style, "left").withColumn("value_uses", F.coalesce("value_uses", F.lit(0)).cast("bigint"))
    return both.where((F.col("label_uses") >= least) & (F.col("value_uses") <= F.col("label_uses")))


def form_vocabulary(lines: DataFrame, least: int = 3) -> DataFrame:
    """(fixture, word, n): words of a document's capital headings printed at least ``least`` times."""
    heads = lines.where(F.col("text").rlike(r"^[A-Z][A-Z ]+$"))
    words = heads.select("fixture", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{3,}"), F.lit(0))).alias("word"))
    return words.groupBy("fixture", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def name_tokens(candidates: DataFrame) -> DataFrame:
    """(fixture, token, n): folded words of the persons that a label confirms."""
    sure = candidates.where("pii_type = 'PERSON' and label_confirmed and text is not null")
    words = sure.select("fixture", "cand_id", F.explode(F.array_distinct(F.split(fold(F.col("text")), " "))).alias("token")).where(F.length("token") >= 2)
    return words.groupBy("fixture", "token").agg(F.count(F.lit(1)).alias("n"))


def all_words_confirmed(candidates: DataFrame) -> DataFrame:
    """(cand_id): persons no label confirms, all of whose words a confirmed person of the document has."""
    open_ = candidates.where("pii_type = 'PERSON' and not label_confirmed and text is not null")
    words = open_.select("cand_id", "fixture", F.explode(F.array_distinct(F.split(fold(F.col("text")), " "))).alias("token")).where(F.length("token") >= 2)
    known = words.join(name_tokens(candidates).select("fixture", "token", F.lit(1).alias("k")), ["fixture", "token"], "left")
    return known.groupBy("cand_id").agg(F.min(F.coalesce("k", F.lit(0))).alias("k")).where("k = 1").select("cand_id")


def clipped_by_labels(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(cand_id, span_start, span_end, value): candidates moved past the label of their own line; none is left empty."""
    own = candidates.select("cand_id", "span_start", "span_end", *LINE_KEY).join(labels.select(*LINE_KEY, "label_start", "label_end"), LINE_KEY)
    # Of several labels that a candidate touches the last one decides.
    own = own.where("span_start < label_end and label_start < span_end").groupBy("cand_id").agg(F.max("label_end").alias("label_end"))
    joined = candidates.where("text is not null").join(own, "cand_id", "left")
    start = F.greatest("span_start", F.coalesce("label_end", F.lit(0)))
    moved = joined.withColumn("from", start).withColumn("part", F.substring("text", F.col("from") - F.col("span_start") + 1, F.length("text")))
    lead = F.length("part") - F.length(F.ltrim("part"))
    out = moved.where("from < span_end and trim(part) <> ''").select("cand_id", (F.col("from") + lead).cast("int").alias("span_start"), "span_end", F.trim("part").alias("value"))
    return out


def retyped_from_labels(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(cand_id, pii_type, label_type): candidates at least half inside the value of a label that announces one other type."""
    behind = F.substring(F.col("text"), F.col("label_end") + 1, F.length("text"))
    value_end = F.col("label_end") + F.length(behind) - F.length(F.ltrim(behind)) + F.length("value")
    values = labels.withColumn("value_end", value_end).where(F.size("expects") == 1).select(*LINE_KEY, F.col("expects")[0].alias("label_type"), F.col("label_end").alias("a"), F.col("value_end").alias("b"))
    joined = candidates.where("text is not null and pii_type is not null and source <> 'manual'").join(values, LINE_KEY)
    inside = F.least("span_end", "b") - F.greatest("span_start", "a")
    half = inside * 2 >= F.col("span_end") - F.col("span_start")
    return joined.where(half & (F.col("pii_type") != F.col("label_type"))).select("cand_id", "pii_type", "label_type")


def figure_overlaps(candidates: DataFrame, figures: DataFrame) -> DataFrame:
    """(cand_id, kind, value): candidates that touch a business figure of their line."""
    f = figures.select(*LINE_KEY, "kind", F.col("value"), F.col("span_start").alias("a"), F.col("span_end").alias("b"))
    return candidates.join(f, LINE_KEY).where("span_start < b and a < span_end").select("cand_id", "kind", "value").distinct()


def roster_lookup(registry: DataFrame, roster: DataFrame) -> DataFrame:
    """(record_id, pseudonym, known): each record's pseudonym, its own or else the roster's for the same type and spelling."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " ")))
    known = roster.where("coalesce(pseudonym, '') <> ''").groupBy("pii_type", key("original").alias("k")).agg(F.min("pseudonym").alias("kept"))
    joined = registry.withColumn("k", key("original")).join(known, ["pii_type", "k"], "left")
    return joined.select("record_id", F.coalesce("pseudonym", "kept").alias("pseudonym"), F.col("kept").isNotNull().alias("known"))


def reading_order(lines: DataFrame, width: float = 612.0) -> DataFrame:
    """(line key, position): two columns by the middle of the line, then downwards, then to the right."""
    middle = (F.col("x0") + F.col("x1")) / 2
    order = Window.partitionBy("fixture", "page_no").orderBy(F.floor(middle / (width / 2)), "y0", "x0", "block_no", "line_no")
    return lines.select(*LINE_KEY, F.row_number().over(order).alias("position"))


def neighbours(lines: DataFrame) -> DataFrame:
    """(line key, before, after): the texts of the lines above and below."""
    order = Window.partitionBy("fixture", "page_no").orderBy("block_no", "line_no")
    return lines.select(*LINE_KEY, F.lag("text").over(order).alias("before"), F.lead("text").over(order).alias("after"))


def word_windows(documents: DataFrame, size: int = 110, overlap: int = 12) -> DataFrame:
    """(doc_id, chunk, n_words, chunk_text): sliding windows of words; every word is in one or two."""
    words = documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n\f\x0B]+"), F.lit(0))).alias("pos", "word"))
    step = size - overlap
    last = F.floor(F.col("pos") / step)
    placed = words.select("doc_id", "pos", "word", F.explode(F.array_distinct(F.array(last, F.greatest(last - 1, F.lit(0))))).alias("chunk")).where(f"pos < chunk * {step} + {size}")
    whole = placed.groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n_words"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return whole.select("doc_id", F.col("chunk").cast("int").alias("chunk"), "n_words", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("chunk_text"))


def first_seen(candidates: DataFrame) -> DataFrame:
    """(fixture, pii_type, value, rank): distinct values in the order in which a document first shows them."""
    value = F.lower(normalized(F.col("text")))
    place = F.min(F.struct("page_no", "block_no", "line_no", "span_start", "cand_id")).alias("p")
    seen = candidates.where("text is not null and pii_type is not null").groupBy("fixture", "pii_type", value.alias("value")).agg(place)
    return seen.select("fixture", "pii_type", "value", F.row_number().over(Window.partitionBy("fixture").orderBy("p.page_no", "p.block_no", "p.line_no", "p.span_start", "p.cand_id")).alias("rank"))


def search_status(hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """(hit_id, touched): how many candidates' values a search hit's line contains on its page."""
    rows = hits.where("line_text is not null and page_no is not null").select("hit_id", "fixture", "page_no", "line_text")
    values = candidates.where("text is not null and text <> ''").select("fixture", "page_no", "text").distinct()
    joined = rows.join(values, ["fixture", "page_no"], "left")
    return joined.groupBy("hit_id").agg(F.sum(F.coalesce(F.contains("line_text", "text").cast("bigint"), F.lit(0))).alias("touched"))


def _surviving(candidates: DataFrame) -> DataFrame:
    """(line key, kept): the candidates that survive on their line, in order of start and reverse end.

    A candidate meets the first kept one it overlaps; the higher source rank wins, then the longer
    span, then the confidence, and the earlier on a tie. Only that first conflict is settled. The fold
    runs over the candidates of one line, an array that the line's length bounds.
    """
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in SOURCE_RANK.items() for x in kv))[F.col("source")], F.lit(1))
    item = F.struct(
        F.col("span_start").alias("a"), (-F.col("span_end")).alias("minus_b"), "cand_id",
        F.struct(rank.alias("r"), (F.col("span_end") - F.col("span_start")).alias("n"), F.coalesce("confidence", F.lit(0.0)).alias("c")).alias("worth"), "pii_type",
    )
    rows = candidates.where("text is not null").groupBy(*LINE_KEY).agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.slice("items", 1, 0)

    def step(kept: Column, x: Column) -> Column:
        hit = F.get(F.filter(kept, lambda k: (k["a"] < -x["minus_b"]) & (x["a"] < -k["minus_b"])), F.lit(0))
        return (
            F.when(hit.isNull(), F.array_append(kept, x))
            .when(x["worth"] > hit["worth"], F.transform(kept, lambda k: F.when(k["cand_id"] == hit["cand_id"], x).otherwise(k)))
            .otherwise(kept)
        )

    return rows.select(*LINE_KEY, F.aggregate("items", empty, step).alias("kept"))


def resolve_overlaps(candidates: DataFrame) -> DataFrame:
    """(cand_id): candidates that survive on their line."""
    return _surviving(candidates).select(F.explode("kept").alias("k")).select("k.cand_id")


def rewritten_lines(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """(line key, text): each line with its surviving candidates replaced by ``[TYPE]``, from left to right."""
    typed = F.filter("kept", lambda k: k["cand_id"].isNotNull() & k["pii_type"].isNotNull())
    target = lambda k: F.struct(k["a"].alias("span_start"), (-k["minus_b"]).alias("span_end"), k["pii_type"].alias("pii_type"))
    targets = _surviving(candidates).select(*LINE_KEY, F.sort_array(F.transform(typed, target)).alias("targets")).where(F.size("targets") > 0)
    joined = lines.select(*LINE_KEY, "text").join(targets, LINE_KEY, "left")

    def step(acc: Column, t: Column) -> Column:
        put = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, t["span_start"] - acc["at"]), F.lit("["), t["pii_type"], F.lit("]"))
        return F.when(t["span_start"] >= acc["at"], F.struct(put.alias("out"), t["span_end"].alias("at"))).otherwise(acc)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = joined.withColumn("p", F.when(F.col("targets").isNotNull(), F.aggregate("targets", start, step)))
    text = F.when(F.col("p").isNull(), F.col("text")).otherwise(F.concat("p.out", F.substring("text", F.col("p.at") + 1, F.length("text"))))
    return done.select(*LINE_KEY, text.alias("text"))


def _runs(text: Column) -> Column:
    """The distinct runs of letters and digits of ``text``, in lower case; the empty run, which values of signs alone go by, is in each."""
    return F.array_distinct(F.array_append(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lit("")))


def _longest_run(value: Column) -> Column:
    """The longest run of letters and digits of ``value`` in lower case, which is rarer than most; '' if it has none."""
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"], F.lit(""))


def _holds(text: Column, value: Column) -> Column:
    """Whether ``text`` has ``value`` as a whole word or phrase, in any case; white space of any kind is one blank."""
    literal = F.regexp_replace(F.regexp_replace(value, r"([^\p{L}\p{N}\s])", r"\\$1"), r"\s+", r"\\s+")
    return F.regexp_like(text, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), literal, F.lit(r"(?![\p{L}\p{N}_])")))


def leaks(rewritten: DataFrame, candidates: DataFrame) -> DataFrame:
    """(fixture, pii_type, n_values, n_leaked): values that a document still shows after the rewriting.

    The longest run of letters and digits of a value leads to the lines of its document that hold it, then the line is searched.
    """
    values = candidates.where("text is not null and pii_type is not null").select("fixture", "pii_type", F.lower(normalized(F.col("text"))).alias("value")).distinct()
    values = values.where(F.length("value") >= 4).withColumn("word", _longest_run(F.col("value")))
    words = rewritten.select("fixture", "text", F.explode(_runs(F.col("text"))).alias("word"))
    seen = values.join(words, ["fixture", "word"]).where(_holds(F.col("text"), F.col("value"))).select("fixture", "pii_type", "value").distinct().withColumn("leaked", F.lit(1))
    joined = values.join(seen, ["fixture", "pii_type", "value"], "left")
    return joined.groupBy("fixture", "pii_type").agg(F.count(F.lit(1)).alias("n_values"), F.sum(F.coalesce("leaked", F.lit(0)).cast("bigint")).alias("n_leaked"))


def propagated(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """(line key, pii_type, value, n): further whole-word occurrences of sure values of the same document.

    The longest run of letters and digits of a value leads to the lines that hold it (a hash join), then the line is searched.
    """
    sure = candidates.where("text is not null and confidence >= 0.85 and pii_type in ('PERSON', 'ORG_PRIVATE', 'EMAIL', 'SSN', 'EIN', 'PHONE')")
    values = sure.select("fixture", "pii_type", normalized(F.col("text")).alias("value")).where(F.length("value") >= 4).distinct()
    values = values.withColumn("word", _longest_run(F.col("value")))
    words = lines.where("text is not null").select(*LINE_KEY, "text", F.explode(_runs(F.col("text"))).alias("word"))
    found = words.join(values, ["fixture", "word"]).where(_holds(F.col("text"), F.col("value")))
    places = found.select(*LINE_KEY, "pii_type", "value").distinct()
    own = sure.select(*LINE_KEY, "pii_type", normalized(F.col("text")).alias("value")).distinct()
    return places.join(own, [*LINE_KEY, "pii_type", "value"], "left_anti")


def metrics(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """(pii_type, tp, fp, fn, precision, recall, f1): candidates against the decisions expected, by document, type and text."""
    key = ["fixture", "pii_type", "value"]
    value = F.lower(normalized(F.col("text"))).alias("value")
    got = candidates.where("text is not null and pii_type is not null").select("fixture", "pii_type", value).distinct().withColumn("got", F.lit(1))
    want = expected.where("text is not null and pii_type is not null").groupBy("fixture", "pii_type", value).agg(F.max((F.col("state") == "approved").cast("int")).alias("want"))
    both = want.join(got, key, "left")
    hit = F.coalesce("got", F.lit(0))
    counts = both.groupBy("pii_type").agg(
        F.sum(((hit == 1) & (F.col("want") == 1)).cast("bigint")).alias("tp"), F.sum(((hit == 1) & (F.col("want") == 0)).cast("bigint")).alias("fp"),
        F.sum(((hit == 0) & (F.col("want") == 1)).cast("bigint")).alias("fn"),
    )
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return counts.select("pii_type", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def coverage_gaps(candidates: DataFrame) -> DataFrame:
    """(pii_type, sources, n, missing): by which detectors each type is found, and by how many it is not."""
    seen = candidates.where("pii_type is not null").groupBy("pii_type").agg(F.array_sort(F.collect_set("source")).alias("s"), F.count(F.lit(1)).alias("n"))
    all_sources = F.array(*(F.lit(x) for x in ("audit", "coverage", "group", "manual", "ner", "regex")))
    return seen.select("pii_type", F.array_join("s", ",").alias("sources"), "n", F.array_join(F.array_except(all_sources, "s"), ",").alias("missing"))
