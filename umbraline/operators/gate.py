"""Protected text, and the gate that every candidate passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraline.functions.text import fold, normalized
from umbraline.operators.rule_tables import COMPATIBLE, FIGURE_CLIP_EXEMPT, FIGURE_WAIVER, STRONG_TYPES
from umbraline.operators.rules import find_figures
from umbraline.sources.tables import LINE_KEY

#: Colour of text that an earlier run has put in place (fixed value).
REPLACED_COLOR = 13369344
#: Kinds of figures; what they protect is never cut out of a date or an identifier.
FIGURE_KINDS = ["money", "percent", "tax_year", "line_number", "form_number"]
SOURCE_RANK = {"manual": 4, "group": 3, "regex": 2}


def _said(evidence: Column) -> Column:
    return F.coalesce(F.lower(F.array_join(F.transform(evidence, lambda e: e["detail"]), " ")), F.lit(""))


def strength(pii_type: Column, source: Column, confidence: Column, evidence: Column) -> Column:
    """strong, medium or weak: what a candidate's source and evidence are worth."""
    said = _said(evidence)
    return (
        F.when(source.isin("manual", "group"), "strong")
        .when((source == "regex") & (said.contains("label context") | pii_type.isin(STRONG_TYPES)), "strong")
        .when((source == "coverage") & said.rlike("entity|propagat|subject|alias"), "strong")
        .when((source == "coverage") | (source == "regex") | ((source == "ner") & (confidence >= 0.8)), "medium")
        .otherwise("weak")
    )


def is_proposal(source: Column, evidence: Column, group_id: Column) -> Column:
    """A guess: neither the user's, nor a rule's, nor a label's."""
    joint = _said(evidence).contains("joint-name") & group_id.isNull()
    return ~source.isin("manual", "regex", "group") | ((source == "group") & joint)


def protected(lines: DataFrame, labels: DataFrame, values: DataFrame) -> DataFrame:
    """(line key, a, b, kind, hard): labels, values of figure labels, replaced text and figures.

    A figure on an identity field's line of values, or right of such a label, is the identity itself and not protected.
    """
    row = lambda kind, a, b: [*LINE_KEY, a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(kind).alias("kind"), F.lit(True).alias("hard")]
    own = labels.select(*row("label", F.col("label_start"), F.col("label_end")))
    end = F.length(F.rtrim("text"))
    non_pii = labels.where("non_pii").where(F.col("label_end") < end).select(*row("non_pii_field", F.col("label_end"), end))
    below = values.where("non_pii and how <> 'inline'").select(*row("non_pii_field", F.lit(0), F.col("span_end")))
    red = lines.where(F.col("color") == REPLACED_COLOR).where(F.trim("text") != "").select(*row("replaced", F.lit(0), F.length("text")))
    waived = F.arrays_overlap("expects", F.lit(FIGURE_WAIVER))
    from_ = labels.where(~F.col("non_pii") & waived).groupBy(*LINE_KEY).agg(F.min("label_end").alias("identity_from"))
    identity = values.where(~F.col("non_pii") & waived & (F.col("how") != "inline")).select(*LINE_KEY, F.lit(True).alias("identity")).distinct()
    figures = find_figures(lines).join(from_, LINE_KEY, "left").join(identity, LINE_KEY, "left")
    figures = figures.where(F.col("identity").isNull() & (F.col("identity_from").isNull() | (F.col("span_start") < F.col("identity_from"))))
    figures = figures.select(*LINE_KEY, F.col("span_start").alias("a"), F.col("span_end").alias("b"), "kind", F.lit(True).alias("hard"))
    return own.unionByName(non_pii).unionByName(below).unionByName(red).unionByName(figures)


def gated(candidates: DataFrame, lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(cand_id, action, reason, strength, span_start, span_end): every candidate with what the gate did.

    ``accept``, ``clip`` (moved off protected text at its ends, or to the larger side of a label
    inside it), ``flag`` (strong evidence on softly protected text) or ``reject``. The regions of a
    candidate's line are one array, bounded by the line's length, and are passed in order of their places.
    """
    region = F.struct("a", "b", "kind", "hard")
    of_line = regions.groupBy(*LINE_KEY).agg(F.array_sort(F.collect_set(region)).alias("regions"))
    texts = lines.select(*LINE_KEY, F.col("text").alias("line"))
    rows = candidates.join(texts, LINE_KEY, "left").join(of_line, LINE_KEY, "left").select(
        "cand_id", "pii_type", "source", "span_start", "span_end", "line", F.coalesce("regions", F.array().cast("array<struct<a:int,b:int,kind:string,hard:boolean>>")).alias("regions"),
        strength(F.col("pii_type"), F.col("source"), F.col("confidence"), F.col("evidence")).alias("strength"), is_proposal(F.col("source"), F.col("evidence"), F.col("group_id")).alias("guess"),
    )
    exempt = F.coalesce(F.col("pii_type").isin(FIGURE_CLIP_EXEMPT), F.lit(False))
    none = F.lit(None).cast("string")
    state = lambda s, e, why, soft, moved: F.struct(s.alias("s"), e.alias("e"), why.alias("why"), soft.alias("soft"), moved.alias("moved"))

    def step(z: Column, r: Column) -> Column:
        s, e = z["s"], z["e"]
        covers = (r["a"] <= s) & (r["b"] >= e)
        figure = r["kind"].isin(FIGURE_KINDS)
        left, right = (r["a"] <= s) & (s < r["b"]), (r["a"] < e) & (e <= r["b"])
        larger_left = r["a"] - s >= e - r["b"]
        return (
            F.when(z["why"].isNotNull() | ~((r["a"] < e) & (s < r["b"])), z)
            .when(~r["hard"] & (F.col("strength") == "strong"), state(s, e, none, F.coalesce(z["soft"], r["kind"]), z["moved"]))
            .when(covers, state(s, e, r["kind"], z["soft"], z["moved"]))
            .when(~r["hard"] | (figure & exempt), z)
            .when(left, state(r["b"], e, none, z["soft"], F.lit(True)))
            .when(right, state(s, r["a"], none, z["soft"], F.lit(True)))
            .when(~figure & larger_left, state(s, r["a"], none, z["soft"], F.lit(True)))
            .when(~figure, state(r["b"], e, none, z["soft"], F.lit(True)))
            .otherwise(z)
        )

    replaced = F.exists("regions", lambda r: (r["kind"] == "replaced") & (r["a"] < F.col("span_end")) & (F.col("span_start") < r["b"]))
    begin = state(F.col("span_start"), F.col("span_end"), none, none, F.lit(False))
    held = rows.withColumn("z", F.explode(F.array(F.aggregate("regions", begin, step)))).withColumn("replaced", replaced)
    part = F.expr("substring(line, z.s + 1, z.e - z.s)")
    lead = F.length(part) - F.length(F.regexp_replace(part, r"^[\s:,;]+", ""))
    tail = F.length(part) - F.length(F.regexp_replace(part, r"[\s:,;]+$", ""))
    held = held.withColumns({"real": F.expr("substring(line, span_start + 1, span_end - span_start)"), "part": part, "s": F.col("z.s") + lead, "e": F.col("z.e") - tail})
    nothing = ~F.coalesce(F.col("real").rlike(r"[\p{L}\p{N}]"), F.lit(False)) | (F.col("span_end") <= F.col("span_start"))
    left_over = F.coalesce(F.col("part").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    manual = F.col("source") == "manual"
    reason = (
        F.when(nothing, "no real text").when(manual, "user").when(F.col("replaced") & F.col("guess"), "replaced").when(F.col("z.why").isNotNull(), F.col("z.why"))
        .when(~left_over, "nothing left").when(F.col("z.soft").isNotNull(), F.col("z.soft")).when((F.col("s") != F.col("span_start")) | (F.col("e") != F.col("span_end")), "moved").otherwise("free")
    )
    action = F.when(reason == "moved", "clip").when(reason.isin("user", "free"), "accept").when(F.col("z.soft").isNotNull() & (reason == F.col("z.soft")) & F.col("z.why").isNull() & left_over, "flag").otherwise("reject")
    kept = action.isin("accept", "clip", "flag") & ~manual
    return held.select(
        "cand_id", action.alias("action"), reason.alias("reason"), "strength",
        F.when(kept, F.col("s")).otherwise(F.col("span_start")).cast("int").alias("span_start"), F.when(kept, F.col("e")).otherwise(F.col("span_end")).cast("int").alias("span_end"),
    )


def held_back(candidates: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(cand_id): proposals that neither a label, nor a propagated entity, nor confirmed persons' words bear out.

    ``confirmed`` (fixture, token) are the words of the persons that labels confirm.
    """
    guess = is_proposal(F.col("source"), F.col("evidence"), F.col("group_id")) & ~F.coalesce("label_confirmed", F.lit(False))
    strong = (F.col("source") == "coverage") & (strength(F.col("pii_type"), F.col("source"), F.col("confidence"), F.col("evidence")) == "strong")
    open_ = candidates.where(guess & ~strong & F.col("text").isNotNull() & F.col("pii_type").isNotNull())
    words = F.filter(F.array_distinct(F.split(fold(F.col("text")), " ")), lambda w: F.length(w) >= 2)
    persons = open_.where("pii_type = 'PERSON'").select("cand_id", "fixture", F.explode(words).alias("token"))
    known = persons.join(confirmed.select("fixture", "token").distinct().withColumn("k", F.lit(1)), ["fixture", "token"], "left")
    borne = known.groupBy("cand_id").agg(F.min(F.coalesce("k", F.lit(0))).alias("k")).where("k = 1")
    return open_.select("cand_id").join(borne, "cand_id", "left_anti")


def family(pii_type: Column) -> Column:
    """The name of the family whose types do not contradict each other; a type without one is its own."""
    out = pii_type
    for types in COMPATIBLE:
        out = F.when(pii_type.isin(types), types[0]).otherwise(out)
    return out


def resolved(candidates: DataFrame) -> DataFrame:
    """(cand_id, span_start, span_end, n_evidence, group_id, needs_review, confidence, absorbed) of the candidates that survive.

    On each line, in order of start and reverse end, a candidate meets the first kept one it overlaps: the
    higher source rank wins, then the longer span, then the confidence, the earlier on a tie. The winner takes over evidence,
    group and the greater confidence, and is reviewed if the types contradict each other, unless a label bound
    it or the loser is a rule's bare shape. The fold runs over one line's candidates, which the line's length bounds.
    """
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in SOURCE_RANK.items() for x in kv))[F.col("source")], F.lit(1))
    shape_only = (F.col("source") == "regex") & F.coalesce("needs_review", F.lit(False)) & ~_said(F.col("evidence")).contains("label context")
    item = F.struct(
        F.col("span_start").alias("a"), (-F.col("span_end")).alias("minus_b"), "cand_id", rank.alias("rank"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.size("evidence"), F.lit(0)).alias("n_evidence"), "group_id", F.coalesce("needs_review", F.lit(False)).alias("needs_review"),
        F.coalesce(family(F.col("pii_type")), F.lit("")).alias("family"), shape_only.alias("shape_only"), F.lit(0).alias("absorbed"),
    )
    rows = candidates.where("text is not null").groupBy(*LINE_KEY).agg(F.sort_array(F.collect_list(item)).alias("items"))

    def absorb(w: Column, lost: Column) -> Column:
        doubt = (w["family"] != lost["family"]) & (w["rank"] != SOURCE_RANK["group"]) & ~lost["shape_only"]
        return F.struct(
            w["a"].alias("a"), w["minus_b"].alias("minus_b"), w["cand_id"].alias("cand_id"), w["rank"].alias("rank"), F.greatest(w["confidence"], lost["confidence"]).alias("confidence"),
            (w["n_evidence"] + lost["n_evidence"]).alias("n_evidence"), F.coalesce(w["group_id"], lost["group_id"]).alias("group_id"), (w["needs_review"] | doubt).alias("needs_review"),
            w["family"].alias("family"), w["shape_only"].alias("shape_only"), (w["absorbed"] + 1).alias("absorbed"),
        )

    def step(kept: Column, x: Column) -> Column:
        hit = F.get(F.filter(kept, lambda k: (k["a"] < -x["minus_b"]) & (x["a"] < -k["minus_b"])), F.lit(0))
        worth = lambda c: F.struct(c["rank"], -c["minus_b"] - c["a"], c["confidence"])
        wins = worth(x) > worth(hit)
        return F.when(hit.isNull(), F.array_append(kept, x)).otherwise(
            F.transform(kept, lambda k: F.when(k["cand_id"] == hit["cand_id"], F.when(wins, absorb(x, hit)).otherwise(absorb(hit, x))).otherwise(k))
        )

    kept = rows.select(F.explode(F.aggregate("items", F.slice("items", 1, 0), step)).alias("k"))
    return kept.select(
        "k.cand_id", F.col("k.a").alias("span_start"), (-F.col("k.minus_b")).alias("span_end"), "k.n_evidence", "k.group_id", "k.needs_review", "k.confidence", "k.absorbed"
    )


def objections(candidates: DataFrame, objected: DataFrame) -> DataFrame:
    """(cand_id, outcome): candidates whose folded value is in ``objected`` (value): ``dropped``, or ``flagged`` if the evidence is strong."""
    wanted = objected.select(fold(normalized(F.col("value"))).alias("v")).where("v <> ''").distinct()
    met = candidates.where("text is not null").withColumn("v", fold(normalized(F.col("text")))).join(wanted, "v", "left_semi")
    strong = strength(F.col("pii_type"), F.col("source"), F.col("confidence"), F.col("evidence")) == "strong"
    return met.select("cand_id", F.when(strong, "flagged").otherwise("dropped").alias("outcome"))
