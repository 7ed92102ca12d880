"""Records that differ only in formatting, by progressive partition refinement.

Rows of one text are collapsed first. Classes are then split by ever costlier keys, each computed
only inside classes that still have several members: the length of what remains without white space
and punctuation, its letter histogram, and the sorted fields of the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraline.plans.lineage import cut

#: A label is known if at least so many texts have it where no other reading is possible; of several that end a value
#: the longest counts that has at least this share of the occurrences of the most frequent one.
LABEL_TEXTS, LABEL_SHARE = 2, 0.001
#: Words of a label at most.
LABEL_WORDS = 6
#: Words before a unit's number (fixed values).
UNIT_WORDS = "suite|ste|unit|apartment|apt|building|bldg|floor|flr|fl|box"


def squeezed(text: Column) -> Column:
    """Letters and digits of ``text`` in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", "")


def _segments(text: Column) -> Column:
    """What stands between the ``:`` and ``=`` of a record, in lower case: a value and the label of the next field."""
    return F.split(F.lower(text), "[:=]")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: squeezed(w) != "")


def _behind_border(segment: Column) -> Column:
    """What stands behind the last ``;``, ``|`` or line end of a segment."""
    return F.regexp_extract(segment, r"([^;|\r\n]*)$", 1)


def plain_labels(records: DataFrame) -> DataFrame:
    """(label, n): squeezed labels where no other reading is possible, at the beginning of a record or behind a border, and their texts."""
    parts = F.col("parts")
    inner = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: F.when(p.rlike(r"[;|\r\n]"), _behind_border(p))), lambda p: p.isNotNull())
    found = records.withColumn("parts", _segments(F.col("text"))).where("size(parts) > 1")
    found = found.select(F.explode(F.array_distinct(F.transform(F.array_prepend(inner, F.element_at(parts, 1)), squeezed))).alias("label"))
    return found.where("label <> '' and length(label) <= 60").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LABEL_TEXTS)


def with_field_key(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (rid, text) that have a label as (rid, key): the fields of each, squeezed and sorted.

    A record (label, then ``:`` or ``=``, then value) gives ``label=value`` fields. Before a further
    label the words that end the value are looked up in ``labels``; where none is known, all behind a
    border is the label, or else the last word. The look-up is a join, for records with copies only.
    """
    parts = rows.withColumn("parts", _segments(F.col("text"))).where("size(parts) > 1")
    heads = parts.select("rid", F.posexplode(F.slice("parts", 1, F.size("parts") - 1)).alias("pos", "segment"))
    heads = heads.withColumn("words", _words(_behind_border(F.col("segment")))).withColumn("whole", squeezed(F.array_join("words", "")))
    ends = heads.select(
        "rid", "pos", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("words"), F.lit(LABEL_WORDS))), lambda k: squeezed(F.array_join(F.slice("words", -k, k), "")))).alias("label")
    ).where("pos > 0 and size(words) > 1")
    known = ends.join(labels, "label").groupBy("rid", "pos").agg(F.collect_list(F.struct(F.length("label").alias("l"), "label", "n")).alias("options"))
    most = F.array_max(F.transform("options", lambda o: o["n"]))
    chosen = known.select("rid", "pos", F.array_max(F.filter("options", lambda o: o["n"] >= LABEL_SHARE * most))["label"].alias("known"))
    border = F.col("segment").rlike(r"[;|\r\n]") | (F.col("pos") == 0)
    label = F.when(F.col("pos") == 0, F.col("whole")).otherwise(F.coalesce("known", F.when(border, F.col("whole")), squeezed(F.element_at("words", -1)), F.lit("")))
    named = heads.join(chosen, ["rid", "pos"], "left").select("rid", "pos", F.coalesce(label, F.lit("")).alias("label"))
    # The label of the next field ends the segment that holds the value of this one.
    values = parts.select("rid", (F.size("parts") - 1).alias("last"), F.posexplode(F.transform("parts", squeezed)).alias("pos", "value"))
    both = values.join(named, ["rid", "pos"], "left").select(
        "rid", "pos", "label", F.when(F.col("pos") > 0, F.expr("substring(value, 1, length(value) - length(coalesce(label, '')))")).alias("value")
    )
    pieces = both.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "value"))).alias("p"))
    fields = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.concat(F.get("p", i - 1)["label"], F.lit("="), F.get("p", i)["value"]))
    return pieces.select("rid", F.array_join(F.array_sort(fields), "|").alias("key"))


def words_key(text: Column) -> Column:
    """The words of a record without labels, squeezed and sorted, a unit's number kept with its word."""
    fused = F.regexp_replace(F.lower(text), rf"\b({UNIT_WORDS})\b\.?\s*#?\s*(\d)", "$1$2")
    return F.array_join(F.array_sort(F.filter(F.transform(F.split(fused, r"[\s,;|/]+"), squeezed), lambda w: w != "")), " ")


def copies(df: DataFrame, id_col: str, text_col: str, class_cols: list[str], order_free: Column) -> DataFrame:
    """(class_cols, first_id, copies) for every record with two copies or more.

    ``order_free`` tells the rows whose fields may come in any order; of the others, letters and
    digits must come in the same order. ids are counted once, rows with a null id or text are no
    record, null class columns are a class of their own, and texts without letters or digits are
    equal only if they are the same text.
    """
    rows = df.withColumn("__free", F.coalesce(order_free, F.lit(False))).select(
        *class_cols, "__free", F.col(id_col).alias("id"), F.col(text_col).alias("text")
    ).where("id IS NOT NULL AND text IS NOT NULL")
    keys = [*class_cols, "__free"]
    bare = squeezed(F.col("text"))
    same = rows.groupBy(*keys, "text").agg(F.min("id").alias("first_id"), F.count_distinct("id").alias("copies"))
    # Cut, so that no level computes the one before again; a row is known by its place from here on.
    levelled = cut(same.withColumn("length", F.length(bare)).withColumn("rid", F.monotonically_increasing_id()))
    lengths = levelled.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("members"))
    several = _with_members(levelled, lengths, [*keys, "length"])
    histogram = F.when(F.col("length") == 0, F.col("text")).otherwise(F.array_join(F.array_sort(F.split(bare, "")), ""))
    # A length that nothing else has needs no histogram.
    several = several.withColumn("level", F.when(F.col("members") > 1, F.md5(histogram)).otherwise("")).drop("members")
    split = _with_members(several, several.groupBy(*keys, "length", "level").agg(F.count(F.lit(1)).alias("members")), [*keys, "length", "level"])
    split = cut(split.where("members > 1 or copies > 1"))
    alone = split.where("members = 1").select(*class_cols, "first_id", "copies")
    refined = split.where("members > 1")
    labelled = with_field_key(refined.where("__free").select("rid", "text"), plain_labels(levelled.where("__free").select("text")))
    plain = F.when(F.col("length") == 0, F.col("text")).when(F.col("__free"), words_key(F.col("text"))).otherwise(bare)
    keyed = refined.join(labelled, "rid", "left").withColumn("key", F.when(F.col("length") == 0, F.col("text")).otherwise(F.coalesce("key", plain)))
    found = keyed.groupBy(*keys, "length", "level", "key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies")).where("copies > 1")
    return found.select(*class_cols, "first_id", "copies").unionByName(alone)


def _with_members(rows: DataFrame, sizes: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the number of members of their class; null class columns are a class."""
    names = {c: f"__{i}" for i, c in enumerate(on)}
    renamed = sizes.withColumnsRenamed(names)
    return rows.join(renamed, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]).drop(*names.values())
