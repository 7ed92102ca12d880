"""One consistent form for text that looks the same.

Text is exploded to positioned code points; a broadcast table holds for each code point what it
looks like, fully decomposed; combining marks are ordered by class within their cluster, letters
and marks are recomposed by a second table, and the text is put together again.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbraline.plans.lineage import cut

# Letters and signs of other scripts beside the Latin ones of the same shape.
LOOKALIKES = (
    "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX УY ҮY ԌG ԚQ ԜW "  # Cyrillic capitals
    "аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs хx уy ԝw ѵv үy "  # Cyrillic small letters
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "  # Greek capitals
    "αa ιi νv οo ρp υu γy ϳj "  # Greek small letters
    "օo հh սu ոn ցg "  # Armenian
    "ɡg ɑa ɩi "  # Latin extensions
    "‐- ‑- ‒- –- −- ﹣- ․. ‚, ’' ‘' ʼ' ′' “\" ”\" ⁄/ ∕/ ∶:"
)
#: Compatibility decompositions that keep the look (fixed values).
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>"}


def _looks(ch: str) -> str:
    """``ch`` as it looks, decomposed; '' if it shows nothing."""
    category = unicodedata.category(ch)
    if category == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or ord(ch) == 0x34F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    if category == "Zs":
        return " "
    if 0xAC00 <= ord(ch) <= 0xD7A3:  # Hangul syllables stay whole
        return ch
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in SAME_LOOK or (tag == "<compat>" and (category == "Nl" or (category in ("Lu", "Ll") and len(rest.split()) > 1))):
        return "".join(_looks(chr(int(x, 16))) for x in rest.split())
    pairs = _pairs()
    return "".join(pairs.get(x, x) for x in unicodedata.normalize("NFD", ch))


@lru_cache(maxsize=1)
def _pairs() -> dict[str, str]:
    return {p[0]: p[1] for p in LOOKALIKES.split()}


@lru_cache(maxsize=1)
def mapping_rows() -> list[tuple[str, list[tuple[str, int]]]]:
    """(code point, its look as (code point, combining class)), for those that change or combine."""
    rows = []
    for number in range(0x80, sys.maxunicode + 1):
        ch = chr(number)
        if unicodedata.category(ch) in ("Cn", "Co", "Cs"):
            continue
        looks = _looks(ch)
        if looks != ch or unicodedata.combining(ch):
            rows.append((ch, [(x, unicodedata.combining(x)) for x in looks]))
    return rows


@lru_cache(maxsize=1)
def composition_rows() -> list[tuple[str, str]]:
    """(letter and mark, the code point of both) for every canonical pair that may be composed."""
    rows = []
    for number in range(0x80, sys.maxunicode + 1):
        ch = chr(number)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
            pair = "".join(chr(int(x, 16)) for x in parts)
            if unicodedata.combining(pair[1]):
                rows.append((pair, ch))
    return rows


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Both tables are bounded by Unicode itself (a few thousand rows), so they are broadcast."""
    looks = spark.createDataFrame(mapping_rows(), "ch string, looks array<struct<c:string,class:int>>")
    pairs = spark.createDataFrame(composition_rows(), "pair string, composed string")
    return F.broadcast(looks), F.broadcast(pairs)


def canonical_texts(texts: DataFrame) -> DataFrame:
    """(text, canonical) for each distinct value of ``texts.text`` that is not plain ASCII.

    Two marks of a cluster are recomposed, further ones stay behind the letter. A text of which
    nothing shows gets ''. Null texts are left out; whole texts are processed whatever their length.
    The code points carry the number of their text, which is joined again at the end, so the work
    grows with the characters and not with their square.
    """
    looks, pairs = _tables(texts.sparkSession)
    # Numbered and cut: the numbers must not change when a task runs again.
    distinct = cut(texts.select("text").where(F.col("text").rlike(r"[^\x00-\x7F]")).distinct().withColumn("n", F.monotonically_increasing_id()))
    points = distinct.select("n", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    shown = points.join(looks, "ch", "left").select(
        "n", "pos", F.posexplode_outer(F.coalesce("looks", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("class"))))).alias("sub", "x")
    )
    in_order = Window.partitionBy("n").orderBy("pos", "sub")
    clustered = shown.select("n", "pos", "sub", "x.c", "x.class", F.sum((F.coalesce("x.class", F.lit(1)) == 0).cast("int")).over(in_order).alias("cluster"))
    clusters = clustered.groupBy("n", "cluster").agg(F.sort_array(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("class", "pos", "sub", "c")))).alias("parts"))
    part = lambda i: F.coalesce(F.get(F.col("parts"), F.lit(i))["c"], F.lit(""))
    one = clusters.withColumn("pair", F.concat(part(0), part(1))).join(pairs, "pair", "left")
    first = F.coalesce("composed", F.concat(part(0), part(1)))
    two = one.select("n", "cluster", "parts", first.alias("head")).withColumn("pair", F.concat("head", part(2))).join(pairs, "pair", "left")
    rest = F.array_join(F.transform(F.slice("parts", 4, F.greatest(F.size("parts") - 3, F.lit(1))), lambda p: p["c"]), "")
    put = F.when(F.size("parts") == 0, "").otherwise(F.concat(F.coalesce("composed", F.concat("head", part(2))), rest))
    letters = two.select("n", F.struct("cluster", put.alias("c")).alias("piece"))
    joined = letters.groupBy("n").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return distinct.join(joined.select("n", F.array_join(F.transform("pieces", lambda p: p["c"]), "").alias("canonical")), "n").select("text", "canonical")


def canonical_form(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``canonical``: plain ASCII is its own form, other texts are looked up; null stays null."""
    known = canonical_texts(df.select(F.col(text_col).alias("text")))
    known = known.select(F.col("text").alias("__look_text"), F.col("canonical").alias("__look_form"))
    joined = df.drop("canonical").join(known, F.col(text_col) == F.col("__look_text"), "left")
    return joined.withColumn("canonical", F.coalesce("__look_form", F.col(text_col))).drop("__look_text", "__look_form")


def same_look_pairs(df: DataFrame, group_cols: list[str], id_col: str, text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """(id_a, id_b) of rows of one group whose texts look the same and differ in their characters.

    Rows of one text are collapsed first, and only classes with several texts are paired, so a
    group full of copies of one text costs nothing. Rows with null text or null group columns are
    in no pair; rows repeated under one id are one record; groups are compared by equality.
    """
    rows = df.select(*group_cols, F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(
        " AND ".join(f"`{c}` IS NOT NULL" for c in [*group_cols, "__id", "__text"])
    )
    if keep is not None:
        rows = rows.where(keep)
    forms = cut(canonical_form(rows, "__text").distinct())
    several = forms.groupBy(*group_cols, "canonical").agg(F.min("__text").alias("x"), F.max("__text").alias("y")).where("x < y").drop("x", "y")
    members = forms.join(several, [*group_cols, "canonical"], "left_semi")
    a = members.withColumnsRenamed({"__id": "ida", "__text": "ta"})
    b = members.withColumnsRenamed({"__id": "idb", "__text": "tb"})
    pairs = a.join(b, [*group_cols, "canonical"]).where("ida < idb AND ta <> tb")
    return pairs.select(F.col("ida").alias("id_a"), F.col("idb").alias("id_b")).distinct()
