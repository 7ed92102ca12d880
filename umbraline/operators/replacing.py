"""Replacements by type, the plan of a rewriting and the checks of its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbraline.functions.text import caseless, entity_key, fold, normalized
from umbraline.operators.pseudonyms import masked, seed
from umbraline.operators.rules import MONEY, PERCENT, financial_tokens
from umbraline.sources.tables import LINE_KEY

# Invented names and streets for replacements.
GIVEN = ["Alva", "Bryn", "Corin", "Dara", "Ellis", "Faye", "Gale", "Hollis", "Indra", "Jory", "Kerin", "Lane", "Merle", "Nico", "Orla", "Perrin"]
SURNAMES = ["Aldmere", "Brackwell", "Carrow", "Dunsley", "Eastlow", "Farring", "Gadsby", "Harwin", "Ilford", "Jessop", "Kelling", "Lorton", "Maddern", "Norbeck", "Oswin", "Pellard"]
STREETS = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Gorse", "Hazel", "Ivy", "Juniper", "Larch", "Maple", "Oak", "Poplar", "Rowan", "Sorrel"]
ORGANISATIONS = ["Arden", "Belford", "Castor", "Denholm", "Elgin", "Fenwick", "Garnet", "Halden", "Inver", "Jura", "Kestrel", "Lomond", "Mercer", "Nevis", "Orchard", "Pentland"]
SUFFIX = r"(?i)[ ,]+(llc|inc\.?|corp\.?|ltd\.?|llp|lp|plc|pllc|pc|co\.?)$"
#: Times that a replacement is drawn anew before the shape mask is taken.
SALTS = 8
#: Rows of 64 bits that are sent to the workers to pass over words with which no value begins.
SLOTS = 1 << 17


def generated(pii_type: Column, value: Column, seed_: Column) -> Column:
    """The replacement of a value by its type, the same for the same seed; types without a form of their own are masked."""
    digest = F.sha2(seed_.cast("string"), 256)
    byte = lambda i: F.conv(F.substring(digest, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")
    digits = lambda a, n: F.concat(*((byte(i) % 10).cast("string") for i in range(a, a + n)))
    pick = lambda names, i: F.get(F.lit(names), byte(i) % len(names))
    name = F.concat_ws(" ", pick(GIVEN, 0), pick(SURNAMES, 1))
    person = F.when(value.rlike(r"^[^\p{Ll}]+$"), F.upper(name)).when(value.contains(","), F.concat_ws(", ", pick(SURNAMES, 1), pick(GIVEN, 0))).otherwise(name)
    number = F.regexp_extract(value, "[0-9]+", 0)
    house = F.substring(F.concat(((byte(2) % 9) + 1).cast("string"), digits(3, 6)), F.lit(1), F.greatest(F.length(number), F.lit(1)))
    street = F.concat_ws(" ", house, pick(STREETS, 0), F.lit("Street"))
    street = F.when(value.rlike(r"^[^\p{Ll}]+$"), F.upper(street)).otherwise(street)
    ending = F.regexp_extract(value, SUFFIX, 0)
    return (
        F.when(pii_type == "PERSON", person)
        .when(pii_type.isin("STREET", "ADDRESS"), street)
        .when(pii_type == "ORG_PRIVATE", F.concat(pick(ORGANISATIONS, 0), F.lit(" "), pick(STREETS, 1), ending))
        .when(pii_type == "SSN", F.concat(F.lit("1"), digits(0, 2), F.lit("-"), digits(2, 2), F.lit("-"), digits(4, 4)))
        .when(pii_type == "ITIN", F.concat(F.lit("9"), digits(0, 2), F.lit("-7"), digits(2, 1), F.lit("-"), digits(3, 4)))
        .when(pii_type.isin("EIN", "TIN"), F.concat(digits(0, 2), F.lit("-"), digits(2, 7)))
        .when(pii_type == "EMAIL", F.concat(F.lower(pick(GIVEN, 0)), F.lit("."), digits(1, 4), F.lit("@example.com")))
        .when(pii_type == "PHONE", F.concat(F.lit("555-01"), digits(0, 2), F.lit("-"), digits(2, 4)))
        .otherwise(masked(value, seed_))
    )


def assigned(registry: DataFrame) -> DataFrame:
    """(scope_ref, key_type, key, replacement, salt): one replacement for each entity of a scope.

    It is drawn SALTS times; the first counts that shares no word of three letters with the value, and of
    entities of a scope and type that drew the same one only the first keeps it: the others go on to their next
    draw, and those that find none are masked. Keys are distinct before anything is drawn, so a value that
    a third of all records hold is one row.
    """
    rows = registry.where("original is not null and pii_type is not null").select("scope_ref", "pii_type", "original", entity_key(F.col("pii_type"), F.col("original")).alias("k"))
    keys = rows.groupBy("scope_ref", "k.key_type", "k.key").agg(F.min("original").alias("value"))
    drawn = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = F.concat_ws("#", "key", F.when(F.col("salt") > 0, F.col("salt").cast("string")))
    drawn = drawn.withColumn("replacement", generated(F.col("key_type"), F.col("value"), seed(F.col("scope_ref"), F.col("key_type"), salted)))
    words = lambda c: F.filter(F.split(fold(F.col(c)), " "), lambda w: F.length(w) >= 3)
    able = drawn.where(~F.arrays_overlap(words("replacement"), words("value")) & (F.lower("replacement") != F.lower("value")))
    # The first of all that draw it, by draw and key, keeps a replacement.
    taken = Window.partitionBy("scope_ref", "key_type", "replacement").orderBy("salt", "key")
    own = able.withColumn("turn", F.row_number().over(taken)).where("turn = 1")
    first = own.groupBy("scope_ref", "key_type", "key").agg(F.min(F.struct("salt", "replacement")).alias("f"))
    joined = keys.join(first, ["scope_ref", "key_type", "key"], "left")
    mask = masked(F.col("value"), seed(F.col("scope_ref"), F.col("key_type"), F.col("key")))
    return joined.select("scope_ref", "key_type", "key", F.coalesce("f.replacement", mask).alias("replacement"), F.coalesce("f.salt", F.lit(-1)).alias("salt"))


def merged_targets(candidates: DataFrame) -> DataFrame:
    """(line key, span_start, span_end, cand_id, n): overlapping targets of a line as one; the longest, then the first, names it."""
    c = candidates.where("pii_type is not null and span_end > span_start").select(*LINE_KEY, "cand_id", "span_start", "span_end")
    before = Window.partitionBy(*LINE_KEY).orderBy("span_start", "span_end", "cand_id").rowsBetween(Window.unboundedPreceding, -1)
    island = Window.partitionBy(*LINE_KEY).orderBy("span_start", "span_end", "cand_id")
    opened = c.withColumn("new", (F.col("span_start") >= F.coalesce(F.max("span_end").over(before), F.lit(0))).cast("int"))
    grouped = opened.withColumn("g", F.sum("new").over(island))
    longest = F.max(F.struct((F.col("span_end") - F.col("span_start")).alias("n"), (-F.col("cand_id")).alias("m")))
    return grouped.groupBy(*LINE_KEY, "g").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), longest.alias("l"), F.count(F.lit(1)).alias("n")).select(
        *LINE_KEY, "span_start", "span_end", (-F.col("l.m")).alias("cand_id"), "n"
    )


def _wanted(values: DataFrame) -> DataFrame:
    """(fixture, value, runs): the distinct values with their runs of letters and digits; those without any are left out."""
    return values.select("fixture", "value").distinct().withColumn("runs", _runs(F.col("value"))).where(F.size("runs") > 0)


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(caseless(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _found(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fixture, value, n): how often values stand in a line that holds all their runs of letters and digits in a row.

    The lines' words are first joined to the numbers of runs that values beginning with them have, one row for each
    word of a document, so that words which begin many values, like "name" or "1", are not multiplied by these.
    Most words begin no value: a table of bits, of a fixed size, spares them the shuffle.
    """
    keyed = wanted.select("fixture", "value", F.array_join("runs", " ").alias("key"))
    begun = wanted.groupBy("fixture", F.get("runs", F.lit(0)).alias("word")).agg(F.collect_set(F.size("runs")).alias("sizes"))
    words = lines.where("text is not null").select("fixture", "text", F.explode(F.array_distinct(_runs(F.col("text")))).alias("word"))
    plain = F.regexp_replace(F.regexp_replace("text", MONEY, " ¤ "), PERCENT, " ¤ ")
    place = F.pmod(F.xxhash64("fixture", "word"), F.lit(64 * SLOTS)).alias("place")
    bits = begun.select(place).groupBy((F.col("place") % SLOTS).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(place div {SLOTS} as int))")).alias("bits"))
    words = words.withColumn("place", place).withColumn("slot", F.col("place") % SLOTS).join(F.broadcast(bits), "slot").where(f"getbit(bits, cast(place div {SLOTS} as int)) = 1")
    rows = words.select("fixture", "text", "word").join(begun, ["fixture", "word"]).select("fixture", "word", "sizes", plain.alias("text"))
    # Both arrays are bound to a variable, so they are computed once and not for every place.
    places = lambda r: F.filter(F.transform(r, lambda w, i: F.when(w == F.col("word"), i)), lambda i: i.isNotNull())
    at = lambda r, i: F.transform(F.filter("sizes", lambda n: i + n <= F.size(r)), lambda n: F.array_join(F.slice(r, i + 1, n), " "))
    keys = F.flatten(F.flatten(F.transform(F.array(_runs(F.col("text"))), lambda r: F.transform(places(r), lambda i: at(r, i)))))
    rows = rows.select("fixture", "text", F.explode(F.array_distinct(keys)).alias("key"))
    literal = F.regexp_replace(F.regexp_replace("value", r"([^\p{L}\p{N}\s])", r"\\$1"), r"\s+", r"\\s+")
    digit = F.col("value").rlike("^[0-9]")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), F.when(digit, r"(?<![0-9][-/.])").otherwise(""), literal, F.lit(r"(?![\p{L}\p{N}_])"), F.when(F.col("value").rlike("[0-9]$"), r"(?![-/.][0-9])").otherwise(""))
    return rows.join(keyed, ["fixture", "key"]).select("fixture", "value", F.regexp_count("text", pattern).cast("bigint").alias("n"))


def value_counts(lines: DataFrame, values: DataFrame) -> DataFrame:
    """(fixture, value, n): how often ``values`` (fixture, value) stand in a document as whole words, in any case.

    A number that is part of a longer one by a hyphen, slash or point, or of an amount, is no occurrence. Values
    that occur nowhere have 0.
    """
    wanted = _wanted(values)
    none = wanted.select("fixture", "value", F.lit(0).cast("bigint").alias("n"))
    return _found(lines, wanted).unionByName(none).groupBy("fixture", "value").agg(F.sum("n").alias("n"))


def verified(lines: DataFrame, rewritten: DataFrame, candidates: DataFrame) -> DataFrame:
    """(fixture, check, failures): what the rewriting of each document left undone; a document without failures has none.

    ``originals``: replaced values that still stand in it; ``placeholders``: candidates whose placeholder is missing;
    ``kept``: lines without a candidate that changed; ``amounts``: amounts of the source that are gone; ``lines``: lines that are gone.
    """
    chosen = candidates.where("text is not null and pii_type is not null")
    values = chosen.select("fixture", normalized(F.col("text")).alias("value")).where("length(value) >= 4")
    left = _found(rewritten, _wanted(values)).where("n > 0").select("fixture", "value").distinct().groupBy("fixture").agg(F.count(F.lit(1)).alias("failures")).withColumn("check", F.lit("originals"))
    both = lines.select(*LINE_KEY, F.col("text").alias("old")).join(rewritten.select(*LINE_KEY, F.col("text").alias("new"), F.lit(1).alias("there")), LINE_KEY, "left")
    marked = chosen.groupBy(*LINE_KEY).agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.concat(F.lit("["), F.col("pii_type"), F.lit("]"))).alias("marks"))
    j = both.join(marked, LINE_KEY, "left")
    changed = ~F.col("old").eqNullSafe(F.col("new"))
    missing = F.exists("marks", lambda m: ~F.contains(F.col("new"), m))
    gone = F.size(F.array_except(financial_tokens(F.col("old")), financial_tokens(F.col("new")))) > 0
    wrong = {
        "placeholders": F.col("n").isNotNull() & F.coalesce(missing, F.lit(True)), "kept": F.col("n").isNull() & changed,
        "amounts": changed & gone, "lines": F.col("there").isNull(),
    }
    # All checks of the lines in one pass.
    counts = j.groupBy("fixture").agg(*(F.count(F.when(w, 1)).alias(name) for name, w in wrong.items()))
    each = F.explode(F.array(*(F.struct(F.col(name).alias("failures"), F.lit(name).alias("check")) for name in wrong))).alias("e")
    return left.unionByName(counts.select("fixture", each).select("fixture", "e.failures", "e.check").where("failures > 0")).select("fixture", "check", "failures")
