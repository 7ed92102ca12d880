"""Packing documents into requests of fixed capacity by minimum bin slack.

Only the number of items of each length matters for the packing, and there are at most
``capacity`` lengths. One task per capacity takes this histogram, and for one request after the
other finds the fullest combination of available lengths by a bitset subset-sum (the longest
remaining item always goes in). A combination is used as often as the stock of its lengths
allows, so the work depends on the capacity and not on the number of documents. Documents then
take their places by their rank within their length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbraline.plans.lineage import cut

#: Slices of one length that are ranked side by side, so that no length is ranked by a single task.
SLICES = 64


def fullest(stock: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """(length, times) of the fullest selection from ``stock`` (length, count) within ``room``.

    Bit s of ``reach`` tells whether sum s can be made; the counts of a length go in as powers of
    two. The steps are kept for the way back, and it stops as soon as ``room`` itself is reached.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length, count in stock:
        left, times = min(count, room // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & mask
            if reach >> room & 1:
                break
            left, times = left - times, times * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            taken[length] = taken.get(length, 0) + times
    return list(taken.items())


def pack(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, per_request, first_request, requests): ranks of a length to requests."""
    left = {a: b for a, b in zip(lengths, counts) if 0 < a <= capacity and b}
    used, rows, request = dict.fromkeys(left, 0), [], 0
    descending = sorted(left, reverse=True)
    while left:
        while descending[0] not in left:
            descending.pop(0)
        longest = descending[0]
        stock = [(a, left[a] - (a == longest)) for a in descending if a in left and a <= capacity - longest]
        chosen = dict(fullest([(a, n) for a, n in stock if n], capacity - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        repeat = min(left[a] // n for a, n in chosen.items())
        for a, n in chosen.items():
            rows.append((a, used[a], n, request, repeat))
            used[a] += n * repeat
            left[a] -= n * repeat
            if not left[a]:
                del left[a]
        request += repeat
    return rows


def _plan(histogram: DataFrame) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = pack(group["tokens"].tolist(), group["n"].tolist(), int(group["capacity"].iloc[0]))
        out = pd.DataFrame(rows, columns=["tokens", "first_rank", "per_request", "first_request", "requests"])
        return out.assign(limit_id=group["limit_id"].iloc[0])[["limit_id", "tokens", "first_rank", "per_request", "first_request", "requests"]]

    schema = "limit_id int, tokens int, first_rank bigint, per_request bigint, first_request bigint, requests bigint"
    return histogram.groupBy("limit_id").applyInPandas(run, schema)


def requests(sizes: DataFrame, limits: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(limit_id, id, part_no, request_no, tokens): the request of each part of each item.

    An item is divided only if it alone exceeds the capacity: into full parts, which fill a
    request each, and a rest, which is packed like any item. Items of size 0 or null need no room and
    have request_no null. Limits that are null or below 1 are ignored. Ties of
    length are settled by slice and id, repeated ids are items of their own, and empty tables give no rows.
    """
    limits = limits.where("capacity_tokens >= 1").select("limit_id", F.col("capacity_tokens").alias("capacity")).distinct()
    items = (
        sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("int").alias("size"))
        .crossJoin(F.broadcast(limits))  # a few rows, never growing: each item times each limit is the output itself
        .withColumn("full", (F.col("size") / F.col("capacity")).cast("int"))
        .withColumn("rest", F.col("size") % F.col("capacity"))
    )
    whole = items.where("full > 0").select(
        "limit_id", "id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part_no"), F.col("capacity").alias("tokens")
    )
    rests = items.where("rest > 0").select(
        "limit_id", "capacity", "id", F.col("full").alias("part_no"), F.col("rest").alias("tokens"),
        F.pmod(F.xxhash64("id", "full"), F.lit(SLICES)).cast("int").alias("slice"),
    )
    none = items.where("size = 0").select("limit_id", "id", F.lit(0).alias("part_no"), F.lit(None).cast("bigint").alias("request_no"), F.lit(0).alias("tokens"))

    # One row per limit, length and slice: bounded by the capacities, whatever the number of items.
    stock = rests.groupBy("limit_id", "capacity", "tokens", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("limit_id", "tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stock.select("limit_id", "tokens", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    plan = cut(_plan(stock.groupBy("limit_id", "capacity", "tokens").agg(F.sum("n").alias("n"))))
    packed = _placed(rests, offsets, plan)

    last = plan.groupBy("limit_id").agg(F.max(F.col("first_request") + F.col("requests")).alias("taken"))
    # Full parts get the numbers behind the packed ones: counted per slice, never by one task.
    whole = whole.withColumn("slice", F.pmod(F.xxhash64("id", "part_no"), F.lit(SLICES)).cast("int"))
    per = whole.groupBy("limit_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("limit_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("limit_id", "slice", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("offset"))
    within = Window.partitionBy("limit_id", "slice").orderBy("id", "part_no")
    full = (
        whole.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(per), ["limit_id", "slice"])  # limits x SLICES rows
        .join(F.broadcast(last), "limit_id", "left")
        .select("limit_id", "id", "part_no", (F.coalesce("taken", F.lit(0)) + F.col("offset") + F.col("rank")).alias("request_no"), "tokens")
    )
    out = packed.unionByName(full).unionByName(none)
    return out.withColumnRenamed("id", id_col)


def _placed(rests: DataFrame, offsets: DataFrame, plan: DataFrame) -> DataFrame:
    """Each rest with its request: its rank within its length, looked up in the plan.

    The plan and the offsets are bounded by the capacities (lengths x slices), not by the items.
    """
    steps = plan.groupBy("limit_id", "tokens").agg(F.sort_array(F.collect_list(F.struct("first_rank", "per_request", "first_request"))).alias("steps"))
    within = Window.partitionBy("limit_id", "tokens", "slice").orderBy("id", "part_no")
    ranked = (
        rests.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["limit_id", "tokens", "slice"])
        .withColumn("rank", F.col("rank") + F.col("offset"))
        .select("limit_id", "tokens", "id", "part_no", "rank")
    )
    looked = ranked.join(F.broadcast(steps), ["limit_id", "tokens"])

    # The step that holds the rank is found by built-in functions, within the JVM.
    step = F.element_at(F.filter("steps", lambda s: s["first_rank"] <= F.col("rank")), -1)
    return looked.withColumn("step", step).select(
        "limit_id", "id", "part_no",
        (F.col("step.first_request") + F.floor((F.col("rank") - F.col("step.first_rank")) / F.col("step.per_request"))).alias("request_no"),
        "tokens",
    )


def fill(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: requests used, the fewest that could do, tokens, and the share of room that is filled."""
    used = packed.where("request_no is not null").groupBy("limit_id").agg(
        F.countDistinct("request_no").alias("requests"), F.sum("tokens").alias("tokens")
    )
    return used.join(F.broadcast(limits.select("limit_id", "capacity_tokens")), "limit_id").select(
        "limit_id", "requests", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"), "tokens",
        F.round(F.col("tokens") / (F.col("requests") * F.col("capacity_tokens")), 4).alias("filled"),
    )
