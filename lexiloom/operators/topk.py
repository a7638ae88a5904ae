"""Ranked caps with coverage ledgers, per-key samples and running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def ledger(total: int, included: int, exact: bool = True, reasons: list[str] | None = None) -> dict:
    """How complete a collection is: complete only if exact, nothing dropped and no reason given."""
    reasons = list(dict.fromkeys(reasons or []))
    return {"total_items": total, "included_items": included, "dropped_items": total - included, "total_items_exact": exact, "complete": exact and total == included and not reasons, "reasons": reasons}


def carried(parent: dict, prefix: str) -> list[str]:
    """Reasons of an input, told as reasons of what was made from it."""
    return [f"{prefix}: {r}" for r in parent["reasons"]]


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of a total order: each task keeps k, one merge."""
    return df.orderBy(*order).limit(k)


def top_k_with_ledger(df: DataFrame, k: int, *order: Column, reason: str | None = None, exact: bool = True, reasons: list[str] | None = None) -> tuple[DataFrame, dict]:
    total = df.count()
    kept = min(total, k)
    return top_k(df, k, *order), ledger(total, kept, exact, [*(reasons or []), *([reason or f"the cap is {k} items"] if kept < total else [])])


def remainder(df: DataFrame, k: int, count_col: str, *order: Column) -> DataFrame:
    """One row: rows and occurrences beyond the first k."""
    top = top_k(df, k, *order).agg(F.count("*").alias("kept"), F.coalesce(F.sum(count_col), F.lit(0)).alias("kept_uses"))
    every = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(count_col), F.lit(0)).alias("uses"))
    return every.join(top).select((F.col("n") - F.col("kept")).alias("dropped_terms"), (F.col("uses") - F.col("kept_uses")).alias("dropped_uses"))


def per_key(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key; the rank limits every partition before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def locations(uses: DataFrame, key: str, k: int, grouped: bool = False) -> DataFrame:
    """(key, locations, locations_truncated) of ``uses(key, path, n)``: the k paths with most uses; ``grouped``: it has a row per key and path."""
    per_path = uses.withColumnRenamed("n", "count") if grouped else uses.groupBy(key, "path").agg(F.sum("n").alias("count"))
    # One row beyond k tells whether more are left out, so paths needn't be counted.
    best = per_key(per_path, [key], k + 1, F.desc("count"), F.asc("path"))
    lists = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "path", "count"))).alias("all"))
    shown = F.transform(F.slice("all", 1, k), lambda x: F.struct(x["path"].alias("path"), x["count"].alias("count")))
    return lists.select(key, shown.alias("locations"), (F.size("all") > k).alias("locations_truncated"))


def within_budget(df: DataFrame, cost: Column, budget: int, *order: Column) -> DataFrame:
    """Rows whose running cost in the order stays within the budget, without a single-task window.

    Rows are dealt by range in the order, part sums are added up (one row a
    part), and only the running sums inside each part are ordered windows.
    """
    # Written once: a deal by sampled ranges that was computed again could differ.
    parts = cut(df.withColumn("cost", cost).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.sum("cost").alias("own"))
    before = sums.withColumn("before", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    run = F.sum("cost").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(before, "part").withColumn("running", run + F.col("before")).where(F.col("running") <= budget).drop("part", "before")


def greedy_budget(df: DataFrame, cost: Column, budget: int, *order: Column) -> DataFrame:
    """``df`` with admitted: in the order, a row is admitted if its cost fits the room left by those admitted before; what doesn't fit is passed over.

    Exact, and not a walk: with room R, costs up to R/2 are small. All small
    rows are admitted up to the first row that ends the round: a small one that
    no longer fits, or a large one that does. Either leaves less than R/2, so the
    rounds are at most log2(budget), each a prefix sum as in ``within_budget``.
    The decision is a filter over the rounds' intervals. Costs are whole numbers
    from zero; a null or negative cost is never admitted.
    """
    spark = df.sparkSession
    # Sorted ranges, written once: the number of a row is its place in the order.
    placed = cut(df.withColumn("_cost", cost.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    slim = placed.select(F.col("_place").alias("place"), F.col("_cost").alias("cost"), F.shiftright("_place", 33).alias("part")).where("cost >= 0")
    room, start, admitted = budget, -1, F.lit(False)
    place, price = F.col("_place"), F.col("_cost")
    while True:
        half = room // 2
        rows = slim.where((F.col("place") > start) & (F.col("cost") <= room)).withColumn("small", F.when(F.col("cost") <= half, F.col("cost")).otherwise(0))
        sums = sorted((r["part"], r["own"]) for r in rows.groupBy("part").agg(F.sum("small").alias("own")).collect())  # a row a part
        before, offsets = 0, []
        for p, own in sums:
            offsets.append((p, before))
            before += own
        mine = F.coalesce(F.sum("small").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        run = rows.withColumn("mine", mine).join(F.broadcast(spark.createDataFrame(offsets, "part long, before long")), "part").withColumn("used", F.col("mine") + F.col("before"))
        fits = F.col("used") + F.col("cost") <= room
        stop = run.where(F.when(F.col("cost") <= half, ~fits).otherwise(fits)).agg(F.min(F.struct("place", "cost", "used")).alias("s")).head()["s"]
        taken = (place > start) & (price <= half)
        if stop is None:
            return placed.withColumn("admitted", F.coalesce((price >= 0) & (admitted | taken), F.lit(False))).drop("_cost", "_place")
        admitted = admitted | (taken & (place < stop["place"]))
        room, start = room - stop["used"], stop["place"]
        if stop["cost"] > half:
            admitted = admitted | (place == start)
            room -= stop["cost"]
