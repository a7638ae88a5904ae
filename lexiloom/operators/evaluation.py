"""How good predictions are, case by case and in all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(judged: DataFrame) -> DataFrame:
    """(case, tp, fp, fn, precision, recall, usefulness, false_alarms_per_1000, median_cost, p90_cost): a row a case and one, of a null case, for all.

    ``judged(case, found, expected, useful, cost)``: a row per item examined.
    ``usefulness``: of what was found, the share that a reviewer would use;
    false alarms are taken per 1,000 items; costs are exact percentiles. Null
    flags count as false, null costs are left out, and a share of nothing is
    null. A null case is named ``(none)``. An empty table gives the row for all alone.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    found, expected, useful = flag("found"), flag("expected"), flag("useful")
    plain = judged.select(F.coalesce(F.col("case").cast("string"), F.lit("(none)")).alias("case"), found.alias("found"), expected.alias("expected"), useful.alias("useful"), "cost")
    n = lambda when: F.count_if(when)
    f, e, u = F.col("found"), F.col("expected"), F.col("useful")
    aggregates = [
        n(f & e).alias("tp"), n(f & ~e).alias("fp"), n(e & ~f).alias("fn"),
        F.try_divide(n(f & e), n(f)).alias("precision"), F.try_divide(n(f & e), n(e)).alias("recall"), F.try_divide(n(f & u), n(f)).alias("usefulness"),
        F.round(F.try_divide(1000.0 * n(f & ~e), F.count("*")), 2).alias("false_alarms_per_1000"),
        F.median("cost").alias("median_cost"), F.percentile("cost", 0.9).alias("p90_cost"),
    ]
    return plain.groupBy("case").agg(*aggregates).union(plain.agg(F.lit(None).cast("string").alias("case"), *aggregates))
