"""Filter interaction audit: every order of a set of filters replayed over the documents' flags.

A document's fate under all orders depends on its flags alone, so documents of
one part with the same flags and outcomes are counted first, before any
shuffle. The profiles meet a broadcast table of all orders (120 of five
filters), each order is exploded into its steps, the first failure says where
a document goes, and conditional sums are combined on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shelf import Shelf

WORD = r"[^\x20\x09-\x0D]+"
#: So many filters make at most 5,040 orders to broadcast.
MOST_FILTERS = 7


def text_flags(text: Column) -> dict[str, Column]:
    """The conditions, true on failure, that a text alone decides: A few words, B few distinct words, C capitals, D symbols. No word: only A fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A to E, good, toxic) for every row of ``docs``.

    E fails where a row of a smaller id has the same text. Texts meet by digest
    and smallest id, so a text of a third of all rows is no hot key. Rows that
    share an id don't fail each other; a null id is smaller than none and has
    none below it. A null text is empty, a null part the empty string. ``labels``
    may repeat ids or lack them: any row that says 1 counts.
    """
    shelf = Shelf(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), text.alias("text"))
    own = shelf.keep(plain.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in text_flags(F.col("text")).items()]))
    first = own.groupBy("digest").agg(F.min("id").alias("least")).select(F.col("digest").alias("same"), "least", F.lit(True).alias("is_first"))
    told = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = own.join(first, (F.col("digest") == F.col("same")) & (F.col("id") == F.col("least")), "left").join(told, F.col("id") == F.col("of"), "left")
    later = F.col("id").isNotNull() & F.col("is_first").isNull()
    return met.select("part", "A", "B", "C", "D", later.alias("E"), *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])


def replay_orders(flags: DataFrame, filters: Sequence[str] = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row per part, order and step.

    ``flags``: part, a column per filter (true: the document fails it; null
    counts as false), good and toxic. ``kept``: documents left after the step;
    ``removed``: first failure here; ``redundant``: fails this filter, removed
    before; ``unique_fails``: fails this filter alone; ``shapley``: documents
    that the step's filter removes, summed over all orders. An empty table has
    no parts and so no rows; extra columns are ignored.
    """
    if not filters or len(set(filters)) < len(filters) or len(filters) > MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} distinct filters are needed")
    spark = flags.sparkSession
    sure = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(False))
    own = flags.select("part", F.array(*[sure(c) for c in filters]).alias("fails"), sure("good").alias("good"), sure("toxic").alias("toxic"))
    profiles = own.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    orders = spark.createDataFrame([("".join(filters[i] for i in p), [i + 1 for i in p]) for p in permutations(range(len(filters)))], "filter_order string, places array<int>")
    crossed = profiles.crossJoin(F.broadcast(orders)).withColumn("verdicts", F.transform("places", lambda i: F.element_at("fails", i)))
    steps = crossed.select("part", "filter_order", "places", "good", "toxic", "n", F.array_position("verdicts", F.lit(True)).alias("first"), F.size(F.filter("fails", lambda x: x)).alias("failed"), F.posexplode("verdicts").alias("at", "here"))
    step, first, here = F.col("at") + 1, F.col("first"), F.col("here")
    removed = step == first
    tally = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    sums = steps.groupBy("part", "filter_order", step.alias("step"), F.element_at("places", step).alias("place")).agg(
        tally((first == 0) | (step < first)).alias("kept"),
        tally(removed).alias("removed"),
        tally(here & (step > first)).alias("redundant"),
        tally(here & (F.col("failed") == 1)).alias("unique_fails"),
        tally(removed & F.col("good")).alias("good_lost"),
        tally(removed & F.col("toxic")).alias("toxic_lost"),
    )
    return sums.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "place"))).drop("place")


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``replay_orders`` of the five filters over whole documents; see there and ``document_flags`` for nulls, repeats and empty tables."""
    return replay_orders(document_flags(docs, labels, id_col, text_col, part_col))
