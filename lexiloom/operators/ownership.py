"""Who owns a word where: claims of (word, concept, prefix) whose scopes meet.

A prefix covers itself and all beneath it, so two scopes meet only if one lies
in the other: prefixes are nested intervals in component order. One sorted
sweep over ranges of (word, prefix) finds what encloses each prefix; a range
begins with what encloses its first row, looked up by equality with that row's
own beginnings. Neither pairs of claims nor a word's claims meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .topk import per_key

#: Between components, so that a prefix is followed by what lies beneath it.
SEP = "\x01"


def _key(prefix: Column) -> Column:
    return F.coalesce(F.replace(prefix, F.lit("/"), F.lit(SEP)), F.lit(""))


def _above(key: str) -> list[str]:
    """A key's beginnings, the whole first, itself last."""
    parts = key.split(SEP) if key else []
    return ["", *(SEP.join(parts[:i]) for i in range(1, len(parts) + 1))]


def _push(stack: list[tuple], key: str, first: str, second: str | None) -> None:
    """A level under those open: its outermost owner, and for that owner's claims the outermost other one."""
    if not stack:
        stack.append((key, first, second))
    else:
        _, owner, other = stack[-1]
        stack.append((key, owner, other if other is not None else first if first != owner else second))


def ownership_conflicts(claims: DataFrame) -> DataFrame:
    """(word, concept, prefix, owner): every distinct claim that lies in, or at, a claim of the same word by another concept.

    ``claims(word, concept, prefix)``; a null or empty prefix claims the whole
    repository, null words and concepts claim nothing. ``owner`` is of the
    outermost such claim, of several concepts there the least. Prefixes are
    literal relative paths. A word's scopes are disjoint if it has no row here.
    """
    spark = claims.sparkSession
    own = claims.where("word is not null and concept is not null").select("word", "concept", F.nullif("prefix", F.lit("")).alias("prefix"), _key(F.col("prefix")).alias("key")).distinct()
    # Another concept than a claim's own is among the two least of a prefix, if there is any.
    two = per_key(own.select("word", "key", "concept").distinct(), ["word", "key"], 2, F.asc("concept")).groupBy("word", "key").agg(F.min("concept").alias("first"), F.max(F.when(F.col("rank") == 2, F.col("concept"))).alias("second"))
    levels = cut(two.repartitionByRange("word", "key").sortWithinPartitions("word", "key").withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    begins = levels.groupBy("part").agg(F.min_by(F.struct("word", "key"), "place").alias("at")).collect()  # a row a part
    asked = [(r["part"], r["at"]["word"], k, i) for r in begins for i, k in enumerate(_above(r["at"]["key"])[:-1])]
    found = levels.drop("part").join(F.broadcast(spark.createDataFrame(asked, "part long, word string, key string, depth int")), ["word", "key"]).collect()  # at most a row a part and depth
    entering: dict[int, list[tuple]] = {}
    for r in sorted(found, key=lambda r: (r["part"], r["depth"])):
        _push(entering.setdefault(r["part"], []), r["key"], r["first"], r["second"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, word, stack = None, None, []
        for batch in batches:
            owners, others = [], []
            columns = [c.to_pylist() for c in batch.columns]
            for part, w, key, first, second in zip(*columns, strict=True):
                if part != now:
                    now, word, stack = part, w, list(entering.get(part, ()))
                elif w != word:
                    word, stack = w, []
                while stack and stack[-1][0] and not key.startswith(stack[-1][0] + SEP):
                    stack.pop()
                _push(stack, key, first, second)
                owners.append(stack[-1][1]), others.append(stack[-1][2])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(owners, pa.string()), pa.array(others, pa.string())], names=["word", "key", "owner", "other"])

    dealt = levels.select("part", "place", "word", "key", "first", "second").repartition("part").sortWithinPartitions("part", "place").select("part", "word", "key", "first", "second")
    swept = dealt.mapInArrow(sweep, "word string, key string, owner string, other string")
    met = own.join(swept, ["word", "key"]).withColumn("owner", F.when(F.col("owner") != F.col("concept"), F.col("owner")).otherwise(F.col("other")))
    return met.where("owner is not null").select("word", "concept", "prefix", "owner")
