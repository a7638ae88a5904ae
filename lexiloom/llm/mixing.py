"""Mixing sources to target weights by entropy balancing.

A document may be taken up to ``most`` = 2 times. Its base rate is a binomial
with two trials; tilting it exponentially by lambda * size * copies gives the
expected rate 2 * sigmoid(lambda * size / scale), the closest rates in entropy
that meet the source's token target. The dual is convex and has one unknown a
source; each Newton step is one distributed aggregate over the histogram of
sizes, in fixed-point sums, so reruns agree to the bit. The rates are then
rounded into copies by error diffusion from long to short documents, in chunks
dealt by a hash of the id and of a number among the rows that are alike in id,
source and size; so neither a source nor the rows of a repeated or missing id
land in one task, and the deal doesn't depend on how rows are split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shelf import Shelf

CHUNK = 8192
FIXED = float(1 << 20)
STEPS = 40


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, key_col: str | None = None) -> DataFrame:
    """(id, source, size, key): the number of words, runs without ASCII white space; key: zero without ``key_col``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.fromiter((len(t.as_buffer().to_pybytes().split()) if t.is_valid else 0 for t in batch.column(2)), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), batch.column(3)], names=["id", "source", "size", "key"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), (F.col(key_col) if key_col else F.lit(0)).cast("long").alias("key")).mapInArrow(run, "id long, source string, size long, key long")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with nth: a number from zero among those alike in every column, which makes them interchangeable; they are counted and dealt out again, never gathered."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")


def targets(sizes: DataFrame, shelf: Shelf, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, get the weights in turn and share
    ``share`` times all words. A target stops at ``most`` times its source; the
    excess goes to the others by weight until none is above. That limit is one
    cut in the order of source_size / weight, found with running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("r", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("r") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    first = Window.orderBy(F.col("cap") / F.col("w"), "r").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("cap") / F.col("w"), "r").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(first), F.lit(0.0))
    level = (left / F.sum("w").over(rest)).alias("level")
    cut = w.select("source", "source_size", "w", "cap", "r", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    final = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("k"), "r", "level"))).over(everything)
    return cut.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final.level") * F.col("w"))).alias("target"))


def _newton(hist: DataFrame, goals: DataFrame, shelf: Shelf, most: float, few: int) -> DataFrame:
    """(source, lam, scale): lam in units of 1 / scale, the source's mean size.

    Safeguarded Newton: a step that leaves the bracket is a bisection. Targets
    at the cap have lam = null; every rate is then ``most``.
    """
    key = F.coalesce(F.col("source"), F.lit(""))
    none = F.col("source").isNull()
    g = hist.groupBy("source").agg(F.sum("n").alias("docs")).withColumnRenamed("source", "s2")
    state = goals.join(g, F.col("source").eqNullSafe(F.col("s2"))).select(
        key.alias("k"), none.alias("k0"), "target", (F.col("source_size") / F.col("docs")).alias("scale"),
        F.lit(-1024.0).alias("lo"), F.lit(1024.0).alias("hi"), F.lit(0.0).alias("lam"), (F.col("target") >= most * F.col("source_size")).alias("full"), F.lit(False).alias("done"),
    )
    state = shelf.keep(state.withColumn("done", F.col("full") | (F.col("scale") == 0)), few)
    h = hist.select(key.alias("hk"), none.alias("h0"), "size", "n")
    for _ in range(STEPS):
        if not state.where("not done").head(1):
            break
        open_ = state.where("not done").select("k", "k0", "lam", "scale")
        x = F.col("size") / F.col("scale")
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("lam") * x))))
        sums = (
            h.join(open_, (h.hk == open_.k) & (h.h0 == open_.k0))
            .select("k", "k0", (F.col("n") * F.round(most * p * F.col("size") * FIXED)).cast("decimal(38,0)").alias("a"), (F.col("n") * F.round(most * p * (1 - p) * F.col("size") * x * FIXED)).cast("decimal(38,0)").alias("b"))
            .groupBy("k", "k0").agg((F.sum("a").cast("double") / FIXED).alias("got"), (F.sum("b").cast("double") / FIXED).alias("slope"))
        )
        off = F.col("got") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - off / F.col("slope")
        far = (F.col("slope") <= 0) | (step <= F.col("nlo")) | (step >= F.col("nhi"))
        near = F.abs(off) <= 0.25 + 1e-9 * F.col("target")
        after = (
            state.join(sums, ["k", "k0"], "left").withColumn("nlo", lo).withColumn("nhi", hi)
            .withColumn("ok", F.col("done") | F.coalesce(near, F.lit(True)))
            .withColumn("next", F.when(F.col("ok"), F.col("lam")).when(far, (F.col("nlo") + F.col("nhi")) / 2).otherwise(step))
            .select("k", "k0", "target", "scale", F.when(F.col("ok"), F.col("lo")).otherwise(F.col("nlo")).alias("lo"), F.when(F.col("ok"), F.col("hi")).otherwise(F.col("nhi")).alias("hi"), F.col("next").alias("lam"), "full", F.col("ok").alias("done"))
        )
        after = shelf.keep(after, few)
        shelf.drop(state)
        state = after
    return state.select("k", "k0", "target", "scale", F.when(~F.col("full"), F.col("lam")).alias("lam"))


def diffuse(size: np.ndarray, rate: np.ndarray, most: int) -> np.ndarray:
    """Copies of documents, long ones first; the error in words is carried on to the next."""
    copies, carry = [], 0.0
    for n, r in zip(size.tolist(), rate.tolist(), strict=True):
        want = r * n + carry
        c = min(most, max(0, int(want / n + 0.5))) if n else int(r + 0.5)
        carry = want - c * n
        copies.append(c)
    return np.array(copies, dtype=np.int64)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, chunk: int = CHUNK, key_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) per row of ``docs``.

    Null texts have size 0; a null source is a source, the last one; a document
    without words is rounded by its rate alone and takes no words. Repeated rows
    are dealt one by one; ``key_col``, a number of each row, comes back as ``key``
    to tell them apart. Sources of one size of zero words have target 0. Extra
    columns are ignored; an empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession)
    rows = shelf.keep(sized(docs, id_col, text_col, source_col, key_col))
    hist = shelf.keep(rows.groupBy("source", "size").agg(F.count("*").alias("n")), rows.count())
    few = hist.select("source").distinct().count()
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    goals = shelf.keep(targets(totals.drop("docs"), shelf, weights, share, most), few)
    lams = shelf.keep(_newton(hist, goals, shelf, float(most), few), few)
    docs_of = totals.select(F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("k0"), "source_size", "docs")
    info = shelf.keep(lams.join(docs_of, ["k", "k0"]), few)
    keyed = numbered(rows).select("id", "source", "size", "key", "nth", F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("k0"))
    x = F.when(F.col("scale") > 0, F.col("lam") * F.col("size") / F.col("scale")).otherwise(F.lit(0.0))
    rate = F.when(F.col("lam").isNull(), F.lit(float(most))).otherwise(most / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x)))))
    rated = keyed.join(info, ["k", "k0"]).select("id", "source", "size", "key", "source_size", "target", rate.alias("rate"), F.pmod(F.xxhash64("id", "size", "key", "nth"), F.ceil(F.col("docs") / chunk)).alias("chunk"), "k", "k0")
    names = ["id", "source", "size", "source_size", "target", "rate", "key"]

    def per_chunk(table: pa.Table) -> pa.Table:
        own = table.select(names).combine_chunks().sort_by([("size", "descending"), ("id", "ascending"), ("key", "ascending")])
        return own.append_column("copies", pa.array(diffuse(own["size"].to_numpy(), own["rate"].to_numpy(), most)))

    out = rated.groupBy("k", "k0", "chunk").applyInArrow(per_chunk, "id long, source string, size long, source_size long, target double, rate double, key long, copies long")
    return out if key_col else out.drop("key")
