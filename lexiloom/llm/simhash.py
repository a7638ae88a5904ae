"""SimHash near-dedup with a segment-popcount embedding.

Fingerprint: per bit, the majority over the XXH64 of all 4-word shingles.

Embedding: the 64 bits are cut into 32 segments of two bits and mapped to
their bit counts, 0 to 2. The Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints. The counts are held as
thermometer codes (0 -> 00, 1 -> 01, 2 -> 11), so one word holds the vector
and the Manhattan distance is the popcount of an XOR.

Grid range-join: the 32 axes are dealt into ``groups`` grids. A distance of at
most d leaves at least groups - d of them at distance zero, so points within
range share a cell in at least one choice of groups - d grids. Points meet per
cell, the Manhattan bound filters, and the exact Hamming distance decides.
A cell yields the edges of a spanning forest, never its pairs. Cells of more
than ``SLICE`` points are cut into slices that meet two by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shelf import Shelf

LOW = 0x5555555555555555
#: Points of one cell that are compared in one task.
SLICE = 4096
SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a text, as an unsigned integer; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    ones, step = np.zeros(64, dtype=np.int64), 1 << 16
    for at in range(0, last, step):
        own = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(last, at + step))]
        bits = np.unpackbits(np.array(own, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed long, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Thermometer codes of the two-bit segments' counts."""
    low, one = np.uint64(LOW), np.uint64(1)
    some, both = (fp | (fp >> one)) & low, fp & (fp >> one) & low
    return some | (both << one)


def spanning_edges(fps: np.ndarray, within: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the graph 'Hamming distance <= within'.

    Breadth first; what is reached leaves the set that is compared, so dense
    groups cost about one pass a member at first and far less later.
    """
    codes, left, out = embed(fps), np.arange(len(fps)), []
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            c = queue.pop()
            near = np.bitwise_count(codes[left] ^ codes[c]) <= within
            near[near] = np.bitwise_count(fps[left[near]] ^ fps[c]) <= within
            hit, left = left[near], left[~near]
            if hit.size:
                out.append((np.full(hit.size, fps[c]), fps[hit]))
                queue.extend(hit)
    return out


def grids_for(n: int, within: int) -> int:
    """So many grids that a cell holds some 64 of n points: a segment's count of 0, 1 or 2 is worth 1.5 bits, and a cell fixes the segments of all grids but ``within``. Seven at least."""
    groups = within + 3
    while 48 * (groups - within) / groups < np.log2(max(1, n)) - 6 and groups < 32:
        groups += 1
    return groups


def _grid_masks(groups: int, within: int) -> list[int]:
    cuts = [round(i * 32 / groups) for i in range(groups + 1)]
    own = [sum(3 << (2 * axis) for axis in range(cuts[i], cuts[i + 1])) for i in range(groups)]
    return [sum(c) for c in combinations(own, groups - within)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _meet(within: int, limit: int):
    """Cells, sorted, to edges (part -1), and to the members of cells beyond the limit."""
    names = ["mask", "cell", "part", "a", "b"]

    def batch(mask, cell, part, a, b) -> pa.RecordBatch:
        n = len(a)
        full = lambda x, kind: pa.array(np.broadcast_to(np.asarray(x, dtype=kind), n))
        return pa.RecordBatch.from_arrays([full(mask, np.int32), full(cell, np.int64), full(part, np.int32), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    def edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        return batch(0, 0, -1, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part = None, np.empty(0, dtype=np.uint64), 0  # the cell that may go on in the next batch

        def close() -> Iterator[pa.RecordBatch]:
            if part:
                if held.size:
                    yield batch(*key, part, held, held)
            elif held.size > 1 and (found := spanning_edges(held, within)):
                yield edges(found)

        for rows in batches:
            if not rows.num_rows:
                continue
            mask, cell = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            fps = rows.column(2).to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (cell[1:] != cell[:-1])])
            ends = np.r_[starts[1:], len(fps)]
            found = []
            sizes = ends - starts
            twos = starts[1:-1][sizes[1:-1] == 2]
            if twos.size:
                a, b = fps[twos], fps[twos + 1]
                near = np.bitwise_count(embed(a) ^ embed(b)) <= within
                near[near] = np.bitwise_count(a[near] ^ b[near]) <= within
                found.append((a[near], b[near]))
            more = np.flatnonzero(sizes > 2)
            for i in sorted({0, len(starts) - 1, *more.tolist()}):
                own, new = fps[starts[i] : ends[i]], (mask[starts[i]], cell[starts[i]])
                if i not in (0, len(starts) - 1) and own.size <= limit:
                    found += spanning_edges(own, within)
                    continue
                if new != key:
                    yield from close()
                    key, held, part = new, own, 0
                else:
                    held = np.concatenate([held, own])
                while held.size > limit:
                    yield batch(*key, part, held[:limit], held[:limit])
                    held, part = held[limit:], part + 1
            if found and sum(len(x[0]) for x in found):
                yield edges(found)
        if key is not None:
            yield from close()

    return run


def near_edges(points: DataFrame, shelf: Shelf, within: int = 4, groups: int = 7, limit: int = SLICE) -> DataFrame:
    """(a, b) for distinct fingerprints ``points(fp)``: edges that span every group of the graph 'at most ``within`` bits'."""
    fp = F.col("fp")
    down = F.shiftrightunsigned(fp, 1)
    code = fp.bitwiseOR(down).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(down).bitwiseAND(F.lit(LOW)), 1))
    masks = [_signed(m) for m in _grid_masks(groups, within)]
    cells = (
        points.select("fp", code.alias("code"))
        .select("fp", "code", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask", "bits"))
        .select("mask", F.col("code").bitwiseAND(F.col("bits")).alias("cell"), "fp")
    )
    met = shelf.keep(cells.repartition("mask", "cell").sortWithinPartitions("mask", "cell", "fp").mapInArrow(_meet(within, limit), "mask int, cell long, part int, a long, b long"))
    found, large = met.where("part < 0").select("a", "b"), met.where("part >= 0")
    if large.head(1):
        slices = large.groupBy("mask", "cell").agg((F.max("part") + 1).alias("parts"))
        dealt = (
            large.join(slices, ["mask", "cell"])
            .select("mask", "cell", "part", "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            .select("mask", "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "a")
        )

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            own = spanning_edges(np.unique(pdf["a"].to_numpy().view(np.uint64)), within)
            a, b = (np.concatenate([x[i] for x in own]).view(np.int64) if own else np.empty(0, dtype=np.int64) for i in (0, 1))
            return pd.DataFrame({"a": a, "b": b})

        found = found.union(dealt.groupBy("mask", "cell", "i", "j").applyInPandas(block, "a long, b long"))
    return found


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, within: int = 4, groups: int | None = None, limit: int = SLICE) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at ``within`` or fewer differing bits; component_id is the
    smallest id reachable. ``groups``: the number of grids, by the number of
    fingerprints if not given. Null, empty and wordless texts have fingerprint zero
    and link like any other. Rows that repeat an id are returned each; a null id
    is never a component's name unless no other is there. Extra columns of any
    name are ignored; an empty table gives an empty result. Text of any length
    is processed whole, in bounded blocks.
    """
    shelf = Shelf(docs.sparkSession)
    marked = shelf.keep(fingerprints(docs, id_col, text_col, shingle))
    n = marked.count()
    # A node is a fingerprint behind its smallest id, so a component's name is the answer; nulls come last.
    points = shelf.keep(marked.groupBy("fp").agg(F.min("id").alias("rep")).select("fp", F.struct(F.col("rep").isNull().alias("none"), "rep", "fp").alias("node")), n)
    edges = near_edges(points.select("fp"), shelf, within, groups or grids_for(points.count(), within), limit)
    named = edges.join(points.select(F.col("fp").alias("a"), F.col("node").alias("u")), "a").join(points.select(F.col("fp").alias("b"), F.col("node").alias("v")), "b")
    parts = connected_components(named.select("u", "v"), "u", "v", shelf, edges.count())
    found = parts.select(F.col("node.fp").alias("found"), F.col("component.rep").alias("of"))
    lookup = points.join(found, F.col("fp") == F.col("found"), "left").select("fp", F.when(F.col("found").isNull(), F.col("node.rep")).otherwise(F.col("of")).alias("component_id"))
    return marked.join(lookup, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
