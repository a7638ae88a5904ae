"""Document fingerprints: SimHash over weighted terms, block tables, and the likeness of edited texts.

Terms are shingles of words; a term that a text holds n times weighs the bit
length of n, so that a line repeated a thousand times doesn't outvote the
rest. Each term's XXH64 votes with its weight for or against every bit.

Two fingerprints that differ in at most d bits agree in all but d of ``blocks``
blocks of bits, so in at least one table keyed by ``blocks`` - d of them. A
table's key holds the chosen blocks in front, as a sorted table of permuted
fingerprints would; equal keys meet, and the exact distance decides. A pair
counts in the first of the tables where it meets. Cells of more than ``SLICE``
fingerprints are cut into slices that meet two by two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shelf import Shelf

SEED = 42
SHINGLE = 5
RADIUS = 3
#: Fingerprints of one cell that are compared in one task.
SLICE = 4096
#: Rows of a comparison that are held as a matrix at once.
STRIP = 256
#: Texts that are Python strings at once.
ROWS = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint; fewer words than ``shingle`` are one term, none: 0. A tied vote leaves the bit unset."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    terms = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))), dtype=np.uint64)
    terms, counts = np.unique(terms, return_counts=True)
    weights, votes, step = np.frexp(counts)[1].astype(np.int64), np.zeros(64, dtype=np.int64), 1 << 16
    for at in range(0, len(terms), step):
        bits = np.unpackbits(terms[at : at + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weights[at : at + step] @ bits
    return int.from_bytes(np.packbits(2 * votes > weights.sum(), bitorder="little").tobytes(), "little")


def edited(text: str, after: str) -> str:
    """``text`` with its last half, rounded down, replaced by as many first code points of ``after``, or all of it."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


ROW = "id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _row(key: int | None, text: str, fp: int, after: str, after_fp: int, shingle: int) -> tuple:
    new = edited(text, after)
    new_fp = fingerprint(new, shingle)
    return key, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), _signed(fp), _signed(new_fp), likeness(fp, new_fp), likeness(fp, after_fp)


def _batches(rows: Iterator[tuple], names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema)


def _schema(ddl: str) -> tuple[list[str], pa.Schema]:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    fields = [f.split() for f in ddl.split(", ")]
    return [f[0] for f in fields], pa.schema([(name, kinds[kind]) for name, kind in fields])


def edited_fingerprints(docs: DataFrame, shelf: Shelf, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``ROW`` per row of ``docs``: each text against its edit by the next in descending id (nulls last, ties by a hash of the text).

    One shuffle by ranges puts the texts in order; a task then sees each text's
    successor but for its last, which a small join with the next range's first
    completes. Two texts are held at a time.
    """
    spark = docs.sparkSession
    order = [F.col("id").desc_nulls_last(), F.col("tie"), F.col("nth")]  # ``nth`` only deals out rows that are alike in all else
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    ddl = f"{ROW}, part int, edge string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, schema = _schema(ddl)
        part = TaskContext.get().partitionId()

        def edge(what: str, key: int | None, text: str, fp: int) -> tuple:
            return key, None, None, _signed(fp), None, None, None, part, what, text

        def made() -> Iterator[tuple]:
            before = None
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                        now = key, text, fingerprint(text, shingle)
                        yield edge("first", *now) if before is None else (*_row(*before, now[1], now[2], shingle), part, None, None)
                        before = now
            if before is not None:
                yield edge("last", *before)

        yield from _batches(made(), names, schema)

    met = shelf.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(run, ddl))
    edges = met.where("edge is not null")
    parts = sorted(r["part"] for r in edges.where("edge = 'first'").select("part").collect())  # a number per partition
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    lasts = edges.where("edge = 'last'").select("part", "id", "fp", "text").join(follows, "part")
    pairs = lasts.join(edges.where("edge = 'first'").select(F.col("part").alias("next"), F.col("fp").alias("next_fp"), F.col("text").alias("next_text")), "next").select("id", "fp", "text", "next_fp", "next_text")

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, schema = _schema(ROW)
        wide = (1 << 64) - 1
        yield from _batches((_row(k, t, f & wide, nt, nf & wide, shingle) for b in batches for k, f, t, nf, nt in zip(*(c.to_pylist() for c in b.columns), strict=True)), names, schema)

    return met.where("edge is null").select(*_schema(ROW)[0]).union(pairs.mapInArrow(complete, ROW))


def blocks_for(n: int, within: int) -> int:
    """So many blocks that a table's key, all blocks but ``within``, tells n fingerprints apart to some 64 a cell; one more than ``within`` at least, 16 at most."""
    blocks = within + 1
    while 64 * (blocks - within) / blocks < np.log2(max(1, n)) - 6 and blocks < 16:
        blocks += 1
    return blocks


def block_masks(blocks: int) -> list[int]:
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]


def _keyed(points: DataFrame, blocks: int, within: int) -> DataFrame:
    """(table, cell, fp): each fingerprint in each table, by its chosen blocks."""
    masks = block_masks(blocks)
    tables = [F.lit(_signed(sum(masks[i] for i in c))).cast("long") for c in combinations(range(blocks), blocks - within)]
    return points.select("fp", F.posexplode(F.array(*tables)).alias("table", "mask")).select("table", F.col("fp").bitwiseAND(F.col("mask")).alias("cell"), "fp")


def _tallies(a: np.ndarray, b: np.ndarray, earlier: list[np.uint64], within: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of b are near each of a, and the reverse, but for pairs that meet in a table before: a block that would make an earlier table is equal. In strips of bounded size."""
    rows, columns = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    for at in range(0, len(a), STRIP):
        apart = a[at : at + STRIP, None] ^ b[None, :]
        near = np.bitwise_count(apart) <= within
        for mask in earlier:
            near &= (apart & mask) != 0
        rows[at : at + STRIP] = near.sum(axis=1)
        columns += near.sum(axis=0)
    return rows, columns


def near_counts(points: DataFrame, shelf: Shelf, within: int = RADIUS, blocks: int | None = None, limit: int = SLICE) -> DataFrame:
    """(fp, near) for distinct fingerprints ``points(fp)``: how many others are within ``within`` bits; those without any aren't listed.

    Exact: slices of a crowded cell meet two by two, each pair of slices in a
    task, and give sums, never pairs.
    """
    n = points.count()
    blocks = blocks or blocks_for(n, within)
    if blocks <= within:
        raise ValueError("more blocks than differing bits are needed")
    masks = [np.uint64(m) for m in block_masks(blocks)]
    before = [[masks[i] for i in range(c[-1]) if i not in c] for c in combinations(range(blocks), blocks - within)]

    def within_cell(table: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = _tallies(fps, fps, before[table], within)[0] - (0 if before[table] else 1)  # itself, unless an earlier table holds it
        return fps[near > 0], near[near > 0]

    names = ["table", "cell", "part", "fp", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part = None, np.empty(0, dtype=np.uint64), 0  # the cell that may go on in the next batch

        def batch(table: int, cell: int, part: int, fps: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
            full = lambda x, kind: pa.array(np.full(len(fps), x, dtype=kind))
            return pa.RecordBatch.from_arrays([full(table, np.int32), full(cell, np.int64), full(part, np.int32), pa.array(fps.view(np.int64)), pa.array(near.astype(np.int64))], names=names)

        def close() -> Iterator[pa.RecordBatch]:
            if key is None or not held.size:
                return
            if part:
                yield batch(*key, part, held, np.zeros(held.size))
            elif held.size > 1:
                yield batch(*key, -1, *within_cell(key[0], held))

        for rows in batches:
            if not rows.num_rows:
                continue
            table, cell, fps = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (cell[1:] != cell[:-1]), True])
            sizes = np.diff(cuts)
            inner = np.flatnonzero((sizes[1:-1] > 1) & (sizes[1:-1] <= limit)) + 1
            done = [(within_cell(table[cuts[i]], fps[cuts[i] : cuts[i + 1]])) for i in inner]
            if done:
                yield batch(0, 0, -1, *(np.concatenate([x[k] for x in done]) for k in (0, 1)))
            for i in sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > limit).tolist()}):
                own, new = fps[cuts[i] : cuts[i + 1]], (table[cuts[i]], cell[cuts[i]])
                if new == key:
                    held = np.concatenate([held, own])
                else:
                    yield from close()
                    key, held, part = new, own, 0
                while held.size > limit:
                    yield batch(*key, part, held[:limit], np.zeros(limit))
                    held, part = held[limit:], part + 1
        yield from close()

    met = shelf.keep(_keyed(points, blocks, within).repartition("table", "cell").sortWithinPartitions("table", "cell", "fp").mapInArrow(run, "table int, cell long, part int, fp long, near long"), n * len(before))
    found, crowded = met.where("part < 0").select("fp", "near"), met.where("part >= 0").drop("near")
    if crowded.head(1):
        slices = crowded.groupBy("table", "cell").agg((F.max("part") + 1).alias("parts"))
        dealt = (
            crowded.join(slices, ["table", "cell"])
            .select("table", "cell", "part", "fp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            .select("table", "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp")
        )

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            table, i, j = (int(pdf[c].iat[0]) for c in ("table", "i", "j"))
            side = lambda k: pdf.loc[pdf["part"] == k, "fp"].to_numpy().view(np.uint64)
            if i == j:
                fps, near = within_cell(table, side(i))
            else:
                a, b = side(i), side(j)
                fps, near = np.concatenate([a, b]), np.concatenate(_tallies(a, b, before[table], within))
            return pd.DataFrame({"fp": fps.view(np.int64), "near": near})

        found = found.union(dealt.groupBy("table", "cell", "i", "j").applyInPandas(block, "fp long, near long"))
    return found.where("near > 0").groupBy("fp").agg(F.sum("near").alias("near"))


def find_near(queries: DataFrame, points: DataFrame, within: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(query, fp, bits): all fingerprints of ``points(fp)`` within ``within`` bits of each of ``queries(fp)``, a stated set; both distinct first, nulls never near."""
    blocks = blocks or blocks_for(points.count(), within)
    asked = _keyed(queries.select("fp").distinct(), blocks, within).withColumnRenamed("fp", "query")
    bits = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return asked.join(_keyed(points.select("fp").distinct(), blocks, within), ["table", "cell"]).select("query", "fp", bits.alias("bits")).where(F.col("bits") <= within).distinct()


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, within: int = RADIUS, blocks: int | None = None, limit: int = SLICE) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_same, n_near) for every row of ``docs``.

    ``n_same``: other rows of the same fingerprint; ``n_near``: other fingerprints
    within ``within`` bits. Null and empty texts have fingerprint 0 and no
    characters; null ids come last in the order, rows that repeat an id are
    ordered by a hash of their text. A single row is its own next. Extra columns
    of any name are ignored, an empty table gives an empty result, texts of any
    length are read whole.
    """
    shelf = Shelf(docs.sparkSession)
    made = edited_fingerprints(docs, shelf, id_col, text_col, shingle)
    points = shelf.keep(made.groupBy("fp").agg((F.count("*") - 1).alias("n_same")), made.count())
    near = points.join(near_counts(points.select("fp"), shelf, within, blocks, limit), "fp", "left").select(F.col("fp").alias("own"), "n_same", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return made.join(near, F.col("fp") == F.col("own")).select("id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_same", "n_near")
