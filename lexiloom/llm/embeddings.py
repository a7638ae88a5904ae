"""Embedding near-dedup by NN-descent.

Equal vectors are one point with a number of copies. Points meet in several
random-hyperplane orders, block by block; only a sketch of a point travels there
(one byte a component, its scale and the length of its rounding error), and the
errors bound how far a sketched cosine may be off. Each point keeps a list of its
``K`` nearest; rounds of joins turn neighbours of neighbours, in either
direction, into candidates until a round finds no new link. Pairs whose sketches
can't tell are decided in double precision on the vectors themselves.

A list that holds ``K`` links is saturated. It is enlarged to its whole extent:
saturated points and all in whose lists they stand are cut into cells, every
member of which links to the cell's leader. By the triangle inequality, two cells
hold no link, or nothing but links, which their sizes count, or they are compared
member by member, which yields numbers, not pairs. So links of saturated lists are exact, and the kept edges of
all other lists are the rest.

Two audits measure the recall. Every point with an id divisible by ``EVERY``, its
own or that of a copy, is compared with all rows, in blocks, and one point in ``EVERY``, by a hash, sends a probe, a vector
at the threshold from it, into each order: the share of probes that meet their
vector holds for isolated pairs even where the data has few. Orders are added until both reach
``RECALL``; if they never do, all points are compared by way of their cells.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shelf import Shelf

#: Length of a list, points of a block, points compared for a cell's leaders.
K, BLOCK, CELLS = 8, 4096, 4096
#: Edges below this cosine lead nowhere; rounds of the descent; times that orders are added.
NEAR, ROUNDS, MORE = 0.8, 4, 4
#: The recall asked for, the audit's query ids, and the queries that are broadcast at once.
RECALL, EVERY, HELD = 0.95, 50, 8192
BITS = 20
#: In rows (a, a, s, sure): s of a saturated point, and sure of a probe that met its vector.
FULL, MET = 2.0, 2
#: By so much, in radians, an angle must clear a bound to count as proven.
SURE = 1e-6
#: Probes that a table sends at least, if it has as many points.
PROBES = 64
LOG = logging.getLogger(__name__)


def matrix(col: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length, stored as bytes, as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype=kind).reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; the largest component first, so no square over- or underflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sketch(u: np.ndarray) -> list[bytes]:
    """Per unit vector its scale, the length of the rounding error, and a byte a component."""
    scale = np.abs(u).max(axis=1, keepdims=True) / 127
    q = np.rint(u / scale).astype(np.int8)
    off = np.sqrt(((u - q * scale) ** 2).sum(axis=1))
    head = np.column_stack([scale[:, 0], off]).astype("<f4")
    return [h.tobytes() + row.tobytes() for h, row in zip(head, q, strict=True)]


def unsketch(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sketched vectors, and how far each may be off."""
    raw = np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(len(col), -1)
    head = np.ascontiguousarray(raw[:, :8]).view("<f4")
    return raw[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1] + np.float32(1e-5)


def _points(rows: DataFrame, kind: str) -> DataFrame:
    """(row_id, key, width, v) per row: v the vector's bytes, key their 128-bit digest; null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, col = batch.num_rows, batch.column(1)
            sizes = np.array([0 if s is None else s for s in col.value_lengths().to_pylist()], dtype=np.int64)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.array(0, dtype=kind)
            starts = np.r_[0, np.cumsum(sizes)[:-1]] if n else sizes
            vs: list[bytes | None] = [None] * n
            for width in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero((sizes == width) & known)
                x = flat[starts[at][:, None] + np.arange(width)]
                for i, row, fine in zip(at, x, np.isfinite(x).all(axis=1) & (x != 0).any(axis=1), strict=True):
                    if fine:
                        vs[i] = row.tobytes()
            keys = [None if v is None else xxhash.xxh3_128_digest(v) for v in vs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(vs, pa.binary())], names=["row_id", "key", "width", "v"])

    return rows.mapInArrow(run, "row_id long, key binary, width int, v binary")


def tables_for(n: int, threshold: float) -> int:
    """Orders in which a pair at the threshold shares a block with a chance of 0.98, by the chance of one sign a bit."""
    bits = min(BITS, max(0.0, log2(max(1, n) / BLOCK)))
    together = (1 - np.arccos(threshold) / np.pi) ** bits
    return 2 if together > 0.9 else ceil(log(0.02) / log(1 - together))


def _one_in(n: int) -> int:
    """One point in so many, of n, sends a probe."""
    return max(1, min(EVERY, n // PROBES))


def _probes(every: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(every)) == 0


def _start(points: DataFrame, kind: str, threshold: float, tables: range, n: int, k: int) -> DataFrame:
    """(a, b, s, sure) from blocks of each order: near edges of points with under ``k`` links in the block, else (a, a, FULL, 0); (a, a, 0, MET) for probes.

    sure: 1 a link, -1 none, 0 the sketches can't tell.
    """

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, u = batch.column(0).to_numpy(), unit(matrix(batch.column(1), kind))
            sketches = pa.array(sketch(u), pa.binary())
            asks = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            side = np.array([np.random.default_rng([5, i & 0xFFFFFFFF]).standard_normal(u.shape[1]) for i in ids[asks].tolist()]).reshape(len(asks), u.shape[1])
            side -= (side * u[asks]).sum(axis=1, keepdims=True) * u[asks]
            probes = threshold * u[asks] + (1 - threshold**2) ** 0.5 * side / np.maximum(np.sqrt((side * side).sum(axis=1, keepdims=True)), 1e-300)
            every, own = np.vstack([u, probes]), np.r_[ids, ids[asks]]
            q = pa.concat_arrays([sketches, pa.nulls(len(asks), pa.binary())])
            for t in tables:
                p = every @ np.random.default_rng([3, t]).standard_normal((BITS + 1, u.shape[1])).T
                code = ((p[:, :BITS] > 0) @ (1 << np.arange(BITS)[::-1])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, dtype=np.int32)), pa.array(code), pa.array(p[:, BITS]), pa.array(own), q], names=["t", "code", "p", "id", "q"])

    def meet(ids: np.ndarray, col: pa.Array) -> Iterator[pa.RecordBatch]:
        own = col.is_valid().to_numpy(zero_copy_only=False)
        met = np.intersect1d(ids[~own], ids[own])
        if met.size:
            yield _edges(met, met, np.zeros(met.size), np.full(met.size, MET))
        ids = ids[own]
        if len(ids) < 2:
            return
        x, off = unsketch(col.drop_null())
        for at in range(0, len(ids), 256):
            s = x[at : at + 256] @ x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
            many = np.flatnonzero((s >= NEAR).sum(axis=1) >= k)
            own_off = off[at + many, None]
            full = many[(s[many] + own_off + off[None, :] * (1 + own_off) >= threshold).sum(axis=1) >= k]
            if full.size:
                yield _edges(ids[at + full], ids[at + full], np.full(full.size, FULL), np.zeros(full.size))
                s[full] = -2
            i, j = np.nonzero(s >= NEAR)
            if i.size:
                s, slack = s[i, j], off[at + i] + off[j] + off[at + i] * off[j]
                sure = np.where(s - slack >= threshold, 1, np.where(s + slack < threshold, -1, 0))
                order = np.lexsort((-s, i))
                order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
                yield _edges(ids[at + i[order]], ids[j[order]], s[order].astype(np.float64), sure[order])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids, held = -1, np.empty(0, dtype=np.int64), pa.array([], pa.binary())
        for batch in batches:
            ts = batch.column(0).to_numpy()
            for t in np.unique(ts).tolist():
                at = np.flatnonzero(ts == t)
                if t != table:
                    yield from meet(ids, held)
                    table, ids, held = t, ids[:0], held[:0]
                ids = np.r_[ids, batch.column(3).to_numpy()[at]]
                held = pa.concat_arrays([held, batch.column(4).slice(at[0], len(at))])
                while len(ids) > BLOCK:  # neighbouring blocks share a quarter
                    yield from meet(ids[:BLOCK], held[:BLOCK])
                    ids, held = ids[BLOCK * 3 // 4 :], held[BLOCK * 3 // 4 :]
        yield from meet(ids, held)

    signed = points.select("id", "v", _probes(_one_in(n))).mapInArrow(signs, "t int, code long, p double, id long, q binary")
    parts = max(1, -(-n * len(tables) // (4 * BLOCK)))
    met = signed.repartitionByRange(parts, "t", "code", "p").sortWithinPartitions("t", "code", "p", "id").mapInArrow(blocks, "a long, b long, s double, sure int")
    return met.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("sure").alias("sure"))


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array(sure.astype(np.int32))], names=["a", "b", "s", "sure"])


def _cosines(pairs: DataFrame, vectors: DataFrame, kind: str, least: float, threshold: float) -> DataFrame:
    """(a, b, s, sure) in double precision for the pairs (a, b) of at least ``least``."""
    met = pairs.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(vectors.select(F.col("id").alias("b"), F.col("v").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", unit(matrix(batch.column(2), kind)), unit(matrix(batch.column(3), kind)))
                fine = s >= least
                yield _edges(batch.column(0).to_numpy()[fine], batch.column(1).to_numpy()[fine], s[fine], np.where(s[fine] >= threshold, 1, -1))

    return met.mapInArrow(run, "a long, b long, s double, sure int")


def _descend(edges: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b: neighbours of neighbours that aren't neighbours, over the ``k`` best of each list, in either direction.

    The lists of points that many others list are cut alike; what that leaves
    unseen shows in the audit.
    """
    both = edges.select("a", "b", "s").union(edges.select("b", "a", "s")).distinct()
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= 2 * k).select("a", "b")
    met = best.select(F.col("a").alias("u"), F.col("b").alias("x")).join(best.select(F.col("a").alias("u"), F.col("b").alias("y")), "u").where("x < y")
    known = edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return met.select("x", "y").distinct().join(known, ["x", "y"], "left_anti").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _held(table: DataFrame, n: int, columns: list[str], shelf: Shelf) -> Iterator[tuple]:
    """Broadcasts of at most about HELD rows each that together hold the ``n`` rows of ``table``."""
    parts = -(-n // HELD)
    for part in range(parts):
        own = table.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part) if parts > 1 else table
        held = shelf.spark.sparkContext.broadcast(own.select(*columns).toArrow().combine_chunks())
        yield held
        held.unpersist()


def _true_links(vectors: DataFrame, queries: DataFrame, n: int, kind: str, threshold: float, shelf: Shelf) -> DataFrame:
    """(a, true): for each query its links among all points, block by block."""
    out = None
    for held in _held(queries, n, ["id", "v"], shelf):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own, q = held.value["id"].to_numpy(), unit(matrix(held.value["v"], kind))
            many = np.zeros(len(own), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    ids, x = batch.column(0).to_numpy(), unit(matrix(batch.column(1), kind))
                    for at in range(0, len(own), 512):
                        many[at : at + 512] += ((q[at : at + 512] @ x.T >= threshold) & (own[at : at + 512, None] != ids[None, :])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(many)], names=["a", "n"])

        got = shelf.keep(vectors.select("id", "v").mapInArrow(run, "a long, n long").where("n > 0").groupBy("a").agg(F.sum("n").alias("true")), HELD)
        out = got if out is None else out.union(got)
    return out


def _cut(members: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(id, m, v, cell, angle): cells of points of one neighbourhood, each within the threshold of the point that names it."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(2), kind))
                p = x @ np.random.default_rng([3, 0]).standard_normal((BITS + 1, x.shape[1])).T
                code = ((p[:, :BITS] > 0) @ (1 << np.arange(BITS)[::-1])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(p[:, BITS]), *batch.columns], names=["code", "p", "id", "m", "v"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CELLS):
                part = batch.slice(at, CELLS)
                ids, x = part.column(2).to_numpy(), unit(matrix(part.column(4), kind))
                cell, angle, left = np.empty(len(ids), dtype=np.int64), np.zeros(len(ids)), np.arange(len(ids))
                while left.size:
                    s = x[left] @ x[left[0]]
                    own = s >= threshold
                    own[0] = True
                    cell[left[own]] = ids[left[0]]
                    angle[left[own][1:]] = np.arccos(np.clip(s[own][1:], -1, 1))
                    left = left[~own]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4), pa.array(cell), pa.array(angle)], names=["id", "m", "v", "cell", "angle"])

    signed = members.select("id", "m", "v").mapInArrow(signs, "code long, p double, id long, m long, v binary")
    return signed.repartitionByRange("code", "p").sortWithinPartitions("code", "p", "id").mapInArrow(cells, "id long, m long, v binary, cell long, angle double")


def _whole_lists(members: DataFrame, kind: str, threshold: float, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """(id, n): the copies that each member links to among the members; (a, b): links that span their components."""
    cut = shelf.keep(_cut(members, kind, threshold))
    size = cut.groupBy("cell").agg(F.max("angle").alias("r"), F.sum("m").alias("all"))
    cells = shelf.keep(cut.where("id = cell").select("id", "v").join(size.select(F.col("cell").alias("id"), "r"), "id"))
    reach, met = float(np.arccos(threshold)), None
    for held in _held(cells, cells.count(), ["id", "v", "r"], shelf):

        def near(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own, r, c = held.value["id"].to_numpy(), held.value["r"].to_numpy(), unit(matrix(held.value["v"], kind))
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x, q = batch.column(0).to_numpy(), unit(matrix(batch.column(1), kind)), batch.column(2).to_numpy()
                for at in range(0, len(own), 512):
                    s, wide = c[at : at + 512] @ x.T, r[at : at + 512, None] + q[None, :]
                    # Leaders so far apart that no members can link, or so near that all do; SURE is far above what rounding does.
                    far = np.cos(np.minimum(wide + reach + SURE, np.pi))
                    i, j = np.nonzero((s >= far - 1e-9) & (own[at : at + 512, None] <= ids[None, :]))
                    sure = np.arccos(np.clip(s[i, j] - 1e-9, -1, 1)) + wide[i, j] <= reach - SURE
                    sure |= (own[at + i] == ids[j]) & (wide[i, j] <= reach - SURE)
                    yield pa.RecordBatch.from_arrays([pa.array(own[at + i]), pa.array(ids[j]), pa.array(sure)], names=["i", "j", "sure"])

        got = shelf.keep(cells.mapInArrow(near, "i long, j long, sure boolean"))
        met = got if met is None else met.union(got)
    pairs, sure = met.where("not sure").select("i", "j"), met.where("sure")
    # Every member of a cell links to all of a sure one, but for itself in its own: sizes count these links, nothing is shipped.
    both = sure.select("i", "j").union(sure.where("i < j").select("j", "i"))
    owed = both.join(size.select(F.col("cell").alias("j"), "all"), "j").groupBy(F.col("i").alias("cell")).agg(F.sum("all").alias("n"), F.max(F.col("i") == F.col("j")).alias("own"))
    whole = cut.join(owed, "cell").select("id", (F.col("n") - F.when(F.col("own"), F.col("m")).otherwise(0)).alias("n"))
    one = pairs.join(cut.withColumnRenamed("cell", "i"), "i").select("i", "j", F.lit(True).alias("first"), "id", "m", "v")
    two = pairs.where("i < j").join(cut.withColumnRenamed("cell", "j"), "j").select("i", "j", F.lit(False).alias("first"), "id", "m", "v")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first = table["first"].to_numpy(zero_copy_only=False).astype(bool)
        ids, m, x = table["id"].to_numpy(), table["m"].to_numpy(), unit(matrix(table["v"], kind))
        same = first.all()
        one, two = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        many = np.zeros(len(ids), dtype=np.int64)
        for at in range(0, len(one), 1024):
            part = one[at : at + 1024]
            near = x[part] @ x[two].T >= threshold
            if same:
                near[np.arange(len(part)), np.arange(at, at + len(part))] = False
            many[part] += near @ m[two]
            if not same:
                many[two] += m[part] @ near
        hit = np.flatnonzero(many)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        links = [(i, j)] if hit.size and not same else []
        return pa.table({"id": np.r_[ids[hit], [x for x, _ in links]].astype(np.int64), "to": pa.array([None] * hit.size + [y for _, y in links], pa.int64()), "n": np.r_[many[hit], np.zeros(len(links), dtype=np.int64)].astype(np.int64)})

    done = shelf.keep(one.union(two).repartition("i", "j").groupBy("i", "j").applyInArrow(run, "id long, to long, n long"))
    counts = done.where("to is null").select("id", "n").union(whole).groupBy("id").agg(F.sum("n").alias("n"))
    spans = cut.where("id != cell").select(F.col("id").alias("a"), F.col("cell").alias("b")).union(done.where("to is not null").select("id", "to")).union(sure.where("i < j").select("i", "j"))
    return counts, spans


def _near_links(vectors: DataFrame, n: int, kind: str, threshold: float, k: int, shelf: Shelf) -> tuple[DataFrame, DataFrame | None, dict]:
    """(a, b) links of lists, (id) of the points whose lists have to be enlarged, None for all, and the audit's figures."""
    queries = vectors.where("asked > 0").select("id", "v")
    asked, points, sent = vectors.agg(F.sum("asked"), F.count_if(F.col("asked") > 0), F.count_if(_probes(_one_in(n)))).head()
    vectors = vectors.select("id", "v")
    true = _true_links(vectors, queries, points, kind, threshold, shelf) if points else None
    found, made, audit = None, 0, {}
    for _ in range(MORE):
        tables = range(made, max(tables_for(n, threshold), 2 * made))
        made = tables.stop
        start = shelf.keep(_start(vectors, kind, threshold, tables, n, k))
        found = start if found is None else found.union(start).groupBy("a", "b").agg(F.max("s").alias("s"), F.max("sure").alias("sure"))
        met, unsure = found.agg(F.count_if(F.col("sure") == MET), F.count_if((F.col("sure") == 0) & (F.col("a") != F.col("b")))).head()
        # A figure without a case is null and decides nothing; there is a probe in any table.
        audit = {"queries": asked, "query_points": points, "orders": made, "probes_met": met / sent if sent else None, "links": 0, "recall": None}
        if sent and audit["probes_met"] < RECALL:
            continue
        edges, wide = _refine(found, unsure, vectors, kind, threshold, k, shelf)
        links = shelf.keep(edges.where("sure = 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if true is not None:
            ends = links.union(links.select("b", "a")).groupBy("a").agg(F.count("*").alias("found"))
            open_ = true.join(wide.withColumnRenamed("id", "a"), "a", "left_anti").join(ends, "a", "left")
            t, f = open_.agg(F.sum("true"), F.sum(F.least("true", F.coalesce("found", F.lit(0))))).head()
            audit |= {"links": t or 0, "recall": f / t if t else None}
        if audit["recall"] is None or audit["recall"] >= RECALL:
            return links, wide, audit
    LOG.warning("the recall stayed short, all points are compared: %s", audit)
    return found.where("false").select("a", "b"), None, audit


def _refine(found: DataFrame, unsure: int, vectors: DataFrame, kind: str, threshold: float, k: int, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """The edges after the descent's rounds, and the (id) of saturated points and those that list them."""
    edges = found.where("a != b")
    if unsure:  # pairs near the threshold
        edges = shelf.keep(edges.where("sure != 0").union(_cosines(edges.where("sure = 0").select("a", "b"), vectors, kind, NEAR, threshold)))
    marked = found.where(F.col("s") == FULL).select(F.col("a").alias("id"))
    full = None
    for _ in range(ROUNDS):
        ends = edges.where("sure = 1").select("a", "b").union(edges.where("sure = 1").select("b", "a")).distinct()
        full = shelf.keep(marked.union(ends.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("a")).distinct())
        open_ = edges.join(full.withColumnRenamed("id", "a"), "a", "left_anti").join(full.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "s", "sure")
        fresh = shelf.keep(_cosines(_descend(open_, k), vectors, kind, NEAR, threshold))
        edges = edges.union(fresh)
        if not fresh.where("sure = 1").head(1):
            break
    to = full.withColumnRenamed("id", "b")
    near = edges.select("a", "b").union(edges.select("b", "a")).join(to, "b", "left_semi").select(F.col("a").alias("id"))
    return edges, shelf.keep(full.union(near).distinct())


def embedding_groups(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, k: int = K) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``rows``; the frame's ``audits`` has the recall by length of vector.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do rows with a null id. Vectors of any finite scale are
    compared in double precision. Equal vectors are one point with a number of
    copies, and link. Vectors of different lengths never link. A row that repeats
    an id is returned each; extra columns are ignored; an empty table gives an
    empty result. Raises nothing for a short recall: everything is then compared.
    """
    shelf = Shelf(rows.sparkSession)
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    base = rows.select(F.col(id_col).cast("long").alias("row_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("e"))
    marked = _points(base, kind)
    points = marked.where("key is not null").groupBy("key", "width").agg(F.min("row_id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v"), F.count_if(F.pmod("row_id", F.lit(EVERY)) == 0).alias("asked"))
    points = shelf.keep(points)
    widths = points.groupBy("width").count().collect()  # a row a length of vector
    total = sum(w["count"] for w in widths)
    counted, spans, audits = [], [], {}
    for width, n in widths:
        own = points.where(F.col("width") == width)
        copies = own.select(F.col("id").alias("b"), F.col("m"))
        links, wide, audits[width] = _near_links(own.select("id", "v", "asked"), n, kind, threshold, k, shelf)
        LOG.info("vectors of %d: %s", width, audits[width])
        members = own if wide is None else own.join(wide, "id", "left_semi")
        if wide is None or wide.head(1):
            counts, edges = _whole_lists(members, kind, threshold, shelf)
            counted.append(counts)
            spans.append(edges)
            ends = links.union(links.select("b", "a"))
            if wide is not None:
                inner = wide.select(F.col("id").alias("a")), wide.select(F.col("id").alias("b"))
                ends = ends.join(inner[0], "a", "left_semi").join(inner[1], "b", "left_anti").union(ends.join(inner[0], "a", "left_anti")).select("a", "b")
        else:
            ends = links.union(links.select("b", "a"))
        counted.append(ends.join(copies, "b").groupBy("a").agg(F.sum("m").alias("n")).withColumnRenamed("a", "id"))
        spans.append(links)
    named = points.select("key", "id", "m")
    if counted:
        edges, counts = spans[0], counted[0]
        for more in spans[1:]:
            edges = edges.union(more)
        for more in counted[1:]:
            counts = counts.union(more)
        parts = connected_components(edges, "a", "b", shelf, edges.count()).withColumnRenamed("node", "id")
        counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
        named = named.join(parts, "id", "left").join(counts, "id", "left")
        named = named.select("key", F.coalesce("component", "id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    else:
        named = named.select("key", F.col("id").alias("component_id"), (F.col("m") - 1).alias("n_links"))
    out = marked.select("row_id", "key").join(shelf.keep(named, total), "key", "left")
    comp = F.coalesce("component_id", "row_id")
    out = out.select(F.col("row_id").alias("id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("row_id") == comp, F.lit(True)).alias("kept"))
    out.audits = audits
    return out
