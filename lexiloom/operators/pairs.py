"""What the pairs of neighbouring words say of a term, counted in tasks by numbers instead of spellings.

No pair is a row. Tasks number the words they read and hand columns of pairs
on, packed by a hash of both words; there each pair is met once, and what it
adds to its two terms is packed by a hash of the term. A task holds a bucket at
a time, and the number of buckets grows with the input.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import vocabulary

#: Bytes of input a bucket, by the planner's estimate, and cells of a table of terms or contexts and modules held at once.
BUCKET_BYTES, CELLS = 4 << 20, 1 << 24
PACKED = "bucket int, terms binary, places binary, numbers binary"
STATS = "token string, compounds long, compound_uses long, modules long, dispersion double"


def buckets(df: DataFrame) -> int:
    """How many buckets an input of this size takes; no result depends on it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, min(1 << 15, size // BUCKET_BYTES + 1))


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in words], np.uint64)


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets of hashes, evenly and alike in all tasks."""
    return (((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _name(module: str | None) -> tuple:
    """Modules in order, null first."""
    return module is not None, module


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sorted(*keys: np.ndarray) -> np.ndarray:
    """The order by these keys, whole numbers from zero, in turn."""
    sizes = [int(k.max(initial=0)) + 1 for k in keys]
    if float(np.prod(np.array(sizes, float))) >= 2.0**62:
        return np.lexsort(keys[::-1])
    key = keys[0]
    for k, size in zip(keys[1:], sizes[1:], strict=True):
        key = key * size + k
    return np.argsort(key, kind="stable")


def _packed(bucket: np.ndarray, terms: list[np.ndarray], words: list[str], place: np.ndarray, places: list[str], numbers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED``, one a bucket, each with the words and places that its own columns name."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, place, terms, numbers = bucket[order], place[order], [t[order] for t in terms], [n[order] for n in numbers]
    first, rows = _runs(bucket), []
    for a, z in zip(first, [*first[1:], len(bucket)], strict=True):
        used, at = np.unique(np.concatenate([t[a:z] for t in terms]), return_inverse=True)
        where, own = np.unique(place[a:z], return_inverse=True)
        held = np.concatenate([at, own, *[n[a:z] for n in numbers]]).astype(np.int64)
        rows.append((int(bucket[a]), "\n".join([words[i] for i in used]).encode(), "\n".join([places[i] for i in where]).encode(), held.tobytes()))
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), [pa.int32(), *[pa.binary()] * 3], strict=True)], names=["bucket", "terms", "places", "numbers"])


def _unpacked(batches: Iterator[pa.RecordBatch], terms: int, columns: int) -> Iterator[tuple[list[str], list[str], list[np.ndarray]]]:
    """Words, places and columns of each bucket in turn, of rows that are sorted by bucket."""
    rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
    for _, own in groupby(rows, key=lambda r: r[0]):
        words, places, parts = {}, {}, []
        for _, spelled, where, numbers in own:
            w = np.array([words.setdefault(x, len(words)) for x in spelled.decode().split("\n")], np.int64)
            p = np.array([places.setdefault(x, len(places)) for x in where.decode().split("\n")], np.int64)
            held = np.frombuffer(numbers, np.int64).reshape(columns, -1)
            parts.append([*(w[c] for c in held[:terms]), p[held[terms]], *held[terms + 1 :]])
        yield list(words), list(places), [np.concatenate(c) for c in zip(*parts, strict=True)]


def _read(n: int, kept: Callable[[str], bool]) -> Callable:
    """Tasks over (module, w): pairs of kept neighbours with a module, and how often they stand in either order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in vocabulary.portions(batch)):
            sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy()
            found = part.column(1).flatten().dictionary_encode()
            spelled = found.dictionary.to_pylist()
            order = sorted(range(len(spelled)), key=spelled.__getitem__)  # one order in all tasks
            words, rank = [spelled[i] for i in order], np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at, row = rank[found.indices.to_numpy()], np.repeat(np.arange(part.num_rows), sizes)
            keep = np.array([kept(w) for w in words], bool)
            ok = (row[1:] == row[:-1]) & keep[at[1:]] & keep[at[:-1]]
            modules = part.column(0).dictionary_encode(null_encoding="encode")
            a, b, m = at[:-1][ok], at[1:][ok], modules.indices.to_numpy()[row[:-1][ok]].astype(np.int64)
            # A file's words are below 2^29, and so many are only counted alone.
            base, most = max(1, len(words)), max(1, len(modules.dictionary))
            key, uses = np.unique(((np.minimum(a, b) * base + np.maximum(a, b)) * most + m) * 2 + (a > b), return_counts=True)
            if not len(key):
                continue
            pair, back = key >> 1, key & 1
            first = _runs(pair)
            ahead, behind = np.add.reduceat(uses * (1 - back), first), np.add.reduceat(uses * back, first)
            pair, m = pair[first] // most, pair[first] % most
            lo, hi, h = pair // base, pair % base, _hashes(words)
            yield from _packed(_mixed(h[lo] * np.uint64(0x85EBCA6B) + h[hi], n), [lo, hi], words, m, [json.dumps(x) for x in modules.dictionary.to_pylist()], [ahead, behind])

    return run


def _meet(n: int) -> Callable:
    """Tasks over buckets of pairs: what each pair adds to its two terms, a term and set of modules at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, places, (lo, hi, m, ahead, behind) in _unpacked(batches, 2, 5):
            by_name = sorted(range(len(places)), key=lambda i: _name(json.loads(places[i])))  # noqa: B023
            places, rank = [places[i] for i in by_name], np.argsort(by_name)
            m = rank[m]
            order = _sorted(lo, hi, m)
            lo, hi, m, ahead, behind = (c[order] for c in (lo, hi, m, ahead, behind))
            first = _runs(lo, hi)
            if len(places) <= 62:
                masks, kind = np.unique(np.bitwise_or.reduceat(np.int64(1) << m, first), return_inverse=True)
                sets = [[i for i in range(len(places)) if mask >> i & 1] for mask in masks.tolist()]
            else:
                own, known = m.tolist(), {}
                kind = np.array([known.setdefault(tuple(dict.fromkeys(own[a:z])), len(known)) for a, z in zip(first, [*first[1:], len(m)], strict=True)], np.int64)
                sets = list(known)
            named = [f"[{','.join([places[i] for i in s])}]" for s in sets]
            lo, hi, ahead, behind = lo[first], hi[first], np.add.reduceat(ahead, first), np.add.reduceat(behind, first)
            shapes, alone = (ahead > 0).astype(np.int64) + (behind > 0), lo == hi
            kind = np.where(alone, len(named), kind)  # a word beside itself is no context
            term, kind = np.concatenate([lo, hi]), np.tile(kind, 2)
            order = _sorted(term, kind)
            term, kind = term[order], kind[order]
            first = _runs(term, kind)
            sums = [np.add.reduceat(np.tile(c, 2)[order], first) for c in (shapes, ahead + behind, (~alone).astype(np.int64))]
            term, kind = term[first], kind[first]
            yield from _packed(_mixed(_hashes(words)[term], n), [term], words, kind, [*named, "[]"], sums)

    return run


def _dispersions(term: np.ndarray, kind: np.ndarray, contexts: np.ndarray, sets: list[list], terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each term, with rows sorted by term: its modules, and one minus the mean Jaccard similarity of its contexts in two of them."""
    modules, dispersion = np.zeros(terms, np.int64), np.full(terms, np.nan)
    every = sorted({x for s in sets for x in s}, key=_name)
    place = {x: i for i, x in enumerate(every)}
    skip = int(bool(every) and every[0] is None)  # null is a module that is compared with none
    first = _runs(term)
    ends = np.append(first[1:], len(term))
    a = 0
    while a < len(first):
        z = max(a + 1, int(np.searchsorted(ends, first[a] + CELLS // max(1, len(every)), side="right")))
        rows = slice(first[a], ends[z - 1])
        at, starts = np.repeat(np.arange(z - a), ends[a:z] - first[a:z]), first[a:z] - first[a]
        used, own = np.unique(kind[rows], return_inverse=True)
        held = np.zeros((len(used), len(every)), np.int64)
        for i, s in enumerate(used):
            held[i, [place[x] for x in sets[s]]] = 1
        weight = held[own] * contexts[rows][:, None]
        size = np.add.reduceat(weight, starts, axis=0)
        total = np.zeros(z - a)
        for x in range(skip, len(every) - 1):
            with_x = np.flatnonzero(held[own, x])
            if len(with_x):
                begin = _runs(at[with_x])
                t = at[with_x][begin]
                both = np.add.reduceat(weight[with_x, x + 1 :], begin, axis=0)
                total[t] += (both / (size[t, x][:, None] + size[t, x + 1 :] - both)).sum(axis=1)
        modules[term[first[a:z]]] = (size > 0).sum(axis=1)
        compared = (size[:, skip:] > 0).sum(axis=1)
        dispersion[term[first[a:z]]] = 1 - total / np.maximum(1, compared * (compared - 1) // 2)
        a = z
    return modules, dispersion


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks over buckets of terms: rows of ``STATS``."""
    for words, places, (term, kind, shapes, uses, contexts) in _unpacked(batches, 1, 5):
        order = _sorted(term, kind)
        term, kind, shapes, uses, contexts = (c[order] for c in (term, kind, shapes, uses, contexts))
        first = _runs(term)
        totals = [np.add.reduceat(c, first) for c in (shapes, uses)]  # the terms are 0, 1, 2 and so on
        first = _runs(term, kind)
        contexts = np.add.reduceat(contexts, first)
        modules, dispersion = _dispersions(term[first], kind[first], contexts, [json.loads(p) for p in places], len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array(t, pa.int64()) for t in totals], pa.array(modules, pa.int64()), pa.array(dispersion, from_pandas=True)], names=["token", "compounds", "compound_uses", "modules", "dispersion"])


def term_stats(words: DataFrame, size: int, kept: Callable[[str], bool]) -> DataFrame:
    """``STATS`` of ``words(module, w)``, the words of a document in order: a term's distinct shapes of a pair, their uses, the modules in which it has contexts and their dispersion.

    ``size``: the number of buckets. ``kept`` says which words make pairs.
    """
    dealt = lambda df: df.repartition(size, "bucket").sortWithinPartitions("bucket")
    pairs = dealt(words.select("module", "w").mapInArrow(_read(size, kept), PACKED))
    return dealt(pairs.mapInArrow(_meet(size), PACKED)).mapInArrow(_add_up, STATS)
