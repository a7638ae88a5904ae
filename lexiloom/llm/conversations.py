"""Conversation structure repair: a dynamic program over the turns that are retained.

A repaired conversation has the role initials ``(s?(ua)+)?``. A turn is kept,
reroled or deleted, and turns without text may be inserted. Between two
retained turns all others are deleted, so the gap costs a difference of prefix
deletion sums, plus the inserts that the two roles call for. Per role of the
last retained turn, the running minimum of cost less prefix sum is all that
later turns need; of equal costs the least audit wins. Audits are compared by
the order of their beginnings (no beginning of as many turns is the start of
another), so none is written out before the end.

Turns are slim rows here (a digest in place of the text), in order over ranges
of (conversation, turn), so a conversation may lie in any number of tasks.
Where a range begins or ends, the program runs from each state to each state;
the few pieces at edges, two a task at most, are put together by costs and
ranks. Texts are moved once, to be joined to their turns and hashed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shelf import Shelf

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
NONBLANK = r"[^\x20\x09-\x0D]"
#: States: nothing yet, system, user, assistant last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Inserts that let a state take a role; a missing pair can't be.
GAPS = {(START, SYSTEM): 0} | {(x, USER): int(x == USER) for x in range(4)} | {(x, ASSISTANT): int(x != USER) for x in range(4)}
#: Inserts that end a conversation.
ENDINGS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: A turn's edit letters by code; codes in the order of their letters.
EDITS = ["D", "IK", "IR", "K", "R"]
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn`` to (conv_id, turn, role, text), with ``copies`` for turns repeated; null roles and texts are one space."""
    blank = F.lit(" ")
    said = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.where(fate != 0).select("conv_id", "turn", F.when(fate == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("copies"))


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


TURN = ["conv", "turn", "role", "digest"]


def _turns(rows: DataFrame, shelf: Shelf) -> DataFrame:
    """Slim rows: TURN, times, blank, truncated and again (the same role and text came before); equal rows of a turn are one."""
    n = rows.count()
    own = shelf.keep(
        rows.groupBy("conv", "turn", "role", _digest(F.col("text")).alias("digest")).agg(
            F.sum("copies").alias("times"), F.max(~F.col("text").rlike(NONBLANK)).alias("blank"), F.max(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated")
        ),
        n,
    )
    # Structs order nulls first. The first turn is part of the key, so that a line said a thousand times is no hot key.
    first = own.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("least")).select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("least.turn").alias("t"), F.lit(True).alias("is_first"))
    met = own.join(first, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return met.select(*TURN, "times", "blank", "truncated", F.col("is_first").isNull().alias("again"))


def solve(turns: list[tuple[int | None, bool, bool]], begin: int) -> tuple[dict[int, tuple[int, int]], list[list[tuple[int, int] | None]]]:
    """Cheapest costs from state ``begin`` over ``turns`` (state of the own role if it has one, must go, truncated).

    Returns the cost and the rank of the audit per state reached, and per turn
    and state the state before and the edit's code.
    """
    best: dict[int, tuple[int, int]] = {begin: (0, 0)}  # running minima of cost less prefix deletion sum, and ranks
    steps: list[list[tuple[int, int] | None]] = []
    for role, must_go, truncated in turns:
        options = {x: (cost, rank, 0, x) for x, (cost, rank) in best.items()}  # deleted: the minima stay as they are
        if not must_go:
            for x, (cost, rank) in best.items():
                for to in (SYSTEM, USER, ASSISTANT):
                    gap = GAPS.get((x, to))
                    if gap is None or (to != role and to == SYSTEM):
                        continue
                    code = (1 if gap else 3) + (to != role)
                    own = cost + INSERT * gap + REROLE * (to != role) + TRUNCATED * truncated - DELETE, rank, code, x
                    if to not in options or own < options[to]:
                        options[to] = own
        order = sorted((rank, code, to) for to, (_, rank, code, _) in options.items())
        best = {to: (options[to][0], i) for i, (_, _, to) in enumerate(order)}
        step: list[tuple[int, int] | None] = [None] * 4
        for to, (_, _, code, x) in options.items():
            step[to] = x, code
        steps.append(step)
    base = DELETE * len(turns)
    return {x: (cost + base, rank) for x, (cost, rank) in best.items()}, steps


def trace(steps: list[list[tuple[int, int] | None]], end: int) -> bytes:
    """The codes of the edits that lead to state ``end``."""
    codes = bytearray(len(steps))
    for i in range(len(steps) - 1, -1, -1):
        end, codes[i] = steps[i][end]
    return bytes(codes)


def cheapest_end(ends: dict[int, tuple[int, int]]) -> int:
    return min(ends, key=lambda x: (ends[x][0] + INSERT * ENDINGS[x], ends[x][1]))


PIECE = "conv {conv}, part int, whole boolean, nth int, begin int, end int, cost long, rank int, turn {turn}, role string, digest binary, codes string, audit string, blank long, duplicate long, truncated long, illegal long, distinct long, low {turn}, high {turn}, initials string"


def _pieces(kinds: dict[str, str]):
    """Turns in order to pieces: a row per turn with its edit in each variant (``nth`` null), and a row per variant with costs and counts.

    A variant is a pair of states at a piece's ends. A conversation inside a
    task has one; the first and last of a task may go on elsewhere and have all.
    """
    ddl = PIECE.format(**kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = None

        def piece(rows: list[tuple], edge: bool) -> Iterator[dict]:
            conv = rows[0][0]
            turns, count = [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            before, distinct, told, low, high = None, 0, object(), None, None
            for _, turn, role, _, times, blank, cut, again in rows:
                must_go = blank or again
                turns.append((INITIALS.get(role[:1]), must_go, cut))
                turns.extend([(None, True, False)] * (times - 1))
                fault = "blank" if blank else "duplicate"
                if must_go:
                    count[fault] += times
                else:
                    count["truncated"] += cut
                    count["duplicate"] += times - 1
                initial = role[:1]
                count["illegal"] += (before is not None and before + initial not in ("su", "ua", "au")) + times - 1
                before = initial
                if turn is not None:
                    distinct += turn != told
                    told, high, low = turn, turn, turn if low is None else low
            facts = count | {"distinct": distinct, "low": low, "high": high, "initials": f"{rows[0][2][:1]:1}{rows[-1][2][:1]:1}"}
            variants = []
            for begin in range(4) if edge else (START,):
                ends, steps = solve(turns, begin)
                for end in sorted(ends) if edge else (cheapest_end(ends),):
                    cost, rank = ends[end]
                    codes = trace(steps, end)
                    variants.append(codes)
                    audit = "".join(EDITS[c] for c in codes)
                    if not edge:
                        audit, cost = audit + "I" * ENDINGS[end], cost + INSERT * ENDINGS[end]
                    yield facts | {"conv": conv, "part": part, "whole": not edge, "nth": len(variants) - 1, "begin": begin, "end": end, "cost": cost, "rank": rank, "audit": audit}
            at = 0
            for _, turn, role, digest, times, *_ in rows:
                yield {"conv": conv, "part": part, "whole": not edge, "turn": turn, "role": role, "digest": digest, "codes": "".join(str(v[at]) for v in variants)}
                at += times

        def grouped() -> Iterator[dict]:
            held: list[tuple] = []
            pieces = 0
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and held[0][0] != row[0]:
                        yield from piece(held, pieces == 0)
                        held, pieces = [], pieces + 1
                    held.append(row)
            if held:
                yield from piece(held, True)

        held = []
        for row in grouped():
            if schema is None:
                schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "smallint": pa.int16(), "tinyint": pa.int8()}[k]) for n, k in (f.split() for f in ddl.split(", "))])
            held.append(row)
            if len(held) == 2000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run, ddl


def join_pieces(pieces: list) -> list[tuple]:
    """Puts the pieces at edges together, by conversation and part: (conv, part, chosen variant, closing inserts or null, cost, illegal and distinct turns to add)."""
    groups: dict = {}
    for p in pieces:
        groups.setdefault((p["conv"] is not None, p["conv"]), {}).setdefault(p["part"], []).append(p)
    out = []
    for (_, conv), parts in groups.items():
        best, ways = {START: (0, 0)}, []
        for part in sorted(parts):
            options = {}
            for p in parts[part]:
                if p["begin"] in best:
                    cost, rank = best[p["begin"]]
                    own = cost + p["cost"], rank, p["rank"], p["begin"], p["nth"]
                    if p["end"] not in options or own < options[p["end"]]:
                        options[p["end"]] = own
            order = sorted(options, key=lambda x: options[x][1:3])
            best = {x: (options[x][0], i) for i, x in enumerate(order)}
            ways.append((part, options))
        end = cheapest_end(best)
        closing, cost, chosen = ENDINGS[end], best[end][0] + INSERT * ENDINGS[end], {}
        for part, options in reversed(ways):
            *_, end, nth = options[end]
            chosen[part] = nth
        last, high = None, None
        for part in sorted(parts):
            p = parts[part][0]
            illegal = int(last is not None and (last + p["initials"][0]).strip() not in ("su", "ua", "au"))
            repeated = int(high is not None and p["low"] == high)
            out.append((conv, part, chosen[part], closing if part == max(parts) else None, cost if part == max(parts) else 0, illegal, -repeated))
            last, high = p["initials"][1], p["high"] if p["high"] is not None else high
    return out


def _hashes(conv: str):
    """Turns with their edit, then their text, in order, to the conversations' hashes; a conversation may be of any length."""
    ddl = f"conv {conv}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, lines, turns, edit, done = (), None, 0, 0, None, []

        def line(role: str, text: str) -> None:
            nonlocal lines
            digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
            lines += 1

        def insert() -> None:
            nonlocal turns
            turns += 1
            line("user" if turns % 2 else "assistant", "")

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, closing, role, code, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name,) != key:
                    if digest:
                        done.append((key[0], digest.hexdigest()))
                    key, digest, lines, turns, edit = (name,), hashlib.sha256(), 0, 0, None
                if closing is not None:
                    for _ in range(closing):
                        insert()
                elif code is not None:
                    edit = code
                elif edit is not None:
                    letters = EDITS[edit]
                    if letters[0] == "I":
                        insert()
                    if letters[-1] == "R":
                        turns += 1
                        line("user" if turns % 2 else "assistant", text)
                    elif letters != "D":
                        turns += role[:1] != "s"
                        line(role, text)
                    edit = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["conv", "repaired_sha256"])
                done = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], kind), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])

    return run, ddl


def repair_conversations(rows: DataFrame, names: DataFrame | None = None, copies_col: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation.

    ``rows``: conv_id, an integer turn, role and text; ``copies_col`` names a column
    that says how many equal rows a row stands for. ``names``: conversations to return even without a row, with
    zeros. Turns go in order, null turns first, equal turns by role and then by a
    digest of the text; equal rows of a turn follow each other. A null conv_id is
    a conversation; null roles and texts are one space. A role's first character
    is its initial; one that is none of s, u and a is reroled or deleted. An
    empty table gives an empty result, other columns are ignored. An audit is one
    string, so a conversation has fewer than 2^31 edits; texts of any length are
    hashed turn by turn, those of one conversation in one task, since SHA-256
    can't be split.
    """
    spark, shelf = rows.sparkSession, Shelf(rows.sparkSession)
    kinds = dict(rows.dtypes)
    types = {"conv": kinds["conv_id"], "turn": kinds["turn"]}
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    own = rows.select(F.col("conv_id").alias("conv"), "turn", space("role"), space("text"), (F.col(copies_col) if copies_col else F.lit(1)).alias("copies"))
    run, ddl = _pieces(types)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    made = shelf.keep(_turns(own, shelf).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, ddl))
    pieces = made.where("nth is not null")
    # At most two pieces a task, in eleven variants of a few numbers each.
    edges = join_pieces(pieces.where("not whole").select("conv", "part", "nth", "begin", "end", "cost", "rank", "low", "high", "initials").collect())
    chosen = F.broadcast(spark.createDataFrame(edges, f"c {types['conv']}, p int, pick int, closing int, whole_cost long, more_illegal long, more_distinct long"))
    at_edge = F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    picked = pieces.join(chosen, at_edge, "left").where("whole or nth = pick")
    sums = [
        F.sum(F.when(F.col("whole"), F.col("cost")).otherwise(F.col("whole_cost"))).alias("cost"),
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), ""), F.repeat(F.lit("I"), F.coalesce(F.max("closing"), F.lit(0)))).alias("audit"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.coalesce("more_illegal", F.lit(0))).alias("illegal"),
        (F.max("high") - F.min("low") + 1 - F.sum(F.col("distinct") + F.coalesce("more_distinct", F.lit(0)))).cast("long").alias("gaps"),
    ]
    told = picked.groupBy("conv").agg(*sums)
    edits = made.where("nth is null").join(chosen, at_edge, "left").select("conv", "turn", "role", "digest", F.substring("codes", F.coalesce("pick", F.lit(0)) + 1, F.lit(1)).cast("int").alias("code"))
    # By conversation and turn: a turn's edit, then its text; what closes the conversation comes last.
    texts = own.select("conv", "turn", "role", _digest(F.col("text")).alias("digest"), F.lit(None).cast("int").alias("code"), "text")
    ends = picked.where("whole or closing is not null").select("conv", F.when(F.col("whole"), F.element_at(F.array(*[F.lit(ENDINGS[x]) for x in range(4)]), F.col("end") + 1)).otherwise(F.col("closing")).alias("closing"))
    rest = lambda df: df.select("conv", F.lit(None).cast("int").alias("closing"), "turn", "role", "digest", "code", F.col("text") if "text" in df.columns else F.lit(None).cast("string").alias("text"))
    stream = rest(edits).union(rest(texts)).union(ends.select("conv", "closing", F.lit(None).cast(types["turn"]).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("int").alias("code"), F.lit(None).cast("string").alias("text")))
    hashing, of = _hashes(types["conv"])
    hashed = stream.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("closing").isNotNull(), F.col("turn").asc_nulls_first(), "role", "digest", F.col("code").isNull()).select("conv", "closing", "role", "code", "text").mapInArrow(hashing, of)
    long = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = told.select("conv", *long, "audit", F.lit(None).cast("string").alias("repaired_sha256")).union(hashed.select("conv", *[F.lit(None).cast("long") for _ in long], F.lit(None).cast("string"), "repaired_sha256"))
    if names is not None:
        every = every.union(names.select("conv_id").distinct().select("conv_id", *[F.lit(0).cast("long") for _ in long], F.lit(""), F.lit(None).cast("string")))
    return every.groupBy(F.col("conv").alias("conv_id")).agg(*[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in long], F.max("audit").alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
