"""Conversation repair, filter interaction audit and document fingerprints."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from lexiloom.llm import conversations, filteraudit, fingerprints
from lexiloom.llm.shelf import Shelf


# Conversation repair: every edit script of small conversations, and a string-carrying program for long ones.


def walk(state, initial):
    """The state after a turn with that initial, or None; states: '' nothing, else the last initial."""
    if initial == "s":
        return "s" if state == "" else None
    return initial if initial in ("u", "a") and (initial == "u") == (state != "u") else None


def brute(turns):
    """turns: (role, text, must go, truncated); the least (cost, audit, lines) over all scripts with up to two inserts before each turn."""
    names = {"u": "user", "a": "assistant"}
    found = {"": (0, "", ())}

    def inserted(states):
        out, now = dict(states), states
        for _ in range(2):
            later = {}
            for state, (cost, audit, lines) in now.items():
                for x in "ua":
                    if walk(state, x):
                        own = cost + 2, audit + "I", (*lines, names[x] + ":")
                        later[x] = min(later.get(x, own), own)
            for x, own in later.items():
                out.setdefault((x, len(own[1])), own)
            now = later
        return [(k if isinstance(k, str) else k[0], v) for k, v in out.items()]

    for role, text, must_go, truncated in turns:
        after = {}

        def put(state, own, after=after):
            after[state] = min(after.get(state, own), own)

        for state, (cost, audit, lines) in inserted(found):
            put(state, (cost + 3, audit + "D", lines))
            if not must_go:
                if (to := walk(state, role[:1])) is not None:
                    put(to, (cost + truncated, audit + "K", (*lines, f"{role}:{text}")))
                for x in "ua":
                    if walk(state, x):
                        put(x, (cost + 2 + truncated, audit + "R", (*lines, f"{names[x]}:{text}")))
        found = after
    return min(v for state, v in inserted(found) if state in ("", "a"))


def expected(rows):
    """conv -> result, from (conv, turn, role, text, copies)."""
    by = {}
    for conv, turn, role, text, copies in rows:
        by.setdefault(conv, []).extend([(turn, " " if role is None else role, " " if text is None else text)] * copies)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()[:16]))
        seen, turns, count, before = set(), [], Counter(), None
        for turn, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            count["illegal"] += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [r[0] for r in own if r[0] is not None]
        cost, audit, lines = brute(turns)
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, count["blank"], count["duplicate"], count["truncated"], count["illegal"], cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string, copies int"


def repaired(spark, rows, **more):
    df = spark.createDataFrame(rows, CONV)
    return {r[0]: tuple(r[1:]) for r in conversations.repair_conversations(df, copies_col="copies", **more).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def some_turns(rng, conv, n, roles=("system", "user", "assistant", "tool", "", None)):
    texts = ["Yes.", "No!", "cut", " ", "", None, "Why?  ", "líne\nÉ."]
    return [(conv, rng.choice([None, i, i, i, i + 3]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}" + rng.choice(["", "."]), rng.choice([1, 1, 1, 2])) for i in range(n)]


def test_random_conversations_equal_every_script(spark):
    rng = random.Random(7)
    rows = [r for conv in [None, *range(150)] for r in some_turns(rng, conv, rng.randint(1, 9))]
    assert repaired(spark, rows) == expected(rows)


def test_long_conversations_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [r for conv, n in ((1, 700), (2, 3), (3, 400), (4, 250)) for r in some_turns(rng, conv, n, ("user", "assistant", "system", "user", "assistant"))]
    rng.shuffle(rows)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = repaired(spark, rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == expected(rows)


def test_solve_prefers_the_least_audit():
    turns = [(conversations.USER, False, False), (conversations.USER, False, False)]
    ends, steps = conversations.solve(turns, conversations.START)
    end = conversations.cheapest_end(ends)
    assert "".join(conversations.EDITS[c] for c in conversations.trace(steps, end)) == "KR" and ends[end][0] == 2


def test_repair_of_empty_tables_missing_rows_and_clashing_columns(spark):
    empty = spark.createDataFrame([], CONV)
    assert conversations.repair_conversations(empty).count() == 0
    names = spark.createDataFrame([(5,), (None,), (5,)], "conv_id long")
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, conversations.repair_conversations(empty, names).collect()), key=repr) == sorted([(5, 0, 0, 0, 0, 0, 0, "", none), (None, 0, 0, 0, 0, 0, 0, "", none)], key=repr)
    odd = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 9), (1, 1, "assistant", "Yes.", "y", 8)], "conv_id long, turn long, role string, text string, digest string, copies long")
    got = conversations.repair_conversations(odd).collect()[0]
    assert got["audit"] == "KK" and got["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b!") for c in (0, 1, None) for t in (*range(40), None)]
    got = Counter(map(tuple, conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = Counter()
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate:
            want[(c, t, "user" if fate == 4 else role, "" if fate == 1 else "A b" if fate == 2 else text, 2 if fate == 3 else 1)] += 1
    assert got == want


# Filter interaction audit.


def test_audit_equals_replay_of_every_document(spark):
    rng = random.Random(3)
    texts = ["", None, "A b c " * 100, "word " * 250, " ".join(f"w{i}" for i in range(300)), "#tag " + " ".join(f"x{i}" for i in range(210)), "ÀÉ " * 30, "\t\n "]
    docs = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice([None, "en", "", "de"])) for _ in range(60)]
    labels = [(1, 1, None), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 0, 0), (4, 1, 1)]
    frame = spark.createDataFrame([(*d, True, "x") for d in docs], "doc_id long, text string, lang string, A boolean, part string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in filteraudit.audit_documents(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    flags = []
    for k, t, lang in docs:
        t = t or ""
        words = t.split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": k is not None and k > least[t]}
        flags.append((lang or "", fails, any(x == k and q == 1 for x, q, _ in labels if k is not None), any(x == k and z == 1 for x, _, z in labels if k is not None)))
    want, total = {}, Counter()
    for part in {f[0] for f in flags}:
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                row = [0] * 6
                for own, fails, good, toxic in flags:
                    if own != part:
                        continue
                    earlier, here = any(fails[x] for x in order[: step - 1]), fails[letter]
                    for i, yes in enumerate((not earlier and not here, here and not earlier, here and earlier, here and sum(fails.values()) == 1, here and not earlier and good, here and not earlier and toxic)):
                        row[i] += yes
                want[(part, order, step)] = row
                total[(part, letter)] += row[1]
    assert got == {(p, o, s): (*row, total[(p, o[s - 1])]) for (p, o, s), row in want.items()}


def test_audit_of_nothing_and_of_bad_filters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filteraudit.audit_documents(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    flags = spark.createDataFrame([("p", True, None, None, True)], "part string, A boolean, B boolean, good boolean, toxic boolean")
    got = filteraudit.replay_orders(flags, "AB")
    assert got.count() == 4 and got.where("step = 1 and filter_order = 'AB'").head()["toxic_lost"] == 1
    for bad in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            filteraudit.replay_orders(flags, bad)


# Document fingerprints.


def slow_fingerprint(text, shingle=5):
    import xxhash

    words = (text or "").encode().lower().split()
    terms = Counter(xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))) if words else {}
    return sum(1 << b for b in range(64) if sum(n.bit_length() if h >> b & 1 else -n.bit_length() for h, n in terms.items()) > 0)


def test_fingerprint_is_the_weighted_vote():
    rng = random.Random(1)
    for n in (0, 1, 4, 5, 40, 400):
        text = " ".join(rng.choice(["Éa", "b", "c"]) for _ in range(n))
        assert fingerprints.fingerprint(text) == slow_fingerprint(text)
    assert fingerprints.fingerprint(None) == fingerprints.fingerprint(" \n") == 0
    long = "same words in one very long line " * 20_000
    assert fingerprints.fingerprint(long) == slow_fingerprint(long)


@pytest.mark.parametrize("parts", [1, 7])
def test_documents_against_their_edits(spark, parts):
    rng = random.Random(parts)
    rows = [(i, " ".join(rng.choice(["un", "deux", "trois", "é"]) + str(rng.randint(0, 3)) for _ in range(rng.choice([0, 1, 7, 60])))) for i in range(60)] + [(None, "last of all"), (3000, None)]
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, tie int, fp string").repartition(5)
        got = {r["id"]: r.asDict() for r in fingerprints.document_fingerprints(frame).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = Counter(fingerprints.fingerprint(t) for _, t in rows)
    assert len(got) == len(rows)
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 2
        new = text[: len(text) - n] + after[:n]
        a, b, c = (fingerprints.fingerprint(x) for x in (text, new, after))
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(new.encode()).hexdigest(), f"{a:016x}", f"{b:016x}")
        assert r["near_edited"] == 1 - (a ^ b).bit_count() / 64 and r["near_next"] == 1 - (a ^ c).bit_count() / 64
        assert r["n_same"] == prints[a] - 1 and r["n_near"] == sum((a ^ x).bit_count() <= 3 for x in prints) - 1


@pytest.mark.parametrize("blocks, limit", [(4, 16), (5, 4096), (7, 10)])
def test_block_tables_find_all_within_the_radius(spark, blocks, limit):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for k in rng.integers(1, 6, 400)])
    fps = np.unique(np.concatenate([base, base[rng.integers(0, 40, 400)] ^ flips, base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    points = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long")
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3).sum(axis=1) - 1
    got = {r["fp"]: r["near"] for r in fingerprints.near_counts(points, Shelf(spark), 3, blocks, limit).collect()}
    assert got == {int(f): int(n) for f, n in zip(fps.view(np.int64), near, strict=True) if n}
    asked = points.limit(30)
    hits = {(r["query"], r["fp"]) for r in fingerprints.find_near(asked, points, 3, blocks).collect()}
    assert hits == {(q, int(f)) for (q,) in asked.collect() for f, u in zip(fps.view(np.int64), fps, strict=True) if (int(u) ^ q % (1 << 64)).bit_count() <= 3}


def test_fingerprints_of_nothing_and_of_one(spark):
    schema = "doc_id long, text string"
    assert fingerprints.document_fingerprints(spark.createDataFrame([], schema)).count() == 0
    (one,) = fingerprints.document_fingerprints(spark.createDataFrame([(1, "a b c d e f")], schema)).collect()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"a b c a b c"[:11]).hexdigest() and one["n_near"] == 0
    with pytest.raises(ValueError):
        fingerprints.near_counts(spark.createDataFrame([(1,)], "fp long"), Shelf(spark), 3, 3)
