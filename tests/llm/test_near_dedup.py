"""SimHash and embedding near-dedup against brute force."""

import numpy as np
import pytest
import xxhash
from lexiloom.llm import embeddings, simhash
from lexiloom.llm.components import connected_components
from lexiloom.llm.shelf import Shelf


def union_find(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).translate({i: " " for i in [32, *range(9, 14)]}).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprint_matches_the_definition():
    for text in (None, "", " \n", "One", "A b C", "a b c d", "É Ä a\x0bb\x1fc d\u00a0e f " * 5, "x y z w " * 100):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_manhattan_never_exceeds_hamming():
    x = np.random.default_rng(1).integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    assert (np.bitwise_count(simhash.embed(x[0]) ^ simhash.embed(x[1])) <= np.bitwise_count(x[0] ^ x[1])).all()


@pytest.mark.parametrize("limit", [4096, 7])
def test_groups_of_fingerprints_equal_brute_force(spark, limit):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique([int(b) ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 5), replace=False)) for b in base for _ in range(12)]).astype(np.uint64)
    shelf = Shelf(spark)
    points = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.near_edges(points, shelf, limit=limit)
    got = {x["node"]: x["component"] for x in connected_components(edges, "a", "b", shelf).collect()}
    signed = fps.view(np.int64).tolist()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = union_find(len(fps), np.argwhere(near).tolist())
    groups = {}
    for i, c in enumerate(want):
        groups.setdefault(c, set()).add(got.get(signed[i], signed[i]))
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({next(iter(g)) for g in groups.values()})


def test_simhash_over_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    fps = np.array([plain_fingerprint(r["text"]) for r in rows], dtype=np.uint64)
    comp = union_find(len(fps), np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4).tolist())
    low = {}
    for r, c in zip(rows, comp):
        low[c] = min(low.get(c, r["doc_id"]), r["doc_id"])
    want = {r["doc_id"]: (f"{int(f):016x}", low[c]) for r, f, c in zip(rows, fps, comp)}
    assert {r["id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()} == want


def test_simhash_edges_of_input(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", None), (5, "a b c d e", "x"), (5, "a b c d e", "x"), (None, "a b c d e", "x"), (9, "w " * 200_000, "x")]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted((r["id"] or -1, r["component_id"]) for r in got)[:6] == [(-1, 5), (1, 1), (2, 1), (3, 1), (5, 5), (5, 5)]
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3), (5000, 1000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", Shelf(spark)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 5000: 1000}


def brute_vectors(rows, t=0.95):
    ids = [r[0] for r in rows]
    ok = [i for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([rows[i][1] for i in ok], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= t - 1e-12) & ~np.eye(len(ok), dtype=bool)
    comp = union_find(len(ok), np.argwhere(near).tolist())
    low = {}
    for i, c in zip(ok, comp):
        low[c] = min(low.get(c, ids[i]), ids[i])
    out = {ids[i]: (0, ids[i]) for i in range(len(rows))}
    out |= {ids[i]: (int(n), low[c]) for i, n, c in zip(ok, near.sum(1), comp)}
    return out


def test_embeddings_over_a_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_vectors([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_groups(table).collect()}
    assert got == want


def test_embeddings_dense_group_and_edges_of_input(spark):
    r = np.random.default_rng(4)
    centre = r.standard_normal(16)
    rows = [(i, (centre + 0.02 * r.standard_normal(16)).tolist()) for i in range(300)] + [(i, r.standard_normal(16).tolist()) for i in range(300, 900)]
    rows += [(900, rows[5][1]), (901, (2 * np.array(rows[5][1])).tolist()), (902, None), (903, [0.0] * 16), (904, [float("nan")] * 16), (905, [float("inf")] * 16), (906, [None] + [1.0] * 15), (907, [1.0, 2.0]), (908, [])]
    got = {x["id"]: x for x in embeddings.embedding_groups(spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, id int")).collect()}
    want = brute_vectors(rows[:902])
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in want} == want
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(902, 909))
    assert embeddings.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_links_between_dense_groups(spark):
    """Eight pairs of groups of 60: a few of the 3,600 cosines between the two of a pair reach the threshold, all within a group do."""
    r = np.random.default_rng(6)
    rows = []
    for _ in range(8):
        u, w = np.linalg.qr(r.standard_normal((32, 2)))[0].T
        for centre in (u, 0.944 * u + (1 - 0.944**2) ** 0.5 * w):
            rows += [(len(rows) + i, (centre + 0.006 * r.standard_normal(32)).tolist()) for i in range(60)]
    want = brute_vectors(rows)
    assert len({c for _, c in want.values()}) == 8
    got = {x["id"]: (x["n_links"], x["component_id"]) for x in embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want


def test_recall_short_of_the_audit_compares_everything(spark, monkeypatch):
    """Blocks of two points: the probes don't meet their vectors, so all points are compared."""
    r = np.random.default_rng(8)
    rows = [(i, r.standard_normal(32).tolist()) for i in range(600)]
    rows += [(600 + i, (np.array(rows[100 * i][1]) + 0.03 * r.standard_normal(32)).tolist()) for i in range(6)]
    monkeypatch.setattr(embeddings, "MORE", 1)
    monkeypatch.setattr(embeddings, "tables_for", lambda n, threshold: 1)
    monkeypatch.setattr(embeddings, "BLOCK", 2)
    out = embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {x["id"]: (x["n_links"], x["component_id"]) for x in out.collect()}
    assert out.audits[32]["probes_met"] < embeddings.RECALL
    assert got == brute_vectors(rows) and got[605] == (1, 500)


@pytest.mark.parametrize("block", [64, 256])
def test_isolated_pairs_and_groups_of_all_sizes(spark, monkeypatch, block):
    """Pairs barely over and under the threshold, and groups of 3 to 90, in small blocks: links are whole to the audit's recall, and none is false."""
    r = np.random.default_rng(9)
    rows = []

    def add(v):
        rows.append((len(rows), v.tolist()))

    for i in range(700):
        u, w = np.linalg.qr(r.standard_normal((48, 2)))[0].T
        c = 0.9501 + 0.04 * r.random() if i % 2 else 0.9499 - 0.05 * r.random()
        add(3 * u)
        add(c * u + (1 - c * c) ** 0.5 * w)
    for size in (3, 7, 8, 9, 17, 40, 90):
        centre = r.standard_normal(48)
        for _ in range(size):
            add(centre + 0.12 * r.standard_normal(48))
    want = brute_vectors(rows)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    out = embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40))
    got = {x["id"]: (x["n_links"], x["component_id"]) for x in out.collect()}
    assert sum(n for n, _ in got.values()) >= embeddings.RECALL * sum(n for n, _ in want.values())
    assert all(got[i][0] <= n for i, (n, _) in want.items())
    assert {i: got[i] for i in want if i >= 1400} == {i: want[i] for i in want if i >= 1400}


def test_extreme_scales_and_null_ids(spark):
    rows = [(1, [1e200, 0.0]), (2, [0.0, 1e200]), (3, [1e-200, 1e-200]), (4, [5.0, 5.0]), (None, [5.0, 5.0]), (5, [1e308, 1e308]), (5, [1e308, 1e308]), (6, [-0.0, 7.0])]
    got = sorted((x["id"] or 0, x["n_links"], x["component_id"]) for x in embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, None), (1, 0, 1), (2, 1, 2), (3, 3, 3), (4, 3, 3), (5, 3, 3), (5, 3, 3), (6, 1, 2)]


def test_links_are_exact_where_found(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.95, (1 - 0.95**2) ** 0.5 + 1e-9]), (3, [0.9501, (1 - 0.9501**2) ** 0.5])], "vec_id long, embedding array<double>")
    got = {x["id"]: x["n_links"] for x in embeddings.embedding_groups(v).collect()}
    assert got == {1: 1, 2: 1, 3: 2}
