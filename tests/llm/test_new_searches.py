"""Exact top-k, the prefix trie and whitening against brute force, whole tables of awkward rows included."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from oracle import compare

from tidegrid.llm import prefix_trie, top_k, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, key string, x string, q int, score double, n int"
TURNS = "conv_id long, turn long, role string, text string, depth int, hi string, n int, least long"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", "x", 3, 0.5, 7) for i, v in rows], VECTORS).repartition(3)


def vectors(seed=0, n=300, dim=12):
    """Random vectors, a third of the rows alike, opposite ones, zero ones, ones that take no part, a repeated row, shared ids."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n)]
    rows += [rows[3]] * 150 + [-r for r in rows[:10]] + [np.zeros(dim)] * 2 + [rows[4] * 1000]
    made = [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(rows)]
    bad = [None, [1.0] * (dim - 1), [math.nan] + [1.0] * (dim - 1), [math.inf] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1), []]
    made += [(1000 + 50 * i, v) for i, v in enumerate(bad)] + [made[7], made[50], (50, made[9][1]), (8, made[11][1]), (None, made[12][1])]
    return made


def usable(rows, dim):
    return [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(np.array(v, float)).all()]


def best(rows, dim, k):
    pool = {(i, tuple(np.floor(256 * v).astype(np.int64).tolist())) for i, v in usable(rows, dim) if i is not None}
    asked = {}
    for i, x in pool:
        if i % 50 == 0:
            asked.setdefault(i, []).append(x)
    out = set()
    for i, mine in asked.items():
        q = min(mine, key=lambda x: np.array(x, np.int64).tobytes())
        found = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in pool if j != i)[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize(("lists", "k", "heads", "block"), [(2, 5, 4, 16384), (3, 5, 1, 3), (12, 2, 1, 16384), (1, 500, 1, 16384)])
def test_top_k(spark, monkeypatch, lists, k, heads, block):
    """However many lists, and with so few first scores that the cutoff is loose: the same answers, ties by id."""
    monkeypatch.setattr(top_k, "HEADS", heads)
    monkeypatch.setattr(top_k, "QUERIES", block)
    monkeypatch.setattr(top_k, "PART", 60)
    rows = vectors()
    frame = vector_frame(spark, rows)
    got = [tuple(r) for r in top_k.search(frame, frame.where("vec_id % 50 = 0"), k, lists=lists).collect()]
    assert len(got) == len(set(got)) and set(got) == best(rows, 12, k)


def test_top_k_collects_few_of_the_pairs(spark):
    """The shares leave most entries where they are, and what they leave can't reach the cutoff."""
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (4000, 16))
    q = x[::100]
    frames = [spark.createDataFrame([(i.to_bytes(16, "big"), r[a : a + 8].tobytes()) for i, r in enumerate(x)], "key binary, part binary") for a in (0, 8)]
    search = top_k._Search(frames, [0, 8, 16], q, x.mean(0), 6, 24)
    first = search.whole_scores(search.highest().groupBy("q", "key").agg({"s": "sum", "bit": "sum"}).toDF("q", "key", "s", "mask"))
    entries = search.reaching(search.shares(first)).count()
    assert entries < len(x) * len(q) / 10
    exact = q @ x.T
    got = {(r["q"], int.from_bytes(r["key"], "big")): r["s"] for r in search.run().collect()}
    for i in range(len(q)):
        limit = np.sort(exact[i])[-6]
        assert {(i, j): int(exact[i, j]) for j in np.flatnonzero(exact[i] >= limit)}.items() <= got.items()


def test_inner_products_are_exact():
    q, x = np.array([[3_000_000_001, -7]]), np.array([[1_000_000_007, 5], [2, 2]])
    assert top_k.inner(q, x).tolist() == [[3_000_000_001 * 1_000_000_007 - 35, 6_000_000_002 - 14]]


def test_top_k_of_large_and_missing_vectors(spark):
    """Clipped components give a score, and tables without vectors none."""
    frame = vector_frame(spark, [(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 0.0])])
    found = [tuple(r) for r in top_k.search(frame, frame.where("vec_id = 0")).collect()]
    assert [r[:3] for r in found] == [(0, 1, 1), (0, 2, 2)] and found[0][3] > 1 << 59
    for rows in ([], [(1, None)], [(0, [])], [(0, [1.0, 2.0])]):
        empty = vector_frame(spark, rows)
        assert top_k.search(empty, empty).count() == 0


def conversations(seed=0):
    """Shared starts, copies, one very long, gaps and ties in turn, nulls, empty texts, a repeated row, ids far apart."""
    rows, rng = [], np.random.default_rng(seed)
    say = [("user", "hi"), ("bot", "hello"), ("user", ""), ("bot", "grüße"), ("user", "b"), ("user:", "b")]
    for c in [*range(-6, 60), 70_001, 9_000_000_000]:
        if c % 7:
            rows += [(c, t * 2, *say[rng.integers(6)]) for t in range(rng.integers(1, 14))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(3)]
    rows += [(61, t, "user", f"turn {t % 50}") for t in range(300)] + [(62, t, "user", f"turn {t % 50}") for t in range(290)]
    rows += [(4, None, None, None), (4, None, "a", None), (4, 0, "a", "tie"), (4, 0, "a", "tie"), (None, 1, "x", "y"), (63, 1, "user", "long " * 5000)]
    return rows


def nodes_of(paths):
    """{path: row} of whole conversations, by plain loops."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    out = set()
    for p, own in members.items():
        children = sum(len(q) == len(p) + 1 for q in below[p])
        leaves = sum(not any(len(r) > len(q) for r in below[q]) for q in below[p])
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below[p])
        ends = ",".join(map(str, sorted(c for c in own if paths[c] == p)))
        out.add((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def dialogues(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((-math.inf if t is None else t, role or "", text or ""))
    return {c: tuple(x[1:] for x in sorted(v)) for c, v in own.items()}


@pytest.mark.parametrize(("stretch", "piece"), [(1024, 8192), (7, 3)])
def test_prefix_trie(spark, monkeypatch, stretch, piece):
    """As they are and rebuilt, with dialogues and end lists in one piece or in many."""
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, "h", 2, 3) for r in rows], TURNS).repartition(5)
    own = dialogues(rows)
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == nodes_of(own)
    made = {}
    for c, path in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, own.get(c - int(math.fmod(c, 5)), ())
        made[c] = base[:h] + path[h:]
    assert () in made.values()  # one has no turns left
    convs = prefix_trie._ids(frame)
    got = {tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.ordered(frame), convs), convs).collect()}
    assert got == nodes_of(made)


def test_prefix_trie_of_nothing(spark):
    for rows in ([], [(None, 1, "a", "b")]):
        assert prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 0


def whitened(rows, dim, components=16):
    kept = [(i, np.floor(64 * v).astype(np.int64) + 1_000_000) for i, v in usable(rows, dim)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in kept}))
    n, total = len(fit), fit.sum(0)
    z = fit - total / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    return kept, n, total, values[order], axes[:, order], values.sum()


@pytest.mark.parametrize(("tile", "block", "held"), [(32, 1 << 17, 64), (5, 120, 2)])
def test_whitening(spark, monkeypatch, tile, block, held):
    """In one tile or several, in row blocks of any size: components and sums of a plain decomposition."""
    for name, value in (("TILE", tile), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(whitening, name, value)
    rows = vectors(dim=12)
    got = whitening.whiten(vector_frame(spark, rows)).collect()
    kept, n, total, values, axes, trace = whitened(rows, 12)
    key = lambda i: (i is None, i)
    wanted = sorted(((i, int(((n * x - total).astype(object) ** 2).sum())) for i, x in kept), key=lambda r: (key(r[0]), r[1]))
    assert sorted(((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1), key=lambda r: (key(r[0]), r[1])) == wanted
    assert len(got) == 12 * len(kept) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    plain = {(i, tuple(x.tolist())): (x - total / n) @ axes / np.sqrt(values) for i, x in kept}
    for c in range(12):
        mine = sorted(round(r["whitened"], 6) + 0.0 for r in got if r["component"] == c + 1)
        options = [sorted(round(s * plain[i, tuple(x.tolist())][c], 6) + 0.0 for i, x in kept) for s in (1, -1)]
        assert any(np.allclose(mine, o, atol=2e-6) for o in options)
        assert {round(r["explained"], 12) for r in got if r["component"] == c + 1} == {round(values[c] / trace, 12)}


def test_whitening_leaves_out_what_has_no_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    assert {r["component"] for r in whitening.whiten(vector_frame(spark, rows)).collect()} == {1}
    for none in ([], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, [])]):
        assert whitening.whiten(vector_frame(spark, none)).count() == 0
    far = whitening.whiten(vector_frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {r["component"] for r in far} == {1} and all(math.isfinite(r["whitened"]) for r in far)
    assert {r["vec_id"]: r["deviation"] is None for r in far} == {1: True, 2: True, 3: False}


@pytest.mark.parametrize("name", ["op11_top_k", "op12_prefix_trie"])
def test_query_matches_sql(spark, name):
    from tidegrid.llm.registry import ORACLES, QUERIES

    compare(spark, QUERIES[name], ORACLES[name], SF)


def test_whitening_query(spark):
    got = whitening.op13_whitening(spark, SF)
    assert got.count() == 500 * 16 and got.where("identity_error > 1e-9").isEmpty()
