"""Operators on texts against brute force, and their defined results on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from fixtures import Union, corpus, frame, odd_rows, words
from oracle import compare
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import components, debruijn, mixing, packing, quality, registry, simhash, suffix_dedup, suffix_sort, tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


# --- op1


def slow_fingerprint(text, n=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    pieces = [b" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    rows = [r for r in corpus()]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark)).collect()}
    prints = {i: slow_fingerprint(t) for i, t, _ in rows}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r["fingerprint"] for i, r in got.items()}
    groups = Union(prints)
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                groups.join(a, b)
    assert {i: groups.find(i) for i in prints} == {i: r["component_id"] for i, r in got.items()}


@pytest.mark.parametrize(("bits", "segments"), [(2, 2), (3, 2), (2, 4), (5, 2)])
def test_links_are_all_close_pairs(spark, bits, segments):
    rng = random.Random(bits)
    prints = [rng.getrandbits(64) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits + 1))) for p in prints for _ in range(4)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {frozenset((r["u"], r["v"])) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bits, segments).collect()}
    wanted = {frozenset((a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    assert found == wanted


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (41, 40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(42)} | {i: 100 for i in range(100, 130)}
    assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_simhash_on_odd_rows(spark):
    got = simhash.near_duplicates(frame(spark, [], odd_rows())).collect()
    assert len(got) == 4 and sorted(r["component_id"] or 0 for r in got if r["doc_id"]) == [100001, 100001]
    assert simhash.near_duplicates(frame(spark, [])).isEmpty()
    kept = simhash.keep_one(frame(spark, None, odd_rows()))
    assert kept.columns == frame(spark).columns and kept.where("doc_id = 100001").count() == 1 and kept.where("doc_id is null").count() == 2


# --- op3


def slow_words(rows, width=50):
    texts = {i: (t or "").encode().split() for i, t, _ in rows}
    first, out = {}, {}
    for i in sorted(texts):
        for a in range(len(texts[i]) - width + 1):
            first.setdefault(tuple(texts[i][a : a + width]), i)
    for i, found in texts.items():
        gone = set()
        for a in range(len(found) - width + 1):
            if first[tuple(found[a : a + width])] < i:
                gone.update(range(a, a + width))
        out[i] = (len(found), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(found) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_words(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: tuple(r)[1:] for r in debruijn.digest(frame(spark, rows)).collect()}
    assert got == slow_words(rows) and sum(n for _, n, _ in got.values()) > 500


def test_repeated_words_in_knotty_graphs(spark):
    """Few different words: vertices branch everywhere and paths run in circles."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(5, 60))), "s") for i in range(30)] + [(50 + i, "a b c " * rng.randint(1, 20), "s") for i in range(6)]
    got = {r["doc_id"]: tuple(r)[1:] for r in debruijn.digest(frame(spark, rows), width=8, k=3).collect()}
    assert got == slow_words(rows, 8)


def test_repeated_words_on_odd_rows(spark):
    got = debruijn.digest(frame(spark, None, odd_rows())).collect()
    assert len(got) == len(corpus()) + 4
    assert [r["n_removed"] for r in got if r["doc_id"] in (None, 100001)] == [0] * 4
    assert debruijn.digest(frame(spark, [])).isEmpty()


# --- op5


def slow_bytes(rows, width=100):
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        raw, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for a in range(len(raw) - width + 1):
            if raw[a : a + width] in seen:
                gone[a : a + width] = b"\1" * width
            seen.add(raw[a : a + width])
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("settings", [{}, {"hot": 3, "shard_bytes": 2000}, {"hot": 1}])
def test_repeated_bytes(spark, settings):
    rows = corpus(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(frame(spark, rows), **settings).collect()}
    assert got == slow_bytes(rows) and sum(n for _, n, *_ in got.values()) > 3000


def test_cut_texts_keep_their_columns(spark):
    rows = corpus(3)
    cut = suffix_dedup.cut_repeats(frame(spark, rows, odd_rows()))
    assert cut.columns == frame(spark).columns and cut.count() == len(rows) + 4
    lengths = {r["doc_id"]: r for r in cut.where("doc_id < 100000").collect()}
    wanted = slow_bytes(rows)
    assert all(abs(len((lengths[i]["text"] or "").encode()) - (n - gone)) <= 3 * spans for i, (n, gone, spans, _) in wanted.items())
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in lengths.values())


def test_repeated_bytes_on_odd_rows(spark):
    got = suffix_dedup.digest(frame(spark, None, odd_rows())).collect()
    assert len(got) == len(corpus()) + 4
    twice = [tuple(r)[1:] for r in got if r["doc_id"] == 100001]
    assert twice[0] == twice[1] and twice[0][2] == 1  # only what repeats within the text
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0, 0]
    assert suffix_dedup.digest(frame(spark, [])).isEmpty()


def shared_ids():
    """Rows of one doc_id with different texts, each also in another document."""
    rng = random.Random(8)
    one, other = words(rng, 130), words(rng, 140)
    return [(1, one, "s"), (7, one, "s"), (7, other, "s"), (9, other, "s"), (9, other, "s"), (9, one + " " + other, "s")], one, other


def test_rows_that_share_an_id_keep_what_is_theirs(spark):
    rows, one, other = shared_ids()
    both = len(one.encode()), len(other.encode())
    sizes = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digest(frame(spark, rows)).collect())
    assert sizes == sorted([(1, both[0], 0), (7, both[0], both[0]), (7, both[1], 0), (9, both[1], both[1]), (9, both[1], both[1]), (9, sum(both) + 1, sum(both))])
    counts = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in debruijn.digest(frame(spark, rows)).collect())
    assert counts == sorted([(1, 130, 0), (7, 130, 130), (7, 140, 0), (9, 140, 140), (9, 140, 140), (9, 270, 270)])


@pytest.mark.parametrize("op", [suffix_dedup, debruijn])
def test_many_places_of_one_anchor(spark, op):
    """A passage that very many documents hold, so that its places travel in rows of their own."""
    rng = random.Random(9)
    passage = words(rng, 70)
    rows = [(i, words(rng, 3) + " " + passage + " " + words(rng, 4), "s") for i in range(1, 200)] + [(300, "la " * 700, "s"), (301, "la " * 500 + words(rng, 9), "s")]
    settings = {"hot": 50} if op is suffix_dedup else {}
    got = {r["doc_id"]: tuple(r)[1:] for r in op.digest(frame(spark, rows), **settings).collect()}
    assert got == (slow_bytes if op is suffix_dedup else slow_words)(rows)


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for k in range(200):
        t = np.append(rng.integers(1, rng.integers(2, 6) if k % 2 else 60, rng.integers(1, 90)), 0)
        assert suffix_sort.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_arrays_recurse_on_real_text(spark, monkeypatch):
    """Names of substrings are sorted by the same induction, level by level, until all differ."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").orderBy("doc_id").collect()]
    raw = np.frombuffer("\n".join(texts).encode()[:200_000], np.uint8)
    levels, sort = [], suffix_sort.suffix_array

    def counted(t):
        levels.append((len(t), int(t.max()) + 1))
        return sort(t)

    monkeypatch.setattr(suffix_sort, "suffix_array", counted)
    order = counted(np.append(raw.astype(np.int64) + 1, 0))
    assert len(levels) >= 4 and levels[1][1] > 1000  # large alphabets are induced too
    text = raw.tobytes()
    assert all(text[a : a + 3000] <= text[b : b + 3000] for a, b in zip(order[1:-1].tolist(), order[2:].tolist()))


def test_permuted_common_prefixes():
    for text in (b"banana bananas and bananas again, bandanas", b"ab" * 90, b"a" * 70 + b"b" + b"a" * 70):
        raw = np.frombuffer(text, np.uint8)
        order = suffix_sort.suffix_array(np.append(raw.astype(np.int64) + 1, 0))[1:]
        got = suffix_sort.permuted_common_prefixes(raw, order, 50)
        assert got[order[0]] == 0
        for a, b in zip(order[1:], order[:-1]):
            both = len(text) - max(a, b)
            assert got[a] == min(50, next((k for k in range(both) if text[a + k] != text[b + k]), both))


# --- op2


def test_tokens_are_the_tokenizers_own():
    path = packing.default_tokenizer()
    whole, raw = Tokenizer.from_file(path), [(t or "").encode() for _, t, _ in corpus()] + ["Straße ÀÉ, İx. a,b. c.. ,d A.B 12,5 x\u0308".encode()]
    wanted = [x.ids for x in whole.encode_batch_fast([r.decode() for r in raw], add_special_tokens=False)]
    for most in (10, 500_000):
        own = tokens.WordEncoder(path, most)
        for _ in range(2):
            for k in range(0, len(raw), 7):
                ids, sizes = own.encode(raw[k : k + 7])
                ends = np.cumsum(sizes)
                assert [ids[a:b].tolist() for a, b in zip(ends - sizes, ends)] == wanted[k : k + 7]


def test_packing_is_a_round_trip(spark):
    rows = corpus() + [(9000 + i, words(random.Random(i), 700 + 60 * i), "s") for i in range(30)]
    got = packing.pack(frame(spark, rows)).toPandas()
    whole = Tokenizer.from_file(packing.default_tokenizer())
    for i, t, _ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048


def test_packing_on_odd_rows(spark):
    got = packing.pack(frame(spark, [], odd_rows())).collect()
    assert len(got) == 4 and sum(r["doc_tokens"] == 1 for r in got) == 1 and sum(r["doc_id"] is None for r in got) == 2
    assert packing.pack(frame(spark, [])).isEmpty()


def test_plan_covers_and_is_near_its_bound():
    rng = np.random.default_rng(2)
    histogram = {int(c): int(n) for c, n in zip(range(1, 65), rng.integers(0, 400, 64))}
    plan = packing.plan(histogram, 64)
    slots = defaultdict(int)
    for pattern, times in plan:
        assert sum(c * k for c, k in pattern.items()) <= 64
        for c, k in pattern.items():
            slots[c] += k * times
    assert all(slots[c] == n for c, n in histogram.items() if n)
    small = {c: n for c, n in histogram.items() if c < 64 and n}
    _, bound = packing.solve_patterns(np.array(list(small)), np.array(list(small.values()), float), 64)
    assert bound >= sum(c * n for c, n in small.items()) / 64
    assert sum(t for _, t in plan) - histogram[64] <= 1.002 * bound + 2
    assert packing.plan({}, 64) == [] and packing.plan({64: 3}, 64) == [({64: 1}, 3)]


def test_knapsack_is_the_best():
    sizes, values = np.array([3, 5, 7]), np.array([0.3, 0.55, 0.7])
    best, counts = packing._knapsack(sizes, values, 16)
    every = [(a * 0.3 + b * 0.55 + c * 0.7) for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16]
    assert math.isclose(best, max(every)) and counts @ sizes <= 16 and math.isclose(counts @ values, best)


# --- op6


def skewed(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 60)), "hot" if i % 3 else f"s{i % 7}") for i in range(400)] + [(1000 + i, words(rng, 4), "tiny") for i in range(5)]
    return rows


def test_mixture_reaches_its_budget(spark):
    rows = skewed(spark)
    sizes = {i: len(t.split()) for i, t, _ in rows}
    total, whole = defaultdict(int), sum(sizes.values())
    for i, _, s in rows:
        total[s] += sizes[i]
    got = mixing.mix(frame(spark, rows), target_entropy=0.95, max_repeats=4.0, block_tokens=200).toPandas()
    assert got.groupby(["doc_id", "epoch"]).size().max() == 1 and (got.progress < 1).all()
    n = {s: int(got[got.source == s].n_tokens.sum()) for s in total}
    shares = {s: t / whole for s, t in total.items()}
    lo, hi = 0.0, 1.0
    entropy = lambda e: (lambda w: -sum(x * math.log(x) for x in w))([p**e / sum(q**e for q in shares.values()) for p in shares.values()])
    repeats = lambda e: max(whole * p**e / sum(q**e for q in shares.values()) / total[s] for s, p in shares.items())
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(mid) >= 0.95 * math.log(len(shares)) else (lo, mid)
    exponent = lo
    if repeats(exponent) > 4.0:
        hi = 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if repeats(mid) <= 4.0 else (mid, hi)
        exponent = hi
    for s, p in shares.items():
        asked = whole * p**exponent / sum(q**exponent for q in shares.values())
        assert asked - 1 <= n[s] <= asked + max(sizes.values())
        full = int(asked // total[s])
        assert all((got[(got.source == s) & (got.epoch == e)].n_tokens.sum() == total[s]) for e in range(full))
    assert max(got.epoch) <= 4


def test_mixture_of_skewed_sources_matches_sql(spark, tmp_path):
    import duckdb
    from oracle import rows as plain

    docs = frame(spark, skewed(spark) + [(5000, None, "hot"), (5001, "", "tiny")]).select("doc_id", "text", "source")
    made = mixing.mix(docs).toPandas()
    connection = duckdb.connect()
    table = docs.toPandas()
    connection.register("documents", table)
    assert plain(made) == plain(connection.sql(mixing.OP6_SQL).df())


def test_mixture_on_odd_rows(spark):
    got = mixing.mix(frame(spark, corpus(), odd_rows()))
    assert got.where("doc_id = 100001 and epoch = 0").count() in (0, 1, 2) and got.where("source = ''").count() > 0
    assert mixing.mix(frame(spark, [])).isEmpty() and mixing.mix(frame(spark, [(1, "", "s"), (2, None, "t")])).isEmpty()
    kept = mixing.rebalance(frame(spark, skewed(spark)), 0.95)
    assert kept.columns == frame(spark).columns and kept.groupBy("doc_id").count().where("count > 1").isEmpty()
    before, after = ({r["source"]: r["count"] for r in x.groupBy("source").count().collect()} for x in (frame(spark, skewed(spark)), kept))
    assert 0.3 * before["hot"] < after["hot"] < before["hot"] and all(after[s] == n for s, n in before.items() if s != "hot")


# --- op8


def test_quality_on_held_out_rows(spark):
    rows = quality.op8_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    got = rows.toPandas()
    out = got[got.held_out]
    assert set(got.held_out) == {True, False} and all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(got.doc_id, got.held_out))
    assert (out.predicted == out.quality).mean() > 0.9
    ranks = out.score.rank()
    good = out.quality == 1
    assert (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) > 0.9


def test_quality_scores_depend_on_the_text_alone(spark):
    network = quality.Network(3)
    raw = [(t or "").encode() for _, t, _ in corpus()] + [b"x" * 300_001, b"ab" * 200_000 + b"tail!"]
    together, apart = network.scores(raw), np.array([network.scores([r])[0] for r in raw])
    assert np.abs(together - apart).max() < 1e-4 and ((0 <= together) & (together <= 1)).all()


def test_quality_in_long_runs_equals_one_run(monkeypatch):
    network, text = quality.Network(3), words(random.Random(9), 40_000).encode()
    pieces = network.scores([text])[0]
    monkeypatch.setattr(quality, "RUN_BYTES", 1 << 24)
    assert abs(pieces - network.scores([text])[0]) < 1e-4


def test_quality_slopes_are_right():
    network = quality.Network(1)
    for k in network.p:
        network.p[k] = network.p[k].astype(np.float64)
    texts, labels, weights = [b"some text here, " * 40, b"and %% other ## marks", b"short"], np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        total = 0.0
        for t, y in zip(texts, labels):
            p = network.scores([t])[0]
            total -= (y * math.log(p) + (1 - y) * math.log(1 - p)) / 3
        return total + 5e-5 * float((network.p["out"] ** 2).sum())

    slopes = network._slopes(texts, labels, weights)
    rng = np.random.default_rng(0)
    for name in ("out", "bias", "left", "right", "out_bias"):
        flat, found = network.p[name].reshape(-1), slopes[name].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - found[i]) < 5e-3


def test_quality_on_odd_rows(spark):
    network = quality.Network(2)
    got = quality.score(frame(spark, None, odd_rows()), network).collect()
    assert len(got) == len(corpus()) + 4 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(frame(spark, []), network).isEmpty()
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    one = quality.learn(frame(spark), labels)
    assert one.fixed and one.fixed > 0.5
    assert quality.learn(frame(spark), labels.limit(0)).fixed == 0.5
    assert quality.keep_good(frame(spark), one).columns == frame(spark).columns


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).persist())
        assert seen[-1].columns == columns
    good, single, cut, mixed = seen[1:]
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").select("doc_id")
    assert good.join(bad, "doc_id").count() <= 0.3 * docs.join(bad, "doc_id").count() and good.count() > 0.8 * docs.count()
    assert single.count() == simhash.similar_groups(good).select("component_id").distinct().count()
    before = [(r["doc_id"], r["text"], "") for r in single.collect()]
    wanted = slow_bytes(before)
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(after[i] == t for i, t, _ in before if wanted[i][1] == 0) and set(after) == {i for i, *_ in before}
    assert mixed.join(cut, "doc_id").count() == mixed.count() <= cut.count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.agg(F.sum("length")).first()[0] == packed.dropDuplicates(["doc_id"]).agg(F.sum("doc_tokens")).first()[0]
    assert packed.select("doc_id").distinct().count() == mixed.count()


def test_every_stage_on_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, an id with two texts, clashing names, and no rows at all."""
    import corpus_pipeline

    docs = frame(spark, None, odd_rows())
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF).persist()
            assert rows.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        whole = packed.dropDuplicates(["doc_id", "start", "sequence_id", "offset"])
        assert packed.count() == whole.count() >= rows.count()


def test_long_labelled_texts_are_learned_from(spark):
    """Labels that only texts of over WHOLE letters have: the mark stands anywhere in them."""
    rng = random.Random(4)
    texts = [words(rng, 200) * 40 if k % 2 else " ".join("%#" + words(rng, 1) + "##" for _ in range(200)) * 30 for k in range(30)]
    assert min(map(len, texts)) > quality.WHOLE
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(90, None), (91, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(90, 0), (91, None), (5, 7)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.learn(docs, labels)).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in range(30)) and len(got) == 32
