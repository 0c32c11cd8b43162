"""The pipeline's near-copy stage against brute-force Jaccard similarity of 5-word shingles."""

import random

from fixtures import Union, corpus, frame, odd_rows, words
from pyspark.sql import functions as F

from tidegrid.llm import common, simhash


def slow_set(text):
    found = (text or "").encode().lower().split()
    return frozenset(tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))) if found else frozenset()


def near(a, b):
    both = len(a & b)
    return a == b or both >= 0.8 * (len(a) + len(b) - both)


def slow_groups(rows):
    sets, groups = {i: slow_set(t) for i, t, _ in rows}, Union(i for i, *_ in rows)
    for a in sets:
        for b in sets:
            if a < b and near(sets[a], sets[b]):
                groups.join(a, b)
    return {i: groups.find(i) for i in sets}


def edited(rng, text, changes):
    found = text.split()
    for k in rng.sample(range(len(found)), changes):
        found[k] = words(rng, 1)
    return " ".join(found)


def planted():
    """Edited copies on both sides of the threshold, a long chain of edits, and a group of many near copies."""
    rng = random.Random(8)
    texts = [words(rng, rng.randint(60, 200)) for _ in range(40)]
    texts += [edited(rng, t, changes) for t in texts[:40] for changes in (1, 2, 3, 5)]
    for _ in range(12):
        texts.append(edited(rng, texts[-1], 1))
    base = words(rng, 150)
    texts += [edited(rng, base, 2) for _ in range(60)]
    return [(i, t, "s") for i, t in enumerate(texts)]


def test_near_copies_are_the_brute_force_groups(spark):
    for rows in (planted(), corpus()):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
        assert got == slow_groups(rows)


def test_crowded_and_hot_segment_values_lose_nothing(spark):
    rows = planted()
    for hot in (0, 20):  # all values are hot; those of the large group are
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows), hot=hot, sampled=1).collect()}
        assert got == slow_groups(rows)


def test_the_stage_drops_near_copies(spark):
    import corpus_pipeline

    rows = planted()
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")
    assert kept.columns == frame(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(slow_groups(rows).values()))


def test_near_copies_on_odd_rows(spark):
    assert simhash.similar_groups(frame(spark, [])).isEmpty()
    kept = simhash.keep_dissimilar(frame(spark, None, odd_rows()))
    assert kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 100001").count() == 1


def test_rows_that_share_an_id_are_kept_or_dropped_by_their_own_text(spark):
    """A second text of an id went with the first, or stayed with it though it is a near copy."""
    rng = random.Random(11)
    a, b, c, d = (words(rng, 120) for _ in range(4))
    rows = [(1, a, "s"), (1, b, "s"), (2, edited(rng, a, 1), "s"), (0, c, "s"), (3, edited(rng, c, 1), "s"), (3, d, "s"), (3, d, "s"), (4, edited(rng, b, 1), "s"), (5, a, "s")]
    kept = simhash.keep_dissimilar(frame(spark, rows))
    assert kept.columns == frame(spark).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(0, c), (1, a), (1, b), (3, d)])
    # near copies under one id: one of them
    rows = [(7, a, "s"), (7, edited(rng, a, 1), "s"), (8, edited(rng, a, 1), "s")]
    assert [r["doc_id"] for r in simhash.keep_dissimilar(frame(spark, rows)).collect()] == [7]


def of_one_template(n, changes, pairs, seed=3, size=200):
    """n texts that differ from one template in `changes` words of their own, below the threshold of each other, and near copies of some."""
    rng = random.Random(seed)
    base = words(rng, size)
    texts = [edited(rng, base, changes) for _ in range(n)]
    texts += [edited(rng, texts[i], 2) for i in range(pairs)]
    return [(i, t, "s") for i, t in enumerate(texts)]


def test_pairs_inside_one_template_are_all_found(spark):
    rows = of_one_template(300, 8, 30)
    expected = slow_groups(rows)
    assert len(set(expected.values())) == 300  # the template itself links nothing
    for hot in (0, simhash.HOT):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows), hot=hot, sampled=1).collect()}
        assert got == expected


def test_values_of_a_few_rows_more_meet_each_other(spark):
    """Too many rows for the first meeting, too few for leaders and the exact search: pairs of one template meet late."""
    rows = of_one_template(20, 8, 6, seed=5)
    expected = slow_groups(rows)
    assert len(rows) <= simhash.MANY and len(set(expected.values())) == 20
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()} == expected


def test_a_row_of_a_large_group_meets_few_firsts(spark):
    """As many values of more rows as there may be: a row meets two firsts of them, and all that small values bring."""
    met = [(key, 500, 9, 100 + key, None, None, None) for key in range(40)] + [(90, 501, 3, None, 7, 8, None), (91, 501, 2, None, 7, None, None)]
    frame_ = spark.createDataFrame(met, "key long, node long, rows long, m0 long, m1 long, m2 long, m3 long")
    assert sorted(map(tuple, simhash._first_pairs(frame_).collect())) == [(500, 100), (500, 101), (501, 7), (501, 8)]


def test_rows_of_crowded_values_are_one_a_text(spark, monkeypatch):
    """What roots are joined to grows with the texts, not with the values that they share."""
    seen, save = [], simhash.saved

    def spied(df, name):
        found = save(df, name)
        if name == "segments":
            seen.append((found.count(), found.select("node").distinct().count()))
        return found

    monkeypatch.setattr(simhash, "saved", spied)
    rows = [r for r in planted() if r[0] >= 212]  # the group of many near copies
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows), hot=20, sampled=1).collect()}
    assert got == slow_groups(rows)
    assert seen and all(n == nodes > 0 for n, nodes in seen)


def with_zero_prints(spark, sets):
    rows = spark.createDataFrame([(node, node, len(items)) for node, items in sets.items()], "node long, root long, n long")
    return rows.select("*", *(F.lit(0).cast("long").alias(p) for p in simhash.PRINTS)), spark.createDataFrame([(n, sorted(i)) for n, i in sets.items()], "node long, items array<long>")


def test_shared_shingles_come_in_one_row_a_text_rarest_first(spark, monkeypatch):
    sets = {1: [5, -7, 9], 2: [5, -7, 11], 3: [5, 12], 4: [], 5: [13]}
    for items in (1, 1 << 19):
        monkeypatch.setattr(simhash, "BUCKET_ITEMS", items)
        found = {r["node"]: r["items"] for r in simhash._shared(with_zero_prints(spark, sets)[1]).collect()}
        assert found == {1: [-7, 5], 2: [-7, 5], 3: [5]}
    assert simhash._shared(with_zero_prints(spark, {1: []})[1]).isEmpty()


def test_prefix_search_keeps_similar_pairs_and_leaves_out_what_cannot_be_similar(spark, monkeypatch):
    rng = random.Random(11)
    template, own = list(range(200)), iter(range(10_000, 1_000_000))
    sets = {}
    for node in range(1, 61):
        sets[node] = set(rng.sample(template, 200 - (changed := rng.randint(0, 40)))) | {next(own) for _ in range(changed)}
    # these look each other up by a rare shingle, but from there on too little is left to be common
    sets[90] = set(template[:179]) | {5000} | {next(own) for _ in range(20)}
    sets[91] = set(template[:163]) | {5000} | {next(own) for _ in range(36)}
    similar = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(similar) > 50
    for head in (1, 64):
        monkeypatch.setattr(simhash, "HEAD", head)
        apart, lists = with_zero_prints(spark, sets)
        got = [tuple(r) for r in simhash._prefix_pairs(apart, lists, 0.8, 0).collect()]
        assert len(got) == len(set(got)) and similar <= set(got)
    assert (91, 90) not in got


def test_texts_are_read_few_at_a_time(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    try:
        for rows, found in ((4096, common.READ_ROWS), (64, 64)):
            spark.conf.set(key, str(rows))
            assert simhash._signatures(frame(spark, [(1, words(random.Random(1), 30), "a")]), 4, 16, 5).count() == 1
            assert int(spark.conf.get(key)) == found
    finally:
        spark.conf.set(key, before)
