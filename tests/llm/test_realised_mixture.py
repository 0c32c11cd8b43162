"""The pipeline's mixture stage reaches its entropy in the tokens that it keeps."""

import math
import random
from collections import Counter

import pytest
from fixtures import frame, words

import corpus_pipeline
from tidegrid.llm import mixing


def hot(share, tiny=0):
    """20 sources, one of which has about `share` of the tokens and `tiny` of which have a hundredth of the others'."""
    rng = random.Random(3)
    texts = [(f"s{k}", rng.randint(15, 25)) for k in range(19) for _ in range(1 if k < tiny else 40)]
    others = sum(n for _, n in texts)
    while sum(n for s, n in texts if s == "hot") < share / (1 - share) * others:
        texts.append(("hot", rng.randint(15, 25)))
    return [(i, words(rng, n), s) for i, (s, n) in enumerate(texts)]


def entropy(rows):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(r["text"].split())
    whole = sum(sizes.values())
    return -sum(n / whole * math.log(n / whole) for n in sizes.values()) / math.log(len(sizes))


@pytest.mark.parametrize(("share", "tiny"), [(1 / 2, 0), (1 / 3, 0), (0.9, 0), (1 / 2, 2)])
def test_stage_reaches_its_entropy(spark, share, tiny):
    rows = hot(share, tiny)
    kept = corpus_pipeline.rebalance(spark, frame(spark, rows), "").collect()
    assert len({r["doc_id"] for r in kept}) == len(kept)
    before, after = Counter(s for *_, s in rows), Counter(r["source"] for r in kept)
    assert abs(entropy(kept) - 0.9) < 0.004
    assert all(after[s] == n for s, n in before.items() if s != "hot") and after["hot"] < before["hot"]


def test_budget_falls_where_equal_weights_fall_short(spark):
    rows = hot(0.9, 12)
    kept = mixing.rebalance(frame(spark, rows), 0.8, realise=True).collect()
    assert abs(entropy(kept) - 0.8) < 0.02


def test_measures_are_the_same_with_and_without_the_driver(spark, monkeypatch):
    """Above MAX_SOURCES sources each step is an aggregation; its numbers are those of the totals on the driver."""
    sizes = [1, 7, 7, 40, 900, 12_345, 0]
    totals = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, total long")
    whole, budget = float(sum(sizes)), 5_000.0
    few = mixing._measures(totals, whole, budget), mixing._realised(totals, whole, budget, 2)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    many = mixing._measures(totals, whole, budget), mixing._realised(totals, whole, budget, 2)
    for exponent in (0.0, 0.3, 1.0):
        assert many[0](exponent) == pytest.approx(few[0](exponent))
        for share in (0.2, 1.0):
            assert many[1](exponent, share) == pytest.approx(few[1](exponent, share))
