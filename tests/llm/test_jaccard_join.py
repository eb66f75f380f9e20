import random

import numpy as np
import pytest

from isobath.llm import jaccard_join
from isobath.llm.jaccard_join import jaccard_components, prefix_size
from tests.llm.test_near_dedup import brute as components_of
from tests.llm.test_near_dedup import texts


def brute(rows, k=5, percent=80):
    return {i: r[:2] for i, r in components_of(rows, k, percent).items()}


def collect(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k, percent", [(5, 80), (2, 60)])
def test_equals_all_pairs(spark, k, percent):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    assert collect(jaccard_components(df, k=k, percent=percent)) == brute(texts(), k, percent)


def test_prefix_leaves_too_little_for_the_similarity():
    for percent in (50, 80, 81, 100):
        for n in range(1, 300):
            p = prefix_size(n, percent)
            # a partner without one of the prefix shares n - p at most
            assert 100 * (n - p) < percent * n and 1 <= p <= n
            assert 100 * (n - p + 1) >= percent * n
    assert prefix_size(0, 80) == 0


def near_copies(seed, groups, size, edits):
    """Texts that share a passage, in groups whose members lie around the wanted similarity."""
    rng = random.Random(seed)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.choice([20, 60, 140]))] + shared
        for _ in range(rng.randrange(2, size)):
            own = list(base)
            for j in rng.sample(range(len(own)), rng.randrange(0, edits)):
                own[j] = f"n{rng.randrange(10**6)}"
            rows += [(len(rows) * 3, " ".join(own))] * rng.choice([1, 1, 1, 2])
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("common", [1, 3])
def test_groups_around_the_limit(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard_join, "SAMPLE", common)
    rows = near_copies(common, 12, 14, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collect(jaccard_components(df)) == brute(rows)


def test_one_group_of_classes_with_one_prefix(spark, monkeypatch):
    """Common shingles at the end: the texts differ there only, so that all have one prefix and size, and not all link."""
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    monkeypatch.setattr(jaccard_join, "COMMON", 2)
    rng = random.Random(2)
    ends = [" ".join(f"e{i}x{j}" for j in range(12)) for i in range(8)]
    rows = []
    for i in range(40):
        picked = sorted(rng.sample(range(8), 4))
        rows.append((i, " | ".join([" ".join(f"h{j}" for j in range(60))] + [ends[p] for p in picked])))
    rows += [(100 + i, e) for i, e in enumerate(ends * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collect(jaccard_components(df)) == brute(rows)


def test_a_long_text_and_its_copy(spark):
    rng = random.Random(1)
    long = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    other = list(long)
    for i in range(0, 200_000, 60):
        other[i] = f"n{i}"
    rows = [(5, " ".join(long)), (9, " ".join(other)), (7, " ".join(long[:100_000]))]
    got = collect(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: c for i, (_, c) in got.items()} == {5: 5, 9: 5, 7: 7}


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, "a b c d e f", "k"), (1, "a b c d e f", "k"), (2, "A B c d e f", None), (None, "a b c d e f", None), (3, None, "z"), (4, "q r s t u v w", "z"), (4, "a b c d e f", "y"), (5, "q R s t u v w", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n_shingles` string")
    got = sorted(map(tuple, jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, None, None), (3, 0, 3), (4, 3, 1), (4, 3, 1), (5, 3, 1)], key=str)
    assert jaccard_components(df.limit(0)).count() == 0
    strings = spark.createDataFrame([("b", "x y"), ("a", "X y"), ("c", "")], "doc_id string, text string")
    assert collect(jaccard_components(strings)) == {"a": (1, "a"), "b": (1, "a"), "c": (0, "c")}


def test_bitmaps_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(4)
    for n, m, both in ((1, 1, 0), (5, 4, 4), (300, 300, 290), (700, 600, 550), (9000, 8000, 7900), (40_000, 33_000, 100)):
        h = rng.integers(0, 2**64, n + m - both, np.uint64)
        a, b = h[:n], h[n - both :]
        got = jaccard_join.differing(jaccard_join.parity(a), jaccard_join.parity(b))
        assert got <= n + m - 2 * both and got == jaccard_join.differing(jaccard_join.parity(b), jaccard_join.parity(a))
    # unrelated sets are refuted
    assert got > (n + m) / 9
