"""Line dedup against a brute force in Python, on both ways of probing."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.llm.line_dedup import PerfectHash, Shard, ShardedIndex, build_shard, dedup_lines

WHITE = " \t\n\x0b\f\r"
DOCS = [
    (1, "Home | About\nfirst words\nsame\nsame"), (2, "  home | about\t\nsecond\n"), (3, "HOME | ABOUT\r\nthird\nÄ"), (4, None), (5, ""), (6, "home | about"),
    (6, "home | about"), (7, "ä\nfirst words"), (8, "long " * 200_000 + "\nhome | about\nend"), (9, "\n\n \n"), (None, "same\nfirst words"), (10, "Same\nx\n\nX"), (11, " same\nfirst words "),
]


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def expected(rows, min_docs, min_chars):
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if held[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()], key=repr)


@pytest.mark.parametrize("options", [{}, {"broadcast_keys": 0}, {"broadcast_keys": 0, "probes": 2}])
@pytest.mark.parametrize(("min_docs", "min_chars"), [(3, 1), (2, 5)])
def test_equals_brute_force(spark, options, min_docs, min_chars):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    assert found(dedup_lines(docs, min_docs=min_docs, min_chars=min_chars, **options)) == expected(DOCS, min_docs, min_chars)


@pytest.mark.parametrize("options", [{}, {"broadcast_keys": 0}])
def test_empty_table_and_clashing_names(spark, options):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(none, **options).collect() == []
    docs = spark.createDataFrame([(i, "a\nb" if i else "b", -1, [i], "kept") for i in range(3)], "doc_id long, text string, N_Lines long, `h1` array<int>, `odd.name` string")
    got = dedup_lines(docs, min_docs=3, **options)
    assert sorted(got.columns) == sorted(["doc_id", "h1", "odd.name", "text", "n_lines", "n_dropped"])
    assert sorted((r.doc_id, r.text, r.n_dropped, r["h1"], r["odd.name"]) for r in got.collect()) == [(0, "", 1, [0], "kept"), (1, "a", 1, [1], "kept"), (2, "a", 1, [2], "kept")]


def test_both_ways_agree_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ways = [found(dedup_lines(docs, min_docs=3, **o).withColumn("text", F.md5("text"))) for o in ({}, {"broadcast_keys": 0, "probes": 100})]
    assert ways[0] == ways[1] and sum(r[2] for r in ways[0]) > 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    table = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(table.index(keys).tolist()) == list(range(5000))


def test_keys_that_share_a_first_hash_are_all_held():
    h1, h2, n = np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 3, 4], np.uint64), np.array([10, 30, 20, 40])
    index = ShardedIndex([(0, *build_shard(h1, h2, n))], 1)
    assert index.counts(h1, h2).tolist() == n.tolist()
    assert index.counts(np.array([7, 8], np.uint64), np.array([4, 1], np.uint64)).tolist() == [0, 0]
    assert len(Shard(*build_shard(h1, h2, n)).more) == 2
