import math
from collections import Counter

import numpy as np

from isobath.llm.language_id import DIMENSIONS, choose, cluster, fit, held_out, identify, op10_language_id, term_counts, vectors
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    own = [r for r in got if r.held_out and len(r.text) > 40]
    assert len(own) > 200
    assert sum(r.lang == r.lang_pred for r in own) / len(own) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in own) / len(own) < 0.1


def test_counts_equal_a_plain_count():
    texts = ["abc", "Ärger!", "", "a b"]
    together = term_counts(texts)
    assert all(np.array_equal(term_counts([t])[0], together[i]) for i, t in enumerate(texts))
    assert together.shape == (4, DIMENSIONS) and together[0].sum() == 2 * 4


def test_clusters_of_separate_directions():
    x = np.eye(3)[[0, 0, 1, 1, 2]]
    c, own = cluster(x, 3)
    assert len({own[0], own[2], own[4]}) == 3 and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert np.allclose(np.linalg.norm(vectors(["some words"], np.ones(DIMENSIONS, np.float32)), axis=1), 1)


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en", 5), (2, "der hund und die katze", "de", 5), (3, None, "en", 1), (4, "", None, 1), (5, "12 !?", "de", 1), (None, "the dog", None, 1), (1, "the cat and the dog", "en", 5), (7, "the dog " * 50000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.text and r.text[:7]): r for r in identify(df, fit(df, "text", "lang", F.col("doc_id"))).collect()}
    assert got[(1, "the cat")].lang_pred == "en" and got[(2, "der hun")].lang_pred == "de" and got[(7, "the dog")].lang_pred == "en"
    assert [got[k].lang_pred for k in ((3, None), (4, ""), (5, "12 !?"))] == ["und"] * 3
    assert isinstance(got[(3, None)].score, float) and got[(None, "the dog")].lang_pred == "en"
    none = identify(df, fit(df.limit(0), "text", "lang", F.col("doc_id")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert identify(df.limit(0), fit(df, "text", "lang", F.col("doc_id"))).count() == 0


def plain_grams(text):
    """Hashed byte bigrams and trigrams of a text, one at a time."""
    b = [x if 97 <= x <= 122 or x >= 128 else 32 for x in f" {text.lower()}  ".encode()]
    out = Counter()
    for i in range(len(b) - 2):
        out[((((b[i] << 8) | b[i + 1]) * 0x9E3779B1) & 0xFFFFFFFF) >> 18] += 1
        out[((((b[i] << 16) | (b[i + 1] << 8) | b[i + 2]) * 0x85EBCA77) & 0xFFFFFFFF) >> 18] += 1
    return out


def test_predictions_equal_a_plain_nearest_centroid(spark):
    """Document frequencies, TF-IDF, cosines, floors and the nearest centroid, recomputed with dictionaries on a whole table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    learn = docs.filter(~held_out("doc_id"))
    model = fit(learn, "text", "lang", F.col("doc_id"))
    known = [plain_grams(r.text) for r in learn.filter("lang IS NOT NULL").collect() if r.text and any(c.isalpha() for c in r.text)]
    held = Counter(g for k in known for g in k)
    idf = {d: math.log((1 + len(known)) / (1 + held[d])) + 0.1 for d in range(DIMENSIONS)}
    assert np.allclose(model.idf, [idf[d] for d in range(DIMENSIONS)], atol=1e-5)
    centroids = [{int(d): float(c[d]) for d in np.flatnonzero(c)} for c in model.centroids]
    assert all(math.isclose(sum(x * x for x in c.values()), 1, abs_tol=1e-4) for c in centroids)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op10_language_id(spark, sf).collect():
        t = texts[r.doc_id]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = {d: math.log1p(n) * idf[d] for d, n in plain_grams(t).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * c.get(d, 0.0) for d, x in v.items()) / length for c in centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert math.isclose(r.score, max(0.0, cosines[best]), abs_tol=1e-4)
        assert r.lang_pred == model.langs[best] or cosines[best] - cosines[model.langs.index(r.lang_pred)] < 1e-4
        assert r.rejected == (cosines[best] < model.floors[best]) or abs(cosines[best] - model.floors[best]) < 1e-4


def test_a_sample_is_bounded_at_every_size(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 4 > 0, "a").otherwise("b").alias("lang"), ((F.xxhash64("id") / 2.0**64) + 0.5).alias("u"), "id")
    sizes = {"a": 3000, "b": 1000}
    got = choose(rows, sizes, 50).collect()
    for lang in "ab":
        smallest = sorted(r.u for r in rows.filter(f"lang = '{lang}'").collect())[:50]
        assert sorted(r.u for r in got if r.lang == lang) == smallest
    # of some thousand million rows a language, few get as far as the ranking, and a sample is no larger for it
    assert choose(rows, {"a": 3 * 10**9, "b": 10**10}, 50).count() <= 1
    # rows that share one hash do not widen it either
    assert choose(rows.withColumn("u", F.lit(0.0)), {"a": 3000, "b": 10**10}, 50).groupBy("lang").count().filter("count <> 50").count() == 0
