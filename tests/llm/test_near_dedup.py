import re
import random

from isobath.llm.near_dedup import components, dedup_near, near_components

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            u = len(sets[a] | sets[b])
            if u and 100 * len(sets[a] & sets[b]) >= percent * u:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for g in range(30):
        base = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        for c in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 12)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            out.append(" ".join(own) if c % 3 else "\n".join(own).upper())
    out += [None, "", " \n\t", "one", "ONE", "two words", "a b c", "x " * 5000, "x " * 4000, "é ß ü É", "é ß ü é"]
    rng.shuffle(out)
    return list(enumerate(out, 10))


def collect(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_equals_all_pairs(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collect(near_components(df, k=4, percent=80)) == brute(rows, 4, 80)


def test_blocks_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr("isobath.llm.near_dedup.BLOCK", 8)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(90):
        own = list(base)
        for j in rng.sample(range(100), rng.randrange(0, 9)):
            own[j] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collect(near_components(df, k=4, percent=80)) == brute(rows, 4, 80)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert collect(near_components(df, k=4, percent=80)) == brute(rows, 4, 80)


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, "a b c d e f", 7, "k"), (1, "a b c d e f", 7, "k"), (2, "A B c d e f", 8, None), (None, "a b c d e f", 9, None), (3, None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, kept string")
    got = sorted(map(tuple, near_components(df, k=4).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, None, None, True), (3, 0, 3, True)], key=str)
    left = dedup_near(df.drop("n_shingles", "kept"), k=4).orderBy("doc_id").collect()
    assert [r.doc_id for r in left] == [None, 1, 3]
    assert near_components(df.limit(0)).count() == 0
    assert dedup_near(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 9), (9, 8)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, 8: 7, 9: 7}


def test_ids_of_other_types_and_of_several_texts(spark):
    rows = [(f"k{i:03}", t) for i, t in texts()]
    got = collect(near_components(spark.createDataFrame(rows, "doc_id string, text string"), k=4, percent=80))
    assert got == brute(rows, 4, 80)
    a, b = "a b c d e f g h i j", "q r s t u v w x y z"
    rows = [(5, a), (5, b), (6, a), (7, b), (4, "other words that stand alone"), (5, a)]
    got = collect(near_components(spark.createDataFrame(rows, "doc_id int, text string"), k=4, percent=80))
    assert got == {4: (2, 4, True), 5: (7, 5, True), 6: (7, 5, False), 7: (7, 5, False)}
    assert sorted(r.doc_id for r in dedup_near(spark.createDataFrame(rows, "doc_id int, text string"), k=4).collect()) == [4, 5]


def test_a_bucket_of_many_components(spark, monkeypatch):
    # a shared passage puts texts of several groups and sizes into the same buckets
    monkeypatch.setattr("isobath.llm.near_dedup.BLOCK", 4)
    monkeypatch.setattr("isobath.llm.near_dedup.BLOCK_BYTES", 4000)
    monkeypatch.setattr("isobath.llm.near_dedup.PIVOT_PAIRS", 3)
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(120)]
    rows = []
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(rng.choice([20, 40, 90]))]
        for c in range(rng.randrange(1, 12)):
            w = shared + own
            for j in rng.sample(range(len(w)), rng.randrange(0, 6)):
                w[j] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collect(near_components(df, k=4, percent=80)) == brute(rows, 4, 80)


def test_words_of_weak_hashes_differ(spark):
    bits = [i.bit_count() & 1 for i in range(2048)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (3, "".join("ab"[b] for b in bits))]
    got = collect(near_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=80))
    assert {i: r[1] for i, r in got.items()} == {1: 1, 2: 2, 3: 1}
