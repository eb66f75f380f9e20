import random
import re
from collections import Counter

from isobath.llm.common import working_path
from isobath.llm.substring_dedup import MAX_RUNS, FingerprintLog, remove_repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window, history=()):
    words = [WORD.findall(t or "") for _, t in rows]
    old = [WORD.findall(t or "") for _, t in history]
    seen = Counter(tuple(w[i : i + window]) for w in words + old for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((k, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def corpus(seed, n=60, words=30):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    shared = [[rng.choice(vocab) for _ in range(rng.randrange(3, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randrange(0, 6)):
            own += rng.choice(shared) if rng.random() < 0.4 else [rng.choice(vocab) for _ in range(rng.randrange(1, 50))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(own)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "same " * 300), (n + 3, rows[5][1]), (n + 4, "x" * 100_000), (3, rows[3][1]), (None, rows[7][1])]


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    for seed, window, gram in ((1, 8, 3), (2, 20, 12), (3, 35, 12), (4, 5, 5)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert result(remove_repeats(df, window=window, gram=gram)) == brute(rows, window), (seed, window)


def test_two_letter_texts(spark):
    rows = corpus(9, words=2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(remove_repeats(df, window=6, gram=3, batches=3)) == brute(rows, 6)


def test_shuffled_spans_agree(spark, monkeypatch):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr("isobath.llm.substring_dedup.BROADCAST_SPANS", 0)
    assert result(remove_repeats(df, window=8, gram=3)) == brute(rows, 8)


def test_new_table_against_a_log(spark):
    first, second = corpus(6, 40), corpus(6, 55)[20:]
    log = FingerprintLog(spark, working_path(spark, "test"), 4)
    a, b = (spark.createDataFrame(x, "doc_id long, text string") for x in (first, second))
    assert result(remove_repeats(a, window=8, gram=3, batches=6, log=log)) == brute(first, 8)
    assert len(log.runs) <= MAX_RUNS
    assert result(remove_repeats(b, window=8, gram=3, log=log, history=a)) == brute(second, 8, first)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 4, "k", "f")], "doc_id long, text string, n_words int, spans string, k1 string")
    got = remove_repeats(df).collect()
    assert [r.asDict() for r in got] == [{"doc_id": 1, "spans": "k", "k1": "f", "text": "a b c", "n_words": 3, "n_removed": 0}]
    assert remove_repeats(df.limit(0)).count() == 0


def thue_morse(n):
    """A word and its complement, which hashes by polynomials modulo a power of two cannot tell apart."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_weak_hashes_differ(spark):
    x, y = thue_morse(2048)
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, " ".join(thue_morse(4096)[0])), (4, " ".join(thue_morse(4096)[1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(remove_repeats(df)) == brute(rows, 35)
    assert result(remove_repeats(df))[0][2] == 0


def test_append_tells_what_earlier_runs_hold(spark):
    log = FingerprintLog(spark, working_path(spark, "test"), 4)

    def batch(*fps):
        return spark.createDataFrame([(f, fps.count(f)) for f in set(fps)], "fp long, n long")

    got = [sorted(r.fp for r in log.append(batch(*b)).collect()) for b in ((1, 2, 2), (1, 3), (4,), (3, 5), (1, 9), (9, 4))]
    assert got == [[2], [1], [], [3], [1], [4, 9]]
    assert len(log.runs) <= MAX_RUNS
    log.drop()
