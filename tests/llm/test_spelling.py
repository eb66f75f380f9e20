import random
import re
import zlib
from collections import Counter

import pytest

from isobath.llm import spelling
from isobath.llm.spelling import group_spellings


def brute(rows, min_chars=5, min_count=3, ratio=2, drop_every=0):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= min_chars and c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, size = {}, {}
    for w in n:
        own = [v for v in n if near(w, v)]
        size[w] = len(own)
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], size[w], n[form[w]] if form[w] else None)
    return out


def collect(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def rows(seed=3, alphabet="abé"):
    """Few letters, so that words have many neighbours and chains are long; null, empty and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(4, 9))) for _ in range(150)]
    texts = [" ".join(rng.choices(words, [1 / (1 + i) for i in range(150)], k=rng.randrange(0, 60))) for _ in range(60)]
    texts += [None, "", "ABCDE abcde ÀBCDE", "one-two_three 12abcde34", texts[0], texts[0]]
    return list(enumerate(texts)) + [(None, texts[1]), (3, texts[3])]


@pytest.mark.parametrize("drop_every", [0, 3])
def test_equals_brute_force(spark, drop_every):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    assert collect(group_spellings(df, drop_every=drop_every)) == brute(rows(), drop_every=drop_every)


def test_parts_of_a_hot_shard_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 7)
    monkeypatch.setattr(spelling, "CHUNK", 20)
    monkeypatch.setattr(spelling, "HELD_WORDS", 5)
    own = [(i, re.sub(r"\b(\w)", r"aa\1", t or "")) for i, t in rows(4)]
    df = spark.createDataFrame(own, "doc_id long, text string")
    got = collect(group_spellings(df, min_count=1))
    assert got == brute(own, min_count=1)
    assert max(r[3] for r in got.values()) > 5


def test_every_place_of_an_edit(spark):
    base = "abcdefghij"
    edits = [base[:i] + x + base[i + 1 :] for i in range(10) for x in "zé"] + [base[:i] + x + base[i:] for i in range(11) for x in "zj"] + [base[:i] + base[i + 1 :] for i in range(10)]
    own = [(1, " ".join([base] * 4 + sorted(set(edits) - {base}) * 1 + ["abcdefghijzz", "ba" + base[2:]]))]
    df = spark.createDataFrame(own, "doc_id long, text string")
    assert collect(group_spellings(df, min_count=1)) == brute(own, min_count=1)


def test_long_words_and_a_long_chain(spark):
    long = "x" * 30_000
    own = [(1, f"{long} {long} {long}y {long}z{long} {long}z"), (2, " ".join(("a" * k + " ") * 2 ** (k - 5) for k in range(5, 14)))]
    df = spark.createDataFrame(own, "doc_id long, text string")
    want = brute(own, min_count=1)
    assert collect(group_spellings(df, min_count=1)) == want
    assert want["aaaaa"][1] == "a" * 13


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "word1 wordy wordy wordy", "n", "w")], "id int, body string, n string, word string")
    assert collect(group_spellings(df, "id", "body")) == {"wordy": (None, "wordy", 3, 0, None)}
    assert group_spellings(df.limit(0), "id", "body").count() == 0
    with pytest.raises(ValueError):
        group_spellings(df, "id", "body", min_chars=3)
