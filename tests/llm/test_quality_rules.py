"""Quality rules against a brute force in Python, with lines held in the plan and joined."""

import random
import re
from collections import Counter, defaultdict

import pytest
from isobath.llm import quality_rules
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
WHITE = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, line_docs, keep_percent, min_words):
    held = defaultdict(int)
    for _, t, host in rows:
        for k in {key(x) for x in (t or "").split("\n") if WORD.search(x)}:
            held[host, k] += 1
    out = []
    for i, t, host in rows:
        t = t or ""
        w, lines = WORD.findall(t), t.split("\n")
        g = Counter(zip(w, w[1:], w[2:]))
        repeat = len({j + k for j in range(len(w) - 2) if g[tuple(w[j : j + 3])] > 1 for k in range(3)})
        solid = [x for x in lines if WORD.search(x)]
        gone = [x for x in solid if held[host, key(x)] > line_docs]
        failed = len(w) < min_words or 100 * repeat > 50 * len(w)
        left = len(w) - sum(len(WORD.findall(x)) for x in gone)
        stay = [x for x in lines if not (WORD.search(x) and held[host, key(x)] > line_docs)]
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(solid) - len(set(solid)), repeat, failed, not failed and 100 * left >= keep_percent * len(w), "\n".join(stay)))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(3)
    common = ["Menu | Home", "  menu | home ", "© the site", "read more about it", "ÄÖ line"]
    out = []
    for i in range(60):
        lines = [" ".join(rng.choice("abcdefgh#") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 8))]
        out.append((i, "\n".join(lines + rng.sample(common, rng.randrange(0, 5))), rng.choice(["h1", "h2", None])))
    return out + [(100, None, "h1"), (101, "", None), (102, "same words here " * 50_000, "h1"), (103, "same words here " * 3, None), (5, out[5][1], out[5][2]), (None, out[7][1], "h1"), (None, None, None)]


@pytest.mark.parametrize("held", [10_000, 0])
def test_equals_brute_force(spark, held):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string").repartition(3)
    got = quality_rules.score_quality(df, min_words=5, line_docs=4, keep_percent=60, held_lines=held)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "text"]
    assert sorted([tuple(r[c] for c in columns) for r in got.collect()], key=repr) == brute(rows(), 4, 60, 5)


@pytest.mark.parametrize("held", [10_000, 0])
def test_empty_table_and_clashing_names(spark, held):
    df = spark.createDataFrame([(1, "a b c", "h", 9, "x")], "doc_id long, text string, source string, N_Words int, `h` string")
    assert quality_rules.score_quality(df.limit(0), held_lines=held).count() == 0
    got = quality_rules.score_quality(df, line_docs=0, min_words=1, held_lines=held).first().asDict()
    assert (got["n_words"], got["h"], got["text"], got["kept"]) == (3, "x", "", False) and "N_Words" not in got


def repeat_words(text):
    w = text.split()
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + k for i, x in enumerate(g) if g.count(x) > 1 for k in range(3)})


def test_windows_that_share_upper_bits(spark, monkeypatch):
    # 1 2 3 and 1 2 1 differ in the bits alone that the packed key gives to the place
    monkeypatch.setattr(F, "xxhash64", lambda *words: F.concat(*words).cast("long"))
    texts = ["1 2 3 1 2 1 7 8 1 2 3 5 9", "1 2 3 4 5 1 2 3", "1 2 3 1 2 1 9", "1 2", ""]
    df = spark.createDataFrame([(t,) for t in texts], "__text string")
    got = {r["__text"]: r.n_repeat_words for r in quality_rules.measure(df).collect()}
    assert got == {t: repeat_words(t) for t in texts} and got[texts[0]] == 6
