import hashlib
import re

from pyspark.sql import functions as F

from isobath.llm.fill_middle import GRAMMARS, fill_middle, restore, units

CUT = {
    "char": lambda t: list(t),
    "word": lambda t: re.findall(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+[\x20\x09-\x0d]*|[\x20\x09-\x0d]+", t) if not re.match(r"[\x20\x09-\x0d]", t) else None,
    "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t),
}


def brute(i, t, pieces):
    t = t or ""
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * j : 8 * j + 8], 16) for j in range(4)]
    n = len(pieces)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    base = ["", None, "a", "ab", "é\U0001f600x\U0001f600\U0001f600y", "one <P> two", "<M", "<S<", "line one\nline two\n\n", "\n", "word  word\tend ", "é‍", "x" * 50_000 + "\U0001f600"]
    return [(i, base[i % len(base)]) for i in range(300)] + [(None, "no id"), (5, "twice"), (5, "twice")]


def test_code_points_equal_brute_force_and_come_back(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    got = fill_middle(df).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows())
    for r in got:
        t = r.text or ""
        assert tuple(r)[2:7] == brute(r.doc_id, r.text, list(t))
        assert r.back == t
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_units_of_every_grammar_join_to_the_text(spark):
    texts = [t for _, t in rows()[:13] if t is not None] + ["One. Two!  Three?\nFour. "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for name, grammar in GRAMMARS.items():
        for r in df.select("text", units(F.col("text"), grammar).alias("u")).collect():
            assert "".join(r.u) == r.text and (all(r.u) or not r.text) and (r.text or r.u == [])
            if name in CUT and CUT[name](r.text) is not None:
                assert r.u == CUT[name](r.text)


def test_other_units_keep_the_rule(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    for r in fill_middle(df, unit="line").collect():
        assert tuple(r)[2:7] == brute(r.doc_id, r.text, CUT["line"](r.text or ""))


def test_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(3, "abc", "old", 1, 2)], "doc_id int, text string, form string, `a.b` int, N int")
    got = fill_middle(df)
    assert got.columns == ["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert got.first()["n"] == 3
    assert fill_middle(df.limit(0)).count() == 0
