import re

from isobath.llm.decontamination import UNITS, contamination, decontaminate, marked_text, op4_decontamination, template_text
from pyspark.sql import functions as F

UNIT = re.compile(r"(#[0-9.,]+) +(?i:(" + "|".join(UNITS) + r"))(?![^\W_])")


def template(text):
    """Plain words of a template, for texts of letters, digits and simple punctuation."""
    t = re.sub(r"[^\w.,;]+|_", " ", text.replace("%", " percent "))
    t = re.sub(r"(?<=[a-zß-öø-ÿ,;] )[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+", r"<\g<0>", t)
    t = re.sub(r"(?<![^\W_])[0-9]++(?:[.,][0-9]++)*", r" #\g<0> ", t)
    t = UNIT.sub(r"\1 @\2", t)
    t = re.sub(r"[.,;](?![0-9])|(?<![0-9])[.,;]|;", " ", t).lower()
    return [w[0] if w[0] in "#<@" else w for w in t.split()]


def windows(text, n=5):
    w = template(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def test_templates(spark):
    df = spark.createDataFrame([("A train took Maria Lopez 12.5 km, in 3 hours; 40% of it. Then 7kg.",)], "text string")
    marked, plain = df.select(marked_text(F.col("text")), template_text(marked_text(F.col("text")))).first()
    assert marked.split() == ["a", "train", "took", "<maria", "<lopez", "#12.5", "@km", "in", "#3", "@hours", "#40", "@percent", "of", "it", "then", "#7", "@kg"]
    assert plain.split() == ["a", "train", "took", "<", "<", "#", "@", "in", "#", "@", "#", "@", "of", "it", "then", "#", "@"]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: windows(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = windows(r.text or "")
        want |= {(r.doc_id, i, len(w), len(w & own)) for i, w in items.items() if len(w & own) >= 0.5 * len(w)}
    got = op4_decontamination(spark, sf).collect()
    assert len(want) > 20 and {(r.doc_id, r.item_id, r.n_windows, r.n_matched) for r in got} == want
    assert {r.kind for r in got} == {"verbatim"}


QUESTION = "A farmer named Anna sells 12 apples for 3 dollars each at the market and later buys 5 pears; how many dollars does Anna have after selling 12 apples in total?"


def test_other_values_and_inconsistent_ones(spark):
    changed = QUESTION.replace("12", "77").replace("Anna", "Boris").replace("3", "9")
    mixed = QUESTION.replace("12 apples for", "31 apples for").replace("named Anna", "named Carla").replace("3", "8").replace("5", "6")
    rows = [(1, "Intro words here. " + QUESTION + " The end."), (2, changed), (3, mixed), (4, "nothing of that kind"), (5, None), (6, ""), (2, changed), (None, QUESTION), (7, "Yes no")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, QUESTION), (11, None), (12, ""), (13, "yes no")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.n_changed > 0) for r in contamination(docs, bench).collect()}
    assert got == {(1, 10): ("verbatim", False), (2, 10): ("reparameterised", True), (None, 10): ("verbatim", False), (7, 13): ("verbatim", False)}
    assert sorted(r.doc_id for r in decontaminate(docs, bench).collect()) == [3, 4, 5, 6]


def test_each_occurrence_is_judged_by_itself(spark):
    def asked(name, *values):
        t = QUESTION.replace("Anna", name)
        for old, new in zip(("12 apples", "3 dollars", "5 pears"), values):
            t = t.replace(old, new)
        return t

    fill = " and so the talk went on about quite other things that nobody there had heard of before"
    first, second = asked("Anna", "12 apples", "3 dollars", "5 pears"), asked("Boris", "77 apples", "9 dollars", "8 pears")
    mixed = QUESTION.replace("12 apples for", "31 apples for").replace("named Anna", "named Carla").replace("3", "8").replace("5", "6")
    one = "the old lamp on the wall of the inn was lit by a boy who had walked for 9 miles through deep snow that night"
    parts = QUESTION.split(" and later ")
    rows = [
        (1, QUESTION + fill * 3 + ". " + mixed),  # verbatim and once more with mixed values
        (2, first + fill + ". " + second),  # two items of one template
        (3, one + fill + " who had walked for 4 miles through the town"),  # a chance window with another value
        (4, mixed + fill + ". " + mixed.replace("81", "66")),  # no true occurrence
        (5, second.replace("market and", "market today and really") + fill + ". " + mixed),  # other values, words put in
        (6, parts[0] + fill * 2 + " and later " + parts[1] + fill + " and later buys 7 pears; how many"),  # in two places
        (7, one.replace("9 miles", "4 miles") + " " + one.replace("9 miles", "5 miles")),  # twice, each with its own value
        (None, QUESTION + ". " + mixed),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, first), (11, second), (12, one)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in contamination(docs, bench).collect()}
    verbatim = {(1, 10), (2, 10), (2, 11), (3, 12), (5, 11), (6, 10), (None, 10)}
    assert {k for k, v in got.items() if v == "verbatim"} == verbatim
    assert got[(7, 12)] == "reparameterised" and not any(k[0] == 4 for k in got)
    assert [r.doc_id for r in decontaminate(docs, bench).collect()] == [4]


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "Where is Oslo?"), (2, "Yes no"), (3, "name 4 red rivers"), (4, "Who wrote it?"), (5, "...")], "item_id long, text string")
    rows = [
        (1, "They asked: where is Oslo? Nobody knew."), (2, "well yes no perhaps"), (3, "yes NO"), (4, "please name 4 red rivers now"), (5, "please name 5 red rivers now"),
        (6, "who wrote it"), (7, "who wrote"), (8, "..."), (9, "who wrote it " * 3000), (10, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination(docs, bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (6, 4), (9, 4)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, QUESTION, 2)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    assert contamination(docs.limit(0), bench).count() == 0
    assert contamination(docs, bench.limit(0)).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == 1
    assert decontaminate(docs, bench).count() == 0


def test_numbers_alone_match_their_own_values_only(spark):
    """An item that is a table of numbers has one template window; only its own numbers repeat it."""
    numbers = " ".join(str(i * i + 3) for i in range(40))
    bench = spark.createDataFrame([(1, numbers), (2, QUESTION)], "item_id long, text string")
    other = " ".join(str(i * 7 + 1) for i in range(500))
    docs = spark.createDataFrame([(1, other), (2, f"a table of {numbers} and no more"), (3, QUESTION), (4, f"{QUESTION} {other}"), (5, f"values {other} of {numbers}")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in contamination(docs, bench).collect()}
    assert got == {(2, 1): "verbatim", (3, 2): "verbatim", (4, 2): "verbatim", (5, 1): "verbatim"}
