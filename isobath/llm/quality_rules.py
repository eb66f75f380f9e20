"""Quality rules with cross-document line frequencies per host, in DataFrame functions only.

Per document: words, word characters, symbols, repeated lines and repeated
three-word windows.  Across documents: normalised lines are hashed, the distinct
documents of a host that hold each line are counted, lines above the limit are
removed, and a document that keeps too few of its words is rejected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.llm.common import join_checked, materialise, quoted

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of one host that may share a line.
LINE_DOCS = 100
#: Share of its words, in percent, that a document must keep.
KEEP_PERCENT = 20
#: Hashes of lines above the limit that are held in the plan as a hash set; more are joined.
HELD_LINES = 10_000


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", " " * 5), " "), "")


def _line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def measure(docs: DataFrame, text: str = "__text") -> DataFrame:
    """docs with __lines and the five measures of text; heavy steps are columns of their own so that each runs once."""
    t = quoted(text)
    df = docs.withColumn("__words", words_of(t)).withColumn("__lines", F.split(t, "\n"))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.translate(t, WHITE, "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    worded = F.filter("__lines", lambda x: F.btrim(x, F.lit(WHITE)) != "")
    df = df.withColumn("__worded", worded).withColumn("n_dup_lines", (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"))
    w = F.col("__words")
    last = F.size(w) - 3
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    df = df.withColumn("__h", F.when(last >= 0, F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    # only texts that repeat a window go on; there a window is one number: the upper bits of its hash, then its place in
    # as many bits as the text needs, so that equal windows come to lie side by side; whole hashes are compared then
    df = df.withColumn("__place", F.expr("shiftleft(1L, CAST(ceil(log2(size(__words) + 1)) AS INT)) - 1"))
    h, place = F.col("__h"), F.col("__place")
    packed = F.transform("__h", lambda x, i: x.bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("long")))
    # where unequal windows share the upper bits, whole hashes are sorted with their places
    df = df.withColumn("__kinds", F.size(F.array_distinct("__h")))
    repeats = F.col("__kinds") < F.size("__h")
    df = df.withColumn("__clash", F.when(repeats, F.size(F.array_distinct(F.transform("__h", lambda x: x.bitwiseAND(F.bitwise_not(place))))) < F.col("__kinds")))
    whole = F.transform(F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda x: x["i"])
    df = df.withColumn("__sorted", F.when(F.col("__clash"), whole).when(repeats, F.transform(F.sort_array(packed), lambda x: x.bitwiseAND(place).cast("int"))))
    s = F.col("__sorted")
    same = F.filter("__sorted", lambda x, j: (F.get(h, x) == F.get(h, F.get(s, j + 1))) | ((j > 0) & (F.get(h, x) == F.get(h, F.get(s, j - 1)))))
    df = df.withColumn("__at", F.sort_array(same))
    at = F.col("__at")
    covered = F.aggregate(F.transform("__at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.drop("__words", "__worded", "__h", "__place", "__kinds", "__clash", "__sorted", "__at")


def score_quality(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source",
    min_words: int = 50, max_repeat_percent: int = 50, line_docs: int = LINE_DOCS, keep_percent: int = KEEP_PERCENT,
    held_lines: int = HELD_LINES,
) -> DataFrame:
    """docs with the measures, ``base_failed``, ``kept`` and the text without the lines that too many documents of its host share.

    A row is a document; rows that agree in id, text and host behave alike.  A null
    text has no words and fails; its text becomes empty.  A null host is a host of
    its own.  base_failed: n_words < min_words, or more than max_repeat_percent of
    the words lie in repeated three-word windows.  kept: not base_failed, and at
    least keep_percent of the words stay after line removal.  Lines are compared
    without outer white space and with A-Z in lower case; empty ones are not
    counted.  Very long texts are taken whole.  Added columns replace columns of
    their names; an empty table gives an empty one.
    """
    added = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words_left", "base_failed", "kept"}
    clean = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in added])
    base = clean.withColumn("__text", F.coalesce(quoted(text), F.lit(""))).withColumn("__id", quoted(id_col).cast("string"))
    base = base.withColumn("__host", F.xxhash64(quoted(host).isNull(), quoted(host).cast("string")))
    base = base.withColumn("__same", F.xxhash64("__text", "__host"))

    def line_hash(line: Column) -> Column:
        return F.xxhash64(_line_key(line), F.col("__host"))

    def solid(line: Column) -> Column:
        return F.btrim(line, F.lit(WHITE)) != ""

    # a document counts a line once: its distinct line hashes are taken inside the row, before any shuffle
    once = base.select(F.explode(F.array_distinct(F.transform(F.filter(F.split("__text", "\n"), solid), line_hash))).alias("h"))
    common = materialise(once.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > line_docs).select("h"), "lines")
    # filters on the verdict must not be pushed below the measures, which would repeat their expressions many times over
    measured = measure(base).observe(f"quality {uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
    held = [r.h for r in common.limit(held_lines + 1).collect()]
    if len(held) <= held_lines:
        hot = (lambda x: solid(x) & line_hash(x).isin(held)) if held else (lambda x: F.lit(False))
        gone = F.array_join(F.filter("__lines", hot), " ")
        joined = measured.withColumn("__lost", F.size(words_of(gone)) if held else F.lit(0))
        stay = F.filter("__lines", lambda x: ~hot(x)) if held else F.col("__lines")
    else:
        # only ids, places and hashes of the lines that go are shuffled; whole texts meet them once
        lines = base.select("__id", "__same", "__host", F.posexplode(F.split("__text", "\n")).alias("p", "line")).filter(solid(F.col("line")))
        lines = lines.select("__id", "__same", "p", line_hash(F.col("line")).alias("h"), F.size(words_of(F.col("line"))).alias("w"))
        gone = join_checked(lines, common, ["h"]).groupBy("__id", "__same").agg(F.collect_set(F.struct("p", "h", "w")).alias("__gone"))
        gone = gone.select("__id", "__same", F.array_distinct("__gone.h").alias("__hot"), F.aggregate("__gone.w", F.lit(0), lambda x, y: x + y).alias("__lost"))
        joined = measured.alias("m").join(gone.alias("g"), F.col("m.__id").eqNullSafe(F.col("g.__id")) & (F.col("m.__same") == F.col("g.__same")), "left")
        joined = joined.select("m.*", "g.__hot", F.coalesce("g.__lost", F.lit(0)).alias("__lost"))
        stay = F.when(F.col("__hot").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~F.array_contains("__hot", line_hash(x)) | ~solid(x)))
    joined = joined.withColumn(text, F.array_join(stay, "\n"))
    joined = joined.withColumn("n_words_left", F.col("n_words") - F.col("__lost"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    joined = joined.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("n_words_left") >= keep_percent * F.col("n_words")))
    return joined.drop("__id", "__same", "__host", "__text", "__lines", "__hot", "__lost")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    scored = score_quality(docs)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w,
        generate_subscripts(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER q AS w1, lead(w, 2) OVER q AS w2 FROM w WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM g WHERE w2 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY doc_id),
l0 AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d),
l AS (SELECT doc_id, source, l, translate(trim(l, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k,
        len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS lw FROM l0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l WHERE lw > 0 GROUP BY doc_id),
hot AS (SELECT source, k FROM l WHERE lw > 0 GROUP BY source, k HAVING count(DISTINCT doc_id) > 100),
gone AS (SELECT doc_id, sum(lw) AS n FROM l JOIN hot h ON l.k = h.k AND l.source IS NOT DISTINCT FROM h.source WHERE lw > 0 GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n.n_words, 0) AS n_words, coalesce(n.word_chars, 0)::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS lost
      FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - lost) >= 20 * n_words AS kept
FROM m
"""
