"""Secrets by patterns and by a battery of randomness tests, in DataFrame functions only.

Long tokens are candidates.  For each the encoding is inferred from its
characters, and three statistics are taken: chi-squared against a uniform
alphabet, runs of character classes, and serial correlation of symbol values.
Each is compared with what text-like tokens of that length and encoding give,
estimated over the corpus' distinct tokens that a random string would not give;
the combined score has a one-sided p-value.  False discoveries are controlled
within each range of lengths over the whole corpus, by the procedure of
Benjamini and Hochberg on a histogram of p-values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobath.llm.common import join_checked, materialise, quoted

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs, so a lower bound on their length changes no match.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/=_-]{16,}+"
KINDS = ["assign", "access", "hex", "random"]
#: Encodings in the order in which they are tried: (name, pattern, alphabet, sum of squared symbol shares in text-like tokens).
ENCODINGS = [
    ("decimal", "^[0-9]+$", "0123456789", 0.15), ("hex", "^[0-9a-f]+$", "0123456789abcdef", 0.16), ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF", 0.16), ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    ("letters", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 0.066), ("alphanumeric", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.06),
    ("base64", "^[A-Za-z0-9+/]+={0,2}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", 0.06), ("other", ".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/=", 0.06),
]
#: Lower ends of the ranges of lengths in which discoveries are controlled.
LENGTHS = [16, 20, 24, 32, 48, 96]
#: Share of false discoveries that is accepted.
FDR = 0.01
#: Of text-like tokens before any is seen: share of neighbours in different character classes, and correlation of neighbouring symbols.
TEXT_CHANGES, TEXT_CORRELATION = 0.2, 0.5
#: Tokens that these and the alphabets' squares count for beside those of the corpus.
PRIOR_TOKENS = 200.0
#: Deviations from a random string of the encoding beyond which a token is not taken for one.
RANDOM_DEVIATIONS = 4.0
#: Steps of -log10(p) in the histogram, and its last step.
STEP, LAST = 0.1, 400
#: Matches whose lengths are summed one by one; see _starts.
RUN = 256


def _starts(before: Column, own: Column) -> Column:
    """Offsets of matches from the lengths of the texts before them and of themselves, in two levels so that long lists stay linear."""

    def total(a: Column, first: Column, n: Column | int) -> Column:
        return F.aggregate(F.slice(a, first, n), F.lit(0), lambda x, y: x + y)

    n = F.size(own)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int"))
    sums = F.transform(blocks, lambda b: total(before, b * RUN + 1, RUN) + total(own, b * RUN + 1, RUN))
    # the last piece has no match after it and lies outside every sum that is used
    heads = F.transform(blocks, lambda b: total(sums, F.lit(1), b))

    def start(i: Column) -> Column:
        b = F.floor(i / RUN).cast("int")
        return F.get(heads, b) + total(before, b * RUN + 1, i % RUN + 1) + total(own, b * RUN + 1, i % RUN)

    return F.transform(F.sequence(F.lit(0), n - 1), start)


def _located(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """df with column name: array of (start, end, own) of the pattern's matches in __text, null without any."""
    some = F.size(f"__m_{name}") > 0
    df = df.withColumn(f"__m_{name}", F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("__before", F.when(some, F.transform(F.split("__text", pattern, -1), lambda x: F.length(x))))
    df = df.withColumn("__own", F.when(some, F.transform(f"__m_{name}", lambda x: F.length(x))))
    df = df.withColumn("__start", F.when(some, _starts(F.col("__before"), F.col("__own"))))
    own = F.col(f"__m_{name}")
    df = df.withColumn(name, F.transform("__start", lambda s, i: F.struct(s.alias("start"), (s + F.length(F.get(own, i))).alias("end"), F.get(own, i).alias("own"))))
    return df.drop(f"__m_{name}", "__before", "__own", "__start")


def _tail_log(z: Column) -> Column:
    """-log10 of the normal distribution's upper tail, within some per cent of p for z > 0."""
    return (F.log(F.lit(2.0)) + 0.717 * z + 0.416 * z * z) / F.log(F.lit(10.0))


def _statistics(tokens: DataFrame) -> DataFrame:
    """tokens (with own) with enc, n, k (symbols of the alphabet), chi, squares, changes, r and looks_random."""
    pick = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        pick = F.when(F.col("own").rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(pick)
    df = tokens.withColumn("enc", pick)
    df = df.withColumn("alphabet", F.get(F.array(*[F.lit(e[2]) for e in ENCODINGS]), F.col("enc")))
    df = df.withColumn("c", F.split("own", "")).withColumn("n", F.size("c").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    chars = F.col("c")
    df = df.withColumn("v", F.transform("c", lambda x: F.instr(F.col("alphabet"), x).cast("double")))
    # 0 lower case, 1 upper case, 2 digit, 3 other
    df = df.withColumn("g", F.transform("c", lambda x: F.when(x.between("a", "z"), 0.0).when(x.between("A", "Z"), 1.0).when(x.between("0", "9"), 2.0).otherwise(3.0)))
    counts = F.transform(F.array_distinct("c"), lambda x: F.size(F.filter(chars, lambda y: y == x)).cast("double"))
    zero = F.lit(0.0)

    def add(a: Column, b: Column) -> Column:
        return a + b

    df = df.withColumn("squares", F.aggregate(F.transform(counts, lambda x: x * (x - 1)), zero, add) / (F.col("n") * (F.col("n") - 1)))
    df = df.withColumn("chi", F.col("k") / F.col("n") * F.aggregate(F.transform(counts, lambda x: x * x), zero, add) - F.col("n"))
    pairs = F.sequence(F.lit(1), F.size("c") - 1)
    v, g = F.col("v"), F.col("g")
    df = df.withColumn("changes", F.aggregate(F.transform(pairs, lambda i: (F.get(g, i) != F.get(g, i - 1)).cast("double")), zero, add))
    df = df.withColumn("high", F.aggregate(F.transform("v", lambda x: (x > F.col("k") / 2).cast("double")), zero, add))
    df = df.withColumn("runs", 1 + F.aggregate(F.transform(pairs, lambda i: ((F.get(v, i) > F.col("k") / 2) != (F.get(v, i - 1) > F.col("k") / 2)).cast("double")), zero, add))
    df = df.withColumn("mean", F.aggregate("v", zero, add) / F.col("n"))
    m = F.col("mean")
    df = df.withColumn("var", F.aggregate(F.transform("v", lambda x: (x - m) * (x - m)), zero, add))
    df = df.withColumn("cov", F.aggregate(F.transform(pairs, lambda i: (F.get(v, i) - m) * (F.get(v, i - 1) - m)), zero, add))
    n, k = F.col("n"), F.col("k")
    r = F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(1.0)
    # against a random string of the encoding
    n1, n0 = F.col("high"), n - F.col("high")
    expected = 1 + 2 * n1 * n0 / n
    spread = F.greatest(2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1)), F.lit(1e-6))
    deviations = [(F.col("chi") - (k - 1)) / F.sqrt(2 * (k - 1)), (F.col("runs") - expected) / F.sqrt(spread), (r + 1 / (n - 1)) * F.sqrt(n)]
    looks = (F.col("enc") != 0) & (n1 > 0) & (n0 > 0)
    for d in deviations:
        looks = looks & (F.abs(d) <= RANDOM_DEVIATIONS)
    df = df.withColumn("r", r).withColumn("looks_random", looks)
    return df.drop("alphabet", "c", "v", "g", "high", "runs", "mean", "var", "cov")


def text_null(tokens: DataFrame) -> list[tuple[float, float, float]]:
    """(squares, changes, correlation) of text-like tokens of each encoding: the means over tokens that do not look random, with the constants as a prior."""
    means = [F.avg(x) for x in ("squares", F.col("changes") / (F.col("n") - 1), "r")]
    # one row an encoding
    seen = {r[0]: r[1:] for r in tokens.filter("NOT looks_random").groupBy("enc").agg(F.count("*"), *means).collect()}
    out = []
    for i, e in enumerate(ENCODINGS):
        n, *own = seen.get(i, (0, 0.0, 0.0, 0.0))
        out.append(tuple((PRIOR_TOKENS * p + n * x) / (PRIOR_TOKENS + n) for p, x in zip((e[3], TEXT_CHANGES, TEXT_CORRELATION), own)))
    return out


def _scored(tokens: DataFrame, null: list[tuple[float, float, float]]) -> DataFrame:
    """tokens with score (deviations from text), bin and step."""
    squares, change, correlation = (F.get(F.array(*[F.lit(float(e[j])) for e in null]), F.col("enc")) for j in range(3))
    change = F.least(F.greatest(change, F.lit(0.02)), F.lit(0.98))
    n, k = F.col("n"), F.col("k")
    text_chi = k * (1 + (n - 1) * squares) - n
    text_spread = F.sqrt(2 * (k - 1)) * k * squares
    z = (text_chi - F.col("chi")) / text_spread
    z = z + F.when(F.col("enc") == 4, 0.0).otherwise((F.col("changes") - change * (n - 1)) / F.sqrt((n - 1) * change * (1 - change)))
    z = (z + (correlation - F.col("r")) * F.sqrt(n)) / F.sqrt(F.lit(3.0))
    df = tokens.withColumn("score", z)
    step = F.when(F.col("looks_random") & (F.col("score") > 0), F.least(F.floor(_tail_log(F.col("score")) / STEP), F.lit(LAST)).cast("int")).otherwise(0)
    return df.withColumn("step", step).withColumn("bin", F.size(F.filter(F.array(*map(F.lit, LENGTHS)), lambda x: x <= n)))


def thresholds(histogram: DataFrame, fdr: float) -> dict[int, int]:
    """The lowest step of each range of lengths at which the expected share of false discoveries is at most fdr, from (bin, step, n)."""
    above = Window.partitionBy("bin").orderBy(F.desc("step"))
    every = Window.partitionBy("bin")
    ranked = histogram.withColumn("found", F.sum("n").over(above)).withColumn("tests", F.sum("n").over(every))
    good = ranked.filter((F.col("step") > 0) & (F.pow(F.lit(10.0), -F.col("step") * STEP) * F.col("tests") <= fdr * F.col("found")))
    # one row a range of lengths
    return {r.bin: r.step for r in good.groupBy("bin").agg(F.min("step").alias("step")).collect()}


def scan(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """docs without the text, with ``spans``: array of (start, kind, end) by start, then kind as in KINDS.

    Offsets are code points, ends exclusive.  assign, access and hex are the base
    and always there; a random span is a long token that the battery accepts and
    that overlaps no base span.  Null and empty texts have no spans; very long texts
    are taken whole.  Rows are judged one by one by thresholds from the whole table,
    repeated rows alike; other columns stay, a column named spans in any case is
    replaced, an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != text and c.lower() != "spans"]
    df = docs.select((F.struct(*map(quoted, kept)) if kept else F.lit(0)).alias("__row"), F.coalesce(quoted(text), F.lit("")).alias("__text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)):
        df = _located(df, name, pattern)
    long = F.filter("assign", lambda x: F.length(F.regexp_extract(x["own"], ASSIGN, 2)) >= 12)
    parts = [_spans(a, i) for i, a in enumerate((long, F.col("access"), F.col("hex")))]
    df = df.withColumn("__base", F.concat(*parts))
    token = F.filter("token", lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    tokens = F.coalesce(token, F.array().cast("array<struct<start:int,end:int,own:string>>"))
    df = materialise(df.select("__row", "__base", tokens.alias("__token"), F.monotonically_increasing_id().alias("__n")), "tokens")
    # a token's statistics depend on the token alone: equal ones are tested once and counted as often as they occur
    each = df.select("__n", F.explode("__token").alias("t")).select("__n", "t.start", "t.end", "t.own")
    own = materialise(_statistics(each.groupBy("own").agg(F.count("*").alias("times"))), "battery")
    own = _scored(own, text_null(own))
    limit = F.lit(LAST + 1)
    for b, s in thresholds(own.groupBy("bin", "step").agg(F.sum("times").alias("n")), fdr).items():
        limit = F.when(F.col("bin") == b, F.lit(s)).otherwise(limit)
    random = own.filter(F.col("step") >= limit).select("own")
    more = join_checked(each, random, ["own"]).groupBy("__n").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("__random"))
    df = df.join(more, "__n", "left")
    spans = F.sort_array(F.concat("__base", F.coalesce("__random", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.get(names, x["kind"]).alias("kind"), x["end"].alias("end")))
    return df.select(*([F.col("__row")[c].alias(c) for c in kept]), named.alias("spans"))


def _spans(found: Column, kind: int) -> Column:
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.coalesce(spans, F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).withColumn("base", F.filter("spans", lambda x: x["kind"] != "random"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
