"""Find benchmark questions in documents, re-parameterised ones too, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question with other
values keeps its template.  Windows of template words are hashed and joined with
those of the benchmark; a document that holds enough of an item's windows is a
suspect.  For suspects the values in the placeholders are compared: a question
asked with new values replaces each value in one way throughout.  They are judged
over the document and, where values differ, in each occurrence of the item by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.llm.common import join_checked, materialise, quoted

#: Template words of a window; shorter items have one window of their own length.
WINDOW = 5
#: Template words below which an item only matches a text that equals it as a whole: one or two words stand in any text.
LEAST = 3
#: Share of an item's distinct windows that a document must hold.
COVERAGE = 0.5
#: Share of the pairs of an item's and a document's value that must be explained by one value each.
CONSISTENCY = 0.8
#: Words that may be put in or left out within one occurrence of an item; at most half of the item's windows.
GAP = 10
#: Rows of benchmark windows that may be broadcast.
BROADCAST_WINDOWS = 500_000
UNITS = [
    "kilometers", "kilometres", "kilograms", "centimeters", "millimeters", "percent", "dollars", "euros", "pounds", "meters", "metres", "grams", "liters", "litres", "inches", "hours", "hour", "minutes", "minute",
    "seconds", "second", "weeks", "week", "months", "month", "years", "year", "days", "day", "miles", "mile", "feet", "foot", "cents", "cent", "km", "kg", "cm", "mm", "mg", "ml", "mph", "kmh", "usd", "eur", "g", "m", "l", "s", "h",
]


def marked_text(text: Column) -> Column:
    """Words parted by single spaces, in lower case, with # before numbers, < before names and @ before units.

    A name is a capitalised word after a lower-case letter, comma or semicolon and a space.
    """
    # each pattern begins with the character that it looks for, and looks back only from there
    t = F.regexp_replace(F.replace(text, F.lit("%"), F.lit(" percent ")), r"[^a-zA-Z0-9.,;\p{L}\p{N}](?:[^a-zA-Z0-9.,;\p{L}\p{N}]+|(?<! ))", " ")
    t = F.regexp_replace(t, r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})\p{Ll}+", "<$0")
    t = F.regexp_replace(t, r"[0-9](?<![\p{L}0-9][0-9])[0-9]*+(?:[.,][0-9]++)*+", " #$0 ")
    t = F.regexp_replace(t, r"(#[0-9.,]++) +(?i:(" + "|".join(UNITS) + r"))(?![\p{L}\p{N}])", "$1 @$2")
    t = F.regexp_replace(t, r"[.,;](?:(?![0-9])|(?<![0-9].)|(?<=;))", " ")
    return F.lower(t)


def template_text(marked: Column) -> Column:
    return F.regexp_replace(marked, r"([#<@])[^ ]+", "$1")


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def _places(words: Column, raw: Column, lengths: list[int]) -> Column:
    """(h, pos, n) of all windows of the given lengths, and of the whole of a text below LEAST words.

    A window of placeholders alone says nothing of a question: it stands for its own values, raw.
    """

    def hashed(i: Column, n: int) -> Column:
        bare = F.lit(True)
        for k in range(n):
            bare = bare & F.get(words, i + k).isin("#", "<", "@")
        values = F.xxhash64(F.lit("values"), F.lit(n), *[F.get(raw, i + k) for k in range(n)])
        return F.when(bare, values).otherwise(F.xxhash64(F.lit(n), *[F.get(words, i + k) for k in range(n)]))

    def windows(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        each = F.transform(starts, lambda i: F.struct(hashed(i, n).alias("h"), i.alias("pos"), F.lit(n).alias("n")))
        return F.when(F.size(words) >= n, each)

    none = F.array().cast("array<struct<h:bigint,pos:int,n:int>>")
    whole = F.array(F.struct(F.xxhash64(F.lit("whole"), F.array_join(words, " ")).alias("h"), F.lit(0).alias("pos"), F.size(words).alias("n")))
    return F.concat(F.when((F.size(words) > 0) & (F.size(words) < LEAST), whole).otherwise(none), *[F.coalesce(windows(n), none) for n in lengths])


def _placed(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (with __text) with one row a window: h, pos, n, and the window's marked words."""
    df = df.withColumn("__marked", marked_text(F.col("__text"))).withColumn("__raw", _split(F.col("__marked"))).withColumn("__t", _split(template_text(F.col("__marked"))))
    df = df.withColumn("__w", F.explode(_places(F.col("__t"), F.col("__raw"), lengths))).drop("__marked", "__t", "__text")
    return df.select("*", "__w.h", "__w.pos", "__w.n", F.slice("__raw", F.col("__w.pos") + 1, F.col("__w.n")).alias("words")).drop("__raw", "__w")


def _same_pair(a: str, b: str) -> Column:
    """Whether rows of the aliases a and b are of one document text and item."""
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.same") == F.col(f"{b}.same")) & (F.col(f"{a}.item") == F.col(f"{b}.item"))


def _occurrences(met: DataFrame, open_pairs: DataFrame, coverage: float, consistency: float) -> DataFrame:
    """(id, same, item, n_slots, n_changed) of each occurrence of an item that by itself holds enough windows with consistent values.

    met has the matching windows of document (pos, d) and item (ipos, b).  An
    occurrence is what lies at most GAP words off one of the offsets pos - ipos; of
    several matches of an item's window the one nearest to that offset counts.
    """
    rows = met.alias("m").join(open_pairs.alias("o"), _same_pair("m", "o")).select("m.*", "o.n_windows", (F.col("m.pos") - F.col("m.ipos")).alias("off"))
    offsets = rows.select("id", "same", "item", "off").distinct()
    reach = F.least(F.lit(GAP), F.floor(F.col("n_windows") / 2).cast("int"))
    near = rows.withColumn("at", F.explode(F.sequence(F.col("off") - reach, F.col("off") + reach))).alias("m")
    near = near.join(offsets.alias("o"), _same_pair("m", "o") & (F.col("m.at") == F.col("o.off"))).select("m.*")
    best = near.groupBy("id", "same", "item", "n_windows", "at", "ipos").agg(F.min(F.struct(F.abs(F.col("off") - F.col("at")).alias("far"), "off", "h", "b", "d")).alias("w"))
    slots = F.filter(F.transform("w.b", lambda x, k: F.struct((F.col("ipos") + k).alias("slot"), x.alias("theirs"), F.get("w.d", k).alias("ours"))), lambda x: F.substring(x["theirs"], 1, 1).isin("#", "<", "@"))
    # one row an item's window: the lists are no longer than the item
    held = best.select("id", "same", "item", "n_windows", "at", "w.h", slots.alias("s")).groupBy("id", "same", "item", "n_windows", "at").agg(F.collect_set("h").alias("h"), F.flatten(F.collect_list("s")).alias("s"))
    held = held.filter(F.size("h") >= coverage * F.col("n_windows"))
    pairs = F.size(F.array_distinct(F.transform("s", lambda x: F.struct(x["theirs"], x["ours"]))))
    changed = F.transform(F.filter("s", lambda x: x["theirs"] != x["ours"]), lambda x: x["slot"])
    held = held.filter(F.size(F.array_distinct("s.theirs")) >= consistency * pairs)
    return held.select("id", "same", "item", F.size(F.array_distinct("s.slot")).cast("long").alias("n_slots"), F.size(F.array_distinct(changed)).cast("long").alias("n_changed"))


def _scattered(met: DataFrame, open_pairs: DataFrame, coverage: float) -> DataFrame:
    """(id, same, item, n_slots, n_changed) of items whose own values stand in enough windows, wherever these lie, and in each value that any match covers."""
    rows = met.alias("m").join(open_pairs.alias("o"), _same_pair("m", "o")).select("m.*", "o.n_windows", (F.col("m.b") == F.col("m.d")).alias("equal"))
    rows = rows.select("id", "same", "item", "n_windows", "h", "equal", F.explode(F.transform("b", lambda x, k: F.when(F.substring(x, 1, 1).isin("#", "<", "@"), F.col("ipos") + k))).alias("slot"))
    found = rows.groupBy("id", "same", "item", "n_windows").agg(
        F.countDistinct(F.when(F.col("equal"), F.col("h"))).alias("n_equal"), F.countDistinct("slot").alias("n_slots"), F.countDistinct(F.when(F.col("equal"), F.col("slot"))).alias("own")
    )
    return found.filter((F.col("n_equal") >= coverage * F.col("n_windows")) & (F.col("own") == F.col("n_slots"))).select("id", "same", "item", "n_slots", F.lit(0).cast("long").alias("n_changed"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY,
) -> DataFrame:
    """One row for each document and benchmark item that it repeats, verbatim or with other values.

    Columns: id_col, item_col, ``n_windows`` (distinct windows of the item),
    ``n_matched`` (of them, by the document), ``n_slots`` (values of the item that the matched windows cover),
    ``n_changed`` (those that differ in the document) and ``kind`` (verbatim or
    reparameterised).  An item that occurs several times counts with the occurrence
    that has the fewest changed values, so a document may hold one verbatim and
    others changed.  An item of fewer template words than a window is one window of
    its own length and counts with its own values only; an item below LEAST words
    only matches a text that equals it as a whole.  Null and empty texts match
    nothing; very long texts are taken whole.  Rows of one id are judged by their
    texts together where they agree, so repeated rows give one row; texts of the
    benchmark that share an item id are one item; a null id is reported as null.
    An empty table on either side gives an empty one.  Other columns are not carried.
    """
    items = benchmark.select(quoted(item_col).alias("item"), quoted(item_text).alias("__text")).filter("__text IS NOT NULL")
    sized = items.withColumn("__n", F.size(_split(template_text(marked_text(F.col("__text"))))))
    # at most window different numbers
    short = [r[0] for r in sized.filter((F.col("__n") >= LEAST) & (F.col("__n") < window)).select("__n").distinct().collect()]
    lengths = [window, *short]
    placed = _placed(sized, lengths).filter((F.col("n") == F.least("__n", F.lit(window)))).drop("__n")
    placed = materialise(placed, "benchmark")
    sizes = placed.groupBy("item").agg(F.countDistinct("h").alias("n_windows"), (F.max("n") < window).alias("short"))
    key = placed.select("h", "item").distinct()
    base = docs.select(quoted(id_col).alias("id"), quoted(text).alias("__text")).filter("__text IS NOT NULL").withColumn("same", F.xxhash64("__text"))
    light = base.select("id", "same", marked_text(F.col("__text")).alias("__m")).select("id", "same", _split(F.col("__m")).alias("__raw"), _split(template_text(F.col("__m"))).alias("__w"))
    light = light.select("id", "same", F.explode(_places(F.col("__w"), F.col("__raw"), lengths)["h"]).alias("h"))
    hits = join_checked(light, key, ["h"], limit=BROADCAST_WINDOWS).groupBy("id", "same", "item").agg(F.countDistinct("h").alias("n_matched"))
    suspects = materialise(hits.join(sizes, "item").filter(F.col("n_matched") >= coverage * F.col("n_windows")), "suspects")

    # values of suspects: only their texts are placed again
    who = suspects.select("id", "same").distinct()
    own = base.alias("b").join(F.broadcast(who).alias("w") if who.count() <= BROADCAST_WINDOWS else who.alias("w"), F.col("b.id").eqNullSafe(F.col("w.id")) & (F.col("b.same") == F.col("w.same")), "left_semi")
    # windows that the benchmark lacks go before anything is shuffled
    in_docs = join_checked(_placed(own, lengths), key.select("h").distinct(), ["h"], "left_semi", BROADCAST_WINDOWS).dropDuplicates(["id", "same", "pos", "n"])
    pair = suspects.select(F.col("id").alias("sid"), F.col("same").alias("ssame"), "item")
    wanted = in_docs.join(pair, F.col("id").eqNullSafe(F.col("sid")) & (F.col("same") == F.col("ssame"))).select("id", "same", "item", "h", "pos", F.col("words").alias("d"))
    met = materialise(wanted.join(placed.select("item", "h", F.col("pos").alias("ipos"), F.col("words").alias("b")), ["item", "h"]), "matches")
    slots = met.select("id", "same", "item", F.explode(F.transform("b", lambda x, k: F.struct((F.col("ipos") + k).alias("slot"), x.alias("theirs"), F.get("d", k).alias("ours")))).alias("s"))
    slots = slots.select("id", "same", "item", "s.*").filter(F.substring("theirs", 1, 1).isin("#", "<", "@")).distinct()
    judged = slots.groupBy("id", "same", "item").agg(
        F.countDistinct("slot").alias("n_slots"), F.countDistinct(F.when(F.col("theirs") != F.col("ours"), F.col("slot"))).alias("n_changed"),
        F.countDistinct("theirs").alias("values"), F.countDistinct("theirs", "ours").alias("pairs"),
    )
    judged = materialise(suspects.alias("s").join(judged.alias("j"), _same_pair("s", "j"), "left").select("s.*", "j.n_slots", "j.n_changed", "j.values", "j.pairs"), "judged")
    whole = judged.filter(F.col("pairs").isNull() | (F.col("values") >= consistency * F.col("pairs")))
    whole = whole.select("id", "same", "item", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"))
    # where values differ, other occurrences or chance matches may hide a true one
    unsure = judged.filter("n_changed > 0").select("id", "same", "item", "n_windows")
    ways = whole.unionByName(_occurrences(met, unsure, coverage, consistency)).unionByName(_scattered(met, unsure, coverage))
    found = ways.alias("y").join(suspects.alias("s"), _same_pair("y", "s"))
    found = found.groupBy(F.col("s.id").alias(id_col), F.col("s.item").alias(item_col)).agg(
        F.max("s.n_windows").alias("n_windows"), F.max("s.n_matched").alias("n_matched"), F.max("s.short").alias("__short"), F.min(F.struct("y.n_changed", (-F.col("y.n_slots")).alias("less"))).alias("__least")
    )
    found = found.filter(~F.col("__short") | (F.col("__least.n_changed") == 0))
    found = found.select(quoted(id_col), quoted(item_col), "n_windows", "n_matched", (-F.col("__least.less")).alias("n_slots"), F.col("__least.n_changed").alias("n_changed"))
    return found.withColumn("kind", F.when(F.col("n_changed") == 0, "verbatim").otherwise("reparameterised"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the documents that repeat a benchmark item; rows that share a contaminated id go together."""
    bad = contamination(docs, benchmark, id_col, text, **options).select(quoted(id_col).alias("__bad")).distinct()
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_WINDOWS else bad, quoted(id_col).eqNullSafe(F.col("__bad")), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
