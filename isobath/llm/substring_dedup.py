"""Remove passages that occur more than once, with a log-structured fingerprint index.

A window of WINDOW words is named by an anchor: the smallest of its GRAM-word
fingerprints, so equal windows have equal anchors at equal places and only about
one word in twelve is an anchor.  Consecutive windows with one anchor form a
span.  Batches of anchors are counted into sorted, bucketed, immutable runs; a
new batch is merge-joined with the runs before it, which tells the anchors that
it or the history repeats, and runs are compacted when they are many.  An anchor
that never repeats proves that its windows are unique.  The spans of the others
are verified on 128-bit xxh3 hashes of their words' bytes: spans with equal words
are repeats as a whole, and where an anchor's spans differ, their single windows
are compared on such hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from isobath.llm.common import delete, discard, join_checked, map_arrow, materialise, quoted, release, small, with_fields, working_path
from isobath.llm.textnum import Words, runs, text_slices

WINDOW, GRAM = 35, 12
#: Runs that may lie side by side before they are compacted.
MAX_RUNS = 4
#: Rows of spans that may be broadcast to the documents; more are shuffled with them.
BROADCAST_SPANS = 500_000

_HIGH = np.iinfo(np.uint64).max


def word_digests(w: Words, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2) 64-bit halves of the xxh3-128 of the words first[i] to end[i], joined by one space."""
    text, at = w.spaced()
    view, digest = memoryview(text), xxhash.xxh3_128_digest
    raw = b"".join([digest(view[a:b]) for a, b in zip(at[first].tolist(), (at[end] - 1).tolist())])
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def anchors(h: np.ndarray, of_doc: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """The spans of all documents of a slice, given its word hashes and the range of words of each document.

    doc, first and last (the span's first windows) and fp, the anchor.
    """
    n = len(h)
    end_of = np.repeat(of_doc[1:], np.diff(of_doc))
    i = np.arange(n)
    starts = np.flatnonzero(i + window <= end_of)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return {k: none for k in ("doc", "first", "last")} | {"fp": none.astype(np.uint64)}
    value = np.full(n + window, _HIGH, np.uint64)
    whole = np.flatnonzero(i + gram <= end_of)
    value[whole] = runs(h, whole, gram)
    place = np.arange(n + window)
    # leftmost minimum of the window's grams, by doubling
    low, at, reach, width = value, place, 1, window - gram + 1
    while reach < width:
        step = min(reach, width - reach)
        right, right_at = np.append(low[step:], np.full(step, _HIGH)), np.append(at[step:], place[-step:])
        better = right < low
        low, at = np.where(better, right, low), np.where(better, right_at, at)
        reach += step
    at = at[starts]
    fresh = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    first, last, at = starts[fresh], starts[np.append(fresh[1:], len(starts)) - 1], at[fresh]
    doc = np.searchsorted(of_doc, first, "right") - 1
    return {"doc": doc, "first": first, "last": last, "fp": value[at]}


ANCHORS = "__k1 long, __k2 int, first int, size int, fp long, d1 long, d2 long"


def find_anchors(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """(__k1, __k2, first, size, fp, d1, d2) of every span in keyed (__k1, __k2, text): its first window, number of windows, anchor and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(c)) for c in (0, 1))
            for i, _, data, offsets in text_slices(batch.column(2)):
                w = Words(data, offsets)
                a = anchors(w.hashes(), w.of_doc, window, gram)
                doc, size = a["doc"], (a["last"] - a["first"] + 1).astype(np.int32)
                d = word_digests(w, a["first"], a["last"] + window)
                columns = [k1[i + doc], k2[i + doc], (a["first"] - w.of_doc[doc]).astype(np.int32), size, a["fp"].view(np.int64), d[:, 0].copy(), d[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["__k1", "__k2", "first", "size", "fp", "d1", "d2"])

    return map_arrow(keyed, run, ANCHORS)


def summarise(found: DataFrame) -> DataFrame:
    """(fp, n): the occurrences of each anchor."""
    return found.groupBy("fp").agg(F.count("*").alias("n"))


class FingerprintLog:
    """Sorted immutable runs of anchor counts in one folder, bucketed alike so that they merge without a shuffle.

    Runs are tables of the session's catalogue; drop() removes them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []

    def _write(self, summary: DataFrame) -> str:
        name = f"isobath_run_{uuid.uuid4().hex}"
        writer = summary.write.bucketBy(self.buckets, "fp").sortBy("fp")
        writer.option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        return name

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        joined = a.alias("a").join(b.hint("merge").alias("b"), F.col("a.fp") == F.col("b.fp"), how)
        return joined.select(F.coalesce("a.fp", "b.fp").alias("fp"), (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))

    def append(self, batch: DataFrame) -> DataFrame:
        """Add a batch's summary as a run; returns the anchors (fp) of the batch that it or the history repeats."""
        history = self.runs[:]
        self.runs.append(self._write(batch))
        own = self.spark.table(self.runs[-1])
        for run in history:
            own = self._merge(own, self.spark.table(run), "left")
        repeated = materialise(own.filter("n > 1").select("fp"), "repeated")
        if len(self.runs) > MAX_RUNS:
            self.compact()
        return repeated

    def compact(self) -> None:
        """Replace all runs by one."""
        if len(self.runs) > 1:
            merged = reduce(lambda a, b: self._merge(a, b, "full"), map(self.spark.table, self.runs))
            old, self.runs = self.runs, [self._write(merged)]
            self._drop(old)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        """Remove all runs."""
        self._drop(self.runs)
        self.runs = []


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """docs with __k1 and __k2, which name a row by its id and whole text; equal rows share them."""
    t = F.coalesce(quoted(text), F.lit(""))
    return docs.withColumn("__k1", F.xxhash64(F.lit("id"), quoted(id_col))).withColumn("__k2", F.hash(t)).withColumn("__text", t)


def _single_windows(texts: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """(d1, d2, hits) of classes of one span: the windows of it that another class of its anchor holds as well."""
    # anchors with several classes, of which one at least occurs once
    open_ = classes.groupBy("fp").agg(F.count("*").alias("k"), F.min("n").alias("low")).filter("k > 1 AND low = 1").select("fp")
    wanted = join_checked(classes, open_, ["fp"], "left_semi").groupBy("e.__k1", "e.__k2")
    wanted = materialise(wanted.agg(F.collect_list(F.struct("d1", "d2", "n", F.col("e.first").alias("first"), F.col("e.size").alias("size"))).alias("__spans")), "wanted")
    # texts that no class needs are left out before anything is shuffled, while the names of the others are few
    source = _join_spans(join_checked(texts, wanted.select("__k1", "__k2"), ["__k1", "__k2"], "left_semi") if small(wanted) else texts, wanted, "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(3).to_pylist()
            for i, j, data, offsets in text_slices(batch.column(2)):
                w = Words(data, offsets)
                rows = [(s["d1"], s["d2"], s["n"], s["size"], s["first"] + int(w.of_doc[r])) for r in range(j - i) for s in spans[i + r]]
                d1, d2, n, size, first = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
                own = np.repeat(np.arange(len(d1)), size)
                place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
                start = first[own] + place
                d = word_digests(w, start, start + window)
                columns = [d1[own], d2[own], n[own], place.astype(np.int32), d[:, 0].copy(), d[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["d1", "d2", "n", "place", "a", "b"])

    windows = materialise(map_arrow(source, run, "d1 long, d2 long, n long, place int, a long, b long"), "windows")
    # equal rows hold the same class twice
    once = windows.groupBy("d1", "d2", "place", "a", "b").agg(F.max("n").alias("n"))
    twice = once.groupBy("a", "b").agg(F.sum("n").alias("t")).filter("t > 1").select("a", "b")
    found = windows.filter("n = 1").join(twice, ["a", "b"]).select("d1", "d2", "place")
    places = materialise(found.groupBy("d1", "d2").agg(F.collect_set("place").alias("hits")), "places")
    discard(wanted, windows)
    return places


def _covered(spans: Column, window: int) -> Column:
    """Ranges (first, end) of words that sorted spans cover, joined where they touch."""
    kind = "array<struct<first:int,end:int>>"

    def add(out: Column, s: Column) -> Column:
        end = s["first"] + s["size"] - 1 + window
        last = F.get(out, F.size(out) - 1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], end).alias("end"))))
        return F.when((F.size(out) > 0) & (s["first"] <= last["end"]), joined).otherwise(F.concat(out, F.array(F.struct(s["first"].alias("first"), end.alias("end")))))

    return F.aggregate(spans, F.array().cast(kind), add)


def _join_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """docs joined with one row of spans a document; broadcast while the spans are few, otherwise shuffled."""
    many = spans.agg(F.sum(F.size("__spans"))).first()[0] or 0
    return docs.join(F.broadcast(spans) if many <= BROADCAST_SPANS else spans.hint("shuffle_merge"), ["__k1", "__k2"], how)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = 2, log: FingerprintLog | None = None, history: DataFrame | None = None) -> DataFrame:
    """docs with every word removed that a repeated window covers; ``n_words`` and ``n_removed`` are added.

    A window is ``window`` consecutive words (runs without ASCII white space,
    unchanged) of one row; it is repeated if its words also start anywhere else
    in docs, the same row included, so all occurrences go, the first one too.
    Repeated rows are documents of their own and so repeats of each other.  The
    text becomes the kept words joined by one space; a null text becomes empty.
    The rows go into the log in ``batches`` parts, by a hash of their id.  With a
    log of earlier rows, and those rows as ``history`` to verify against, what
    repeats them goes as well; the earlier rows themselves are not returned.
    Added columns replace columns of their names; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    if log is not None and log.runs and history is None:
        raise ValueError("a log of earlier rows needs these rows as history")
    keyed = _keyed(docs, id_col, text)
    private = log is None
    log = log or FingerprintLog(spark, working_path(spark, "log"))
    found = materialise(find_anchors(keyed.select("__k1", "__k2", "__text"), window, gram), "anchors")
    parts = []
    for part in range(batches):
        parts.append(log.append(summarise(found.filter(F.pmod("__k1", F.lit(batches)) == part))))
        release(spark)
    # what a batch repeats of itself or of earlier ones; a later batch names what it repeats of this one
    repeated = reduce(DataFrame.union, parts).distinct()
    hit = materialise(join_checked(found, repeated, ["fp"]), "hits")
    discard(found)
    if private:
        log.drop()
    release(spark)
    texts, members = keyed.select("__k1", "__k2", "__text"), hit
    if history is not None:
        old = _keyed(history, id_col, text).select("__k1", "__k2", "__text")
        same = find_anchors(old, window, gram)
        members = members.unionByName(join_checked(same, repeated, ["fp"], "left_semi"))
        texts = texts.union(old)
    # spans with equal words form a class; d1 and d2 are the digest of these words
    classes = members.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("fp").alias("fp"), F.min(F.struct("__k1", "__k2", "first", "size")).alias("e"))
    classes = materialise(classes, "classes")
    whole = join_checked(hit, classes.filter("n > 1").select("d1", "d2"), ["d1", "d2"], "left_semi").select("__k1", "__k2", F.struct("first", "size").alias("s"))
    places = _single_windows(texts, classes, window)
    part = join_checked(hit, places, ["d1", "d2"]).select("__k1", "__k2", "first", F.explode("hits").alias("p"))
    part = part.select("__k1", "__k2", F.struct((F.col("first") + F.col("p")).alias("first"), F.lit(1).alias("size")).alias("s"))
    spans = whole.union(part).groupBy("__k1", "__k2").agg(F.sort_array(F.collect_set("s")).alias("__spans"))
    spans = materialise(spans.select("__k1", "__k2", _covered(F.col("__spans"), window).alias("__spans")), "spans")
    discard(hit, classes, places, *parts)
    release(spark)
    joined = _join_spans(keyed, spans, "left")
    names = ["n_words", "n_removed"]
    added = StructType([StructField(text, StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    kept, schema = with_fields(joined, added)
    hidden = ("__k1", "__k2", "__text", "__spans")
    schema = StructType([f for f in schema if f.name not in hidden])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).cast(pa.binary()).to_pylist()
            marks = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
            out, total, gone = [], [], []
            for t, own in zip(texts, marks):
                words = t.split()
                total.append(len(words))
                if own:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, [s["first"] for s in own], 1)
                    np.add.at(edge, [s["end"] for s in own], -1)
                    words = [w for w, c in zip(words, np.cumsum(edge).tolist()) if not c]
                gone.append(total[-1] - len(words))
                out.append(b" ".join(words))
            arrays = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in hidden]
            arrays += [pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [n for n in batch.schema.names if n not in hidden] + [text, *names])

    return map_arrow(kept, remove, schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents)),
g AS (SELECT doc_id, i, w, count(*) OVER q AS n, string_agg(w, ' ') OVER q AS s FROM w WINDOW q AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT doc_id, i, n = 35 AND count(*) OVER (PARTITION BY n, s) > 1 AS rep FROM g),
c AS (SELECT doc_id, i, coalesce(bool_or(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone FROM r),
k AS (SELECT c.doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY c.i) FILTER (WHERE NOT gone) AS t
      FROM c JOIN w ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
