"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Byte bigrams and trigrams of lower-case letters are hashed into a fixed number of
dimensions.  Each language gets several centroids by spherical k-means over a
bounded sample of labelled documents; a text takes the language of the centroid
with the highest cosine, and is marked rejected where that cosine is lower than
the centroid's own training members explain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from isobath.llm.common import map_arrow, quoted, with_fields

DIMENSIONS = 1 << 14
CENTROIDS = 4
#: Labelled documents of a language that centroids are fitted on, about.
SAMPLE = 600
#: Standard deviations below its members' mean cosine at which a centroid rejects a text.
REJECT_DEVIATIONS = 4.0
#: Characters of text that are vectorised together.
GROUP_CHARS = 1_000_000

_BYTE = np.full(256, 32, np.int64)
_BYTE[97:123] = np.arange(97, 123)
_BYTE[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def term_counts(texts: list[str]) -> np.ndarray:
    """(texts, DIMENSIONS) counts of hashed bigrams and trigrams of each whole text."""
    raw = [t.lower().encode() for t in texts]
    b = _BYTE[np.frombuffer(b" " + b"  ".join(raw) + b"  ", np.uint8)]
    two = (b[:-2] << 8) | b[1:-1]
    mask = np.int64(0xFFFFFFFF)
    grams2 = ((two * 0x9E3779B1) & mask) >> 18
    grams3 = ((((two << 8) | b[2:]) * 0x85EBCA77) & mask) >> 18
    out = np.empty((len(texts), DIMENSIONS), np.float32)
    at = 0
    for i, r in enumerate(raw):
        end = at + len(r) + 1
        out[i] = np.bincount(grams2[at:end], minlength=DIMENSIONS)
        out[i] += np.bincount(grams3[at:end], minlength=DIMENSIONS)
        at = end + 1
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    x = np.log1p(term_counts(texts)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts: (unit centroids, the cluster of each row)."""
    k = min(k, len(x))
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, np.argmax(x @ c.T, axis=1)


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, floors: np.ndarray):
        self.idf, self.langs, self.centroids, self.floors = idf, langs, centroids, floors

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        if not self.langs or not known:
            return out
        i = 0
        while i < len(known):
            j, chars = i, 0
            while j < len(known) and j - i < 256 and (j == i or chars + len(texts[known[j]]) <= GROUP_CHARS):
                chars += len(texts[known[j]])
                j += 1
            own = known[i:j]
            cosine = vectors([texts[n] for n in own], self.idf) @ self.centroids.T
            best = np.argmax(cosine, axis=1)
            for n, b, row in zip(own, best.tolist(), cosine):
                out[n] = (self.langs[b], float(min(max(row[b], 0.0), 1.0)), bool(row[b] < self.floors[b]))
            i = j
        return out


def choose(rows: DataFrame, sizes: dict[str, int], sample: int) -> DataFrame:
    """At most sample rows (u, lang and others) of each language, those with the smallest u, which is evenly spread over 0 to 1.

    sizes has the rows of each language.  Rows that cannot be among the smallest, but
    for a chance below one in a million, go at once; the rest is ranked, whatever
    their number.
    """
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit((sample + 6 * sample**0.5 + 20) / n))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    return rows.filter(F.col("u") < share[F.col("lang")]).withColumn("rank", rank).filter(F.col("rank") <= sample).drop("rank")


def fit(docs: DataFrame, text: str, lang: str, order: Column, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Fit on at most sample labelled rows of each language, chosen by a hash of the order column.

    Only rows with a language and a letter in the text count.  Document
    frequencies come from all of these rows.  One small group a language is kept on
    the driver, so languages are taken to be some thousands at most.
    """
    rows = docs.select(quoted(text).alias("text"), quoted(lang).cast("string").alias("lang"), (F.xxhash64(order, F.lit("sample")) / 2.0**64 + 0.5).alias("u"))
    rows = rows.filter("lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(np.zeros(DIMENSIONS, np.float32), [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    chosen = choose(rows, sizes, sample).select("text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            known = [t for t in batch.column(0).to_pylist() if t and has_letter(t)]
            n += len(known)
            for i in range(0, len(known), 64):
                total += np.count_nonzero(term_counts(known[i : i + 64]), axis=0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int32()), pa.array([n, *total[found].tolist()], pa.int64())], ["d", "n"])

    df = map_arrow(rows.select("text"), frequencies, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    counts = {r.d: r.n for r in df}
    n = counts.pop(-1, 0)
    seen = np.zeros(DIMENSIONS)
    seen[list(counts)] = list(counts.values())
    idf = (np.log((1 + n) / (1 + seen)) + 0.1).astype(np.float32)

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in pdf["text"] if t and has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        x = np.concatenate([vectors([t], idf) for t in texts])
        c, own = cluster(x, centroids)
        cosine = (x * c[own]).sum(1)
        floors = [float(cosine[own == j].mean() - REJECT_DEVIATIONS * cosine[own == j].std()) if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "floor": floors})

    found = sorted(chosen.groupBy("lang").applyInPandas(centre, "lang string, centroid binary, floor double").collect(), key=lambda r: (r.lang, bytes(r.centroid)))
    matrix = np.stack([np.frombuffer(bytes(r.centroid), np.float32) for r in found]) if found else np.zeros((0, DIMENSIONS), np.float32)
    return Model(idf, [r.lang for r in found], matrix, np.array([r.floor for r in found]))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``.

    A null text and one without a letter get ``und``, 0 and rejected; so does
    every text if the model saw no language.  Ties go to the first language in
    alphabetic order.  Other columns stay, those of the added names are replaced.
    """
    names = ["lang_pred", "score", "rejected"]
    added = StructType([StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), BooleanType()))])
    kept, schema = with_fields(docs.withColumn("__text", quoted(text)), added)
    schema = StructType([f for f in schema if f.name != "__text"])
    # fixed size: centroids of the known languages
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            found = held.value.predict(batch.column(at).to_pylist())
            lang, score, rejected = (list(c) for c in zip(*found)) if found else ([], [], [])
            arrays = [batch.column(k) for k in range(batch.num_columns) if k != at]
            arrays += [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [x for x in batch.schema.names if x != "__text"] + names)

    return map_arrow(kept, predict, schema)


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 modulo 3; false for a null id, which is not learnt from either."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string")) % 3 == 1, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    model = fit(learn, "text", "lang", F.col("doc_id"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
