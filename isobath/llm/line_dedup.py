"""Drop lines that many documents share, by probing a sharded minimal perfect hash.

Distinct line keys are counted over the corpus with two 64-bit hashes each.  The
keys that reach the limit are split into shards by the first hash; each shard
becomes a minimal perfect hash whose index points into a fingerprint array (the
second hash) and a count array.  Keys of a shard that share their first hash
with another one lie in a small list beside the arrays.  Documents probe those
arrays; lines are never joined with lines.  While the arrays fit a stated bound
they are broadcast; beyond it the documents' line hashes are sent to copies of
each shard, as many as its probes need.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from isobath.llm.common import discard, map_arrow, materialise, quoted, with_fields
from isobath.llm.textnum import mix, seeds

#: Keys of a shard.
SHARD_KEYS = 1 << 16
#: Keys whose arrays may be broadcast: about 13 bytes each.
BROADCAST_KEYS = 2_000_000
#: Probes that one copy of a shard answers; a shard that holds a very common line has more copies.
PROBES = 1_000_000
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LEVELS = seeds(64, 71)


class PerfectHash:
    """A minimal perfect hash of uint64 keys: one bit array a level, keys that collide go to the next level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.concatenate([[0], np.cumsum(ones)[:-1]]))
            total += int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels = []
        while len(keys):
            words = np.zeros(int(len(keys) * gamma) // 64 + 1, np.uint64)
            at = mix(keys ^ _LEVELS[len(levels)]) % np.uint64(len(words) * 64)
            alone = np.bincount(at.astype(np.int64), minlength=len(words) * 64)[at.astype(np.int64)] == 1
            won = at[alone]
            np.bitwise_or.at(words, (won >> np.uint64(6)).astype(np.int64), np.uint64(1) << (won & np.uint64(63)))
            levels.append(words)
            keys = keys[~alone]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or -1 where no level holds it; a key that was not built in may get any index."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for words, before, salt in zip(self.levels, self.before, _LEVELS):
            at = mix(keys[left] ^ salt) % np.uint64(len(words) * 64)
            w, b = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[w] >> b) & np.uint64(1) == 1
            below = np.bitwise_count(words[w[hit]] & ((np.uint64(1) << b[hit]) - np.uint64(1)))
            out[left[hit]] = before[w[hit]] + below
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], np.uint64)
        return head.tobytes() + b"".join(w.tobytes() for w in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.uint64, 1)[0])
        sizes = np.frombuffer(data, np.uint64, n, 8).astype(int)
        ends = 8 * (1 + n) + 8 * np.cumsum(sizes)
        return cls([np.frombuffer(data, np.uint64, k, int(e) - 8 * int(k)) for k, e in zip(sizes, ends)])


class Shard:
    """A perfect hash, its fingerprint and count arrays, and the (h1, h2, count) rows of keys whose first hash it holds for another key."""

    def __init__(self, table: bytes, prints: bytes, counts: bytes, more: bytes):
        self.table, self.prints, self.counts_of = PerfectHash.load(table), np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32)
        self.more = {(a, b): n for a, b, n in np.frombuffer(more, np.uint64).reshape(-1, 3).tolist()}

    def counts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The document count of each key, 0 for keys that are not held."""
        out = np.zeros(len(h1), np.int64)
        at = self.table.index(h1)
        good = (at >= 0) & (self.prints[np.maximum(at, 0)] == h2)
        out[good] = self.counts_of[at[good]]
        if self.more:
            for i in np.flatnonzero(~good).tolist():
                out[i] = self.more.get((int(h1[i]), int(h2[i])), 0)
        return out


class ShardedIndex:
    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes, bytes]], n_shards: int):
        self.n = n_shards
        self.shards = {s: Shard(*parts) for s, *parts in rows}

    def counts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), np.int64)
        shard = (h1 % np.uint64(self.n)).astype(np.int64)
        for s in np.unique(shard).tolist():
            if s in self.shards:
                own = np.flatnonzero(shard == s)
                out[own] = self.shards[s].counts(h1[own], h2[own])
        return out


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)
    return raw[:, 0], raw[:, 1]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def count_keys(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, n): the hashes of every distinct line key and the number of documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for t in _texts(batch.column(0)):
                seen.update({k for k in map(line_key, t.split(b"\n")) if _long_enough(k, min_chars)})
            h1, h2 = key_hashes(list(seen)) if seen else (np.zeros(0, np.uint64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["h1", "h2", "n"])

    found = map_arrow(docs.select(quoted(text)), count, "h1 long, h2 long, n long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


INDEX = "shard int, table binary, prints binary, counts binary, more binary"


def shard_of(h1: Column, n_shards: int) -> Column:
    """The first hash, read as unsigned, modulo the number of shards."""
    return F.pmod(F.conv(F.hex(h1), 16, 10).cast("decimal(20,0)"), F.lit(n_shards)).cast("int")


def build_shard(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """The parts of a Shard of distinct keys."""
    order = np.lexsort((-n, h1))
    h1, h2, n = h1[order], h2[order], np.minimum(n[order], np.iinfo(np.uint32).max)
    first = np.append(True, h1[1:] != h1[:-1])
    table = PerfectHash.build(h1[first])
    at = table.index(h1[first])
    prints, counts = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint32)
    prints[at], counts[at] = h2[first], n[first]
    more = np.stack([h1[~first], h2[~first], n[~first].astype(np.uint64)], 1)
    return table.dump(), prints.tobytes(), counts.tobytes(), more.tobytes()


def build_index(keys: DataFrame, n_shards: int) -> DataFrame:
    """(shard, table, prints, counts, more): the parts of every shard of keys (h1, h2, n)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = build_shard(*(pdf[c].to_numpy().view(np.uint64) for c in ("h1", "h2")), pdf["n"].to_numpy())
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), *parts)], columns=["shard", "table", "prints", "counts", "more"])

    return keys.withColumn("shard", shard_of(F.col("h1"), n_shards)).groupBy("shard").applyInPandas(build, INDEX)


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS, probes: int = PROBES) -> DataFrame:
    """docs with every line dropped whose key at least min_docs documents hold.

    A key is the line without ASCII white space at its ends and with A-Z in lower
    case; keys of fewer than min_chars code points stay.  Each row is a document,
    so repeated rows count one by one, and a line that a document repeats counts
    once.  A null text is an empty line and comes back as an empty text.  Very long
    texts are taken whole.  The other columns stay; ``n_lines`` and ``n_dropped``
    are added and replace columns of those names.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    held_by = Observation()
    counted = count_keys(docs, text, min_chars).observe(held_by, F.coalesce(F.sum("n"), F.lit(0)).alias("probes"))
    keys = materialise(counted.filter(F.col("n") >= min_docs), "keys")
    n_keys = keys.count()
    n_shards = max(1, -(-n_keys // SHARD_KEYS))
    index = build_index(keys, n_shards)
    added = StructType([StructField(text, StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    if n_keys <= broadcast_keys:
        held = spark.sparkContext.broadcast(([tuple(r) for r in index.collect()], n_shards))
        discard(keys)
        return _drop(docs, text, min_chars, added, held, None)
    # probes of a shard: those of its frequent keys, and its part of all others; one row a shard
    hot = {r.shard: r.n for r in keys.groupBy(shard_of(F.col("h1"), n_shards).alias("shard")).agg(F.sum("n").alias("n")).collect()}
    others = (held_by.get["probes"] - sum(hot.values())) // n_shards
    copies = [1 + (hot.get(s, 0) + others) // probes for s in range(n_shards)]
    return _drop(_probed(docs, text, min_chars, index, copies), text, min_chars, added, None, "__hot")


def _drop(docs: DataFrame, text: str, min_chars: int, added: StructType, held, hot: str | None) -> DataFrame:
    names = [f.name for f in added]
    source = docs.select("*", quoted(text).alias("__text"))
    kept, schema = with_fields(source, added)
    schema = StructType([f for f in schema if f.name not in ("__text", hot)])
    loaded: list[ShardedIndex] = []

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held is not None and not loaded:
            loaded.append(ShardedIndex(*held.value))
        for batch in batches:
            texts = _texts(batch.column(batch.schema.get_field_index("__text")))
            hots = batch.column(batch.schema.get_field_index(hot)).to_pylist() if hot else None
            out, lines, dropped = [], [], []
            split = [t.split(b"\n") for t in texts]
            keys = [[line_key(x) for x in s] for s in split]
            if loaded:
                distinct = list({k for ks in keys for k in ks})
                h1, h2 = key_hashes(distinct) if distinct else (np.zeros(0, np.uint64),) * 2
                bad = {k for k, n in zip(distinct, loaded[0].counts(h1, h2)) if n and _long_enough(k, min_chars)}
            for i, (s, ks) in enumerate(zip(split, keys)):
                if hots is not None:
                    own = set(hots[i] or ())
                    bad = {k for k in set(ks) if xxhash.xxh3_128_digest(k) in own} if own else set()
                stay = [x for x, k in zip(s, ks) if k not in bad]
                out.append(b"\n".join(stay))
                lines.append(len(s))
                dropped.append(len(s) - len(stay))
            arrays = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("__text", hot)]
            arrays += [pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [n for n in batch.schema.names if n not in ("__text", hot)] + names)

    return map_arrow(kept, drop, schema)


def _probed(docs: DataFrame, text: str, min_chars: int, index: DataFrame, copies: list[int]) -> DataFrame:
    """docs with ``__hot``: the digests of its frequent keys, found by probing copies of the shards."""
    n_shards, salts = len(copies), np.array(copies, np.int64)
    docs = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys = [], []
            for r, t in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                own = {k for k in map(line_key, t.split(b"\n")) if _long_enough(k, min_chars)}
                row += [r] * len(own)
                keys += own
            h1, h2 = key_hashes(keys) if keys else (np.zeros(0, np.uint64),) * 2
            shard = (h1 % np.uint64(n_shards)).astype(np.int64)
            # by the document, so that the copies share a common line evenly
            salt = np.array(row, np.int64) % salts[shard]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.array(row, np.int64), h1.view(np.int64), h2.view(np.int64), shard.astype(np.int32), salt.astype(np.int32))], ["__row", "h1", "h2", "shard", "salt"])

    asked = map_arrow(docs.select("__row", quoted(text)), ask, "__row long, h1 long, h2 long, shard int, salt int")

    def answer(asked: pa.Table, arrays: pa.Table) -> pa.Table:
        rows = arrays.select(["shard", "table", "prints", "counts", "more"]).to_pylist()
        held = ShardedIndex([tuple(r.values()) for r in rows], n_shards)
        h1, h2 = (asked[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        hit = np.flatnonzero(held.counts(h1, h2))
        raw = np.stack([h1[hit], h2[hit]], 1).astype(">u8").tobytes()
        return pa.table({"__row": asked["__row"].take(pa.array(hit)), "key": pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())})

    number = F.get(F.array(*map(F.lit, copies)), F.col("shard")) if n_shards <= 1000 else F.udf(lambda s: copies[s], "int")("shard")  # one call a shard
    every = index.withColumn("salt", F.explode(F.sequence(F.lit(0), number.cast("int") - 1)))
    found = asked.groupBy("shard", "salt").cogroup(every.groupBy("shard", "salt")).applyInArrow(answer, "__row long, key binary")
    hot = found.groupBy("__row").agg(F.collect_list("key").alias("__hot"))
    return docs.join(hot, "__row", "left").drop("__row")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
hot AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE h.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot h USING (k) GROUP BY doc_id
"""
