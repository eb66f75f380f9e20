"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

Documents with one shingle set form a class, of which one row goes on.  MinHash
bands propose links.  First every class is compared with one pivot of each of
its buckets: pairs whose odd sketches differ too much are dropped, the others
are confirmed on full sets, and connected components are formed.  Only buckets
that still join different components go on; there members of different components
whose sizes allow the similarity are compared on full sets, in blocks of bounded
bytes, and a block returns no more links than it has members.  Members of a
bucket's largest component meet those of the others only, never one another, so
a tight group of copies costs one link a member.

A link at the wanted similarity is missed where no band holds both ends, with
probability below 2e-6, or where the sketches' estimate is more than five
deviations off in each bucket that the two share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, LongType, StructField, StructType

from isobath.llm.common import discard, join_checked, map_arrow, materialise, quoted, small, with_fields
from isobath.llm.textnum import Words, mix, seeds, shingles, text_slices

#: At similarity 0.8 a link is missed in all bands with probability (1 - 0.8**4)**25 < 2e-6.
BANDS, ROWS = 25, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch; at 0.8 about 40 of the 200 unshared samples toggle bits.
SKETCH_BITS = 256
#: An estimate this far below the wanted similarity is more than five deviations off.
SKETCH_MARGIN = 0.22
#: Members of a block, and bytes of their sets, unless a single member has more.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Pairs that one copy of a pivot's set serves.
PIVOT_PAIRS = 64

_MULTIPLIERS = seeds(SAMPLES, 31) | np.uint64(1)
_TOGGLE = seeds(SAMPLES, 37)
_BAND = seeds(BANDS, 41)
_EMPTY = np.iinfo(np.uint64).max


def minhash(s: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a set of mixed hashes under multiplicative permutations."""
    out = np.full(SAMPLES, _EMPTY, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(out, (s[None, i : i + 512] * _MULTIPLIERS[:, None]).min(1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key a band of (documents, SAMPLES) signatures."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.zeros((len(sig), BANDS), np.uint64) + _BAND
    for r in range(ROWS):
        key = mix(key ^ parts[:, :, r])
    return key


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    """Parity bitmaps: every sample toggles the bit that it hashes to."""
    at = (mix(sig ^ _TOGGLE) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = at + np.arange(len(sig))[:, None] * SKETCH_BITS
    bits = np.bincount(flat.ravel(), minlength=len(sig) * SKETCH_BITS) & 1
    return np.packbits(bits.reshape(len(sig), SKETCH_BITS).astype(np.uint8), axis=1)


def sketch_similarity(differing_bits: np.ndarray) -> np.ndarray:
    """The similarity that the population count of two sketches' XOR stands for."""
    odd = np.minimum(2.0 * differing_bits / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(1 - odd)


def _doc_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text, in order."""
    for i, j, data, offsets in text_slices(column):
        w = Words(data, offsets, lower=True)
        h = w.hashes()
        for r in range(j - i):
            yield np.unique(shingles(h[w.of_doc[r] : w.of_doc[r + 1]], k))


def _names(s: np.ndarray) -> tuple[int, int]:
    """Two sums that name a set of hashes."""
    return int(np.add.reduce(s)), int(np.add.reduce(mix(s ^ _TOGGLE[0])))


def _fields(kind: DataType, **others: DataType) -> StructType:
    return StructType([StructField("id", kind)] + [StructField(n, t) for n, t in others.items()])


def signatures(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(id, n_shingles, s1, s2, bands, sketch) of every row; s1 and s2 name the set, bands and sketch are null for an empty one."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, sigs = [], [], []
            for s in _doc_sets(batch.column(1), k):
                n.append(len(s))
                sigs.append(minhash(s))
                names.append(_names(s))
            if not n:
                continue
            sig, full = np.array(sigs), np.array(n) > 0
            keys, sketch = band_keys(sig).view(np.int64), odd_sketches(sig)
            s12 = np.array(names, np.uint64).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            arrays = [
                batch.column(0), pa.array(n, pa.int64()), pa.array(s12[:, 0].copy()), pa.array(s12[:, 1].copy()),
                pa.compute.if_else(pa.array(full), bands, pa.nulls(len(n), bands.type)), pa.array([x.tobytes() if f else None for x, f in zip(sketch, full)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_shingles", "s1", "s2", "bands", "sketch"])

    source = docs.select(quoted(id_col).alias("id"), quoted(text).alias("text"))
    return map_arrow(source, sign, _fields(source.schema[0].dataType, n_shingles=LongType(), s1=LongType(), s2=LongType(), bands=ArrayType(LongType()), sketch=BinaryType()))


def _sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(id, s1, s2, set) for the rows of docs with one of ids."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(_doc_sets(batch.column(1), k))
            s12 = np.array([_names(s) for s in own], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s12[:, 0].copy()), pa.array(s12[:, 1].copy()), pa.array([s.tobytes() for s in own], pa.binary())], ["id", "s1", "s2", "set"])

    chosen = join_checked(docs.select(quoted(id_col).alias("id"), quoted(text).alias("text")), ids, ["id"], "left_semi")
    return map_arrow(chosen, sets, _fields(chosen.schema[0].dataType, s1=LongType(), s2=LongType(), set=BinaryType()))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a may be the pivot of very many pairs."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("set_a", "set_b"))
            good = [_linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    kind = sets.schema["id"].dataType
    # a pivot's pairs are dealt to as many copies of its set as they need
    times = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_PAIRS).cast("int").alias("copies"))
    copies = join_checked(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), times, ["a"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    dealt = join_checked(pairs, times.filter("copies > 1"), ["a"], "left").withColumn("copy", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))).cast("int"))
    both = dealt.select("a", "b", "copy").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(copies.drop("copies"), ["a", "copy"])
    return map_arrow(both.select("a", "b", "set_a", "set_b"), confirm, StructType([StructField("a", kind), StructField("b", kind)]))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of edges (a, b) reaches, by alternating large and small stars."""
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        before, edges = edges, materialise(small.filter("a <> b").distinct(), "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
        seen = now


def _pivot_pairs(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's smallest member with each other member, where the odd sketches allow the similarity."""
    low = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = buckets.join(low, "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    sketch = classes.select("id", "sketch")
    pairs = pairs.join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b").join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a")
    least = percent / 100 - SKETCH_MARGIN

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8) for c in "xy")
            differing = np.bitwise_count(x ^ y).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(sketch_similarity(differing) >= least))

    kind = classes.schema["id"].dataType
    return map_arrow(pairs.select("a", "b", "x", "y"), close, StructType([StructField("a", kind), StructField("b", kind)]))


def _open_members(buckets: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, id, component, n_shingles, large): members of buckets that still hold several components and more than one other member than the pivot.

    large marks members of the pivot's component where that holds more than half of the bucket.
    """
    placed = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("id", "component"))["component"].alias("pivot")).filter("n > 2 AND lo <> hi")
    members = join_checked(placed, mixed.select("key", "pivot"), ["key"])
    return members.select("key", "id", "component", (F.col("component") == F.col("pivot")).alias("large")).join(classes.select("id", "n_shingles"), "id")


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside each bucket, from pairs of blocks of its members."""
    # sets of that similarity lie in one size class or in neighbouring ones
    step = math.log(100 / percent) + 1e-9
    placed = members.withColumn("bin", F.floor(F.log("n_shingles") / step).cast("int"))
    kinds = placed.groupBy("key", "bin", "large").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    kinds = materialise(kinds, "kinds")
    own = placed.join(kinds, ["key", "bin", "large"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    block = kinds.select("key", "bin", "large", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    place = F.struct("bin", "large", "block")
    # every block of small components meets all blocks of its size and the next ones, once each
    one, two = block.filter("NOT large").select("key", place.alias("x")), block.select("key", place.alias("y"))
    met = one.join(two, "key").filter((F.abs(F.col("x.bin") - F.col("y.bin")) <= 1) & (F.col("y.large") | (F.col("x") <= F.col("y"))))
    ends = met.select("key", "x", "y", F.col("x").alias("at")).union(met.filter("x <> y").select("key", "x", "y", F.col("y").alias("at")))
    sent = own.select("key", "id", "component", place.alias("at")).join(ends, ["key", "at"]).join(sets.select("id", "set"), "id")
    kind = sets.schema["id"].dataType

    def link(rows: pa.Table) -> pa.Table:
        comp, block = (_codes(rows[c].to_pylist()) for c in ("component", "at"))
        within = rows["x"][0].as_py() == rows["y"][0].as_py()
        sets_ = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows["set"]]
        size = np.array([len(s) for s in sets_])
        # the intersection sizes of all pairs, through an incidence matrix
        flat = np.concatenate(sets_)
        _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets_)), size)
        shared = times[code] > 1
        column = np.cumsum(np.bincount(code[shared], minlength=len(times)) > 0) - 1
        both = np.zeros((len(sets_), len(sets_)), np.float64)
        r, c = row[shared], column[code[shared]]
        width = int(c.max()) + 1 if len(c) else 0
        for lo in range(0, width, 8192):
            part = (c >= lo) & (c < lo + 8192)
            m = np.zeros((len(sets_), min(8192, width - lo)), np.float32)
            m[r[part], c[part] - lo] = 1
            both += m @ m.T
        union = size[:, None] + size[None, :] - both
        good = (100 * both >= percent * union) & (comp[:, None] != comp[None, :])
        if not within:
            good &= block[:, None] != block[None, :]
        # a forest of these links is enough
        root = list(range(int(comp.max()) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for p, q in zip(*np.nonzero(np.triu(good, 1))):
            x, y = find(int(comp[p])), find(int(comp[q]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(p), int(q)))
        a, b = (pa.array([o[i] for o in out], pa.int64()) for i in (0, 1))
        return pa.table({"a": rows["id"].combine_chunks().take(a), "b": rows["id"].combine_chunks().take(b)})

    return sent.groupBy("key", "x", "y").applyInArrow(link, StructType([StructField("a", kind), StructField("b", kind)]))


def _codes(values: list) -> np.ndarray:
    """A number for each distinct value."""
    known: dict = {}
    return np.array([known.setdefault(repr(v), len(known)) for v in values], np.int64)


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the text, with ``n_shingles``, ``component_id`` and ``kept``.

    Two rows are linked if 100 * intersection >= percent * union of their sets of
    distinct k-word shingles; a shorter text is one shingle, an empty or null text
    has none and is linked with nothing.  Words are runs without ASCII white space,
    A-Z in lower case; shingles are compared by 64-bit hashes.  component_id is the
    smallest id that links reach, kept marks the row that has it.  Ids may be of
    any type that has an order.  Repeated rows with one id belong together and
    agree, also where their texts differ; n_shingles is then the largest of theirs.
    A null id gets a null component and is kept.  Very long texts are taken whole.
    Columns with the added names are replaced; an empty table gives an empty one.
    """
    ids = docs.filter(quoted(id_col).isNotNull())
    signed = materialise(signatures(ids, id_col, text, k), "signed")
    several = signed.filter("n_shingles > 0").groupBy("id").agg(F.count("*").alias("n"), F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.min("s2").alias("lo2"), F.max("s2").alias("hi2")).filter("n > 1")
    several = materialise(several.select("id", (F.expr("lo <> hi OR lo2 <> hi2")).alias("differ")), "several")
    repeats = several.limit(1).count() > 0
    # a class is named by its smallest id, and by its set as well where one id has several sets
    parts = several.filter("differ").limit(1).count() > 0
    name = F.struct("id", "s1", "s2") if parts else F.col("id")
    full = signed.filter("n_shingles > 0").withColumn("own", name)
    classes = full.groupBy("s1", "s2", "n_shingles").agg(F.min("own").alias("id"), F.min_by("bands", "id").alias("bands"), F.min_by("sketch", "id").alias("sketch"))
    classes = materialise(classes, "classes")
    buckets = classes.select("id", F.explode("bands").alias("key"))
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = materialise(join_checked(buckets, crowded, ["key"]), "buckets")
    wanted = buckets.select(F.col("id.id") if parts else F.col("id")).distinct()
    sets = _sets_of(ids, wanted, id_col, text, k).select(name.alias("id"), "set")
    sets = materialise(sets.dropDuplicates(["id"]) if repeats else sets, "sets")
    pairs = materialise(_pivot_pairs(buckets, classes, percent), "pairs")
    first = materialise(_confirm(pairs, sets, percent), "links")
    labels = materialise(components(first), "labels")
    opened = materialise(_open_members(buckets, labels, classes), "open")
    more = materialise(_block_links(opened, sets, percent), "links")
    copies = full.join(classes.select("s1", "s2", "n_shingles", F.col("id").alias("rep")), ["s1", "s2", "n_shingles"])
    links = first.union(more)
    if parts:  # rows with one id but different sets belong together too
        one = join_checked(copies, several.filter("differ").select("id"), ["id"], "left_semi")
        links = links.union(one.join(one.groupBy("id").agg(F.min("rep").alias("least")), "id").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    joined = materialise(components(links), "labels")
    member = copies.join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("found", F.coalesce("component", "rep"))
    member = member.groupBy("id").agg(F.min("found.id" if parts else "found").alias("component_id"))
    sizes = signed.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"))
    found = sizes.join(member, "id", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    discard(several, buckets, sets, pairs, first, labels, opened, more)
    added = StructType([StructField("n_shingles", LongType()), StructField("component_id", docs.schema[id_col].dataType), StructField("kept", BooleanType())])
    rest, _ = with_fields(docs.drop(text), added)
    found = found.withColumnRenamed("id", "__id")
    return rest.join(found, quoted(id_col) == F.col("__id"), "left").withColumn("kept", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(True))).drop("__id")


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate component left: of those with the smallest id, the one whose text has the smallest hash.

    Rows with a null id stay; columns and other edge cases as near_components().
    """
    ids = docs.select(quoted(id_col).alias("__near"), quoted(text).alias("__text"))
    found = near_components(ids, "__near", "__text", k, percent)
    gone = materialise(found.filter("NOT kept").select("__near").distinct(), "gone")
    stay = docs.join(F.broadcast(gone) if small(gone) else gone, quoted(id_col) == F.col("__near"), "left_anti")
    # repeated ids are looked for among ids alone; only their rows are numbered
    again = materialise(ids.filter("__near IS NOT NULL").groupBy("__near").agg(F.count("*").alias("n")).filter("n > 1").select("__near"), "again")
    if not again.limit(1).count():
        return stay
    again = F.broadcast(again) if small(again) else again
    same = quoted(id_col) == F.col("__near")
    number = F.row_number().over(Window.partitionBy(quoted(id_col)).orderBy(F.xxhash64(quoted(text))))
    return stay.join(again, same, "left_anti").unionByName(stay.join(again, same, "left_semi").withColumn("__copy", number).filter("__copy = 1").drop("__copy"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_components(docs, k=4, percent=80)
