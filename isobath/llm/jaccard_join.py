"""N-gram Jaccard self-join by grouped prefixes.

Documents with one shingle set form a class.  All shingles are put in one order,
common ones last, and a set is known by its prefix: two sets of the wanted
similarity share a shingle of their prefixes.  Classes with the same prefix and
size are one group, which is listed once under each prefix shingle.  Pairs of
groups from one list are filtered by size and by the places of the shingle, then
expanded to their classes.  Parity bitmaps refute most pairs of classes: two sets
differ by at least as many shingles as their bitmaps do bits.  The rest is
verified on full sets.

Only components are asked for, so a list is not paired with itself.  Each member
is paired with the list's pivot first, the member that has the shingle earliest.  Lists and groups that hold one component
after that are done.  In the others the members outside of the largest component
meet those of other components, which leaves no possible link unverified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from isobath.llm.common import discard, join_checked, map_arrow, materialise, quoted, with_fields
from isobath.llm.near_dedup import _confirm, _doc_sets, _fields, _names, _sets_of, components

#: One of so many documents is looked at for common shingles.
SAMPLE = 32
#: Documents of the sample that hold a common shingle, at least.
COMMON = 3
#: Common shingles that are told apart, the most frequent first; more only make lists longer.
COMMON_SHINGLES = 500_000
#: Bits of a parity bitmap: the power of two from twice the set's size on, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 16


def _common(docs: DataFrame, id_col: str, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles, sorted, and how common each is.  They steer the order only; every order gives the same links."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s for s in _doc_sets(batch.column(0), k) if len(s)]
            if own:
                name = np.repeat(np.array([_names(s)[0] for s in own], np.uint64), [len(s) for s in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(name.view(np.int64))], ["shingle", "name"])

    chosen = docs.filter(F.pmod(F.xxhash64(quoted(id_col)), F.lit(SAMPLE)) == 0).select(quoted(text))
    found = map_arrow(chosen, sample, "shingle long, name long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi"))
    # shingles of one set alone, however often it is copied, are not common
    found = found.filter((F.col("n") >= COMMON) & (F.col("lo") != F.col("hi"))).select("shingle", "n").orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).toArrow()
    shingle, n = found["shingle"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of n that a set of the wanted similarity must share one of."""
    return n + percent * n // -100 + 1 if n else 0


def parity(s: np.ndarray) -> bytes:
    """A bitmap of a set's shingles by their low bits, in which every second one clears the bit again."""
    bits = min(max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()), MOST_BITS)
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits by which two bitmaps differ, the longer one folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def prefixes(docs: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """(id, n, s1, s2, g1, g2, rare, prefix, bits): size and names of every row's set and of its prefix, the prefix in the common order, how many of it are not common, and the set's bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(_common(docs, id_col, text, k))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = held.value
        for batch in batches:
            rows, parts, bits = [], [], []
            for s in _doc_sets(batch.column(1), k):
                p = prefix_size(len(s), percent)
                at = np.searchsorted(common, s)
                at[at == len(common)] = 0
                hit = common[at] == s if len(common) else np.zeros(len(s), bool)
                own = s[:p] if not hit.any() else s[np.lexsort((s, np.where(hit, times[at], 0)))[:p]]
                parts.append(own)
                bits.append(parity(s))
                rows.append((len(s), *_names(s), *_names(own), min(p, len(s) - int(hit.sum()))))
            numbers = np.array(rows, np.uint64).reshape(-1, 6).view(np.int64)
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            columns = [batch.column(0), *(pa.array(numbers[:, i].copy()) for i in range(6)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "s1", "s2", "g1", "g2", "rare", "prefix", "bits"])

    source = docs.select(quoted(id_col).alias("id"), quoted(text).alias("text"))
    return map_arrow(source, cut, _fields(source.schema[0].dataType, n=LongType(), s1=LongType(), s2=LongType(), g1=LongType(), g2=LongType(), rare=LongType(), prefix=ArrayType(LongType()), bits=BinaryType()))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether postings a and b of one shingle leave room for the similarity: o >= percent / (100 + percent) of both sizes together, and no more than what follows the shingle."""
    room = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    sizes = (100 * F.least(f"{a}.n", f"{b}.n")) >= (percent * F.greatest(f"{a}.n", f"{b}.n"))
    return sizes & ((100 + percent) * room >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def _lists(groups: DataFrame, percent: int) -> DataFrame:
    """(shingle, gid, n, pos, pivot): the postings of shingles that several groups have, with the group that has the shingle earliest among those of a list's size.

    Sizes are classed so that those of one class fit each other.  A list in which
    nobody could be the smaller one of a pair is left out.  Lists of shingles that
    are not common are short and come from one sort; common ones, which may be
    long, are counted before they are dealt out.
    """
    step = math.log(100 / percent) + 1e-9
    posting = groups.select("gid", "n", "rare", F.floor(F.log("n") / step).cast("int").alias("bin"), F.posexplode("prefix").alias("pos", "shingle"))
    # a pair's smaller set needs room for percent / (100 + percent) of twice its size behind the shingle
    posting = posting.withColumn("first", (100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n"))
    earliest = F.min(F.struct("pos", "gid", "n"))
    whole, own = Window.partitionBy("shingle"), Window.partitionBy("shingle", "bin")
    seldom = posting.filter("pos < rare").withColumns({"times": F.count("*").over(whole), "any": F.max("first").over(whole), "pivot": earliest.over(own)})
    common = posting.filter("pos >= rare")
    counted = common.groupBy("shingle").agg(F.count("*").alias("times"), F.max("first").alias("any"))
    pivots = common.groupBy("shingle", "bin").agg(earliest.alias("pivot"))
    often = join_checked(join_checked(common, counted, ["shingle"]), pivots, ["shingle", "bin"])
    names = ["shingle", "gid", "n", "pos", "pivot"]
    return seldom.filter("times > 1 AND any").select(*names).union(often.filter("times > 1 AND any").select(*names))


def _pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(x, y): each list's pivots with the other members of their size."""
    met = lists.select(F.struct("gid", "n", "pos").alias("a"), F.col("pivot").alias("b")).filter((F.col("a.gid") != F.col("b.gid")) & _may_link("a", "b", percent))
    return met.select(F.col("b.gid").alias("x"), F.col("a.gid").alias("y")).distinct()


def _open_pairs(lists: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(x, y): groups of one list that may be linked and do not lie in one component; placed gives (gid, lo, hi), the components of a group's classes."""
    own = lists.drop("pivot").join(placed, "gid")
    mixed = own.groupBy("shingle").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).filter("least <> most").select("shingle")
    own = materialise(join_checked(own, mixed, ["shingle"], "left_semi"), "open")
    # the component with most groups of a list does not meet itself
    sizes = own.filter("lo = hi").groupBy("shingle", F.col("lo").alias("c")).agg(F.count("*").alias("k"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("k", "c"))["c"].alias("main"))
    marked = own.join(main, "shingle", "left").withColumn("rest", ~F.coalesce((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("main")), F.lit(False))).drop("main")
    a, b = marked.filter("rest").alias("a"), marked.alias("b")
    apart = (F.col("a.lo") != F.col("b.lo")) | (F.col("a.hi") != F.col("b.hi")) | (F.col("a.lo") != F.col("a.hi"))
    once = ~F.col("b.rest") | (F.col("a.gid") < F.col("b.gid"))
    met = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & once & apart & _may_link("a", "b", percent))
    found = materialise(met.select(F.col("a.gid").alias("x"), F.col("b.gid").alias("y")).distinct(), "pairs")
    discard(own)
    return found


def _unrefuted(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose bitmaps leave the similarity possible: linked sets differ by (100 - percent) / (100 + percent) of both sizes together at most."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, m = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("x", "y", "n", "m"))
            good = [(100 + percent) * differing(*bits) <= (100 - percent) * (i + j) for *bits, i, j in zip(x, y, n, m)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # most classes are in no pair
    used = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    classes = join_checked(classes, used, ["c"], "left_semi")
    a = classes.select(F.col("c").alias("a"), F.col("bits").alias("x"), "n")
    b = classes.select(F.col("c").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m"))
    met = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y", "n", "m")
    return map_arrow(met, check, StructType([met.schema["a"], met.schema["b"]]))


def _expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): the classes of pairs (x, y) of groups that lie in different components; members has (gid, c, component)."""
    a = members.select(F.col("gid").alias("x"), F.col("c").alias("a"), F.col("component").alias("p"))
    b = members.select(F.col("gid").alias("y"), F.col("c").alias("b"), F.col("component").alias("q"))
    return pairs.join(a, "x").join(b, "y").filter("p <> q").select("a", "b")


def _inside(members: DataFrame) -> DataFrame:
    """(a, b): classes of one group that lie in different components."""
    several = members.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("gid")
    own = join_checked(members, several, ["gid"], "left_semi")
    main = own.groupBy("gid", "component").agg(F.count("*").alias("k")).groupBy("gid").agg(F.max(F.struct("k", "component"))["component"].alias("main"))
    marked = own.join(main, "gid").withColumn("rest", F.col("component") != F.col("main"))
    a, b = marked.filter("rest").alias("a"), marked.alias("b")
    met = a.join(b, (F.col("a.gid") == F.col("b.gid")) & (F.col("a.component") != F.col("b.component")) & (~F.col("b.rest") | (F.col("a.c") < F.col("b.c"))))
    return met.select(F.col("a.c").alias("a"), F.col("b.c").alias("b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the text, with ``n_shingles`` and ``component_id``.

    Two rows link if 100 * intersection >= percent * union of their sets of distinct
    k-word shingles; a shorter text is one shingle, an empty or null text has none
    and links with nothing.  Words are runs without ASCII white space, A-Z in lower
    case; shingles are compared by 64-bit hashes.  component_id is the smallest id
    that links reach.  No link is missed.

    Repeated rows of one id belong together, also where their texts differ;
    n_shingles is then the largest of theirs.  A null id has a null component.
    Very long texts are taken whole.  Columns with the added names are replaced;
    an empty table gives an empty one.
    """
    ids = docs.filter(quoted(id_col).isNotNull())
    pre = materialise(prefixes(ids, id_col, text, k, percent), "prefixes")
    full = pre.filter("n > 0").withColumn("c", F.struct("s1", "s2"))
    groups = full.groupBy("n", "g1", "g2").agg(F.min("c").alias("rep"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"))
    groups = materialise(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    classes = full.groupBy("n", "g1", "g2", "c").agg(F.min("id").alias("id"), F.first("bits").alias("bits"))
    classes = materialise(join_checked(classes, groups.select("n", "g1", "g2", "gid", "rep"), ["n", "g1", "g2"]).select("gid", "c", "rep", "id", "n", "bits"), "classes")
    every = materialise(pre.select("id", "n", "s1", "s2"), "names")
    names = every.filter("n > 0").select("id", F.struct("s1", "s2").alias("c"))
    discard(pre)
    several = names.groupBy("id").agg(F.count("*").alias("times"), F.min("c").alias("least"), F.max("c").alias("most")).filter("times > 1")
    several = materialise(several, "several")
    repeats = several.limit(1).count() > 0

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link."""
        raw = materialise(pairs, "candidates")
        pairs = materialise(_unrefuted(raw, classes, percent), "pairs")
        used = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
        sets = _sets_of(ids, join_checked(classes, used, ["c"], "left_semi").select("id").distinct(), id_col, text, k).select(F.struct("s1", "s2").alias("id"), "set")
        sets = materialise(sets.dropDuplicates(["id"]) if repeats else sets, "sets")
        links = materialise(_confirm(pairs, sets, percent), "links")
        discard(raw, pairs, sets)
        return links

    lists = materialise(_lists(groups, percent), "lists")
    discard(groups)
    rep = classes.filter("c = rep").select("gid", "rep")
    pivots = _pivot_pairs(lists, percent).join(rep.select(F.col("gid").alias("x"), F.col("rep").alias("a")), "x").join(rep.select(F.col("gid").alias("y"), F.col("rep").alias("b")), "y").select("a", "b")
    first = verified(pivots.union(classes.filter("c <> rep").select(F.col("rep").alias("a"), F.col("c").alias("b"))))
    labels = components(first)
    members = classes.join(labels.withColumnRenamed("id", "c"), "c", "left").select("gid", "c", F.coalesce("component", "c").alias("component"))
    members = materialise(members, "members")
    placed = members.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    opened = _open_pairs(lists, placed, percent)
    more = verified(_expand(opened, members).union(_inside(members)))
    links = first.union(more)
    if repeats:  # rows of one id belong together
        apart = several.filter("least <> most").select("id", F.col("least").alias("b"))
        links = links.union(join_checked(names, apart, ["id"]).select(F.col("c").alias("a"), "b"))
    joined = classes.join(components(links).withColumnRenamed("id", "c"), "c", "left").select("c", "id", F.coalesce("component", "c").alias("component"))
    joined = materialise(joined, "joined")
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = joined.join(least, "component").select("c", "component_id")
    sizes = every.groupBy("id").agg(F.max("n").alias("n_shingles"))
    found = sizes.join(names.join(of_class, "c").groupBy("id").agg(F.min("component_id").alias("component_id")), "id", "left")
    found = found.select(F.col("id").alias("__id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    discard(classes, several, lists, first, members, opened, more)
    added = StructType([StructField("n_shingles", LongType()), StructField("component_id", docs.schema[id_col].dataType)])
    rest, _ = with_fields(docs.drop(text), added)
    return rest.join(found, quoted(id_col) == F.col("__id"), "left").drop("__id")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, k=5, percent=80)


#: Links of the shingle sets of k words, and the smallest id that they reach, for a table documents(doc_id, text).
COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < {k} THEN [hash(array_to_string(l, ' '))]
    ELSE list_transform(range(1, len(l) - {k} + 2), lambda i: hash(array_to_string(l[i:i + {k} - 1], ' '))) END) AS s FROM w),
classes AS (SELECT s, min(doc_id) AS c FROM (SELECT doc_id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT c, len(s) AS n, unnest(s) AS h FROM classes),
links AS (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.c <> b.c AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.c, b.c HAVING 100 * count(*) >= {percent} * (max(a.n) + max(b.n) - count(*))),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON c.s = list_sort(s.s) LEFT JOIN least l ON l.a = c.c
"""
OP13_SQL = COMPONENTS_SQL.format(k=5, percent=80)
