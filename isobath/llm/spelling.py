"""Groups of spelling variants: words that one character tells apart, by Aho-Corasick automata over word halves.

One inserted, deleted or replaced character leaves one half of a word whole, at
the start or at the end of its neighbour.  Shards of bounded size hold an
automaton over both segments of their words, with the word's edge as part of the
segment, so that a match has the right offset.  Every word is scanned by the
shards that hold segments with its first or last characters; matches of a
compatible length are verified.  A pair that both halves find is counted at the
first one only.  A word's neighbours are counted and compared where they are
found, so that no pair leaves a shard.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.llm.common import discard, join_checked, map_arrow, materialise, quoted

#: Words of a shard; a shard with more is split in parts, and each part of it is met by each part of the words.
SHARD_WORDS = 20_000
#: Distinct words that a worker counts before it passes them on.
HELD_WORDS = 300_000
#: Code points of candidate pairs that are verified at once.
CHUNK = 4_000_000
#: Length of a text from which its runs are taken one at a time.
LONG_TEXT = 1 << 20

_RUN = re.compile("[a-zÀ-ÿ]+")


def _runs(text: str) -> Counter[str]:
    return Counter(_RUN.findall(text) if len(text) < LONG_TEXT else (m[0] for m in _RUN.finditer(text)))


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 5, drop_every: int = 0) -> DataFrame:
    """(word, n): the runs of letters of all texts with A-Z in lower case, of at least min_chars code points, and their occurrences.

    Letters are A-Z, a-z and U+00C0 to U+00FF.  With drop_every, misspellings are
    planted: where the crc32 h of ``<id>:<run>`` is a multiple of it, the run loses
    the code point at h modulo its length.  A null text has no words, a null id
    counts as an empty one; texts are taken whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                head = zlib.crc32(f"{i}:".encode())
                for w, c in _runs((t or b"").lower().decode()).items():
                    if drop_every and not (h := zlib.crc32(w.encode(), head)) % drop_every:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= min_chars:
                        held[w] += c
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    source = docs.select(F.coalesce(quoted(id_col).cast("string"), F.lit("")), quoted(text))
    return map_arrow(source.toDF("id", "text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of the code point matrices a and b differ by exactly one inserted, deleted or replaced code point."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    s, g = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    if not s.shape[1]:
        return np.ones(len(s), bool)
    head = np.logical_and.accumulate(s == g[:, :-1], axis=1).sum(1)
    tail = np.logical_and.accumulate((s == g[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= s.shape[1]


class Lexicon:
    """Words by number, with a code point matrix for each length."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.place = np.zeros(len(words), np.int64)
        self.points: dict[int, np.ndarray] = {}
        for k in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == k)
            self.place[own] = np.arange(len(own))
            self.points[k] = np.array([words[i] for i in own], f"U{k}").view(np.uint32).reshape(len(own), k)

    def matrix(self, which: np.ndarray, size: int) -> np.ndarray:
        """The code points of words that all have this size."""
        return self.points[size][self.place[which]]


class Shard:
    """An automaton over the first (side 0) or last (side 1) segments of words."""

    def __init__(self, lexicon: Lexicon, side: int):
        self.lexicon, self.side = lexicon, side
        segments: dict[str, int] = {}
        own = [segments.setdefault("\n" + w[: len(w) // 2] if side == 0 else w[len(w) // 2 :] + "\n", len(segments)) for w in lexicon.words]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in segments.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        # a segment belongs to words of two lengths, which lie side by side
        self.shorter = np.array([2 * (len(s) - 1) - side for s in segments], np.int64)
        own = np.array(own, np.int64)
        slot = 2 * own + lexicon.size - self.shorter[own]
        self.order = np.argsort(slot, kind="stable")
        self.bounds = np.searchsorted(slot[self.order], np.arange(2 * len(segments) + 1))

    def candidates(self, scanned: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(own, other): words of this shard whose segment a scanned word holds at the right end, of a compatible length; in chunks."""
        line = "\n" + "\n".join(scanned.words) + "\n"
        found = np.array(list(self.automaton.iter(line)), np.int64).reshape(-1, 2)
        begin = np.cumsum(np.append(1, scanned.size[:-1] + 1)) if len(scanned.words) else np.zeros(0, np.int64)
        # a match ends inside its word, or at the edge behind it
        other, segment = np.searchsorted(begin, found[:, 0] - self.side, "right") - 1, found[:, 1]
        for longer in (0, 1):
            fits = np.flatnonzero(np.abs(self.shorter[segment] + longer - scanned.size[other]) <= 1)
            lo, n = self.bounds[2 * segment[fits] + longer], np.diff(self.bounds)[2 * segment[fits] + longer]
            cost = np.cumsum(n * (self.shorter[segment[fits]] + 2))
            at = 0
            while at < len(fits):
                end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + CHUNK, "right")))
                k = n[at:end]
                inside = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                yield self.order[np.repeat(lo[at:end], k) + inside], np.repeat(other[fits[at:end]], k)
                at = end

    def near(self, scanned: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The candidates (own, other) that differ by one edit, each pair at the first side that finds it."""
        for own, other in self.candidates(scanned):
            a, b = self.lexicon.size[own], scanned.size[other]
            kind = 3 * a + b - a + 1
            for one in np.unique(kind).tolist():
                at = np.flatnonzero(kind == one)
                x, y = int(a[at[0]]), int(b[at[0]])
                # a hot segment's single word may have very many candidates
                for lo in range(0, len(at), step := max(1, CHUNK // x)):
                    part = at[lo : lo + step]
                    p, q, m = self.lexicon.matrix(own[part], x), scanned.matrix(other[part], y), x // 2
                    if self.side == 0:
                        good = one_edit(p[:, m:], q[:, m:])
                    else:
                        good = one_edit(p[:, :m], q[:, : y - x + m]) & (p[:, :m] != q[:, :m]).any(1)
                    yield own[part[good]], other[part[good]]


def _neighbours(rows: pa.Table) -> pa.Table:
    """(word, n, n_near, near_n, near): the scanned words of a shard, how many of its words are near each, and the most frequent of these."""
    order = sorted(range(rows.num_rows), key=(words := rows["word"].to_pylist()).__getitem__)
    held, scanned = (rows[c].to_numpy(zero_copy_only=False) for c in ("held", "scanned"))
    mine, theirs = [i for i in order if held[i]], [i for i in order if scanned[i]]
    shard, other = Shard(Lexicon([words[i] for i in mine]), rows["side"][0].as_py()), Lexicon([words[i] for i in theirs])
    n = rows["n"].to_numpy()
    times = n[mine]
    count, best_n, best = np.zeros(len(theirs), np.int64), np.zeros(len(theirs), np.int64), np.full(len(theirs), -1)
    for a, b in shard.near(other):
        count += np.bincount(b, minlength=len(theirs))
        # words are numbered in code point order
        a = a[first := np.lexsort((a, -times[a], b))]
        b = b[first]
        top = np.flatnonzero(np.diff(b, prepend=-1))
        a, b = a[top], b[top]
        better = (times[a] > best_n[b]) | ((times[a] == best_n[b]) & (a < best[b]))
        best[b[better]], best_n[b[better]] = a[better], times[a[better]]
    forms = [words[mine[i]] if i >= 0 else None for i in best.tolist()]
    return pa.table({"word": pa.array([words[i] for i in theirs], pa.string()), "n": pa.array(n[theirs]), "n_near": pa.array(count), "near_n": pa.array(best_n), "near": pa.array(forms, pa.string())})


def near_words(words: DataFrame, edge: int = 2) -> DataFrame:
    """(word, n, n_near, near_n, near) of every row of words (word, n): the number of words one edit away and the most frequent of these.

    Words are distinct and have at least 2 * edge code points: edge is the number of
    code points at either end that choose a word's shards.
    """
    total = words.count()
    shards = max(1, -(-total // SHARD_WORDS))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, edge).alias("key")), F.struct(F.lit(1).alias("side"), F.substring("word", -edge, edge).alias("key"))))
    placed = words.select("word", "n", ends.alias("e")).select("word", "n", "e.side", F.pmod(F.xxhash64("e.side", "e.key"), F.lit(shards)).cast("int").alias("shard"))
    parts = placed.groupBy("side", "shard").agg(F.ceil(F.count("*") / SHARD_WORDS).cast("int").alias("parts"))
    placed = join_checked(placed, parts, ["side", "shard"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    # a part's automaton meets all parts of the words; with one part, a row serves as both
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_both = F.struct(F.col("own").alias("part"), F.col("own").alias("slice"), F.lit(True).alias("held"), F.lit(True).alias("scanned"))
    others = F.filter(every, lambda i: i != F.col("own"))
    as_held = F.transform(others, lambda i: F.struct(F.col("own").alias("part"), i.alias("slice"), F.lit(True).alias("held"), F.lit(False).alias("scanned")))
    as_scanned = F.transform(others, lambda i: F.struct(i.alias("part"), F.col("own").alias("slice"), F.lit(False).alias("held"), F.lit(True).alias("scanned")))
    sent = placed.select("word", "n", "side", "shard", F.inline(F.concat(F.array(as_both), as_held, as_scanned)))
    found = sent.groupBy("side", "shard", "part", "slice").applyInArrow(_neighbours, "word string, n long, n_near long, near_n long, near string")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))))
    found = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n", "n_near", (-F.col("best.minus")).alias("near_n"), F.col("best.near").alias("near"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of forms (word, form) whose form is given: the end of its chain of forms, by doubling.

    Each round halves what is left of a chain; chains have no cycle, as n grows along them.
    """
    at = materialise(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "chains")
    while at.filter("moved").limit(1).count():
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = join_checked(at.drop("moved"), step, ["root"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, at = at, materialise(moved, "chains")
        discard(before)
    return at.drop("moved")


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 5, min_count: int = 3, ratio: int = 2, drop_every: int = 0) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of docs with the frequent word that each is a variant of.

    Words are those of count_words() with at least min_count occurrences n.  Two
    words are near if exactly one inserted, deleted or replaced code point tells
    them apart.  form is the near word of largest n, the smallest in code point
    order of several, if form_n is at least ratio times n; otherwise it is null.
    root is the end of the chain of forms, the word itself without one.  n_near
    counts the near words.  Repeated rows count each time; null and empty texts
    have no words; very long texts and words are taken whole.  Columns of docs
    other than id and text do not matter.  An empty table gives an empty one.
    """
    if min_chars < 4 or ratio < 2:
        raise ValueError("words need at least four code points and forms twice the occurrences")
    words = materialise(count_words(docs, id_col, text, min_chars, drop_every).filter(F.col("n") >= min_count), "words")
    near = near_words(words)
    form = F.col("near_n") >= ratio * F.col("n")
    formed = materialise(near.select("word", F.when(form, F.col("near")).alias("form"), "n", "n_near", F.when(form, F.col("near_n")).alias("form_n")), "forms")
    discard(words)
    out = join_checked(formed, follow(formed), ["word"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return group_spellings(docs, drop_every=97)


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
  SELECT doc_id, w, count(*) AS k, hex(doc_id::VARCHAR || ':' || w) AS x
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY doc_id, w),
hashed AS (
  SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substring(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS h FROM runs, crc),
cut AS (SELECT k, CASE WHEN h % 97 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, substring(word, 1, i - 1) || substring(word, i + 1) AS d, i FROM places),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.d
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.d),
best AS (SELECT word, count(*) AS n_near, min(near) FILTER (WHERE near_n = m) AS near, max(m) AS near_n FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS m FROM pairs) GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c USING (word) JOIN formed e ON e.word = c.root WHERE e.form IS NULL
"""
