"""Order-preserving packing of token streams into fixed windows by dynamic programming.

Each task lays its documents end to end, in order, and cuts the stream into
windows.  A cut costs nothing at a document's end, little at a sentence's end
and more elsewhere; a window costs the tokens of padding that it needs.  With
f[j] = min over i of f[i] + (size - (j - i)) + penalty(j), only f[i] + i matters
inside the reach of j, so a monotone queue finds each minimum in constant time.
The stream is solved in blocks of bounded size; what follows a block's last cut
opens the next block, so only a task's last window is short.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from tokenizers import Tokenizer

from isobath.llm.bpe import MergeTable, ragged
from isobath.llm.common import map_arrow, quoted
from isobath.llm.textnum import span_checks, span_hashes

WINDOW = 2048
#: Tokens of padding that a cut is worth: after a sentence, and inside one.
SENTENCE_CUT, INNER_CUT = 4.0, 24.0
#: Inside a sentence, cuts are considered at every so many tokens.
INNER_STEP = 32
#: Tokens that are solved together.
BLOCK_TOKENS = 1 << 20
#: Entries of a worker's table of encoded chunks.
CACHE = 150_000
#: Bits of a sequence id below the task's number.
TASK_BITS = 40

_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LETTERS = "ªµºÀ-ÖØ-öø-įı-ɏ"
#: Chunks in which lower case and composition are plain; the library takes the others whole.
_PLAIN = re.compile(f"[!-~{_LETTERS}]*")
#: Texts whose bytes tell where pre-tokens begin: no contraction, and letters only beyond ASCII.
_SIMPLE = re.compile(f"[\\t\\n\\r\\x20-&(-~{_LETTERS}]*")
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0, 9, 10, 13, 32]] = 0
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_WORKERS: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Ids of a lower-casing word-end BPE vocabulary, as little-endian uint32 bytes."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.library = Tokenizer.from_file(path)
        self.marks = tuple(self.table.special)
        self.chunks: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self._empty_pool()
        vocab = self.library.get_vocab()
        self.stops = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            if re.fullmatch(r"""[.!?…]["')\]]*</w>""", token):
                self.stops[i] = True

    def _learn(self, missing: list[str]) -> None:
        if len(self.chunks) + len(missing) > CACHE:
            self.chunks.clear()
            self.chunks[""] = b""
        if len(self.pieces) + len(missing) > CACHE:
            self.pieces.clear()
        parts: dict[str, list[str]] = {}
        odd: list[str] = []
        for c in missing:
            if not _PLAIN.fullmatch(c) or any(m in c for m in self.marks):
                odd.append(c)
            elif c.isalpha():
                parts[c] = [c.lower()]
            else:
                parts[c] = _PATTERN.findall(c.lower())
        for c, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False) if odd else ()):
            self.chunks[c] = np.array(e.ids, "<u4").tobytes()
        new = list({p for own in parts.values() for p in own if p not in self.pieces})
        if new:
            ids, offsets = self.table.encode([p.encode() for p in new])
            raw, at = ids.astype("<u4").tobytes(), (offsets * 4).tolist()
            self.pieces.update(zip(new, [raw[a:b] for a, b in zip(at, at[1:])]))
        get = self.pieces.__getitem__
        for c, own in parts.items():
            self.chunks[c] = get(own[0]) if len(own) == 1 else b"".join(map(get, own))

    def _encode_chunks(self, texts: list[str]) -> list[bytes]:
        """The ids of any texts, by chunks between spaces."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        wanted = set().union(*split) if split else set()
        missing = [c for c in wanted if c not in self.chunks]
        if len(self.chunks) + len(missing) > CACHE:
            self.chunks.clear()
            missing = list(wanted)
        self._learn(missing)
        get = self.chunks.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def _encode_simple(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that _SIMPLE matches: pre-tokens are found, named and looked up as arrays."""
        data = np.frombuffer("\0".join(["", *texts, ""]).lower().encode(), np.uint8)
        kind = _CLASS[data]
        other = kind[1:] != kind[:-1]
        digit = kind == 2
        starts = np.flatnonzero((other | digit[1:]) & (kind[1:] != 0)) + 1
        ends = np.flatnonzero((other | digit[:-1]) & (kind[:-1] != 0)) + 1
        names, example, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        check = span_checks(data, starts, ends)
        if self.pool_used + len(names) > CACHE:
            self._empty_pool()
        at = np.fromiter(map(self.pool_at.get, names.tolist(), repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            ids, offsets = self.table.encode_spans(data, starts[example[new]], ends[example[new]])
            at[new] = np.arange(self.pool_used, self.pool_used + len(new))
            self.pool_at.update(zip(names[new].tolist(), at[new].tolist()))
            self.pool_used += len(new)
            self.pool_start = np.concatenate([self.pool_start, len(self.pool_ids) + offsets[:-1]])
            self.pool_size = np.concatenate([self.pool_size, np.diff(offsets)])
            self.pool_check = np.concatenate([self.pool_check, check[example[new]]])
            self.pool_ids = np.concatenate([self.pool_ids, ids.astype("<u4")])
        if (self.pool_check[at[which]] != check).any():  # two pre-tokens share a hash
            return self._encode_chunks(texts)
        piece = at[which]
        size = self.pool_size[piece]
        raw = self.pool_ids[ragged(self.pool_start[piece], size)].tobytes()
        bounds = np.searchsorted(starts, np.flatnonzero(data == 0))
        tokens = (4 * np.concatenate([[0], np.cumsum(size)])[bounds]).tolist()
        return [raw[a:b] for a, b in zip(tokens, tokens[1:])]

    def _empty_pool(self) -> None:
        self.pool_at: dict[int, int] = {}
        self.pool_used = 0
        self.pool_start = self.pool_size = np.zeros(0, np.int64)
        self.pool_check = np.zeros(0, np.uint64)
        self.pool_ids = np.zeros(0, "<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        simple = [bool(_SIMPLE.fullmatch(t)) and not any(m in t for m in self.marks) for t in texts]
        fast = iter(self._encode_simple([t for t, s in zip(texts, simple) if s]))
        slow = iter(self._encode_chunks([t for t, s in zip(texts, simple) if not s]))
        return [next(fast) if s else next(slow) for s in simple]


def choose_cuts(nodes: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Node positions at which to cut, from the first node to the best one within the last window; neighbours lie at most size apart.

    Minimises padding plus penalties; the last cut's window need not be the stream's end.
    """
    p, pen = nodes.tolist(), penalty.tolist()
    n = len(p)
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(float(p[0]), p[0], 0)])
    for k in range(1, n):
        at = p[k]
        while queue[0][1] < at - size:
            queue.popleft()
        low, _, i = queue[0]
        cost[k] = f = low + size - at + pen[k]
        back[k] = i
        g = f + at
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, at, k))
    # what follows the last cut goes on in the next window, so a late cut is worth its tokens' share of a window
    ends = [k for k in range(n - 1, -1, -1) if p[k] > p[-1] - size]
    k = min(ends, key=lambda j: cost[j] - 0.001 * p[j])
    cuts = [p[k]]
    while k:
        k = back[k]
        cuts.append(p[k])
    return cuts[::-1]


def cut_nodes(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, with their penalties: the best of every INNER_STEP tokens."""
    steps = np.arange(INNER_STEP, total, INNER_STEP)
    at = np.concatenate([steps, sentence_ends, doc_ends])
    pen = np.repeat([INNER_CUT, SENTENCE_CUT, 0.0], [len(steps), len(sentence_ends), len(doc_ends)])
    # the last of the cheapest positions of each step stays
    order = np.lexsort((-at, pen, at // INNER_STEP))
    first = np.flatnonzero(np.diff((at // INNER_STEP)[order], prepend=-1))
    at, pen = at[order[first]], pen[order[first]]
    inside = (at > 0) & (at < total)
    return np.concatenate([[0], at[inside], [total]]), np.concatenate([[0.0], pen[inside], [0.0]])


def _tail(length: int) -> list[int]:
    """A short last window as powers of two, which need no padding."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    def __init__(self, encoder: ChunkEncoder, size: int, end_id: int, first_sequence: int, ids: bool):
        self.encoder, self.size, self.ids = encoder, size, ids
        self.end = np.array([end_id], "<u4").tobytes()
        self.sequence = first_sequence
        self.docs: list[tuple] = []  # (row of ids column, tokens of the document, tokens before, bytes)
        self.tokens = 0

    def add(self, ids: list, texts: list[str]) -> None:
        for i, raw in zip(ids, self.encoder.encode(texts)):
            raw += self.end
            self.docs.append((i, len(raw) // 4, 0, raw))
            self.tokens += len(raw) // 4

    def solve(self, last: bool) -> list[tuple]:
        """Rows of all windows that are decided; with last, of all."""
        if not self.docs:
            return []
        stream = b"".join(d[3] for d in self.docs)
        sizes = np.array([len(d[3]) // 4 for d in self.docs], np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        sentence = np.flatnonzero(self.encoder.stops[np.frombuffer(stream, "<u4")]) + 1
        cuts = choose_cuts(*cut_nodes(total, ends, sentence), self.size)
        if last and cuts[-1] < total:
            cuts += (cuts[-1] + np.cumsum(_tail(total - cuts[-1]))).tolist()
        elif last and len(cuts) > 1:  # the last window may be short as well
            at = cuts[-2]
            cuts[-1:] = (at + np.cumsum(_tail(total - at))).tolist()
        starts = ends - sizes
        edges = np.unique(np.concatenate([starts, cuts, ends]))
        edges = edges[edges <= cuts[-1]]
        doc = np.searchsorted(ends, edges[:-1], "right")
        window = np.searchsorted(cuts, edges[:-1], "right") - 1
        rows = []
        for a, b, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), window.tolist()):
            i, tokens, before, _ = self.docs[d]
            piece = stream[4 * a : 4 * b]
            row = (i, before + a - int(starts[d]), b - a, zlib.crc32(piece), tokens, self.sequence + w, a - cuts[w])
            rows.append((*row, piece) if self.ids else row)
        self.sequence += len(cuts) - 1
        rest = []
        for (i, tokens, before, raw), s, e in zip(self.docs, starts.tolist(), ends.tolist()):
            if e > cuts[-1]:
                skip = max(0, cuts[-1] - s)
                rest.append((i, tokens, before + skip, raw[4 * skip :]))
        self.docs, self.tokens = rest, total - cuts[-1]
        return rows


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", size: int = WINDOW, end_id: int = 1, ids: bool = False) -> DataFrame:
    """The pieces of docs in windows of size tokens, one row a piece.

    tokenizer is the path, on every executor, of a word-end BPE vocabulary in
    tokenizers' JSON format; each document's ids are the library's without added
    special tokens, then end_id, so a null or empty text is one token.  Columns:
    the id column, ``start`` (the document's ids before the piece), ``length``,
    ``ids_crc32`` (of its ids as little-endian uint32), ``doc_tokens``,
    ``sequence_id``, ``offset`` (in the sequence) and, if ids is set, ``ids``
    (the bytes).  A sequence belongs to one task, whose number is in its upper
    bits; a task's last tokens form sequences whose lengths are powers of two.
    Repeated rows are packed one by one; other columns are not carried, so none
    clashes, and an empty table gives no piece.  Texts of any length are taken whole.
    Of cuts of equal cost the one with the earliest window start is taken.
    """
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    source = docs.select(quoted(id_col), quoted(text).alias("__text"))
    schema = StructType([StructField(id_col, source.schema[0].dataType)] + [StructField(n, LongType()) for n in names] + [StructField("ids", BinaryType())] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _WORKERS.get(tokenizer) or _WORKERS.setdefault(tokenizer, ChunkEncoder(tokenizer))
        packer = Packer(encoder, size, end_id, TaskContext.get().partitionId() << TASK_BITS, ids)
        kind = pa.int64()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [kind] + [pa.int64()] * len(names) + [pa.binary()] * ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

        for batch in batches:
            kind = batch.column(0).type
            texts, keys = batch.column(1), batch.column(0).to_pylist()
            sizes = np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64)
            i = 0
            while i < len(keys):
                j, room = i + 1, 2_000_000 - sizes[i]
                while j < len(keys) and sizes[j] <= room:
                    room -= sizes[j]
                    j += 1
                packer.add(keys[i:j], [t or "" for t in texts.slice(i, j - i).to_pylist()])
                i = j
                if packer.tokens >= BLOCK_TOKENS and (rows := packer.solve(False)):
                    yield out(rows)
        if rows := packer.solve(True):
            yield out(rows)

    return map_arrow(source, run, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
