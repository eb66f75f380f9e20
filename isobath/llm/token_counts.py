"""Exact token counts of a byte-level BPE vocabulary, without making token lists.

Text is cut at spaces into chunks, which pre-tokens never cross; chunks repeat,
so each worker keeps a bounded table of chunk counts.  The pre-tokens of unknown
chunks are merged together as ragged numpy arrays (see ``bpe``) and only the
surviving symbols are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from isobath.llm.bpe import MergeTable
from isobath.llm.common import map_arrow, quoted, with_fields

#: Entries of a worker's table; it is emptied when full.
CACHE = 150_000
#: Characters of a chunk beyond which it is not kept there.
LONG = 256
#: Characters of text whose unknown chunks are merged together.
GROUP_CHARS = 2_000_000
#: A space inside or at the end of a run of white space: the run may be one pre-token.
_RUN = re.compile(r"\s (?:\s|\Z)")
_WORKERS: dict[str, TokenCounter] = {}


class TokenCounter:
    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = re.compile("(" + "|".join(map(re.escape, self.table.special)) + ")") if self.table.special else None
        self.marks = tuple(self.table.special)
        self.chunks: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.pieces: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of text; a special token's string stands for itself."""
        if self.special and any(m in text for m in self.marks):
            out = []
            for part in self.special.split(text):
                out += [part] if part in self.table.special else self.pattern.findall(part)
            return out
        return self.pattern.findall(text)

    def _learn(self, groups: dict[tuple[bool, str], list[str]], loose: set[str]) -> None:
        """Fill the tables for chunks given with their pre-tokens, and for loose pre-tokens."""
        for m in self.marks:
            self.pieces[m] = 1
        new = list({p for own in (*groups.values(), loose) for p in own if p not in self.pieces})
        if new:
            _, offsets = self.table.encode([p.encode() for p in new])
            self.pieces.update(zip(new, np.diff(offsets).tolist()))
        get = self.pieces.__getitem__
        for (first, chunk), own in groups.items():
            self.chunks[first][chunk] = sum(map(get, own))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts, whole = [], []
        for t in texts:
            slow = bool(_RUN.search(t)) or any(m in t for m in self.marks)
            parts.append(None if slow else t.split(" "))
            whole.append(self.pretokens(t) if slow else None)
        # only a text's first chunk has no space before it; the two sorts have a table each
        wanted = ({c for p in parts if p for c in p[1:]}, {p[0] for p in parts if p})
        loose = {w for own in whole if own for w in own}
        if sum(map(len, (*self.chunks, *wanted))) > CACHE:
            self.chunks = ({}, {})
        if len(self.pieces) + len(loose) + sum(map(len, wanted)) > CACHE:
            self.pieces.clear()
        groups = {}
        for first in (False, True):
            for c in wanted[first]:
                if c not in self.chunks[first]:
                    text = c if first else " " + c
                    groups[first, c] = [text] if c.isalpha() else self.pattern.findall(text)
        self._learn(groups, loose)
        after, at_start, one = self.chunks[False].__getitem__, self.chunks[True].__getitem__, self.pieces.__getitem__
        out = [at_start(p[0]) + sum(map(after, p[1:])) if p else sum(map(one, own)) for p, own in zip(parts, whole)]
        # long pieces hardly come again
        for first, c in groups:
            if len(c) > LONG:
                del self.chunks[first][c]
        for p in [p for p in loose.union(*groups.values()) if len(p) > LONG]:
            del self.pieces[p]
        return out


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """docs with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    tokenizer is the path, on every executor, of a byte-level BPE vocabulary in
    tokenizers' JSON format.  Counts equal the library's without added begin or
    end tokens, whatever characters a text has: a special token's string inside a
    text is one token.  Texts of any length are taken whole.  Null and
    empty texts have 0 bytes and 0 tokens.  Rows are counted one by one, so
    repeated rows repeat; other columns stay, columns of the added names are
    replaced, an empty table gives an empty one.
    """
    names = ["n_bytes", "n_tokens", "over_limit"]
    added = StructType([StructField(names[0], LongType()), StructField(names[1], LongType()), StructField(names[2], BooleanType())])
    kept, schema = with_fields(docs.withColumn("__text", quoted(text)), added)
    schema = StructType([f for f in schema if f.name != "__text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _WORKERS.get(tokenizer) or _WORKERS.setdefault(tokenizer, TokenCounter(tokenizer))
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            column = batch.column(at)
            sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)).astype(np.int64)
            tokens: list[int] = []
            i = 0
            while i < len(column):
                j, room = i + 1, GROUP_CHARS - sizes[i]
                while j < len(column) and sizes[j] <= room:
                    room -= sizes[j]
                    j += 1
                tokens += counter.count([t or "" for t in column.slice(i, j - i).to_pylist()])
                i = j
            n = np.array(tokens, np.int64)
            arrays = [batch.column(k) for k in range(batch.num_columns) if k != at] + [pa.array(sizes), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(arrays, [x for x in batch.schema.names if x != "__text"] + names)

    return map_arrow(kept, count, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024).drop("text")
