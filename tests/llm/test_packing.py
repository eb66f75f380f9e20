import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from isobath.llm import packing
from isobath.llm.packing import ChunkEncoder, choose_cuts, cut_nodes, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "B", " ", "  ", "\n", "\t", "'s", "'LL", "12", "é", "中", "<|endoftext|>", "<|", ".", "!!", "\xa0", "’", "İ", "²", "́", "🙂", "\x1c", "ñ", "Σ", "ß", "ǅ", "word", "\0"]


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    rng = random.Random(2)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(0, 15))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(PATH).encode(texts)] == library(texts)


def test_small_tables_are_emptied(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    texts = [" ".join(f"w{i * j}" for j in range(20)) for i in range(40)] + ["it's a don't"] * 3
    encoder = ChunkEncoder(PATH)
    got = [encoder.encode(texts[i : i + 5]) for i in range(0, len(texts), 5)]
    assert [np.frombuffer(x, "<u4").tolist() for part in got for x in part] == library(texts)


def test_cuts_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        nodes = np.concatenate([[0], np.cumsum(rng.integers(1, 9, n))])
        pen = rng.choice([0.0, 4.0, 24.0], n + 1)
        cost = [0.0]
        for j in range(1, n + 1):
            cost.append(min(cost[i] + 20 - (nodes[j] - nodes[i]) + pen[j] for i in range(j) if nodes[j] - nodes[i] <= 20))
        cuts = choose_cuts(nodes, pen, 20)
        assert cuts[0] == 0 and all(0 < b - a <= 20 for a, b in zip(cuts, cuts[1:])) and cuts[-1] > nodes[-1] - 20
        where = {int(p): k for k, p in enumerate(nodes)}
        assert sum(20 - (b - a) + pen[where[b]] for a, b in zip(cuts, cuts[1:])) == pytest.approx(cost[where[cuts[-1]]])


def test_nodes_prefer_document_ends():
    nodes, pen = cut_nodes(200, np.array([70, 200]), np.array([65, 90]))
    assert nodes.tolist() == [0, 32, 70, 96, 128, 160, 192, 200] or 70 in nodes and 65 not in nodes
    assert pen[nodes.tolist().index(70)] == 0


def check(rows, docs, size=2048):
    want = {}
    for (i, t), ids in zip(docs, library([t or "" for _, t in docs])):
        want.setdefault(i, []).append([*ids, 1])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for i, lists in want.items():
        if len(lists) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(lists[0])
                assert r.ids_crc32 == zlib.crc32(np.array(lists[0][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(lists[0])
        assert sum(r.length for r in by_doc[i]) == sum(map(len, lists))
    padding = total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(total, 1)


def test_table_is_packed_whole(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert check(pack(df.repartition(3), PATH).collect(), docs) < 0.02


def test_blocks_carry_over(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 3000)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    encoder = ChunkEncoder(PATH)
    packer = packing.Packer(encoder, 512, 1, 0, False)
    rows = []
    from collections import namedtuple

    row = namedtuple("row", "doc_id start length ids_crc32 doc_tokens sequence_id offset")
    for i, t in docs:
        packer.add([i], [t])
        if packer.tokens > 3000:
            rows += packer.solve(False)
    rows += packer.solve(True)
    assert check([row(*r) for r in rows], docs, 512) < 0.05


def test_nulls_empty_repeats_and_ids(spark):
    docs = [(1, None), (2, ""), (3, "a b."), (3, "a b."), (4, "x " * 9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = pack(df.coalesce(1), PATH, ids=True).collect()
    check(got, docs)
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert pack(df.limit(0), PATH).count() == 0


def test_words_of_weak_hashes_differ(monkeypatch):
    bits = [i.bit_count() & 1 for i in range(2048)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits), "a bc a"]
    assert [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(PATH).encode(texts)] == library(texts)
    # pre-tokens that share a hash fall back to whole chunks
    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    texts = ["one two six ten", "abc abd xyz", "longer wordss letter"]
    encoder = ChunkEncoder(PATH)
    for own in texts:
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([own])] == library([own])
