"""Byte-pair encoding by rank-synchronous merging of ragged numpy arrays.

All pre-tokens of a batch lie in one flat symbol array.  A round looks up the
rank of every adjacent pair, takes each sequence's lowest rank, merges all its
pairs of that rank at once and drops sequences that have none left.  A merge of
a pair only creates pairs of higher rank, so this equals merging one by one.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.iinfo(np.int32).max


def byte_names() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    moved = iter(range(256, 512))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] positions, then those of the next run."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


class MergeTable:
    """Merge rules of a tokenizers JSON file with a byte-level BPE model.

    ``first`` gives the symbol of each byte, ``last`` that of a pre-token's last
    byte (the same unless the vocabulary marks word ends).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[c] for c in byte_names()], np.int32)
        self.last = np.array([vocab[c + end] for c in byte_names()], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # open addressing, at most a quarter full: a key lies at most self.reach slots after its home
        self.bits = max(19, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        tail = 1024
        self.keys, self.rank, self.made = np.full(size + tail, -1, np.int64), np.full(size + tail, NONE, np.int32), np.zeros(size + tail, np.int32)
        home, self.reach = self._home(keys), 0
        for rank, (k, h) in enumerate(zip(keys.astype(np.int64), home.tolist())):
            at = h
            while self.keys[at] != -1:
                if self.keys[at] == k:
                    break
                at += 1
            if self.keys[at] == -1:
                self.keys[at], self.rank[at], self.made[at] = k, rank, made[rank]
                self.reach = max(self.reach, at - h)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table slot of each pair, or an empty slot."""
        keys = left.astype(np.int64) << 32 | right
        at = self._home(keys.view(np.uint64))
        found = self.keys[at]
        odd = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.reach):
            if not len(odd):
                break
            at[odd] += 1
            found = self.keys[at[odd]]
            odd = odd[(found != keys[odd]) & (found != -1)]
        if len(odd):
            at[odd] = len(self.keys) - 1
        return at

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the symbols of word i are ids[offsets[i]:offsets[i + 1]]."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        return self.encode_runs(np.frombuffer(b"".join(words), np.uint8), ends)

    def encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, of the words data[starts[i]:ends[i]]."""
        return self.encode_runs(data[ragged(starts, ends - starts)], np.cumsum(ends - starts))

    def encode_runs(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, of words that lie end to end in raw."""
        words = ends
        sizes = np.diff(ends, prepend=0)
        sym = self.first[raw]
        full = sizes > 0
        sym[ends[full] - 1] = self.last[raw[ends[full] - 1]]
        seq = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        done_sym, done_seq = [], []
        rank = made = None
        while len(sym):
            inside = np.zeros(len(sym), bool)
            np.equal(seq[1:], seq[:-1], out=inside[:-1])
            if rank is None:
                rank, made = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
                renew = np.flatnonzero(inside)
            else:
                rank[~inside] = NONE
                renew = renew[inside[renew]]
            if len(renew):
                at = self._slots(sym[renew], sym[renew + 1])
                rank[renew], made[renew] = self.rank[at], self.made[at]
            starts = np.flatnonzero(np.concatenate([[True], ~inside[:-1]]))
            low = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(sym)))
            ready = np.repeat(low, counts)
            over = ready == NONE
            merge = (rank == ready) & ~over
            hits = np.flatnonzero(merge)
            if len(hits):
                # of a run of overlapping pairs (aaa) every second one merges, from the left
                near = np.flatnonzero(hits[1:] == hits[:-1] + 1)
                if len(near):
                    fresh = np.concatenate([[True], hits[1:] != hits[:-1] + 1])
                    run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
                    hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
                sym[hits] = made[hits]
            keep = ~over
            keep[hits + 1] = False
            if over.any():
                done_sym.append(sym[over])
                done_seq.append(seq[over])
            # pairs that touch a new symbol are looked up again
            moved = np.cumsum(keep) - 1
            touched = np.zeros(int(keep.sum()) + 1, bool)
            touched[moved[hits]] = True
            before = moved[hits] - 1
            touched[before[before >= 0]] = True
            sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
            renew = np.flatnonzero(touched[: len(sym)])
            renew = renew[renew < len(sym) - 1]
            if len(sym):
                rank[-1] = NONE
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym, seq = np.concatenate(done_sym), np.concatenate(done_seq)
        order = np.argsort(seq, kind="stable")
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=len(words)), out=offsets[1:])
        return sym[order], offsets
