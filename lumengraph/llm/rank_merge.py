"""Byte-pair merging over ragged numpy arrays.

All pre-tokens of a batch lie in one flat symbol array. Each round finds every sequence's lowest-rank pair and
merges all its occurrences, left to right without overlap, in all sequences at once. A pair that holds a merged
symbol always ranks after the pair that made the symbol (checked when a file is read), so this gives what merging one
pair at a time gives.
"""

from __future__ import annotations

import json

import numpy as np

NO_RANK = np.iinfo(np.int32).max
_SLOT_BITS = 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter of each byte: itself where printable in Latin-1, else the next from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankMerger:
    """Counts the tokens that a byte-level BPE tokenizer file gives."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        if len(vocab) > 1 << 16:
            raise ValueError("vocabularies above 65536 entries need wider pair keys")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that change their surroundings aren't supported")
        letters = byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if len(set(made.tolist())) != len(made) or len(np.unique(keys)) != len(keys):
            raise ValueError("a symbol made by two merges needs merging one pair at a time")
        born = np.full(1 << 16, -1)
        born[made] = np.arange(len(made))
        if (np.maximum(born[(keys >> np.uint64(16)).astype(np.int64)], born[(keys & np.uint64(0xFFFF)).astype(np.int64)]) >= np.arange(len(keys))).any():
            raise ValueError("a pair that ranks before one of its symbols is made needs merging one pair at a time")
        self.keys, self.made = keys, np.append(made, 0)
        order = np.argsort(keys)
        self.sorted_keys, self.sorted_ranks = keys[order], order.astype(np.int32)
        slot = self._slot(keys)
        self.table = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.table[slot] = np.arange(len(keys), dtype=np.int32)
        self.shared = np.bincount(slot, minlength=1 << _SLOT_BITS) > 1

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NO_RANK if it doesn't merge."""
        keys = left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)
        slot = self._slot(keys)
        at = self.table[slot]
        hit = (at >= 0) & (self.keys[at] == keys)
        out = np.where(hit, at, NO_RANK).astype(np.int32)
        again = np.flatnonzero(~hit & self.shared[slot])
        if len(again):
            k = keys[again]
            i = np.minimum(np.searchsorted(self.sorted_keys, k), len(self.sorted_keys) - 1)
            out[again] = np.where(self.sorted_keys[i] == k, self.sorted_ranks[i], NO_RANK)
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word; an empty word has none."""
        counts = np.zeros(len(words), np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.flatnonzero(lens)
        lens = lens[ids]
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        if not len(sym):
            return counts
        last = np.zeros(len(sym), bool)
        last[np.cumsum(lens) - 1] = True
        rank = np.full(len(sym), NO_RANK, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(ids):
            starts = np.cumsum(lens) - lens
            best = np.minimum.reduceat(rank, starts)
            open_ = best != NO_RANK
            if not open_.all():
                counts[ids[~open_]] = lens[~open_]
                keep = np.repeat(open_, lens)
                sym, rank, last = sym[keep], rank[keep], last[keep]
                ids, lens, best = ids[open_], lens[open_], best[open_]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lens))
            new_run = np.append(True, np.diff(at) != 1)
            run_start = at[np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))]
            at = at[(at - run_start) % 2 == 0]
            sym[at] = self.made[rank[at]]
            last[at] |= last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            seq = np.searchsorted(np.cumsum(lens), at, side="right")
            lens = lens - np.bincount(seq, minlength=len(lens))
            moved = at - np.arange(len(at))
            sym, rank, last = sym[keep], rank[keep], last[keep]
            rank[moved] = NO_RANK
            inner = moved[~last[moved]]
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
            before = moved[moved > 0] - 1
            before = before[~last[before]]
            rank[before] = self.ranks(sym[before], sym[before + 1])
        return counts
