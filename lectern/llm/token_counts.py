"""Token counts by rank-synchronous merging of batched pre-tokens.

A batch of distinct pre-tokens is held as one ragged numpy array of byte
symbols. In every round each sequence finds its lowest-rank adjacent pair
and merges all its occurrences at once (left to right where they overlap);
a pair made by a merge always has a later rank, so this equals merging one
pair at a time. Sequences without a mergeable pair leave the array and
their surviving symbols are their token count.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated
rows are counted row by row; columns besides the id and the text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.common import slices, texts

#: Entries a worker keeps in its chunk cache before it starts anew; bounds memory, not results.
CACHE_ENTRIES = 400_000
NO_RANK = np.int32(2**31 - 1)
#: Sequences of more symbols are merged over an index of their pairs.
LONG = 2_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Ranks and products of symbol pairs in an open-addressed table that numpy probes for whole arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, products: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_RANK, np.int32)
        self.products = np.zeros(size, np.int32)
        todo, slot = np.arange(len(pairs)), self._home(pairs)
        while len(todo):
            slot_now = slot[todo]
            free = self.keys[slot_now] < 0
            taken, first = np.unique(slot_now[free], return_index=True)
            win = todo[free][first]
            self.keys[taken], self.ranks[taken], self.products[taken] = pairs[win], ranks[win], products[win]
            todo = np.setdiff1d(todo, win, assume_unique=True)
            slot[todo] = np.where(self.keys[slot[todo]] >= 0, (slot[todo] + 1) & (size - 1), slot[todo])

    def _home(self, pairs: np.ndarray) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Slot of every pair, -1 where it has no merge."""
        slot = self._home(pairs)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != pairs) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found[open_] = self.keys[slot[open_]]
            open_ = open_[(found[open_] != pairs[open_]) & (found[open_] >= 0)]
        return np.where(found == pairs, slot, -1)


class RankMerger:
    """Byte-level merge vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte_symbol = np.zeros(256, np.int32)
        for char, byte in byte_alphabet().items():
            self.byte_symbol[byte] = vocab[char]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.table = PairTable(left << 20 | right, np.arange(len(merges), dtype=np.int32), np.array([vocab[a + b] for a, b in merges], np.int32))
        special = sorted((a["content"] for a in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_texts = tuple(special)
        self.pattern = regex.compile(pattern)
        self.loose_space = re.compile(r" (?:(?=\s)|(?<=\s ))")
        self.cache: dict[str, int] = {}

    def merged_lengths(self, words: list[str]) -> np.ndarray:
        """Number of symbols that survive in every pre-token."""
        data = [w.encode() for w in words]
        length = np.fromiter(map(len, data), np.int64, len(data))
        symbols = self.byte_symbol[np.frombuffer(b"".join(data), np.uint8)]
        out = length.copy()
        ends = np.cumsum(length)
        for k in np.flatnonzero(length > LONG):
            out[k] = self._long(symbols[ends[k] - length[k] : ends[k]])
        batched = (length > 1) & (length <= LONG)
        owner = np.flatnonzero(batched)
        keep = np.repeat(batched, length)
        symbols, length = symbols[keep], length[owner]
        while len(owner):
            starts = np.cumsum(length) - length
            last = np.zeros(len(symbols), bool)
            last[starts + length - 1] = True
            pairs = symbols.astype(np.int64) << 20
            pairs[:-1] |= symbols[1:]
            slot = self.table.find(pairs)
            rank = np.where((slot >= 0) & ~last, self.table.ranks[slot], NO_RANK)
            lowest = np.minimum.reduceat(rank, starts)
            seq = np.repeat(np.arange(len(owner)), length)
            hit = (rank == lowest[seq]) & (rank != NO_RANK)
            at = np.flatnonzero(hit)
            # where occurrences overlap (a run of one symbol) every second one merges, from the left
            run = np.concatenate(([True], np.diff(at) != 1)) if len(at) else np.zeros(0, bool)
            run_start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbols[at] = self.table.products[slot[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            length = length - np.bincount(seq[at], minlength=len(owner))
            symbols, seq = symbols[stays], seq[stays]
            done = (lowest == NO_RANK) | (length == 1)
            out[owner[done]] = length[done]
            symbols, owner, length = symbols[~done[seq]], owner[~done], length[~done]
        return out

    def _long(self, symbols: np.ndarray) -> int:
        """Number of symbols that survive in one long sequence."""
        pairs = symbols[:-1].astype(np.int64) << 20 | symbols[1:]
        slots = self.table.find(pairs)
        left, rank_of, product_of = symbols.tolist(), self.table.ranks, self.table.products
        after, before = list(range(1, len(left) + 1)), list(range(-1, len(left) - 1))
        at_rank: dict[int, list[int]] = {}
        pair_slot: dict[int, int] = dict(zip(pairs.tolist(), slots.tolist()))
        for i in np.flatnonzero(slots >= 0).tolist():
            at_rank.setdefault(int(rank_of[slots[i]]), []).append(i)
        ranks = list(at_rank)
        heapq.heapify(ranks)
        survive = len(left)

        def offer(i: int) -> None:
            j = after[i]
            if i < 0 or j >= len(left):
                return
            pair = left[i] << 20 | left[j]
            slot = pair_slot.get(pair)
            if slot is None:
                slot = pair_slot[pair] = int(self.table.find(np.array([pair], np.int64))[0])
            if slot >= 0:
                rank = int(rank_of[slot])
                if rank not in at_rank:
                    at_rank[rank] = []
                    heapq.heappush(ranks, rank)
                at_rank[rank].append(i)

        while ranks:
            rank = heapq.heappop(ranks)
            # all occurrences at once, from the left where they overlap
            for i in sorted(at_rank.pop(rank)):
                j = after[i]
                if left[i] < 0 or j >= len(left):
                    continue
                slot = pair_slot.get(left[i] << 20 | left[j], -1)
                if slot < 0 or rank_of[slot] != rank:
                    continue
                left[i], left[j] = int(product_of[slot]), -1
                after[i] = after[j]
                if after[i] < len(left):
                    before[after[i]] = i
                survive -= 1
                if before[i] >= 0:
                    offer(before[i])
                offer(i)
        return survive

    def _pieces(self, text: str) -> tuple[str, list[str]]:
        """A head and the rest cut at single spaces between other characters; such cuts are always pre-token bounds."""
        if text[0] == " " or text[-1] == " " or self.loose_space.search(text):
            head, *rest = regex.split(r"(?<=\S) (?=\S)", text)
        else:
            head, *rest = text.split(" ")
        return head, rest

    def _pre_tokens(self, piece: str) -> list[str]:
        """Pre-tokens of a piece that follows a single space; one of letters alone, or with a closing mark, needs no pattern."""
        if piece.isalpha():
            return [" " + piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        return self.pattern.findall(" " + piece)

    def count(self, batch: list[str]) -> list[int]:
        """Token counts of whole texts."""
        split = []
        for text in batch:
            parts = self.special.split(text) if self.special and any(s in text for s in self.special_texts) else [text]
            split.append((len(parts) - 1, [self._pieces(p) for p in parts if p]))
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cache = self.cache
        fresh = list(set().union(*(rest for _, parts in split for _, rest in parts)).difference(cache))
        heads = [head for _, parts in split for head, _ in parts]
        found = [*map(self._pre_tokens, fresh), *map(self.pattern.findall, heads)]
        distinct = list(set().union(*found))
        sizes = dict(zip(distinct, self.merged_lengths(distinct).tolist())) if distinct else {}
        counts = [sum(map(sizes.__getitem__, words)) for words in found]
        cache.update(zip(fresh, counts))
        head_counts = iter(counts[len(fresh) :])
        get = cache.__getitem__
        return [n + sum(next(head_counts) + sum(map(get, rest)) for _, rest in parts) for n, parts in split]


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text, under the byte-level vocabulary file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = RankMerger(vocabulary, pattern)
        for batch in slices(batches):
            whole = texts(batch)
            n = merger.count(whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in whole], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
