"""Benchmark decontamination by edit distance over words.

An item is a window of its words, or, if it has more than PART, several of equal size: of a passage within the budget
one lies within its share of the edits. Windows of the same sizes of the texts, and those of the items, go through a CGK
random walk: reading a word, the walk stays or moves on by a random bit of the word and the step, so that after an edit
two walks soon meet again and few edits become few differing places. Tables that each sample some places of a walk
propose (text, item, place); a bound on the words in common and the edit distance decide. Every window of a text is
walked but those with more words that no item has than edits are allowed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, text_slices

#: Walks, tables of each, and places that a table samples; with these, the tables' recall of passages at the very budget
#: of a fifth is above 0.98. Words of an item's part at most (half the bits of a step), and the share of a walk's steps
#: that places are sampled from: later ones lie past a window's end.
WALKS, TABLES, PLACES, PART, DEPTH = 3, 8, 2, 32, 0.9
#: Text bytes of the items that are matched in one pass over the documents; more items take more passes.
ITEM_BYTES = 8 << 20
#: Words of a text that are looked at together; blocks overlap by more than the passages.
WORD_BLOCK = 1 << 16
#: Bits of the filters in front of a table, and of the one of items' words.
FILTER_BITS, BAG_BITS = 16, 22
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def budget_of(size: int, similarity: float) -> int:
    return int((1 - similarity) * size + 1e-9)


def edit_distance(item: dict[int, int], size: int, words: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to a run of `words`, and where that run ends. item: each word's places as bits.
    Bit-parallel (Myers 1999)."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best = (size, 0)
    for k, w in enumerate(words):
        eq = item.get(w, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        hp, hn = down | (full & ~(d0 | up)), up & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1) & full, (hn << 1) & full
        up, down = hn | (full & ~(d0 | hp)), hp & d0
        if score < best[0]:
            best = (score, k + 1)
    return best


class Items:
    """Items prepared for matching: word ids, parts by size, tables. A long item costs its own size."""

    def __init__(self, rows: list[tuple], similarity: float, walks: int = WALKS, tables: int = TABLES, places: int = PLACES, seed: int = 11):
        self.rows = [(key, w) for key, w in ((k, words_of(t)) for k, t in rows) if w]
        self.ids: dict[str, int] = {}
        for _, ws in self.rows:
            for w in ws:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.words = [np.array([self.ids[w] for w in ws], np.int64) for _, ws in self.rows]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.budgets = np.array([budget_of(int(n), similarity) for n in self.sizes], np.int64)
        self.widest = int((self.sizes + self.budgets).max(initial=0))
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 2**63, (walks, tables, places), np.uint64) * np.uint64(2) + np.uint64(1)
        #: A bit for each word, walk and step; no word has the number 0.
        self.coins = rng.integers(0, 2**64 - 1, (walks, len(self.ids) + 1), np.uint64, endpoint=True)
        self.sample = rng.random((walks, tables, places))
        self.bag = np.zeros(1 << BAG_BITS, bool)
        for i, ws in enumerate(self.words):
            self.bag[self._bag_slots(np.full(len(ws), i), ws)] = True
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for i, (n, b) in enumerate(zip(self.sizes.tolist(), self.budgets.tolist(), strict=True)):
            k = -(-n // PART)
            size = n // k
            parts.setdefault(size, []).extend((i, j * (n - size) // max(1, k - 1), b // k) for j in range(k))
        self.parts = {size: self._tables(size, own) for size, own in sorted(parts.items())}
        self.bits: dict[int, dict[int, int]] = {}

    @staticmethod
    def _bag_slots(item: np.ndarray, words: np.ndarray) -> np.ndarray:
        h = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + item.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) >> np.uint64(64 - BAG_BITS)).astype(np.int64)

    def _tables(self, size: int, own: list[tuple[int, int, int]]):
        """(edits allowed, and of each walk and table: the filter, sorted keys, and their parts as (item, offset))."""
        item, offset, edits = (np.array(x, np.int64) for x in zip(*own, strict=True))
        flat = np.concatenate([np.concatenate([self.words[i][o : o + size], [0]]) for i, o, _ in own])
        starts = np.arange(len(own)) * (size + 1)
        out = []
        for keys in self.walks(flat, starts, size, starts + size):
            good = np.flatnonzero(keys)
            good = good[np.argsort(keys[good], kind="stable")]
            there = np.zeros(1 << FILTER_BITS, bool)
            there[(keys[good] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            out.append((there, keys[good], item[good], offset[good]))
        return int(edits.max()), out

    def walks(self, ids: np.ndarray, starts: np.ndarray, size: int, ends: np.ndarray | None = None):
        """For each walk and table a key of each window: the words at the sampled places, 0 if one of them has no number.
        Walks read on past a window's end, by its size at most, or stay at `ends`."""
        steps = np.minimum((self.sample * 2 * size * DEPTH).astype(np.int64), 2 * size - 1)
        for coins, places, odds in zip(self.coins, steps, self.odd, strict=True):
            toss, at, seen = coins[ids], starts.copy(), {}
            wanted = set(places.ravel().tolist())
            for j in range(max(wanted) + 1):
                if j in wanted:
                    seen[j] = ids[at].astype(np.uint64)
                at += ((toss[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
                if ends is not None:
                    np.minimum(at, ends, out=at)
            for own, odd in zip(places.tolist(), odds, strict=True):
                key, good = np.full(len(starts), size, np.uint64), np.ones(len(starts), bool)
                for j, o in zip(own, odd, strict=True):
                    good &= seen[j] > 0
                    key = (key ^ seen[j]) * o
                    key ^= key >> np.uint64(31)
                yield np.where(good, key * odd[0], np.uint64(0))

    def propose(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) that some table proposes; a start may lie before or after the passage by the edits."""
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        items, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size, (edits, tables) in self.parts.items():
            starts = np.flatnonzero(known[size : len(ids) - PART] - known[: len(ids) - PART - size] >= size - edits)
            for k in range(0, len(starts), 1 << 16):
                own = starts[k : k + (1 << 16)]
                for key, (there, keys, item, offset) in zip(self.walks(ids, own, size), tables, strict=True):
                    at = np.flatnonzero(there[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] & (key > 0))
                    lo = np.searchsorted(keys, key[at])
                    n = np.searchsorted(keys, key[at], side="right") - lo
                    which = np.repeat(np.arange(len(at)), n)
                    hit = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
                    items.append(item[hit])
                    places.append(own[at[which]] - offset[hit])
        return np.concatenate(items), np.concatenate(places)

    def match(self, texts: list[list[str]]) -> list[dict[int, tuple[int, int]]]:
        """For each text's words, {item's number: (least distance, first word)}."""
        get = self.ids.get
        sizes = np.array([len(ws) + 1 for ws in texts], np.int64)
        ends = np.cumsum(sizes) - 1  # a zero ends each text
        starts = ends + 1 - sizes
        ids = np.zeros(int(sizes.sum()) + 2 * PART, np.int64)
        for ws, s, e in zip(texts, starts.tolist(), ends.tolist(), strict=True):
            ids[s:e] = [get(w, 0) for w in ws]
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        item, place = self.propose(ids)
        if not len(item):
            return out
        text = np.searchsorted(ends, np.clip(place, 0, ends[-1]))
        # Places of one text and item that lie within its budget of each other are one range.
        order = np.lexsort((place, item, text))
        item, place, text = item[order], place[order], text[order]
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (place[1:] - place[:-1] > self.budgets[item[1:]] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(item)]]) - 1
        low, high, item, text = place[first], place[last], item[first], text[first]
        low = np.maximum(starts[text], low - self.budgets[item])
        high = np.minimum(ends[text], high + self.sizes[item] + self.budgets[item])
        fits = self._share_words(ids, low, high, item) >= self.sizes[item] - self.budgets[item]
        for t, i, lo, hi in zip(*(x[fits].tolist() for x in (text, item, low, high)), strict=True):
            n, b = int(self.sizes[i]), int(self.budgets[i])
            d, end = edit_distance(self._bits(i), n, ids[lo:hi].tolist())
            if d <= b:
                found = (d, max(0, lo + end - n - int(starts[t])))
                out[t][i] = min(out[t].get(i, found), found)
        return out

    def _share_words(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """At least as many words of each range as the item has, too."""
        out = np.zeros(len(low), np.int64)
        width = np.maximum(high - low, 0)
        cut = np.cumsum(width)
        at = 0
        while at < len(low):
            end = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + (1 << 20), side="right")))
            n = width[at:end]
            which = np.repeat(np.arange(at, end), n)
            words = ids[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]]
            out[at:end] = np.bincount(which[self.bag[self._bag_slots(item[which], words)] & (words > 0)] - at, minlength=end - at)
            at = end
        return out

    def _bits(self, i: int) -> dict[int, int]:
        """Each word's places in an item as bits."""
        if i not in self.bits:
            own: dict[int, int] = {}
            for k, w in enumerate(self.words[i].tolist()):
                own[w] = own.get(w, 0) | 1 << k
            self.bits[i] = own
        return self.bits[i]


def word_blocks(text: str, overlap: int, block: int = WORD_BLOCK):
    """(number of the first word, words): a long text's words in blocks that overlap."""
    if len(text) <= 4 * block:
        yield 0, words_of(text)
        return
    held, first = [], 0
    for m in _WORD.finditer(text):
        held.append(m[0].lower())
        if len(held) == block + overlap:
            yield first, held
            held, first = held[block:], first + block
    yield first, held


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(id, text_key, item, distance, similarity, first_word): each item that a text holds within the edit budget, the
    distance being in words, lower-cased, without punctuation, at most (1 - similarity) of the item's. One row for each
    row of docs and item, with the least distance; text_key is the text's xxhash64.

    Null, empty and wordless texts and items match nothing. Repeated rows and items each get their rows; null ids stay;
    extra columns are ignored; empty tables give an empty result. Whole texts are read, in overlapping blocks of words
    if long. Items are collected item_bytes of text at a time, a pass over the documents for each."""
    bounded_batches(docs.sparkSession)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    wanted = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // item_bytes) or 1

    item_kind = to_arrow_type(items.schema[item_col].dataType)

    def one(known: list[tuple]):
        shared = docs.sparkSession.sparkContext.broadcast(known)  # at most about item_bytes of text

        def run(batches):
            ready = Items(shared.value, similarity)
            overlap = 2 * ready.widest + PART + 2
            names = ["id", "text_key", "item", "distance", "similarity", "first_word"]
            for batch in batches:
                for part in text_slices(batch, "text"):
                    blocks = [(k, first, ws) for k, t in enumerate(part.column("text").to_pylist()) for first, ws in word_blocks(t or "", overlap)]
                    best: dict[tuple[int, int], tuple[int, int]] = {}
                    for (k, first, _), found in zip(blocks, ready.match([ws for _, _, ws in blocks]), strict=True):
                        for i, (d, at) in found.items():
                            best[k, i] = min(best.get((k, i), (d, first + at)), (d, first + at))
                    out = [(k, ready.rows[i][0], d, 1 - d / int(ready.sizes[i]), at) for (k, i), (d, at) in sorted(best.items())]
                    if out:
                        where, item, d, s, at = zip(*out, strict=True)
                        where = pa.array(where, pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id").take(where), part.column("text_key").take(where), pa.array(item, item_kind), pa.array(d, pa.int32()), pa.array(s, pa.float64()), pa.array(at, pa.int64())], names
                        )

        return rows.mapInArrow(run, f"id {id_type}, text_key long, item {item_type}, distance int, similarity double, first_word long")

    out = None
    for k in range(passes):
        mine = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        found = one([tuple(r) for r in mine.orderBy("item", "text").collect()])
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})
