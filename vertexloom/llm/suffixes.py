"""Suffix-array dedup: a distributed merge sort of front-coded suffix runs.

Every window of `length` bytes is held by one anchor: the place in it whose k-byte hash is least, the leftmost if tied.
Equal windows have their anchors at the same offset, so only suffixes that start at anchors need to be sorted (about
one in 85), and only those whose k bytes start an anchor elsewhere, too. Each task sorts its suffixes into runs, one
for each range of anchor hashes, and front-codes them; a loser tree that carries the common prefixes merges the runs of
a range. The common prefixes of neighbours in the merged order, with what stands left of the anchors, tell which windows
occur more than once.

Suffixes of an anchor that very many texts have would all meet in one range. They are dealt by more of what their windows
hold: for a span of the windows' offsets, the bytes that all of them cover. Where that still brings too many different
suffixes together, the span is cut into four. Suffixes with the same surroundings count as one that is there twice.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, shuffle_partitions, staged, text_slices

LENGTH = 200
#: Bytes that an anchor's hash covers (a power of two).
GRAM = 32
#: A longer text is cut, windows overlapping, so that offsets fit 24 bits.
PIECE = 1 << 20
#: Suffixes in a task's runs, and in one range of hashes on average.
RUN_SIZE, RANGE_SIZE = 1 << 16, 1 << 15
#: Suffixes of one anchor beyond which they are dealt by more than the anchor, and that any finer group may have: as many
#: as a usual range.
HOT = RANGE_SIZE
#: Rows, of some 60 bytes, of surroundings that over HOT suffixes have, up to which they are broadcast.
BROADCAST_ROWS = 1 << 17
#: Of a run's suffix: text key, anchor, largest and smallest offset of a window, bytes kept right and left.
ENTRY = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("at", "<i8"), ("far", "<u2"), ("near", "<u2"), ("right", "<u2"), ("left", "<u2"), ("lcp", "<u2"), ("lcs", "<u2")])

_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, np.uint64)
_ODD = np.random.Generator(np.random.PCG64(8)).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each place on."""
    h, size, level = _BYTES[data], 1, 0
    while size < gram:
        h = h[:-size] * _ODD[level] + h[size:]
        h ^= h >> np.uint64(29)
        size, level = 2 * size, level + 1
    return h * _ODD[level]


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text's index, anchor, first window, last window, hash) of each run of windows with one anchor; places are in
    the text."""
    out = []
    for first, piece, shift in _pieces(texts, length):
        data = np.frombuffer(b"".join(piece), np.uint8)
        if len(data) < length:
            continue
        hashes = gram_hashes(data, gram)
        low = np.uint64((1 << 24) - 1)
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        at = (window_least(ranked, length - gram + 1) & low).astype(np.int64)
        sizes = np.array([len(x) for x in piece])
        ends = np.cumsum(sizes)
        counts = np.maximum(sizes - length + 1, 0)
        own = np.repeat(np.arange(len(piece)), counts)
        starts = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + (ends - sizes)[own]
        at = at[starts]
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))
        last = np.concatenate([new[1:] - 1, [len(at) - 1]])
        base = (ends - sizes)[own[new]] - shift
        out.append((own[new] + first, at[new] - base, starts[new] - base, starts[last] - base, hashes[at[new]]))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pieces(texts: list[bytes], length: int):
    """(index of the first text, texts, how far into that text they begin), each of about PIECE bytes."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        if len(text) > PIECE:
            if held:
                yield first, held, 0
            for k in range(0, len(text) - length + 1, PIECE):
                yield i, [text[k : k + PIECE + length - 1]], k
            held, size, first = [], 0, i + 1
            continue
        if size + len(text) > PIECE:
            yield first, held, 0
            held, size, first = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield first, held, 0


def text_keys(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), np.int64).reshape(-1, 2)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(h, k1, at): the anchors of each text; copies within a task count once."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = list(dict.fromkeys(_texts(part)))
                keys = text_keys(texts)
                new = [i for i, k in enumerate(keys) if k.tobytes() not in seen]
                seen.update(keys[i].tobytes() for i in new)
                if len(seen) > 1 << 18:
                    seen.clear()
                own, at, _, _, h = anchors([texts[i] for i in new], length)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[new][own, 0]), pa.array(at)], ["h", "k1", "at"])

    return docs.select("text").mapInArrow(run, "h long, k1 long, at long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, n_bytes, kept): each row's text key, size and digest."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = _texts(part)
                keys = text_keys(texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])], ["id", "k1", "k2", "n_bytes", "whole"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, k1 long, k2 long, n_bytes long, whole string")


def packed(docs: DataFrame) -> DataFrame:
    """(k1, k2, z, size): the different texts, compressed, for the one shuffle that they take part in, and their bytes."""

    def run(batches):
        seen: set[bytes] = set()
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = list(dict.fromkeys(_texts(part)))
                keys = text_keys(texts)
                new = [i for i, k in enumerate(keys) if k.tobytes() not in seen]
                seen.update(keys[i].tobytes() for i in new)
                if len(seen) > 1 << 18:
                    seen.clear()
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[new, 0]), pa.array(keys[new, 1]), pa.array([press.compress(texts[i]) for i in new], pa.binary()), pa.array([len(texts[i]) for i in new], pa.int64())], ["k1", "k2", "z", "size"])

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, z binary, size long")


def common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    end = min(len(x), len(y))
    if x[known:end] == y[known:end]:
        return end
    low, high = known, end
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def front_code(texts: list[bytes]) -> tuple[list[int], bytes]:
    """Of each text, the bytes it shares with the one before it, and all that they don't share."""
    before, shared, tails = b"", [], []
    for text in texts:
        n = common(before, text, 0)
        shared.append(n)
        tails.append(text[n:])
        before = text
    return shared, b"".join(tails)


def front_decode(shared: np.ndarray, sizes: np.ndarray, tails: bytes) -> list[bytes]:
    before, at, out = b"", 0, []
    for n, size in zip(shared.tolist(), sizes.tolist(), strict=True):
        before = before[:n] + tails[at : at + size - n]
        at += size - n
        out.append(before)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]):
    """Merges sorted runs, each with its common prefixes of neighbours, by a loser tree. Yields (run, index, common
    prefix with what came before). Contenders know what they share with the last winner: if that differs, the longer
    one wins unseen; else bytes are read from there on only."""
    width = 1
    while width < max(1, len(runs)):
        width *= 2
    at = [0] * len(runs)
    losers: list[tuple[int, int]] = [(-1, -1)] * width  # (run, common prefix with the winner there); run -1: used up

    def play(x, y):
        if x[0] < 0:
            return y, x
        if y[0] < 0:
            return x, y
        if x[1] != y[1]:
            return (x, y) if x[1] > y[1] else (y, x)
        p, q = runs[x[0]][0][at[x[0]]], runs[y[0]][0][at[y[0]]]
        n = common(p, q, x[1])
        if p[n : n + 1] <= q[n : n + 1]:
            return x, (y[0], n)
        return y, (x[0], n)

    field = [(i, 0) if i < len(runs) and runs[i][0] else (-1, -1) for i in range(width)]
    level = field
    size = width
    while size > 1:
        size //= 2
        nxt = []
        for i in range(size):
            win, losers[size + i] = play(level[2 * i], level[2 * i + 1])
            nxt.append(win)
        level = nxt
    win = level[0]
    while win[0] >= 0:
        run = win[0]
        yield run, at[run], win[1]
        at[run] += 1
        win = (run, runs[run][1][at[run]]) if at[run] < len(runs[run][0]) else (-1, -1)
        node = (width + run) // 2
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2


RUNS = "range int, entries binary, rights binary, lefts binary"


def packed_runs(held: dict[int, list]):
    """Sorts and front-codes each range's (right, left, k1, k2, anchor, largest and smallest offset), and empties held."""
    rows = []
    for where, entries in held.items():
        entries.sort(key=lambda e: e[0])
        table = np.zeros(len(entries), ENTRY)
        for name, col in zip(("k1", "k2", "at", "far", "near"), zip(*(e[2:] for e in entries), strict=True), strict=True):
            table[name] = col
        table["lcp"], rights = front_code([e[0] for e in entries])
        table["lcs"], lefts = front_code([e[1] for e in entries])
        table["right"], table["left"] = [len(e[0]) for e in entries], [len(e[1]) for e in entries]
        rows.append((where, table.tobytes(), rights, lefts))
    held.clear()
    for k in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 256], strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["range", "entries", "rights", "lefts"])


def suffix_runs(candidates: DataFrame, length: int, ranges: int) -> DataFrame:
    """candidates (k1, k2, z, places) to front-coded runs: (range, entries, rights, lefts)."""

    def run(batches):
        held: dict[int, list] = {}
        n = 0
        unpack = zstandard.ZstdDecompressor()

        for batch in batches:
            for part in text_slices(batch, "size"):
                texts = [unpack.decompress(z) if z else b"" for z in part.column("z").to_pylist()]
                keys = np.stack([part.column(c).to_numpy() for c in ("k1", "k2")], 1).tolist()
                places = part.column("places").to_pylist()
                own, at, first, last, h = anchors(texts, length)
                wanted = [set(p) for p in places]
                range_of = (((h * _ODD[20]) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                for d, a, i, j, r in zip(own.tolist(), at.tolist(), first.tolist(), last.tolist(), range_of.tolist(), strict=True):
                    if a in wanted[d]:
                        text = texts[d]
                        held.setdefault(r, []).append((text[a : j + length], text[i:a][::-1], *keys[d], a, a - i, a - j))
                        n += 1
                if n >= RUN_SIZE:
                    yield from packed_runs(held)
                    n = 0
        yield from packed_runs(held)

    return candidates.mapInArrow(run, RUNS)


def hot_suffixes(candidates: DataFrame, length: int) -> DataFrame:
    """candidates (k1, k2, z, hot_places) to (h, k1, k2, at, lo, hi, left, right): the suffixes of hot anchors, with the
    smallest and largest offset of their windows, the bytes to the left in reverse."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in text_slices(batch, "size"):
                texts = [unpack.decompress(z) if z else b"" for z in part.column("z").to_pylist()]
                keys = np.stack([part.column(c).to_numpy() for c in ("k1", "k2")], 1).tolist()
                wanted = [set(p) for p in part.column("hot_places").to_pylist()]
                own, at, first, last, h = anchors(texts, length)
                rows = [(g, *keys[d], a, a - j, a - i, texts[d][i:a][::-1], texts[d][a : j + length]) for d, a, i, j, g in zip(own.tolist(), at.tolist(), first.tolist(), last.tolist(), h.view(np.int64).tolist(), strict=True) if a in wanted[d]]
                if rows:
                    kinds = [pa.int64()] * 6 + [pa.binary()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "k1", "k2", "at", "lo", "hi", "left", "right"])

    return candidates.mapInArrow(run, "h long, k1 long, k2 long, at long, lo long, hi long, left binary, right binary")


def deal_hot(suffixes: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans, rest): spans (k1, k2, lo, hi) of windows of suffixes whose surroundings others have, too; rest (key, k1, k2,
    at, lo, hi, left, right): of different surroundings one suffix, in groups of at most HOT that share what all windows
    of a span of offsets cover. Windows that are equal share it, and so stay together."""
    columns = ["key", "a", "b", "k1", "k2", "at", "lo", "hi", "left", "right"]
    now = staged(suffixes.select(F.col("h").alias("key"), F.lit(0).cast("long").alias("a"), F.lit(length - GRAM).cast("long").alias("b"), *columns[3:]), "hot")
    spans, rest = [], []
    while True:
        own = now.withColumns({"lo": F.greatest("lo", "a"), "hi": F.least("hi", "b")}).where("lo <= hi")
        own = own.withColumns({"left": F.substring("left", F.lit(1), F.col("hi").cast("int")), "right": F.substring("right", F.lit(1), (F.lit(length) - F.col("lo")).cast("int"))})
        own = own.withColumn("content", F.unhex(F.md5(F.concat("left", "right"))))
        same = ["key", "lo", "hi", "content"]
        kinds = staged(own.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one"), *(F.first(c).alias(c) for c in ("a", "b", "left", "right"))), "hot-kinds")
        # What very many have, at most a row for each HOT suffixes, is broadcast if it is small, so that it is no hot key;
        # beyond that, it is joined as skewed keys are. The rest has no hot keys.
        usual = kinds.where(F.col("n") > HOT).select(*same)
        usual = F.broadcast(usual) if usual.count() <= BROADCAST_ROWS else usual
        some = kinds.where((F.col("n") > 1) & (F.col("n") <= HOT)).select(*same)
        again = own.join(usual, same, "left_semi").unionByName(own.join(usual, same, "left_anti").join(some, same, "left_semi"))
        spans.append(again.select("k1", "k2", (F.col("at") - F.col("hi")).alias("lo"), (F.col("at") - F.col("lo") + length).alias("hi")))
        many = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        judged = kinds.join(many, "key").select("key", "a", "b", "one.*", "lo", "hi", "left", "right", "kinds")
        rest.append(judged.where(F.col("kinds") <= HOT).drop("a", "b", "kinds"))
        hot = judged.where(F.col("kinds") > HOT)
        if hot.isEmpty():
            break
        width = F.ceil((F.col("b") - F.col("a") + 1) / 4)
        first = F.explode(F.sequence("a", "b", width)).alias("x")
        parts = hot.select("*", first, width.alias("width")).withColumn("part", F.struct("x", F.least(F.col("b"), F.col("x") + F.col("width") - 1).alias("y"))).where("lo <= part.y and hi >= part.x")
        inside = F.xxhash64(F.substring("left", F.lit(1), F.col("part.x").cast("int")), F.substring("right", F.lit(1), (F.lit(length) - F.col("part.y")).cast("int")), "part.x")
        now = parts.select(inside.alias("key"), F.col("part.x").alias("a"), F.col("part.y").alias("b"), *columns[3:])
    return reduce(DataFrame.unionByName, spans), reduce(DataFrame.unionByName, rest)


def dealt_runs(rest: DataFrame, ranges: int) -> DataFrame:
    """Suffixes (key, k1, k2, at, lo, hi, left, right) to front-coded runs, ranges by the key."""

    def run(batches):
        held: dict[int, list] = {}
        n = 0
        for batch in batches:
            for part in text_slices(batch, "right", 1 << 22):
                for where, *entry in zip(*(part.column(c).to_pylist() for c in ("range", "right", "left", "k1", "k2", "at", "hi", "lo")), strict=True):
                    held.setdefault(where, []).append(tuple(entry))
                n += part.num_rows
                if n >= RUN_SIZE:
                    yield from packed_runs(held)
                    n = 0
        yield from packed_runs(held)

    return rest.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int")).mapInArrow(run, RUNS)


def repeated_windows(lcp: np.ndarray, rights: np.ndarray, lefts: list[bytes], far: np.ndarray, near: np.ndarray, length: int):
    """For suffixes in sorted order: (suffix, offset) of each window that some other window equals. Hashes bring windows
    together; their bytes are compared."""
    who, off = [], []
    hashes = np.zeros(len(lefts), np.uint64)  # of the last o bytes before the anchor
    sizes = np.array([len(x) for x in lefts])
    wide = int(sizes.max(initial=0))
    flat = np.zeros((len(lefts), wide), np.uint8)
    for i, x in enumerate(lefts):
        flat[i, : len(x)] = np.frombuffer(x, np.uint8)
    for o in range(wide + 1):
        if o:
            hashes = (hashes + _BYTES[flat[:, o - 1]]) * _ODD[3]
            hashes ^= hashes >> np.uint64(31)
        right = length - o
        ok = np.flatnonzero((near <= o) & (o <= far))
        if len(ok) < 2:
            continue
        same = np.cumsum(lcp < right).astype(np.uint64)[ok] * _ODD[5] ^ hashes[ok]
        order = np.argsort(same)
        s = same[order]
        eq = s[1:] == s[:-1]
        hit = np.zeros(len(ok), bool)
        a, b = order[1:][eq], order[:-1][eq]
        for k in range(0, len(a), 1 << 12):
            x, y = a[k : k + (1 << 12)], b[k : k + (1 << 12)]
            true = (flat[ok[x], :o] == flat[ok[y], :o]).all(1)
            hit[x[true]] = hit[y[true]] = True
        who.append(ok[hit])
        off.append(np.full(int(hit.sum()), o))
    return (np.concatenate(who), np.concatenate(off)) if who else (np.empty(0, np.int64), np.empty(0, np.int64))


def merge_range(table: pa.Table, length: int) -> pa.Table:
    """The runs of one range of hashes to (k1, k2, lo, hi): bytes of texts that repeated windows cover."""
    runs, entries, lefts = [], [], []
    for e, r, s in zip(*(table.column(c).to_pylist() for c in ("entries", "rights", "lefts")), strict=True):
        own = np.frombuffer(e, ENTRY)
        entries.append(own)
        runs.append((front_decode(own["lcp"], own["right"], r), own["lcp"].tolist()))
        lefts.append(front_decode(own["lcs"], own["left"], s))
    out: list[np.ndarray] = []

    def flush(held, lcps):
        rows = np.array([entries[r][i] for r, i in held], ENTRY)
        who, off = repeated_windows(np.array(lcps), rows["right"], [lefts[r][i] for r, i in held], rows["far"], rows["near"], length)
        order = np.lexsort((-off, who))
        who, start = who[order], rows["at"][who[order]] - off[order]
        new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)])) if len(who) else np.empty(0, np.int64)
        last = np.concatenate([new[1:] - 1, [len(who) - 1]])[: len(new)]
        out.append(np.stack([rows["k1"][who[new]], rows["k2"][who[new]], start[new], start[last] + length], 1))

    held, lcps = [], []
    for run, i, n in merge_runs(runs):
        if n < GRAM and len(held) >= 4096:  # no window spans suffixes that share less than their anchor's bytes
            flush(held, lcps)
            held, lcps = [], []
        held.append((run, i))
        lcps.append(n)
    if held:
        flush(held, lcps)
    rows = np.concatenate(out) if out else np.empty((0, 4), np.int64)
    return pa.table(dict(zip(("k1", "k2", "lo", "hi"), rows.T, strict=True)))


def covered(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The union of spans; spans that touch become one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(k1, k2, z, size, spans): of each different text with repeated windows that isn't itself repeated whole, its compressed
    bytes and the packed (lo, hi) pairs that windows of `length` bytes which also start elsewhere cover."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(text_col).alias("text"))
    rows = staged(anchor_rows(docs, length), "anchors")
    # Written out, so that the join shuffles both sides and Spark can split a hash that very many texts share.
    twice = staged(
        rows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("k1", "at") for n, f in (("min", F.min), ("max", F.max))))
        .where("min_k1 <> max_k1 or min_at <> max_at")
        .select("h", (F.col("n") > HOT).alias("hot")),
        "twice",
    )
    places = rows.join(twice, "h").groupBy("k1").agg(F.collect_set(F.when(~F.col("hot"), F.col("at"))).alias("places"), F.collect_set(F.when(F.col("hot"), F.col("at"))).alias("hot_places"))
    texts = packed(docs).repartition("k1").dropDuplicates(["k1", "k2"])  # one shuffle serves both the copies and the join
    candidates = staged(texts.join(places, "k1"), "candidates")
    discard(rows, twice)
    total, hot = candidates.agg(F.sum(F.size("places")), F.sum(F.size("hot_places"))).first()
    ranges = max(shuffle_partitions(spark), -(-(total or 0) // RANGE_SIZE))
    merged = lambda runs: runs.groupBy("range").applyInArrow(lambda t: merge_range(t, length), "k1 long, k2 long, lo long, hi long")
    found = merged(suffix_runs(candidates.where("size(places) > 0"), length, ranges))
    if hot:
        spans, rest = deal_hot(hot_suffixes(candidates.where("size(hot_places) > 0"), length), length)
        again = max(shuffle_partitions(spark), -(-hot // RANGE_SIZE))
        found = found.unionByName(merged(dealt_runs(rest, again))).unionByName(spans)
    found = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return candidates.select("k1", "k2", "z", "size").join(found, ["k1", "k2"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with keep_text
    the bytes that stay.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in this text or another; matches
    don't cross texts. Null texts are empty. Rows that repeat whole lose all their bytes if they have `length` of them.
    Ids may be null or repeat; extra columns are ignored; an empty table gives an empty result."""

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in text_slices(batch, "size"):
                removed, spans, digests, kept_texts = [], [], [], []
                for z, pairs in zip(part.column("z").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    text, runs = unpack.decompress(z), covered([(p["lo"], p["hi"]) for p in pairs])
                    at, kept = 0, []
                    for lo, hi in runs:
                        kept.append(text[at:lo])
                        at = hi
                    kept = b"".join([*kept, text[at:]])
                    removed.append(len(text) - len(kept))
                    spans.append(len(runs))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept if keep_text else None)
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.binary())], ["k1", "k2", "removed", "runs", "digest", "kept"])

    cuts = repeated_spans(docs, text_col, length).mapInArrow(cut, "k1 long, k2 long, removed long, runs long, digest string, kept binary")
    cuts = staged(cuts, "cuts")
    rows = staged(keyed(docs, id_col, text_col), "keys")
    copies = rows.where(F.col("n_bytes") >= length).groupBy("k1", "k2").count().where("count > 1").select("k1", "k2", F.lit(True).alias("copied"))
    marks = cuts.join(copies, ["k1", "k2"], "full").select("k1", "k2", "removed", "runs", "digest", "kept", F.coalesce("copied", F.lit(False)).alias("copied"))
    out = rows.join(marks, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("digest", "whole")).alias("kept_sha256"),
        *([F.when(F.col("copied"), F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    )
    return out
