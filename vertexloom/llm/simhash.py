"""SimHash near-dedup by a binary trie self-join.

Fingerprints are the leaves of a binary trie. Pairs of nodes are walked together from the root; a pair holds the number
of bits in which its two paths differ and is dropped as soon as that exceeds the budget. The top of the trie is cut
into nodes by a count of fingerprints; each surviving pair of cut nodes is joined within one task.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, discard, staged, text_slices

SEED = 42
#: Bits of the trie that the cut may use, its least depth, and the fingerprints that a node holds before it is split.
TOP_BITS, LEAST_DEPTH, NODE_SIZE = 16, 6, 1 << 16


#: A byte's bits, one in each byte of a word.
_SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(b)) & np.uint64(1)) << np.uint64(8 * b) for b in range(8))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of hashes, `counts` long: the bits set in over half of a run; zero for an empty run. Up to 255 rows are
    summed eight bits to a word."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    own = counts[full]
    if not len(own):
        return out
    parts = -(-own // 255)
    first = np.repeat(np.cumsum(own) - own, parts)
    starts = first + 255 * (np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts))
    columns = hashes.view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(_SPREAD[columns[:, k]], starts) for k in range(8)], 1)
    ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > own[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprint_batch(texts: list[bytes | None], width: int) -> np.ndarray:
    """SimHash of each text: 64 majority bits over the XXH64 of its word shingles, repeats included."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
        else:
            shingles = [b" ".join(words)] if words else []
        before = len(hashes)
        hashes.extend(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)))
        counts[i] = len(hashes) - before
    return majority(np.array(hashes, np.uint64), counts)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                fp = fingerprint_batch(part.column("text").cast(pa.binary()).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def trie_cut(counts: dict[int, int]) -> list[tuple[int, int]]:
    """Nodes (depth, prefix) that together hold all fingerprints. counts: fingerprints by their first TOP_BITS bits."""
    sums = {TOP_BITS: dict(counts)}
    for depth in range(TOP_BITS - 1, -1, -1):
        sums[depth] = {}
        for prefix, n in sums[depth + 1].items():
            sums[depth][prefix >> 1] = sums[depth].get(prefix >> 1, 0) + n
    nodes, open_ = [], [(0, 0)]
    while open_:
        depth, prefix = open_.pop()
        if depth < TOP_BITS and (depth < LEAST_DEPTH or sums[depth][prefix] > NODE_SIZE):
            open_ += [(depth + 1, p) for p in (2 * prefix, 2 * prefix + 1) if p in sums[depth + 1]]
        else:
            nodes.append((depth, prefix))
    return sorted(nodes, key=lambda x: x[1] << (TOP_BITS - x[0]))


def node_pairs(nodes: list[tuple[int, int]], budget: int) -> list[list[int]]:
    """For each node of the cut, the nodes from it onwards that are within the budget on the bits both have."""
    depth = np.array([d for d, _ in nodes])
    prefix = np.array([p for _, p in nodes], np.int64)
    out = []
    for i in range(len(nodes)):
        d = np.minimum(depth[i:], depth[i])
        apart = np.bitwise_count((prefix[i:] >> (depth[i:] - d)) ^ (prefix[i] >> (depth[i] - d)))
        out.append((i + np.flatnonzero(apart <= budget)).tolist())
    return out


def trie_links(a: np.ndarray, b: np.ndarray, budget: int, same: bool, block: int = 1 << 17):
    """Yields (ia, ib): indices of pairs of a and b (sorted, distinct) that differ in at most `budget` bits; same: a is
    b, and each pair comes once. Blocks of node pairs wait on a stack, so that memory stays bounded."""
    one = np.uint64(1)
    if not (len(a) and len(b)):
        return
    stack = [(*(np.array([x]) for x in (0, len(a), 0, len(b), 0)), 63)]
    while stack:
        alo, ahi, blo, bhi, diff, bit = stack.pop()
        if len(alo) > block:
            half = len(alo) // 2
            stack += [(*(x[:half] for x in (alo, ahi, blo, bhi, diff)), bit), (*(x[half:] for x in (alo, ahi, blo, bhi, diff)), bit)]
            continue
        size = (ahi - alo) * (bhi - blo)
        leaf = (size <= 48) | (bit < 0)
        if leaf.any():
            n, wide, first, second = size[leaf], (bhi - blo)[leaf], alo[leaf], blo[leaf]
            which = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            ia, ib = first[which] + at // wide[which], second[which] + at % wide[which]
            near = np.bitwise_count(a[ia] ^ b[ib]) <= budget
            if same:
                near &= ia < ib
            if near.any():
                yield ia[near], ib[near]
        if leaf.all():
            continue
        alo, ahi, blo, bhi, diff = (x[~leaf] for x in (alo, ahi, blo, bhi, diff))
        step = one << np.uint64(bit)
        above = ~((step << one) - one) if bit < 63 else np.uint64(0)
        amid = np.searchsorted(a, (a[alo] & above) | step)
        bmid = np.searchsorted(b, (b[blo] & above) | step)
        amid, bmid = np.clip(amid, alo, ahi), np.clip(bmid, blo, bhi)
        kids = []
        for x in (0, 1):
            for y in (0, 1):
                kid = [(alo, amid)[x], (amid, ahi)[x], (blo, bmid)[y], (bmid, bhi)[y], diff + (x != y)]
                keep = (kid[0] < kid[1]) & (kid[2] < kid[3]) & (kid[4] <= budget)
                if same and (x, y) == (1, 0):
                    keep &= alo != blo
                kids.append([k[keep] for k in kid])
        stack.append((*(np.concatenate(x) for x in zip(*kids, strict=True)), bit - 1))


class Groups:
    """Disjoint sets over 0..n-1; links join in whole arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            up = self.root[r]
            if np.array_equal(up, r):
                return r
            r = up

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            ru, rv = self.find(u), self.find(v)
            apart = ru != rv
            u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
            np.minimum.at(self.root, np.maximum(ru, rv), np.minimum(ru, rv))


def join_nodes(table: pa.Table, budget: int) -> pa.Table:
    """One home node against itself and its partners: for each fingerprint with links, its local group's first member
    and its number of links."""
    home = table.column("home")[0].as_py()
    own, rest = [], []
    for src, blob in zip(table.column("src").to_pylist(), table.column("fps").to_pylist(), strict=True):
        (own if src == home else rest).append(np.frombuffer(blob, np.uint64))
    a = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
    b = np.unique(np.concatenate(rest)) if rest else np.empty(0, np.uint64)
    every = np.concatenate([a, b])
    groups, degree = Groups(len(every)), np.zeros(len(every), np.int64)
    for other, shift, same in ((a, 0, True), (b, len(a), False)):
        for ia, ib in trie_links(a, other, budget, same):
            groups.link(ia, ib + shift)
            degree += np.bincount(ia, minlength=len(every)) + np.bincount(ib + shift, minlength=len(every))
    hit = np.flatnonzero(degree)
    return pa.table({"fp": every[hit].view(np.int64), "root": every[groups.find(hit)].view(np.int64), "links": degree[hit]})


def fingerprint_links(classes: DataFrame, budget: int) -> DataFrame:
    """classes (fp: distinct longs) to rows (fp, root, links): the roots of a spanning forest of the links that each
    task found, and the number of links it found for fp."""
    counts = {r[0]: r[1] for r in classes.groupBy(F.shiftrightunsigned("fp", 64 - TOP_BITS).alias("p")).count().collect()}  # at most 2^TOP_BITS rows
    nodes = trie_cut(counts) if counts else []
    homes: list[list[int]] = [[] for _ in nodes]
    for i, partners in enumerate(node_pairs(nodes, budget)):
        for j in partners:
            homes[j].append(i)
    starts = np.array([p << (TOP_BITS - d) for d, p in nodes], np.uint64)

    def send(batches):
        held: list[np.ndarray] = []

        def out():
            fps = np.concatenate(held) if held else np.empty(0, np.uint64)
            src = np.searchsorted(starts, fps >> np.uint64(64 - TOP_BITS), side="right") - 1
            order = np.argsort(src, kind="stable")
            fps, src = fps[order], src[order]
            rows = []
            for part, k in zip(np.split(fps, np.flatnonzero(np.diff(src)) + 1), np.unique(src), strict=bool(len(fps))):
                rows += [(h, int(k), part.tobytes()) for h in homes[k]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["home", "src", "fps"])

        for batch in batches:
            held.append(batch.column("fp").to_numpy().view(np.uint64))
            if sum(map(len, held)) >= 1 << 16:
                yield from out()
                held.clear()
        yield from out()

    return (
        classes.select("fp")
        .mapInArrow(send, "home int, src int, fps binary")
        .groupBy("home")
        .applyInArrow(lambda t: join_nodes(t, budget), "fp long, root long, links long")
    )


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at
    most `budget` differing bits, its own included) and n_links (other fingerprints that its own links to).

    Null or wordless texts have fingerprint zero and link like any other; fewer than `width` words are one shingle.
    Repeated rows, and ids that repeat, stay as they come. Null ids stay, but are never a component_id unless a group
    has no other. Extra columns are ignored; an empty table gives an empty result."""
    bounded_batches(docs.sparkSession)
    prints = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    found = staged(fingerprint_links(classes, budget), "links")
    comps = connected_components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("fp").agg(F.sum("links").alias("n_links"))
    linked = classes.join(comps.select(F.col("node").alias("fp"), "component"), "fp")
    tops = linked.groupBy("component").agg(F.min("rep").alias("top"))
    by_print = staged(
        classes.join(linked.join(tops, "component").select("fp", "top"), "fp", "left")
        .join(links, "fp", "left")
        .select("fp", F.coalesce("top", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")),
        "components",
    )
    discard(classes, found)
    return prints.join(by_print, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )
