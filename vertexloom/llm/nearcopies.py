"""Near copies at a five-word similarity of 0.8: the SimHash trie and bands of least hashes propose pairs, the sets of
shingles decide.

The trie self-join of `simhash.py` runs over fingerprints of five-word shingles. At a similarity of 0.8 two of these
differ in about ten bits, which few pairs have less of; so bands of least hashes of the same shingles propose pairs, too.
Each text is first compared with one text of each of its bands. Where that leaves a band in several groups, all its texts
of different groups are compared, in blocks. Every comparison is the Jaccard similarity itself.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, discard, staged, text_slices
from .simhash import SEED, Groups, fingerprint_links, majority

#: Words of a shingle, and the differing bits of two fingerprints that the trie proposes.
WIDTH, BUDGET = 5, 3
#: Bands of least hashes, and hashes of a band: of pairs of a similarity of 0.8, 0.35 per cent share none (1 - 0.8^7)^24.
BANDS, DEEP = 24, 7
#: Shingles of a block on average; texts of a band that aren't all in one group are compared block by block.
BLOCK_GRAMS = 1 << 20

_MIN = np.random.Generator(np.random.PCG64(22)).integers(0, 2**63, (BANDS, DEEP, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> list[bytes]:
    """A text's five-word shingles; fewer words are one shingle."""
    ws = text.lower().split() if text else []
    return list(map(b" ".join, zip(*(ws[k:] for k in range(WIDTH)), strict=False))) if len(ws) >= WIDTH else [b" ".join(ws)] if ws else []


def _hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, items, repeat(SEED)), np.uint64, len(items))


def prints(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's fingerprint; its bands, all 0 without words; and a hash of its set of shingles."""
    grams = [shingles(t) for t in texts]
    sizes = np.array(list(map(len, grams)), np.int64)
    found = _hashes([g for own in grams for g in own])
    sets = (xxhash.xxh64_intdigest(np.unique(x).tobytes(), SEED) for x in np.split(found, np.cumsum(sizes[:-1])))
    nodes = np.fromiter(sets, np.uint64) if texts else np.empty(0, np.uint64)
    full, least = sizes > 0, np.zeros((len(sizes), BANDS), np.uint64)
    least[full] = bands(found, sizes[full])
    return majority(found, sizes), least, nodes


def bands(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BANDS hashes of least hashes of each run of shingle hashes, `sizes` (none 0) long, in rows."""
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), BANDS), np.uint64)
    if len(sizes):
        for k in range(BANDS):
            for odd, place in _MIN[k]:
                h = np.minimum.reduceat(grams * odd, starts)
                out[:, k] = (out[:, k] ^ (h >> np.uint64(29)) ^ h) * place
    return out


def similar_groups(flat: np.ndarray, sizes: np.ndarray, group: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """For sets (their members in a row, and their sizes, none 0) in known groups: for each group, by its number, one
    group of those that links of a Jaccard similarity of 0.8 and more tie together. Sets of one group aren't compared,
    nor, if sides are given, those of one side. The largest group is only compared with."""
    value, flat = np.unique(flat, return_inverse=True)
    ties, mark = Groups(int(group.max(initial=-1)) + 1), np.zeros(len(value), bool)
    many = np.bincount(group)
    order = np.lexsort((group, many[group]))
    starts = (np.cumsum(sizes) - sizes)[order]
    size, own = sizes[order], group[order]
    apart = None if side is None else side[order]
    members = np.concatenate([flat[s : s + n] for s, n in zip(starts.tolist(), size.tolist(), strict=True)])
    starts = np.cumsum(size) - size
    for a in np.sort(np.unique(own, return_index=True)[1]).tolist():
        end = a + int(many[own[a]])
        if end == len(own):
            break
        rest, left, at = np.arange(end, len(own)), members[starts[end] :], size[end:]
        stale = True
        for row in range(a, end):
            if stale:
                keep = ties.find(own[rest]) != ties.find(own[a : a + 1])
                rest, left, at = rest[keep], left[np.repeat(keep, at)], at[keep]
                stale = False
            if not len(rest):
                break
            mine = members[starts[row] : starts[row] + size[row]]
            mark[mine] = True
            both = np.add.reduceat(mark[left], np.cumsum(at) - at, dtype=np.int64)
            mark[mine] = False
            hit = 5 * both >= 4 * (size[row] + at - both)
            if apart is not None:
                hit &= apart[rest] != apart[row]
            if hit.any():
                ties.link(np.full(int(hit.sum()), own[row]), own[rest[hit]])
                stale = True
    return ties.find(np.arange(len(ties.root)))


def _proposals(classes: DataFrame) -> DataFrame:
    """classes (node, fp, bands) to pairs (a, b): each node with the least node of its fingerprint and of each of its
    bands, and those of fingerprints that the trie links with the least of its root."""
    heads = classes.groupBy("fp").agg(F.min("node").alias("head"))
    same = classes.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    links = fingerprint_links(heads, BUDGET).where("fp <> root")
    near = links.join(heads, "fp").select(F.col("head").alias("a"), F.col("root").alias("fp")).join(heads, "fp").select("a", F.col("head").alias("b"))
    each = classes.select("node", F.posexplode("bands").alias("k", "band")).where("band <> 0")
    least = each.groupBy("k", "band").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top")
    banded = each.join(least, ["k", "band"]).where("node <> b").select(F.col("node").alias("a"), "b")
    return same.unionByName(near).unionByName(banded).distinct()


def _sets(texts: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, grams): the sets of shingles of the named nodes that have words."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [np.unique(_hashes(shingles(t))).view(np.int64) for t in part.column("text").cast(pa.binary()).to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.concatenate(found) if found else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "grams"])

    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("rep.id").alias("rep_id"), F.col("rep.key").alias("rep_key"))
    once = texts.join(wanted, texts["id"].eqNullSafe(wanted["rep_id"]) & (texts["key"] == wanted["rep_key"])).groupBy("node").agg(F.first("text").alias("text"))
    return once.mapInArrow(run, "node long, grams array<long>").where("size(grams) > 0")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of a similarity of 0.8 and more."""
    a, b = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(a, "a").join(b, "b").where(5 * both >= 4 * (F.size("ga") + F.size("gb") - both)).select("a", "b")


def _within_bands(classes: DataFrame, sets: DataFrame, comps: DataFrame) -> DataFrame:
    """Links (a, b) between groups of comps (node, component) that share a band. Of a band's groups the largest one's
    texts meet the others' only, so that a group of any size that is already one costs nothing."""
    sized = sets.select("node", F.size("grams").alias("size")).join(comps, "node", "left").select("node", "size", F.coalesce("component", "node").alias("component"))
    each = classes.select("node", F.posexplode("bands").alias("k", "band")).where("band <> 0").join(sized, "node")
    per = each.groupBy("k", "band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"))
    open_ = per.groupBy("k", "band").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("sign").alias("sign"), F.max(F.struct("n", "size", "component")).alias("top")).where("groups > 1 and n > 2")
    # Bands with the same texts count once.
    open_ = open_.groupBy("sign", "n").agg(F.min(F.struct("k", "band", "size", "top")).alias("x")).select("x.k", "x.band", (F.col("x.size") - F.col("x.top.size")).alias("few"), F.col("x.top.size").alias("many"), F.col("x.top.component").alias("main"))
    blocks = [F.ceil(F.col(c) / BLOCK_GRAMS).cast("int").alias(f"{c}_blocks") for c in ("few", "many")]
    rows = each.join(open_.select("k", "band", "main", *blocks), ["k", "band"])
    rows = rows.withColumn("big", F.col("component") == F.col("main")).withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("big"), F.col("many_blocks")).otherwise(F.col("few_blocks"))).cast("int"))
    few = F.sequence(F.lit(0), F.col("few_blocks") - 1)
    # A text of the largest group goes to every block of others; one of these to that of its own, and to pairs.
    met = F.when(F.col("big"), F.transform(few, lambda j: F.struct(j.alias("low"), (-1 - F.col("mine")).alias("high"))))
    met = met.otherwise(F.concat(F.transform(few, lambda j: F.struct(F.least(j, "mine").alias("low"), F.greatest(j, "mine").alias("high"))), F.transform(F.sequence(F.lit(0), F.col("many_blocks") - 1), lambda j: F.struct(F.col("mine").alias("low"), (-1 - j).alias("high")))))
    dealt = rows.select("k", "band", "node", "component", F.when(F.col("big"), -1 - F.col("mine")).otherwise(F.col("mine")).alias("side"), F.explode(met).alias("at")).select("*", "at.*").drop("at")

    def link(table: pa.Table) -> pa.Table:
        grams = table.column("grams").combine_chunks()
        names, group = np.unique(table.column("component").to_numpy(), return_inverse=True)
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        side = None if low == high else table.column("side").to_numpy()
        root = similar_groups(grams.flatten().to_numpy(), grams.value_lengths().to_numpy().astype(np.int64), group, side)
        hit = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": names[hit], "b": names[root[hit]]})

    return dealt.join(sets, "node").groupBy("k", "band", "low", "high").applyInArrow(link, "a long, b long")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, text_key (the text's xxhash64), and component_id and component_key, those of the row
    with the smallest id, then key, that is reachable over links of near copies.

    Texts with the same set of shingles are one. Null and wordless texts are alike. Repeated rows and ids stay; null ids
    are never a component_id unless a group has no other; extra columns are ignored; an empty table gives an empty
    result."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                fp, least, nodes = prints(part.column("text").cast(pa.binary()).to_pylist())
                own = pa.ListArray.from_arrays(pa.array(np.arange(0, least.size + 1, BANDS, dtype=np.int32)), pa.array(least.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(fp.view(np.int64)), own, pa.array(nodes.view(np.int64))], ["id", "key", "fp", "bands", "node"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    rows = staged(texts.mapInArrow(run, f"id {kind}, key long, fp long, bands array<long>, node long"), "prints")
    row = F.struct("id", "key")
    rep = F.coalesce(F.min(F.when(F.col("id").isNotNull(), row)), F.min(row)).alias("rep")
    classes = staged(rows.groupBy("node").agg(rep, F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
    pairs = staged(_proposals(classes), "proposals")
    sets = staged(_sets(texts, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "shingles")
    first = staged(_checked(pairs, sets), "links")
    comps = staged(connected_components(first), "groups")
    more = staged(_within_bands(classes, sets, comps), "more-links")
    if not more.isEmpty():
        comps = staged(connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "groups")
    linked = classes.select("node", "rep").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = F.coalesce(F.min(F.when(F.col("rep.id").isNotNull(), F.col("rep"))), F.min("rep")).alias("rep")
    least = linked.groupBy("component").agg(found)
    by_node = staged(linked.select("node", "component").join(least, "component").select("node", "rep"), "components")
    discard(classes, pairs, sets, first, more)
    return rows.join(by_node, "node").select(F.col("id").alias(id_col), F.col("key").alias("text_key"), F.col("rep.id").alias("component_id"), F.col("rep.key").alias("component_key"))
