"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Inverted files, one for each pivot, post the vectors that have
the pivot among those, with its place. A query reads the files of its own nearest pivots, ranks what they post by the
footrule distance between the two orders, a pivot that isn't among the nearest counting as next in place, and measures
the best again on the original vectors.

The files are built once, block by block of the rows, and written to the shared folder. Queries then stream past each
block in packs; nothing of the index is sent twice.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Pivots (different vectors among the SAMPLE rows with the smallest hashes of their ids: the bounded sample the index is
#: fitted on); of them, how many make a vector's order; rows of a block and queries of a pack.
PIVOTS, SAMPLE, ORDER, BLOCK_ROWS, PACK_ROWS = 1024, 2048, 96, 1 << 15, 256
#: Rows measured again for a query: FACTOR times the square root of all rows, each block its part and half as much again.
FACTOR = 8.0


def usable(vector: str) -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first, ties to the smaller number."""
    out = np.empty((len(rows), min(order, len(pivots))), np.int64)
    norm = (pivots**2).sum(1)
    for k in range(0, len(rows), 2048):
        far = norm - 2 * (rows[k : k + 2048] @ pivots.T)
        if out.shape[1] < len(pivots):
            few = np.sort(np.argpartition(far, out.shape[1] - 1, axis=1)[:, : out.shape[1]], axis=1)
        else:
            few = np.broadcast_to(np.arange(len(pivots)), far.shape)
        by = np.argsort(np.take_along_axis(far, few, 1), axis=1, kind="stable")
        out[k : k + 2048] = np.take_along_axis(few, by, 1)
    return out


class Inverted:
    """The inverted files of one block: of each pivot, the rows that it is near to, and its places in their orders."""

    def __init__(self, file: np.ndarray, place: np.ndarray, cut: np.ndarray, rows: int):
        self.file, self.place, self.cut, self.rows = file, place, cut, rows

    @staticmethod
    def of(near: np.ndarray, pivots: int) -> Inverted:
        flat = near.ravel()
        by = np.argsort(flat, kind="stable")
        width = max(1, near.shape[1])
        return Inverted((by // width).astype(np.int32), (by % width).astype(np.int16), np.searchsorted(flat[by], np.arange(pivots + 1)), len(near))

    def closeness(self, near: np.ndarray) -> np.ndarray:
        """For each row, a constant less the footrule distance to an order of pivots."""
        size = len(near)
        who, worth = [], []
        for place, p in enumerate(near.tolist()):
            lo, hi = self.cut[p], self.cut[p + 1]
            who.append(self.file[lo:hi])
            worth.append(2 * (size - np.maximum(self.place[lo:hi], place)))
        return np.bincount(np.concatenate(who), np.concatenate(worth), self.rows)

    def best(self, near: np.ndarray, keep: int) -> np.ndarray:
        """The `keep` rows nearest by footrule; ties at the bound stay."""
        close = self.closeness(near)
        return np.flatnonzero(close >= np.partition(close, self.rows - keep)[self.rows - keep])


def search_block(index: Inverted, rows: np.ndarray, ids: np.ndarray, pivots: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, keep: int, order: int):
    """(query, row, distance) of each query's k nearest rows that the index proposes; its own id is left out."""
    out = []
    near = nearest_pivots(queries, pivots, order)
    for q in range(len(queries)):
        found = index.best(near[q], min(keep, len(ids)))
        found = found[ids[found] != query_ids[q]]
        far = np.sqrt(((rows[found] - queries[q]) ** 2).sum(1))
        if len(found) > k:
            bound = np.partition(far, k - 1)[k - 1]
            found, far = found[far <= bound], far[far <= bound]
        best = np.lexsort((ids[found], far))[:k]
        out.append((np.stack([np.full(len(best), q), found[best]]), far[best]))
    at = np.concatenate([a for a, _ in out], axis=1) if out else np.empty((2, 0), np.int64)
    return at[0], at[1], np.concatenate([f for _, f in out]) if out else np.empty(0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, order: int = ORDER, factor: float = FACTOR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows by Euclidean distance in double precision, ties to the smaller
    id, for the rows that is_query picks, against every row but those of the query's own id.

    Rows whose vector is null, zero or holds null or non-finite components, or has another length than most, or whose
    id is null, take no part. Rows that repeat id and vector count once; of more than k + 1 rows with one vector, those
    with the smallest ids stand for all, as ties go to them. Fewer candidates than k give as many rows. Extra columns
    are ignored; an empty table gives an empty result. Rows are dealt to blocks by a hash of the id, so that like vectors
    spread."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.groupBy("id", "v").agg(F.max("q").alias("q"))
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = staged(rows.withColumn("copy", copy).where((F.col("copy") <= k + 1) | F.col("q")), "vectors")
    first = (F.col("copy") <= k + 1).cast("long")
    shapes = rows.groupBy(F.size("v").alias("n")).agg(F.sum(first).alias("rows"), F.sum(F.col("q").cast("long")).alias("queries")).orderBy(F.desc("rows"), "n").first()
    if shapes is None or not shapes.queries:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    rows = rows.where(F.size("v") == shapes.n)
    chosen = rows.orderBy(F.xxhash64("id"), "id", "v").select("v").limit(max(SAMPLE, pivots)).collect()
    fixed = spark.sparkContext.broadcast(np.array(list(dict.fromkeys(tuple(r.v) for r in chosen))[:pivots]))  # at most PIVOTS vectors
    blocks = -(-shapes.rows // block_rows)
    keep = max(k + 1, math.ceil((1.5 if blocks > 1 else 1.0) * factor * math.sqrt(shapes.rows) / blocks))

    def matrix(t) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, held = t.column("id").to_numpy(), matrix(t)
        files = Inverted.of(nearest_pivots(held, fixed.value, order), len(fixed.value))
        blobs = [x.tobytes() for x in (ids, held, files.file, files.place, files.cut)]
        return pa.table({"block": t.column("block")[:1], "ids": [blobs[0]], "rows": [blobs[1]], "files": [blobs[2]], "places": [blobs[3]], "cuts": [blobs[4]]})

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    parts = "block int, ids binary, rows binary, files binary, places binary, cuts binary"
    index = staged(rows.where("copy <= " + str(k + 1)).select("id", "v", block).groupBy("block").applyInArrow(build, parts), "pivot-files")

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                part = pa.table(batch.slice(at, PACK_ROWS))
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().tobytes()]), pa.array([matrix(part).tobytes()])], ["ids", "rows"])

    packs = rows.where("q").select("id", "v").mapInArrow(pack, "ids binary, rows binary")
    none = [F.lit(None).cast("binary").alias(c) for c in ("files", "places", "cuts")]
    asked = packs.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "ids", "rows", *none)
    stream = index.select("block", F.lit(0).alias("kind"), "ids", "rows", "files", "places", "cuts").unionByName(asked)

    def search(batches):
        here, held = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                ids = np.frombuffer(one["ids"].as_buffer(), np.int64)
                own = np.frombuffer(one["rows"].as_buffer(), np.float64).reshape(len(ids), -1)
                if one["kind"].as_py() == 0:
                    file, place, cut = (np.frombuffer(one[c].as_buffer(), t) for c, t in (("files", np.int32), ("places", np.int16), ("cuts", np.int64)))
                    here, held = one["block"].as_py(), (Inverted(file.copy(), place.copy(), cut.copy(), len(ids)), own.copy(), ids.copy())
                elif here == one["block"].as_py():  # a block without rows has no index
                    files, rows_, ids_ = held
                    q, r, far = search_block(files, rows_, ids_, fixed.value, own, ids, k, keep, order)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(ids_[r]), pa.array(far)], ["query_id", "id", "score"])

    dealt = stream.repartition(blocks, "block").sortWithinPartitions("block", "kind")
    best = dealt.mapInArrow(search, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
