"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than a chunk is cut into windows that overlap. Each window is pre-tokenised by itself; two neighbours are
stitched at the first boundary that both have in their overlap, for from there on the pattern, which looks ahead only,
gives both the same. Pairs without such a boundary send their text to be pre-tokenised whole. The pieces between stitches
are encoded, and the ids of a text's chunks are joined in order. Decoding concatenates the ids' raw bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, staged, text_slices

#: Characters of a chunk and of the overlap; characters before a window's end where lookahead may still change a boundary.
CHUNK, OVERLAP, MARGIN = 1 << 15, 512, 4
#: Pieces that a worker remembers the ids of.
REMEMBERED = 200_000


class Codec:
    """Encodes pieces by ranks; decodes ids."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.single = self.encoding._encode_single_piece
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token
        self.text = [str(i) for i in range(len(self.raw))]
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.single(piece.encode()))
                if len(known) < REMEMBERED and len(piece) <= 32:
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def ends(self, text: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text)]

    def digest(self, ids) -> str:
        return hashlib.sha256(",".join(map(self.text.__getitem__, ids)).encode()).hexdigest()


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 (decimal ids, comma-joined), decoded_sha256 (bytes decoded from
    the ids), and with keep_ids the ids.

    Null texts are empty: no tokens, digests of the empty string. Repeated rows and ids, null ids included, stay as they
    come; extra columns are ignored; an empty table gives an empty result. Texts of any length are exact: only those
    over one chunk are shuffled, chunk by chunk."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out_type = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"

    def finish(keys, found) -> pa.RecordBatch:
        c = codec(path, pattern)
        return pa.RecordBatch.from_arrays(
            [keys, pa.array([len(x) for x in found], pa.int64()), pa.array([c.digest(x) for x in found], pa.string()), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in found], pa.string()), pa.array([list(x) if keep_ids else None for x in found], pa.list_(pa.int32()))],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
        )

    def whole(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield finish(part.column("id"), [c.encode(c.pattern.findall(t)) for t in part.column("text").to_pylist()])

    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, out_type)

    def windows(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                for key, text in zip(part.column("id"), part.column("text").to_pylist(), strict=True):
                    name = hashlib.sha256(text.encode()).digest()[:16]
                    starts = range(0, len(text), chunk)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * len(starts), part.column("id").type), pa.array([name] * len(starts), pa.binary()), pa.array(list(starts), pa.int64()), pa.array([len(text)] * len(starts), pa.int64()), pa.array([text[s : s + chunk + overlap] for s in starts])],
                        ["id", "name", "start", "size", "text"],
                    )

    def boundaries(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in text_slices(batch, "text"):
                heads, tails = [], []
                for start, text in zip(part.column("start").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ends = np.array(c.ends(text), np.int64)
                    heads.append((ends[ends <= overlap] + start).tolist())
                    tails.append((ends[ends > chunk] + start).tolist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("name", "start", "size", "text")), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["name", "start", "size", "text", "heads", "tails"])

    # Each different long text goes once; its chunks are dealt evenly, however long it is.
    cut = staged(rows.where(F.length("text") > chunk).mapInArrow(windows, f"id {kind}, name binary, start long, size long, text string"), "chunks")
    names = cut.where("start = 0").select("id", "name")
    pieces = staged(
        cut.select("name", "start", "size", "text").dropDuplicates(["name", "start"]).mapInArrow(boundaries, "name binary, start long, size long, text string, heads array<long>, tails array<long>"), "windows"
    )
    marks = pieces.select("name", "start", "size", "heads", "tails")
    order = Window.partitionBy("name").orderBy("start")
    met = marks.withColumn("right", F.lead("heads").over(order)).withColumn("next", F.lead("start").over(order))
    # The first common boundary, at least MARGIN characters before the left window's end.
    both = F.array_min(F.filter(F.array_intersect("tails", "right"), lambda p: (p > F.col("next")) & (p <= F.col("next") + overlap - MARGIN)))
    met = met.withColumn("to", F.when(F.col("next").isNull(), F.col("size")).otherwise(both))
    met = met.withColumn("from", F.when(F.col("start") == 0, F.lit(0)).otherwise(F.lag("to").over(order)))
    lost = met.where(F.col("to").isNull()).select("name").distinct()
    spans = met.select("name", "start", "from", "to")

    def encode_spans(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = []
                for start, lo, hi, text in zip(*(part.column(n).to_pylist() for n in ("start", "from", "to", "text")), strict=True):
                    at, pieces_ = lo - start, []
                    for end in c.ends(text):
                        if at < end <= hi - start:
                            pieces_.append(text[at:end])
                            at = end
                    found.append(np.array(c.encode(pieces_), "<i4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("name"), part.column("start"), pa.array(found, pa.binary())], ["name", "start", "part"])

    kept = pieces.select("name", "start", "text").join(spans.join(lost, "name", "left_anti"), ["name", "start"])
    parts = kept.mapInArrow(encode_spans, "name binary, start long, part binary")
    joined = parts.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts"))

    def join_parts(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = np.frombuffer(b"".join(p["part"] for p in row.column("parts").to_pylist()[0]), "<i4").tolist()
                yield finish(row.column("name"), [ids]).rename_columns(["name", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    def join_whole(batches):
        c = codec(path, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                text, before = [], 0
                for p in row.column("parts").to_pylist()[0]:
                    text.append(p["text"][before - p["start"] :])
                    before = p["start"] + len(p["text"])
                yield finish(row.column("name"), [c.encode(c.pattern.findall("".join(text)))]).rename_columns(["name", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    by_name = out_type.replace(f"id {kind}", "name binary")
    rest = pieces.join(lost, "name", "left_semi").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
    long_texts = joined.mapInArrow(join_parts, by_name).unionByName(rest.mapInArrow(join_whole, by_name))
    long_rows = names.join(long_texts, "name").select("id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    found = short.unionByName(long_rows).withColumnRenamed("id", id_col)
    return found if keep_ids else found.drop("ids")
