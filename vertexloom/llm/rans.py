"""Token ids as blocks of a static range asymmetric numeral system (rANS).

One frequency table serves all blocks. A block interleaves lanes: token t goes to lane t mod L, and each step codes one
token of every lane in arrays. A block holds checkpoints, the lanes' states and the place in the stream every so many
steps, from which its sections are decoded independently, and a checksum.

A corpus is a folder of two Parquet tables that Spark writes and commits: `table` (id, freq), and `blocks` (shard, block,
n_tokens, data, docs), docs telling where in a block each document's ids lie. Nothing else is needed to read it.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, discard, scratch_path, shuffle_partitions, staged, text_slices

SCALE, LOW = 18, np.uint64(1 << 31)
LANES, BLOCK, EVERY = 4096, 1 << 20, 64
HEAD = struct.Struct("<4sIIIII")  # magic, tokens, lanes, words, steps between checkpoints, the table's crc32
MAGIC = b"rAN1"
#: Chunks of text that a worker remembers the ids of.
REMEMBERED = 500_000


class Table:
    """Frequencies of the ids that occur, in ascending order; they add up to 2^SCALE."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.place = np.zeros(int(self.ids.max(initial=0)) + 1, np.uint32)
        self.place[self.ids] = np.arange(len(self.ids))
        self.crc = zlib.crc32(self.ids.tobytes() + self.freq.tobytes())

    @classmethod
    def of(cls, counts: dict[int, int]) -> Table:
        """Counts scaled to 2^SCALE in all, none below one."""
        ids = np.array(sorted(counts), np.uint32)
        n = np.array([counts[i] for i in ids.tolist()], np.float64)
        total = 1 << SCALE
        if len(n) > total:
            raise ValueError("more different ids than the table has room for")
        freq = np.maximum(1, np.floor(n / max(n.sum(), 1) * total)).astype(np.int64)
        while (over := int(freq.sum()) - total) > 0:  # taken where it costs least
            take = np.argsort(-freq, kind="stable")[:over]
            freq[take] -= freq[take] > 1
        if len(freq):
            freq[np.argmax(freq)] += total - int(freq.sum())
        return cls(ids, freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = EVERY) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n // 64))
        symbols = self.place[ids]
        steps = -(-n // lanes)
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, bytes]] = []  # words that follow, states
        written, shift, word = 0, np.uint64(SCALE), np.uint64(32)
        for step in range(steps - 1, -1, -1):
            s = symbols[step * lanes : (step + 1) * lanes]
            k = len(s)
            f, y = self.freq[s], x[:k]
            full = (y >> np.uint64(63 - SCALE)) >= f
            if full.any():
                words.append(y[full].astype(np.uint32))
                written += len(words[-1])
                y = np.where(full, y >> word, y)
            q = y // f
            x[:k] = (q << shift) + (y - q * f) + self.start[s]
            if step % every == 0:
                marks.append((written, x.tobytes()))
        stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
        body = b"".join(struct.pack("<I", written - left) + state for left, state in marks[::-1])
        data = HEAD.pack(MAGIC, n, lanes, written, every, self.crc) + body + stream.tobytes()
        return data + struct.pack("<I", zlib.crc32(data))

    def decode(self, data: bytes) -> np.ndarray:
        """All ids of a block."""
        block = Block(self, data)
        return np.concatenate([np.empty(0, np.uint32), *map(block.section, range(block.sections))])


class Block:
    """A block that is open for reading: its checksum holds, and each section is decoded from its own checkpoint."""

    def __init__(self, table: Table, data: bytes):
        if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum doesn't hold")
        magic, self.n, self.lanes, written, self.every, crc = HEAD.unpack_from(data)
        if magic != MAGIC or crc != table.crc:
            raise ValueError("a block of another format or table")
        self.table, self.data = table, data
        self.steps = -(-self.n // self.lanes)
        self.sections = -(-self.steps // self.every)
        self.width = 4 + 8 * self.lanes
        self.stream = np.frombuffer(data, np.uint32, written, HEAD.size + self.width * self.sections)
        self.last: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def section(self, k: int) -> np.ndarray:
        """The ids between checkpoint k and the next."""
        if self.last[0] == k:
            return self.last[1]
        table, lanes, mark = self.table, self.lanes, HEAD.size + self.width * k
        at = struct.unpack_from("<I", self.data, mark)[0]
        x = np.frombuffer(self.data, np.uint64, lanes, mark + 4).copy()
        out, mask, shift, word = [], np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for step in range(k * self.every, min((k + 1) * self.every, self.steps)):
            width = min(lanes, self.n - step * lanes)
            low = x[:width] & mask
            s = table.slot[low]
            out.append(s)
            y = table.freq[s] * (x[:width] >> shift) + low - table.start[s]
            empty = y < LOW
            m = int(np.count_nonzero(empty))
            if m:
                y[empty] = (y[empty] << word) | self.stream[at : at + m]
                at += m
            x[:width] = y
        self.last = (k, table.ids[np.concatenate(out)])
        return self.last[1]

    def ids(self, at: int, n: int) -> np.ndarray:
        """n ids from place `at` on; sections that have none of them aren't decoded."""
        each = self.lanes * self.every
        first, end = at // each, -(-(at + n) // each)
        parts = [self.section(k)[max(0, at - k * each) : at + n - k * each] for k in range(first, end)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint32), *parts])


#: Where plain letters end; texts with characters beyond, or with control characters that only some count as white space,
#: are encoded whole.
PLAIN = 0x250
_ODD = re.compile(f"[^\t-\r -{chr(PLAIN - 1)}]")


class Encoder:
    """The tokenizers library with a memory of chunks between white space, which tokens never cross where the pre-tokeniser
    drops white space. A new chunk's pieces go to the library's model, many at once; each piece's last token has the
    word-end suffix, which tells the pieces' tokens apart."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        #: Texts that hold an added token's content are the library's to encode.
        self.added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.whole.to_str())
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = spec["model"].get("end_of_word_suffix")
        pattern = (splits[0].get("pattern") or {}).get("Regex", "")
        self.chunks = kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0].get("invert") and bool(suffix) and "[^\\s\\p{L}\\p{N}]+" in pattern
        if self.chunks:
            classes = {k: "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
            for k, chars in classes.items():
                pattern = pattern.replace(f"\\p{{{k}}}", chars)
            self.split = re.compile(pattern)
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(PLAIN)} | {32: " "}
            self.pieces = Tokenizer(self.whole.model)
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            size = self.whole.get_vocab_size()
            self.last = np.array([(self.whole.id_to_token(i) or "").endswith(suffix) for i in range(size)])

    def _fresh(self, chunks: list[str]) -> dict[str, bytes]:
        cut = [[c] if c.isascii() and c.isalpha() else self.split.findall(c) for c in chunks]
        known = self.known
        new = list({p: None for ps in cut for p in ps if p not in known})
        found = {}
        if new:
            ids = np.array(self.pieces.encode_batch_fast([" ".join(new).translate(self.bytes)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(new):
                raise ValueError("pieces and word ends differ")
            raw, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
            found = {p: raw[i:j] for p, i, j in zip(new, [0, *ends], ends, strict=False)}
        return found | {c: b"".join([found[p] if p in found else known[p] for p in ps]) for c, ps in zip(chunks, cut, strict=True) if len(ps) > 1}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned integers, of 16 bits if the vocabulary has room in them."""
        out: list = [None] * len(texts)
        words = {}
        for i, t in enumerate(texts):
            if self.chunks and not _ODD.search(t):
                low = t.lower()
                if (t.isascii() or not _ODD.search(low)) and not any(a in low for a in self.added):
                    words[i] = low.split()
        odd = [i for i in range(len(texts)) if i not in words]
        for i, e in zip(odd, self.whole.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.kind).tobytes()
        known = self.known
        found = {i: list(map(known.get, ws)) for i, ws in words.items()}
        gaps = {i: _places(got, None) for i, got in found.items()}
        fresh = self._fresh(list(dict.fromkeys(words[i][k] for i, at in gaps.items() for k in at)))
        for i, got in found.items():
            for k in gaps[i]:
                got[k] = fresh[words[i][k]]
            out[i] = b"".join(got)
        if len(known) < REMEMBERED:
            known |= {w: ids for w, ids in fresh.items() if len(w) <= 24}
        return out


def _places(items: list, value) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = items.index(value, at + 1)
            out.append(at)
    except ValueError:
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_rows(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """(id, ids, counts): each text's token ids, as the encoder packs them, with the end id; and of each task a row that
    has only the packed (token, how often) of its texts."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        e, end = encoder(path), np.array([end_id], encoder(path).kind).tobytes()
        total, id_type = np.zeros(0, np.int64), None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in text_slices(batch, "text"):
                found = [x + end for x in e.encode(part.column("text").to_pylist())]
                own = np.bincount(np.frombuffer(b"".join(found), e.kind), minlength=len(total))
                own[: len(total)] += total
                total = own
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.binary()), pa.nulls(part.num_rows, pa.binary())], ["id", "ids", "counts"])
        hit = np.flatnonzero(total)
        if len(hit):
            pairs = np.stack([hit, total[hit]], 1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())], ["id", "ids", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, ids binary, counts binary")


def token_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs; at most as many rows as the vocabulary has reach the driver."""

    def run(batches):
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                pairs = np.frombuffer(x, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["token", "n"])

    rows = tokens.where("counts is not null").select("counts").mapInArrow(run, "token long, n long")
    return {r[0]: r[1] for r in rows.groupBy("token").agg(F.sum("n")).collect()}


def write_blocks(tokens: DataFrame, table: Table, kind: np.dtype, folder: str, block: int = BLOCK) -> None:
    """Writes the documents' ids in ascending id order: shards by ranges of ids, blocks in a shard. The rows (shard,
    block, n_tokens, data, docs): docs has the pieces of documents that the block holds (id, number in the shard,
    ids before it in the shard, ids in all, place in the block, ids here)."""
    names = ("no", "before", "size", "at", "here")
    piece = f"struct<id:{tokens.schema['id'].dataType.simpleString()},{','.join(n + ':bigint' for n in names)}>"

    def run(batches):
        held, pieces, size, shard, number, no, before = [], [], 0, 0, 0, 0, 0

        def out():
            ids = np.concatenate(held)
            cols = [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([table.encode(ids)], pa.binary())]
            docs = pa.array([pieces], pa.list_(pa.struct([("id", id_type), *((n, pa.int64()) for n in names)])))
            return pa.RecordBatch.from_arrays([*cols, docs], ["shard", "block", "n_tokens", "data", "docs"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for key, blob, own in zip(*(batch.column(n).to_pylist() for n in ("id", "ids", "shard")), strict=True):
                ids, at, shard = np.frombuffer(blob, kind), 0, own
                if size and size + len(ids) > block >= len(ids):  # what fits into one block isn't cut
                    yield out()
                    held, pieces, size, number = [], [], 0, number + 1
                while at < len(ids):
                    here = min(len(ids) - at, block - size)
                    held.append(ids[at : at + here])
                    pieces.append({"id": key, "no": no, "before": before, "size": len(ids), "at": size, "here": here})
                    at, size = at + here, size + here
                    if size == block:
                        yield out()
                        held, pieces, size, number = [], [], 0, number + 1
                no, before = no + 1, before + len(ids)
        if size:
            yield out()

    dealt = tokens.repartitionByRange(shuffle_partitions(tokens.sparkSession), "id").sortWithinPartitions("id", "ids")
    rows = dealt.withColumn("shard", F.spark_partition_id()).mapInArrow(run, f"shard int, block long, n_tokens long, data binary, docs array<{piece}>")
    rows.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id", keep_ids: bool = False, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """From a folder alone, per document: id, start (ids of all documents before it), n_tokens, ids_crc32, and with
    keep_ids the ids' bytes. wanted: a condition on ids; only sections that hold a wanted document's ids are decoded."""
    found = spark.read.parquet(f"{folder}/table").orderBy("id").toPandas()  # a row for each id that occurs
    shared = spark.sparkContext.broadcast(Table(found["id"].to_numpy(np.int64), found["freq"].to_numpy(np.int64)))
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    names = ["id", "shard", "no", "before", "n_tokens", "block", "ids_crc32", "ids"]
    fields = f"id {kind}, shard int, no long, before long, n_tokens long, block long, ids_crc32 long, ids binary"

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field("docs").type.value_type.field("id").type
            kinds = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            for k in range(batch.num_rows):
                shard, number, data, docs = (batch.column(n)[k].as_py() for n in ("shard", "block", "data", "docs"))
                block, rows = Block(shared.value, data), []
                for d in docs:
                    own = block.ids(d["at"], d["here"]).astype("<u4").tobytes()
                    whole = d["here"] == d["size"]
                    rows.append((d["id"], shard, d["no"], d["before"], d["size"], number, zlib.crc32(own) if whole else None, own if keep_ids or not whole else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def join(batches):
        for batch in batches:
            whole = [b"".join(p["ids"] for p in x) for x in batch.column("parts").to_pylist()]
            names = ["id", "shard", "no", "before", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([zlib.crc32(x) for x in whole], pa.int64()), pa.array([x if keep_ids else None for x in whole], pa.binary())], [*names, "ids_crc32", "ids"])

    def pieces(pick: Callable[[Column], Column]) -> DataFrame:
        own = F.filter("docs", pick if wanted is None else lambda d: pick(d) & wanted(d["id"]))
        return blocks.withColumn("docs", own).where("size(docs) > 0").mapInArrow(run, fields)

    # Only documents that cross a block's end are put together, in block order.
    cross = (
        pieces(lambda d: d["here"] < d["size"]).groupBy("shard", "no").agg(F.first("id").alias("id"), F.first("before").alias("before"), F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "ids"))).alias("parts"))
        .select("id", "shard", "no", "before", "n_tokens", "parts")
        .mapInArrow(join, fields.replace("block long, ", ""))
    )
    docs = pieces(lambda d: d["here"] == d["size"]).drop("block").unionByName(cross)
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each shard
    ahead = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return docs.join(F.broadcast(ahead), "shard").select(F.col("id").alias(id_col), (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Tokenises and writes a corpus into a new folder, documents in ascending id order.

    Null and empty texts have the end id alone. Null ids come first; rows with one id come in the order of their ids'
    bytes. A document of more ids than a block has spans several; others lie in one. Extra columns are ignored; an empty table gives an empty corpus."""
    bounded_batches(docs.sparkSession)
    tokens = staged(token_rows(docs, id_col, text_col, path, end_id), "tokens")
    kind = encoder(path).kind
    table = Table.of(token_counts(tokens))
    rows = pa.table({"id": table.ids.astype(np.int64), "freq": table.freq.astype(np.int64)})
    docs.sparkSession.createDataFrame(rows).coalesce(1).write.parquet(f"{folder}/table")
    write_blocks(tokens.where("ids is not null").select("id", "ids"), table, kind, folder, block)
    discard(tokens)


def encode_corpus(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, keep_ids: bool = False, folder: str | None = None) -> DataFrame:
    """write_tokens to a folder (by default one in the scratch folder), then read_tokens from it: one row per row of docs
    with id, start, n_tokens (with the end id) and ids_crc32."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, folder, path, end_id, id_col, text_col, block)
    return read_tokens(docs.sparkSession, folder, id_col, keep_ids)
