"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit for each language in every slot; the slots of an n-gram, one in each of a few
tables, together give all languages that contain it. A text's n-grams are looked up; how many each language contains,
less what false positives add, decides.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, text_slices

#: Characters of an n-gram, tables, bits of a table's slots.
GRAM, TABLES, SLOTS = 4, 2, 18
#: Learning reads at most TEXTS texts of a language (those of the smallest hashes) and keeps its GRAMS most frequent
#: n-grams, but those that another language has more than RATIO times as often.
TEXTS, GRAMS, RATIO = 3000, 20_000, 4.0
UNKNOWN = "und"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@functools.cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of the n-grams of letters and single spaces that stand for all else, and whether texts have letters."""
    flat = np.frombuffer("".join(f" {t.lower()} \n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[flat]
    sizes = np.array([len(t.lower()) + 3 for t in texts], np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a space after a word; the next word's first space
    chars = np.where(letter, flat, 32).astype(np.uint64)[keep]
    own = own[keep]
    has = np.bincount(own[chars != 32], minlength=len(texts)) > 0
    # Each text starts with a space.
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    chars, own = np.insert(chars, first, 32), np.insert(own, first, own[first] if len(own) else [])
    n = max(0, len(chars) - GRAM + 1)
    h = chars[:n].copy()
    for k in range(1, GRAM):
        h = h * _MIX[0] + chars[k : n + k]
        h ^= h >> np.uint64(29)
    inside = own[:n] == own[GRAM - 1 :] if n else np.empty(0, bool)
    return h[inside], own[:n][inside], has


class Filter:
    """languages: names; rows: (language, n-gram's hash) that each contains."""

    def __init__(self, names: list[str], rows: list[tuple[str, int]]):
        self.names = sorted(names)
        planes = -(-max(1, len(self.names)) // 64)
        self.masks = np.zeros((TABLES, planes, 1 << SLOTS), np.uint64)
        for number, name in enumerate(self.names):
            own = np.array([g for n, g in rows if n == name], np.int64).view(np.uint64)
            for t in range(TABLES):
                self.masks[t, number // 64, self.slots(own, t)] |= np.uint64(1) << np.uint64(number % 64)
        fill = np.array([[((self.masks[t, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.names))] for t in range(TABLES)])
        self.false = fill.prod(0) if len(self.names) else np.empty(0)

    @staticmethod
    def slots(h: np.ndarray, t: int) -> np.ndarray:
        x = (h ^ (h >> np.uint64(31))) * _MIX[1 + t]
        return (x >> np.uint64(64 - SLOTS)).astype(np.int64)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        h, own, has = grams(texts)
        n = np.bincount(own, minlength=len(texts)).astype(float)
        shares = np.zeros((len(texts), len(self.names)))
        found = [self.masks[0, p, self.slots(h, 0)] for p in range(self.masks.shape[1])]
        for t in range(1, TABLES):
            at = self.slots(h, t)
            found = [f & self.masks[t, p, at] for p, f in enumerate(found)]
        for k in range(len(self.names)):
            hit = ((found[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)
            count = np.bincount(own[hit], minlength=len(texts))
            shares[:, k] = np.maximum(0, count - n * self.false[k]) / np.maximum(1e-9, n * (1 - self.false[k]))
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = shares.argmax(1)
        total = shares.sum(1)
        score = np.where(has & (total > 0), shares[np.arange(len(texts)), best] / np.maximum(total, 1e-12), 0.0)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)], np.clip(score, 0, 1)


def learn(docs: DataFrame, picked: Column, text_col: str = "text", lang_col: str = "lang") -> Filter:
    """A filter from the rows that `picked` picks with text and language: counts are made in Spark; the driver gets at
    most GRAMS rows of a language."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(picked & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # Texts are chosen by their hashes, so that neither a common language nor copies of a text bring texts to one task.
    rows = rows.withColumn("hash", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = rows.select("lang", "hash").distinct().withColumn("place", place).where(F.col("place") <= TEXTS).select("lang", "hash")
    sample = rows.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "hash").agg(F.first("text").alias("text")).select("text", "lang")

    def count(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                h, own, _ = grams(part.column("text").to_pylist())
                lang, names = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                for k, name in enumerate(lang):
                    g, n = np.unique(h[names[own] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    most = share.groupBy("gram").agg(F.max("p").alias("most"))
    kept = share.where("n > 1").join(most, "gram").where(F.col("p") * RATIO >= F.col("most"))
    top = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= GRAMS)
    found = [(r.lang, r.gram) for r in top.select("lang", "gram").collect()]
    return Filter([r.lang for r in rows.select("lang").distinct().collect()], found)


def identify(docs: DataFrame, model: Filter, text_col: str = "text") -> DataFrame:
    """All columns of docs with lang_pred and score (0 to 1: the language's share of all languages' corrected counts).

    Null texts and texts without a letter are `und` with score 0; letters of no known n-gram give the first language
    with score 0. Columns of those names are replaced; repeated rows stay; an empty table gives an empty result."""
    from pyspark.sql import types as T

    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^SLOTS words for each table and 64 languages
    plain = docs.drop("lang_pred", "score")
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text_col):
                names, score = shared.value.predict([t or "" for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], schema.names)

    return plain.mapInArrow(run, schema)
