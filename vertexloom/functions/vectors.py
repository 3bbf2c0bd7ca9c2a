"""Vector distances as column expressions: BF16 words by sign, exponent and mantissa; 4-bit codebooks; Hamming, dot
product, cosine and Euclidean distance; XOR binding."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The weights of a differing sign and of an exponent step, the largest exponent step whose mantissas are
# compared, the largest exponent step there is, mantissa bits, a nibble's largest level.
SIGN_WEIGHT, EXP_WEIGHT, EXP_NEAR, EXP_MOST, MANT_BITS, LEVELS = 64, 4, 2, 255, 7, 15
_WORST = SIGN_WEIGHT + EXP_WEIGHT * EXP_MOST


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def to_bf16(values: pd.Series) -> pd.Series:
    """Floats, shifted by two, to BF16 words: the upper half of their 32 bits."""
    import numpy as np

    return values.map(lambda v: None if v is None else ((np.asarray(v, np.float32) + np.float32(2)).view(np.uint32) >> 16).astype(np.int32))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bf16(words: pd.Series) -> pd.Series:
    import numpy as np

    return words.map(lambda w: None if w is None else (np.asarray(w, np.uint32) << 16).view(np.float32) - np.float32(2))


def bf16_distance(a: Column, b: Column) -> Column:
    """Of two lists of BF16 words: struct of score, sign_flips, exp_delta_sum, mant_bit_flips, mant_elements_compared and
    total_elements. A word scores SIGN_WEIGHT for another sign, EXP_WEIGHT for each exponent step, and differing mantissa
    bits if signs agree and exponents are near."""

    def parts(x: Column, y: Column) -> Column:
        flip = F.shiftright(x.bitwiseXOR(y), 15).bitwiseAND(F.lit(1))
        step = F.abs(F.shiftright(x, 7).bitwiseAND(F.lit(EXP_MOST)) - F.shiftright(y, 7).bitwiseAND(F.lit(EXP_MOST)))
        near = (flip == 0) & (step <= EXP_NEAR)
        bits = F.when(near, F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(127)))).otherwise(0)
        return F.struct(flip.cast("long").alias("f"), step.cast("long").alias("e"), bits.cast("long").alias("m"), near.cast("long").alias("n"))

    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in "femn"))
    total = F.aggregate(F.zip_with(a, b, parts), zero, lambda s, p: F.struct(*((s[c] + p[c]).alias(c) for c in "femn")))
    return F.transform(F.array(total), lambda t: F.struct((SIGN_WEIGHT * t["f"] + EXP_WEIGHT * t["e"] + t["m"]).alias("score"), t["f"].alias("sign_flips"), t["e"].alias("exp_delta_sum"), t["m"].alias("mant_bit_flips"), t["n"].alias("mant_elements_compared"), F.size(a).cast("long").alias("total_elements")))[0]


def bf16_similarity(d: Column) -> Column:
    return F.lit(1.0) - d["score"] / (F.lit(float(_WORST)) * d["total_elements"])


def sign_agreement(d: Column) -> Column:
    return F.lit(1.0) - d["sign_flips"] / d["total_elements"]


def exp_agreement(d: Column) -> Column:
    return F.lit(1.0) - d["exp_delta_sum"] / (F.lit(float(EXP_MOST)) * d["total_elements"])


def mant_agreement(d: Column) -> Column:
    """0 if no mantissas were compared."""
    return F.when(d["mant_elements_compared"] > 0, F.lit(1.0) - d["mant_bit_flips"] / (F.lit(float(MANT_BITS)) * d["mant_elements_compared"])).otherwise(0.0)


def gate_pass_ratio(d: Column) -> Column:
    """The share of elements whose mantissas were compared; 0 without elements."""
    return F.when(d["total_elements"] > 0, d["mant_elements_compared"] / d["total_elements"]).otherwise(0.0)


def spo_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """struct of the distances of subject, predicate and object (lists of BF16 words), and of their total."""
    each = {k: bf16_distance(a[k], b[k]) for k in ("subject", "predicate", "object")}
    parts = F.struct(*(d.alias(k) for k, d in each.items()))
    return F.transform(F.array(parts), lambda p: F.struct(*(p[k].alias(k) for k in each), (p["subject"]["score"] + p["predicate"]["score"] + p["object"]["score"]).alias("total")))[0]


def awareness_tensor(spo: Column) -> list[Column]:
    """The nine agreements of an SPO distance, under the names of `reasoning.DIMENSIONS`."""
    kinds = (("sign", sign_agreement), ("exp", exp_agreement), ("mant", mant_agreement))
    return [f(spo[part]).alias(f"{part[0]}_{kind}") for part in ("subject", "predicate", "object") for kind, f in kinds]


@dataclass(frozen=True)
class Codebook:
    """Each dimension's least and largest value; a constant dimension spans one."""

    low: list[float]
    high: list[float]

    @staticmethod
    def fit(df: DataFrame, vector: str) -> Codebook:
        """One aggregation; as many rows as dimensions reach the driver."""
        cells = df.select(F.posexplode(vector).alias("d", "v")).groupBy("d").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("d").collect()
        return Codebook([r.lo for r in cells], [r.hi if abs(r.hi - r.lo) >= 1e-9 else r.lo + 1.0 for r in cells])

    def _arrays(self) -> tuple[Column, Column]:
        return tuple(F.array(*(F.lit(x).cast("double") for x in xs)) for xs in (self.low, self.high))

    def encode(self, vector: Column) -> Column:
        low, high = self._arrays()
        level = lambda v, i: F.round((v.cast("double") - low[i]) / (high[i] - low[i]) * LEVELS).cast("int")
        return F.transform(vector, lambda v, i: F.least(F.greatest(level(v, i), F.lit(0)), F.lit(LEVELS)))

    def decode(self, nibbles: Column) -> Column:
        low, high = self._arrays()
        return F.transform(nibbles, lambda n, i: low[i] + n / F.lit(float(LEVELS)) * (high[i] - low[i]))


def nibble_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def nibble_distance_normalized(a: Column, b: Column) -> Column:
    return nibble_distance(a, b) / (F.lit(float(LEVELS)) * F.size(a))


def nibble_hex(nibbles: Column) -> Column:
    return F.array_join(F.transform(nibbles, lambda x: F.hex(x.cast("long"))), ":")


def pack_words(nibbles: Column, intensity: Column) -> Column:
    """Up to 16 nibbles, four a word from the lowest, and a fifth word whose top bit is the intensity."""
    four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda w: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.coalesce(F.get(nibbles, w * 4 + p), F.lit(0)) * F.element_at(F.array(*(F.lit(16**k) for k in range(4))), p + 1)), F.lit(0), lambda s, x: s + x))
    return F.concat(four, F.array(F.when(intensity, 1 << 15).otherwise(0)))


def unpack_words(words: Column) -> Column:
    """struct of nibbles (16) and intensity."""
    place = F.array(*(F.lit(16**k) for k in range(4)))
    nibbles = F.flatten(F.transform(F.slice(words, 1, 4), lambda w: F.transform(place, lambda p: F.floor(w / p).cast("int").bitwiseAND(F.lit(LEVELS)))))
    return F.struct(nibbles.alias("nibbles"), (F.get(words, F.lit(4)) >= 1 << 15).alias("intensity"))


def full_distance(a: Column, b: Column, penalty: int = 16) -> Column:
    """Of packed words: the nibbles' distance, and the penalty if intensities differ."""
    x, y = unpack_words(a), unpack_words(b)
    return nibble_distance(x["nibbles"], y["nibbles"]) + F.when(x["intensity"] != y["intensity"], penalty).otherwise(0)


def spo_nibble_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """struct of subject, predicate, object, their total, and the total by the largest that there is."""
    each = {k: nibble_distance(a[k], b[k]) for k in ("subject", "predicate", "object")}
    total = each["subject"] + each["predicate"] + each["object"]
    size = F.size(a["subject"]) + F.size(a["predicate"]) + F.size(a["object"])
    return F.struct(*(d.alias(k) for k, d in each.items()), total.alias("total"), (total / (F.lit(float(LEVELS)) * size)).alias("normalized"))


def hamming_sweep(record: Column, asked: Column, threshold: int) -> tuple[Column, Column]:
    """(distance, whether it is below the threshold): a step of a pipeline over records."""
    d = hamming(record, asked)
    return d.cast("long"), d < threshold


def meta_filter(words: Column, place: int, mask: int, expected: int) -> tuple[Column, Column]:
    """(0, whether a word, counted from 0, is as expected under a mask)."""
    return F.lit(0).cast("long"), F.get(words, F.lit(place)).bitwiseAND(F.lit(mask)) == expected


def vector_dot(record: Column, asked: Column) -> tuple[Column, Column]:
    """(dot product, true)."""
    return dot(record, asked), F.lit(True)


def edge_bind(src: Column, rel: Column, dst: Column) -> Column:
    """An edge of three words lists: XOR of the source, the relationship turned left by one bit, and the target turned
    left by two."""
    return bind(bind(src, F.transform(rel, lambda w: _turned(w, 1))), F.transform(dst, lambda w: _turned(w, 2)))


def edge_unbind(edge: Column, src: Column, rel: Column) -> Column:
    """The target of a bound edge, given the other two."""
    rest = bind(bind(edge, src), F.transform(rel, lambda w: _turned(w, 1)))
    return F.transform(rest, lambda w: _turned(w, 62))


def _turned(word: Column, by: int) -> Column:
    """A long's bits turned left."""
    return F.shiftleft(word, by).bitwiseOR(F.shiftrightunsigned(word, 64 - by))


def sweep(df: DataFrame, steps: list[tuple[Column, Column]]) -> DataFrame:
    """The rows that pass every step (score, passed), with their scores: score_0, score_1 … A step is looked at only where
    those before it passed."""
    for k, (score, passed) in enumerate(steps):
        df = df.withColumn(f"score_{k}", score).where(passed)
    return df


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two lists of integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bind(a: Column, b: Column) -> Column:
    """XOR, word by word: bind(bind(a, b), b) is a."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def top_k(df: DataFrame, score: Column, k: int, *ties: str, largest: bool = True) -> DataFrame:
    """The k best rows, as a top-k without a full sort."""
    return df.withColumn("score", score).orderBy(F.desc("score") if largest else F.asc("score"), *ties).limit(k)


def top_k_each(df: DataFrame, by: str, score: Column, k: int, *ties: str, largest: bool = True) -> DataFrame:
    """The k best rows of each key; Spark keeps k of each in a partition before it exchanges them."""
    best = Window.partitionBy(by).orderBy(F.desc("score") if largest else F.asc_nulls_last("score"), *ties)
    return df.withColumn("score", score).withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k).drop("_place")
