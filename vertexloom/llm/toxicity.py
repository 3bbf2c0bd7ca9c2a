"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words counts their common subsequences of P letters, a subsequence that spans s letters weighing
DECAY^(s - P), spans up to SPAN; letters inserted into an insult, or left between its letters, cost weight but don't
break the match. Words start with a mark, so that word beginnings count as such. Landmarks, words of the training texts,
give a word the features K(word, landmarks) · K(landmarks, landmarks)^(-1/2), on which a linear SVM is trained. A text
is a bag of words; its score is a logistic function of how large a share of its words is on the toxic side, and how far.

Which words make a text toxic isn't labelled. Training starts with the Fisher discriminant of the texts' means in the
kernel's feature space (its covariance taken as diagonal), and goes on in rounds: under the classifier so far, the worst
words of toxic texts are positive examples, those of clean texts negative ones, each by the share of texts that has it,
so that a word of both counts on both sides; the SVM over them is the next classifier. Texts stay in Spark: the driver
gets sums, a few words of each text, and shares.

As the classifier is linear in the subsequences, it is kept as one weight for each subsequence of the landmarks, and
scoring reads whole texts in arrays.
"""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, staged, text_slices

P, SPAN, DECAY = 4, 6, 0.6
#: The score from which a text counts as toxic.
BOUND = 0.7
#: Training texts at most of each label (those of the smallest hashes), landmarks at most, rounds, the worst words and
#: other words of a text that are examples, and the share below which shares of toxic words count alike.
TEXTS, LANDMARKS, ROUNDS, WORST, OTHERS, LEAST_SHARE = 2000, 400, 3, 8, 3, 0.002
#: Bits of the table of subsequence weights, and of the sums that the discriminant is made of.
SLOTS, SUM_SLOTS = 22, 18
_OFFSETS = [(0, *c) for c in combinations(range(1, SPAN), P - 1)]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LETTERS = re.compile(r"[^\W\d_]+")
_STRETCHED = re.compile(r"(.)\1{2,}")
_LONE = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S[^\w\s]*(?!\S)")


def chunks_of(text: str) -> list[str]:
    """The lower-case chunks between white space; characters that stand alone in a row are one."""
    return _LONE.sub(lambda m: re.sub(r"\s+", "", m[0]), text.lower()).split()


def letters_of(chunk: str) -> str:
    """Its letters; one that comes more than twice in a row comes twice."""
    return _STRETCHED.sub(r"\1\1", chunk if chunk.isalpha() else "".join(_LETTERS.findall(chunk)))


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hash, weight) of each subsequence of the words, and of each word's mark."""
    flat = np.frombuffer("".join(f"^{w}" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    own = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # letters up to the word's end
    who, key, weight = [], [], []
    for offsets in _OFFSETS:
        at = np.flatnonzero(room > offsets[-1])
        h = flat[at]
        for k in offsets[1:]:
            h = h * _MIX[0] + flat[at + k]
            h ^= h >> np.uint64(29)
        who.append(own[at])
        key.append(h * _MIX[1])
        weight.append(np.full(len(at), DECAY ** (offsets[-1] + 1 - P)))
    return np.concatenate(who), np.concatenate(key), np.concatenate(weight)


def slots(keys: np.ndarray, bits: int = SLOTS) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


class Model:
    """A weight for each subsequence and a bias, which give a word's margin: the weighted sum over its subsequences, by the
    norm of their weights. A text's score is logistic in the logarithm of its share of toxic words."""

    def __init__(self, table: np.ndarray, bias: float, scale: float = 1.0, shift: float = -3.0):
        self.table, self.bias, self.scale, self.shift = table.astype(np.float32, copy=False), bias, scale, shift
        self.bits = len(table).bit_length() - 1

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for k in range(0, len(words), 5_000):
            part = words[k : k + 5_000]
            who, key, weight = subsequences(part)
            top = np.bincount(who, self.table[slots(key, self.bits)] * weight, len(part))
            norm = np.sqrt(np.bincount(who, weight**2, len(part)))
            out[k : k + 5_000] = np.where(norm > 0, top / np.maximum(norm, 1e-9), 0.0) + self.bias
        return out

    def scores(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * np.log(share + LEAST_SHARE) + self.shift, -40, 40)))


class Reader:
    """Remembers words' margins for the texts of a task."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def margins(self, bags: list[list[str]]) -> list[np.ndarray]:
        """Of each chunk the margin of its letters; minus infinity without letters."""
        known = self.known
        if len(known) > 150_000:
            known.clear()
        new = sorted({w for b in bags for w in b if w not in known})
        letters = [letters_of(w) for w in new]
        known |= zip(new, np.where(np.array(list(map(len, letters)), np.int64) > 0, self.model.margins(letters), -np.inf).tolist(), strict=True)
        return [np.fromiter(map(known.__getitem__, b), float, len(b)) for b in bags]

    def shares(self, bags: list[list[str]]) -> np.ndarray:
        """Of each text the mean of its words' margins, cut to 0 … 1; 0 without words."""
        return np.array([np.clip(m, 0, 1).sum() / max(1, np.count_nonzero(m > -np.inf)) for m in self.margins(bags)])


def kernel_rows(words: list[str], place: np.ndarray, width: int) -> np.ndarray:
    """Words by subsequences, normed. place: each slot's column, -1 for none."""
    out = np.zeros((len(words), width), np.float32)
    who, key, weight = subsequences(words)
    norm = np.sqrt(np.bincount(who, weight**2, len(words)))
    at = place[slots(key)]
    hit = at >= 0
    np.add.at(out, (who[hit], at[hit]), weight[hit] / np.maximum(norm[who[hit]], 1e-9))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, by Nesterov's accelerated gradient; the last column of
    x is one. In single precision, without copies of x."""
    sign = np.where(y, 1, -1).astype(np.float32)
    cost = cost.astype(np.float32)
    gram = sum((x[k : k + 2_000] * cost[k : k + 2_000, None]).T @ x[k : k + 2_000] for k in range(0, len(x), 2_000))
    step = np.float32(1 / (1 + 2 * np.linalg.eigvalsh(gram.astype(np.float64))[-1]))
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(np.float32(0), 1 - sign * (x @ v))
        new = v - step * (v - 2 * ((cost * sign * slack) @ x))
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1].astype(np.float64), float(w[-1])


def bag_sums(bags: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Over texts: the sums, and those of squares, of their means in the kernel's feature space, by slot."""
    total, square = np.zeros(1 << SUM_SLOTS), np.zeros(1 << SUM_SLOTS)
    for bag in bags:
        words, n = np.unique(np.array([w for w in map(letters_of, bag) if w], object), return_counts=True)
        if not len(words):
            continue
        who, key, weight = subsequences(words.tolist())
        norm = np.sqrt(np.bincount(who, weight**2, len(words)))
        at, back = np.unique(slots(key, SUM_SLOTS), return_inverse=True)
        mean = np.bincount(back, weight * n[who] / np.maximum(norm[who], 1e-9)) / n.sum()
        total[at] += mean
        square[at] += mean**2
    return total, square


def discriminant(sums: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """From (texts, sums, sums of squares) of labels 0 and 1, the Fisher discriminant with a diagonal covariance; slots that
    vary less than nearly all are shrunk."""
    mean = {y: total / n for y, (n, total, _) in sums.items()}
    spread = sum(square / n - mean[y] ** 2 for y, (n, _, square) in sums.items())
    usual = float(np.quantile(spread[spread > 0], 0.99)) if (spread > 0).any() else 1.0
    return Model((mean[1] - mean[0]) / (spread + usual), 0.0)


def examples(bags: list[list[str]], labels: list[int], reader: Reader) -> list[tuple[int, str, float]]:
    """(label, word, weight): the worst words of each text, of toxic ones those about as bad as the worst, and of clean
    ones a few others."""
    out = []
    for bag, y, value in zip(bags, labels, reader.margins(bags), strict=True):
        margin = {letters_of(w): v for w, v in zip(bag, value.tolist(), strict=True) if v > -np.inf}
        worst = sorted(margin, key=lambda w: (-margin[w], w))[:WORST]
        if y:
            worst = [w for w in worst if margin[w] >= 0.5 * margin[worst[0]]]
            out += [(1, w, 1 / len(worst)) for w in worst]
        else:
            out += [(0, w, 1.0) for w in worst]
            out += [(0, w, 0.3) for w in sorted(margin, key=lambda w: (zlib.crc32(w.encode()), w))[:OTHERS]]
    return out


def variants(word: str) -> list[str]:
    """The word with one letter, picked by hash, put in at each inner place: still the same insult."""
    return [word[:k] + chr(97 + zlib.crc32(f"{word}{k}".encode()) % 26) + word[k:] for k in range(1, len(word))]


def fit_words(weights: dict[int, dict[str, float]], before: Model | None = None, landmarks: int = LANDMARKS) -> Model:
    """The SVM over weighted examples {label: {word: weight}}. Landmarks are the words that speak most for each label, and
    the words of clean texts that the classifier before takes for the worst."""
    pos, neg = weights[1], weights[0]
    every = sorted({*pos, *neg})
    gain = {w: pos.get(w, 0.0) - neg.get(w, 0.0) for w in every}
    margin = {} if before is None else dict(zip(clean := sorted(neg), before.margins(clean).tolist(), strict=True))
    wrong = sorted((w for w in margin if gain[w] < 0), key=lambda w: (-margin[w], w))[: landmarks // 4]
    marks = list(dict.fromkeys([*sorted(every, key=lambda w: (-gain[w], w))[: landmarks // 2], *wrong, *sorted(neg, key=lambda w: (-neg[w], w))[: landmarks // 4]]))
    used = np.unique(slots(subsequences(marks)[1]))
    place = np.full(1 << SLOTS, -1, np.int32)
    place[used] = np.arange(len(used))
    basis = kernel_rows(marks, place, len(used))
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    good = values > 1e-5 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    more = {v: 0.5 * pos[w] / max(1, len(w) - 1) for w in pos if gain[w] > 0 for v in variants(w)}
    rows = [(w, 1, x) for w, x in pos.items()] + [(w, 0, x) for w, x in neg.items()] + [(w, 1, x) for w, x in sorted(more.items()) if w not in gain]
    words, y, cost = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x = np.ones((len(words), root.shape[1] + 1), np.float32)
    for k in range(0, len(words), 200):  # Nyström features
        x[k : k + 200, :-1] = (kernel_rows(words[k : k + 200], place, len(used)) @ basis.T) @ root
    for label in (0, 1):
        cost[y == label] *= len(words) / (2 * cost[y == label].sum())
    w, bias = linear_svm(x, y, cost)
    table = np.zeros(1 << SLOTS, np.float32)
    table[used] = basis.T @ (root @ w)
    return Model(table, bias)


def calibrate(share: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic function, by Newton steps; both labels count the same."""
    value = np.log(share + LEAST_SHARE)
    centre, width = value.mean(), value.std() + 1e-9
    ones, zeros = truth.sum(), len(truth) - truth.sum()
    cost = np.where(truth == 1, 0.5 / ones, 0.5 / zeros) * len(truth)
    x = np.stack([(value - centre) / width, np.ones(len(value))], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (cost * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, x.T @ (cost * (truth - p)) - 1e-2 * w), -2, 2)
    scale = max(float(w[0]), 1e-3) / width
    return scale, float(w[1]) - scale * centre


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", texts: int = TEXTS, rounds: int = ROUNDS) -> Model:
    """Fits on at most `texts` labelled texts of each label, those of the smallest hashes of their ids among the rows
    that `learn` picks; whole texts. Of rows with one id the least text counts, of several labels the larger. With one
    label only, or none, all texts score alike."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    ids = docs.where(learn & F.col(text_col).isNotNull()).select(id_col).distinct().join(known, id_col)
    chosen = [tuple(r) for y in (0, 1) for r in ids.where(F.col("label") == y).orderBy(F.xxhash64(id_col), id_col).limit(texts).collect()]
    n = {y: sum(1 for _, z in chosen if z == y) for y in (0, 1)}
    if not (n[0] and n[1]):
        return Model(np.zeros(2), 0.0, 0.0, 3.0 if n[1] else -3.0)
    kind = docs.schema[id_col].dataType.simpleString()
    few = F.broadcast(spark.createDataFrame(chosen, f"{id_col} {kind}, label int"))  # at most 2 * texts rows
    picked = docs.where(learn & F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text")).join(few, id_col)
    sample = staged(picked.groupBy(id_col, "label").agg(F.min("text").alias("text")).select("label", "text"), "labelled")

    def over(step, schema: str) -> DataFrame:
        """step: from texts' chunks and labels, and a task's state, to columns."""

        def run(batches):
            state = {}
            for batch in batches:
                for part in text_slices(batch, "text"):
                    yield step([chunks_of(t) for t in part.column("text").to_pylist()], part.column("label").to_pylist(), state)

        return sample.mapInArrow(run, schema)

    def sums(bags, ys, _):
        parts = []
        for y in set(ys):
            total, square = bag_sums([b for b, z in zip(bags, ys, strict=True) if z == y])
            at = np.flatnonzero(total)
            parts.append(pa.record_batch([pa.array(np.full(len(at), y, np.int32)), pa.array(at), pa.array(total[at]), pa.array(square[at])], ["label", "slot", "total", "square"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0]

    # At most 2 * 2^SUM_SLOTS rows.
    found = over(sums, "label int, slot long, total double, square double").groupBy("label", "slot").agg(F.sum("total").alias("total"), F.sum("square").alias("square")).toArrow()
    by_label = {}
    for y in (0, 1):
        own = found.column("label").to_numpy() == y
        columns = [np.zeros(1 << SUM_SLOTS), np.zeros(1 << SUM_SLOTS)]
        for column, name in zip(columns, ("total", "square"), strict=True):
            column[found.column("slot").to_numpy()[own]] = found.column(name).to_numpy()[own]
        by_label[y] = (n[y], *columns)
    model = discriminant(by_label)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def telling(bags, ys, state, shared=shared):
            rows = examples(bags, ys, state.setdefault("reader", Reader(shared.value)))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int32(), pa.string(), pa.float64()), strict=True)], ["label", "word", "weight"])

        # At most WORST + OTHERS words of a text.
        words = over(telling, "label int, word string, weight double").groupBy("label", "word").agg(F.sum("weight").alias("weight")).collect()
        weights = {y: {r.word: r.weight / n[y] for r in words if r.label == y} for y in (0, 1)}
        if not (weights[0] and weights[1]):
            break
        model = fit_words(weights, model)
    shared = spark.sparkContext.broadcast(model)

    def share(bags, ys, state):
        return pa.record_batch([pa.array(ys, pa.int32()), pa.array(state.setdefault("reader", Reader(shared.value)).shares(bags))], ["label", "share"])

    rows = over(share, "label int, share double").toArrow()
    discard(sample)
    order = np.lexsort((rows.column("share").to_numpy(), rows.column("label").to_numpy()))
    return Model(model.table, model.bias, *calibrate(rows.column("share").to_numpy()[order], rows.column("label").to_numpy()[order]))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = BOUND) -> DataFrame:
    """All columns of docs with score (0 to 1) and predicted (1 from the threshold on). Null, empty and wordless texts
    score as no toxic word at all does. A column score or predicted of docs is replaced. Repeated rows stay; an empty
    table gives an empty result."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("score", "predicted")
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            for part in text_slices(batch, text_col):
                score = shared.value.scores(reader.shares([chunks_of(t) if t else [] for t in part.column(text_col).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema.names)

    return plain.mapInArrow(run, schema)
