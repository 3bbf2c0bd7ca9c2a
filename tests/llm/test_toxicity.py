import numpy as np
from pyspark.sql import functions as F

from vertexloom.llm.common import crc32_text
from vertexloom.llm.toxicity import DECAY, SLOTS, SPAN, P, chunks_of, fit_words, kernel_rows, letters_of, score_texts, slots, subsequences, train

SCHEMA = "doc_id long, text string, score string"


def brute_kernel(x, y):
    from itertools import combinations

    def count(word):
        word, out = f"^{word}", {}
        for c in combinations(range(len(word)), P):
            if c[-1] - c[0] < SPAN:
                u = "".join(word[i] for i in c)
                out[u] = out.get(u, 0) + DECAY ** (c[-1] - c[0] + 1 - P)
        return out

    a, b = count(x), count(y)
    return sum(v * b.get(u, 0) for u, v in a.items())


def test_kernel_equals_enumeration():
    words = ["idiot", "idxiot", "moron", "scum", "an", "", "loweischaft", "loweient"]
    used = np.unique(slots(subsequences(words)[1]))
    place = np.full(1 << SLOTS, -1)
    place[used] = np.arange(len(used))
    rows = kernel_rows(words, place, len(used)).astype(float)
    who, _, weight = subsequences(words)
    norm = np.maximum(np.sqrt(np.bincount(who, weight**2, len(words))), 1e-9)
    got = rows @ rows.T * norm[:, None] * norm[None]
    assert np.allclose(got, [[brute_kernel(x, y) for y in words] for x in words], atol=1e-3)


def test_chunks():
    assert chunks_of("An i d i o t, now now") == ["an", "idiot,", "now", "now"]
    assert letters_of("i-d.i*o7t") == "idiot" and letters_of("stuuuupid!") == "stuupid" and letters_of("123") == ""


def test_inserted_letters_and_common_words():
    clean = {w: 0.2 for w in ["the", "student", "stapled", "order", "pathway", "ordinary", "placement", "station"]}
    model = fit_words({1: {"stupid": 0.3, "pathetic": 0.3, "moron": 0.2, "the": 0.05}, 0: clean})
    value = dict(zip(words := ["stupid", "stxupid", "stuqpid", "stupzid", "pathvetic", "moyron", "the", "student", "pathway"], model.margins(words), strict=True))
    assert min(value[w] for w in words[:6]) > 0 > max(value[w] for w in words[6:])


def test_held_out_accuracy_and_edges(spark):
    rng = np.random.default_rng(0)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda: "".join(rng.choice(parts, int(rng.integers(1, 5))))
    rows, labels = [], []
    for d in range(1500):
        toxic = int(rng.random() < 0.3)
        words = [word() for _ in range(int(rng.integers(5, 150)))]
        for _ in range(toxic * int(rng.integers(1, 4))):
            bad = rng.choice(["idiot", "moron", "stupid", "scum", "lowei" + word()])
            words.insert(int(rng.integers(0, len(words))), "-".join(bad) if rng.random() < 0.1 else bad)
        rows.append((d, " ".join(words)))
        labels.append((d, toxic))
    rows += [(5000, None), (5001, ""), (5002, "123 !!"), (None, "you idiot"), (5003, ("there " * 30 + "moron ") * 2000), (5005, "there " * 60_000), (5004, "x"), (5004, "x")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(3)
    frame = spark.createDataFrame([*labels, (77, None), (None, 1)], "doc_id long, toxic int")
    held = crc32_text("doc_id") % 3 == 1
    model = train(docs, frame, ~held)
    got = score_texts(docs, model).select("doc_id", held.alias("held"), "score", "predicted").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = dict(labels)
    pairs = [(r.predicted, truth[r.doc_id]) for r in got if r.held and r.doc_id in truth]
    assert len(pairs) > 300 and sum(p == y for p, y in pairs) >= 0.98 * len(pairs)
    by = {r.doc_id: r.predicted for r in got}
    assert (by[5000], by[5001], by[5002], by[None], by[5003], by[5004], by[5005]) == (0, 0, 0, 1, 1, 0, 0)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "")], SCHEMA)
    model = train(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert score_texts(docs, model).first().predicted == 0
    assert score_texts(docs.limit(0), model).count() == 0


def test_held_out_texts_of_the_tables(spark):
    """More than nine in ten toxic texts are found, and less than two in a hundred others are rejected; labels of a few
    texts are noise."""
    from vertexloom.llm.queries import QUERIES

    data = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = QUERIES["op10_subsequence_svm"](spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    toxic = [p for p, y in held if y]
    assert sum(toxic) > 0.9 * len(toxic)
    assert sum(p for p, y in held if not y) < 0.02 * (len(held) - len(toxic))


def test_one_label_only(spark):
    docs = spark.createDataFrame([(1, "a b", ""), (2, None, "")], SCHEMA)
    for y in (0, 1):
        model = train(docs, spark.createDataFrame([(1, y)], "doc_id long, toxic int"), F.lit(True))
        assert {r.predicted for r in score_texts(docs, model).collect()} == {y}
