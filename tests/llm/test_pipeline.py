import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_bytebpe import brute as brute_ids
from tests.llm.test_decontam import least
from tests.llm.test_nearcopies import brute as brute_groups
from vertexloom.llm.decontam import words_of

pipeline = pytest.importorskip("corpus_pipeline")
BAD = ["idiot", "moron", "stupid", "pathetic"]


def brute(docs, items):
    rows = [(d, t or "") for d, t in docs if not set(words_of(t)) & set(BAD)]
    keep = {c for _, c in brute_groups(rows)}
    rows = [(d, t) for d, t in rows if d in keep]
    from collections import Counter

    from vertexloom.llm.suffixes import covered

    seen = Counter(t.encode()[i : i + 200] for _, t in rows for i in range(len(t.encode()) - 199))
    cut = []
    for d, t in rows:
        b = t.encode()
        at, kept = 0, b""
        for lo, hi in covered([(i, i + 200) for i in range(len(b) - 199) if seen[b[i : i + 200]] > 1]):
            kept, at = kept + b[at:lo], hi
        cut.append((d, (kept + b[at:]).decode(errors="ignore")))
    clean = [(d, t) for d, t in cut if all(least(words_of(i), words_of(t)) > len(words_of(i)) // 5 for _, i in items)]
    return brute_ids(clean)


def test_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(0)
    parts = ["th", "er", "on", "an", "re", "hé", "in", "ed", "nd", "ha", "at", "en"]
    prose = lambda n: [("".join(rng.choice(parts, int(rng.integers(2, 6))))) for _ in range(n)]
    items = [(i, " ".join(prose(30))) for i in range(5)]
    passage = " ".join(prose(70))
    docs, labels = [], []
    for d in range(300):
        words, toxic = prose(int(rng.integers(20, 200))), int(rng.random() < 0.3)
        if toxic:
            words.insert(3, str(rng.choice(BAD)))
        if d % 10 == 1:
            words.insert(10, passage)
        if d % 25 == 2:
            words.insert(10, items[d % 5][1])
        docs.append((d, " ".join(words)))
        labels.append((d, toxic, toxic))
        if d % 20 == 3:
            docs.append((1000 + d, " ".join(words)))
    docs += [(2000, None), (2001, "")]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(docs, items)


def test_stages_keep_columns_and_stand_empty_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(None, None, None, None, None), (None, "a b", None, None, 3), (1, "x" * 500, "en", "s", 500)]):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                assert dict(out.dtypes) == dict(docs.dtypes)
            assert out.count() == len(rows), name
    assert docs.where(F.col("doc_id").isNull()).count() == 2


def test_near_dedup_keeps_every_text_of_an_id(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, _scratch map<string,int>"
    rows = [(1, "one two three four five six", "en", "s", 1, {"a": 1}), (1, "other words than those before", "en", "s", 1, None), (1, "one two three four five six", "en", "s", 1, {"a": 2}), (2, "one two three four five six", "de", "s", 1, None)]
    rows += [(None, "other words than those before", None, None, None, None), (None, "alone", None, None, None, None), (None, "alone", None, None, None, None), (3, None, None, None, None, None), (4, "", None, None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    out = pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, "one two three four five six"), (1, "other words than those before"), (None, "alone"), (3, None)], key=str)


def test_very_long_texts_go_through_all_stages(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocab = [f"w{k}" for k in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    item, passage = prose(40), prose(80)
    long = prose(120_000)
    docs = [(1, long), (2, long + " " + prose(500)), (3, prose(90_000) + " " + item + " " + prose(10)), (4, prose(50_000) + " " + passage), (5, passage + " " + prose(30))]
    docs += [(10 + k, prose(50) + (" idiot moron" if k % 3 == 0 else "")) for k in range(60)]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d >= 10 and d % 3 == 1)) for d, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.n_tokens for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 4, 5, *(10 + k for k in range(60) if k % 3)}
    whole = {r.doc_id: r.n_tokens for r in pipeline.encode(spark, frame, "").collect()}
    assert got[1] == whole[1] and got[4] < whole[4] and got[5] < whole[5]
