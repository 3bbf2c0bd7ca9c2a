import numpy as np

from vertexloom.llm.decontam import Items, budget_of, edit_distance, find_leaks, word_blocks, words_of

SCHEMA = "doc_id long, text string, item_id string"


def least(item, words):
    """Least edit distance of the item to any run of the words."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_distance_equals_the_table():
    rng = np.random.default_rng(0)
    for _ in range(300):
        item, words = rng.integers(1, 5, rng.integers(1, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 30)).tolist()
        bits = {}
        for k, w in enumerate(item):
            bits[w] = bits.get(w, 0) | 1 << k
        assert edit_distance(bits, len(item), words)[0] == least(item, words)


def test_blocks_hold_all_words():
    text = " ".join(f"w{i}" for i in range(500))
    got = {}
    for first, words in word_blocks(text, 20, 64):
        got |= {first + i: w for i, w in enumerate(words)}
    assert [got[i] for i in range(500)] == text.split()


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = ["the", "of", "a"] * 8 + [f"v{i}" for i in range(300)]
    prose = lambda n: rng.choice(vocab, n).tolist()
    items = [(i, prose(int(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 12, 20, 40, 40, 55, 80])]
    rows = []
    for d in range(150):
        words = prose(int(rng.integers(0, 120)))
        if d % 2:
            part = list(items[int(rng.integers(4, len(items)))][1])
            for _ in range(int(rng.integers(0, 1 + len(part) // 4))):
                p = int(rng.integers(0, len(part)))
                part[p : p + 1] = [[], ["zz"], [part[p], "yy"]][rng.integers(0, 3)]
                part = part or ["x"]
            p = int(rng.integers(0, len(words) + 1))
            words[p:p] = part
        rows.append((d, " ".join(w.upper() + "," if rng.random() < 0.2 else w for w in words)))
    rows += [(900, None), (901, ""), (902, " ".join(prose(30_000) + items[9][1] + prose(3000))), (1, rows[1][1]), (903, " ".join(items[11][1][3:]))]
    table = [(f"i{i}", " ".join(w)) for i, w in items] + [("null", None), ("none", "...")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(3)
    want = []
    for d, t in rows:
        for i, w in items:
            n = least(w, words_of(t))
            if n <= budget_of(len(w), 0.8):
                want.append((d, f"i{i}", n))
    frame = spark.createDataFrame(table, "item_id string, text string")
    for item_bytes in (8 << 20, 300):
        got = sorted((r.doc_id, r.item_id, r.distance) for r in find_leaks(df, frame, item_bytes=item_bytes).collect())
        assert set(got) <= set(want)
        assert len(got) >= 0.99 * len(want)
    assert find_leaks(df.limit(0), frame).count() == 0 and find_leaks(df, frame.limit(0)).count() == 0


def test_recall_of_the_tables_alone():
    """Passages at the very budget of a fifth: how many some table proposes, at a start within the edits."""
    rng = np.random.default_rng(2)
    vocab = ["the", "of", "a", "to"] * 30 + [f"v{i}" for i in range(2000)]
    items = [rng.choice(vocab, int(n)).tolist() for n in rng.integers(8, 90, 200)]
    ready = Items([(i, " ".join(w)) for i, w in enumerate(items)], 0.8)
    found = 0
    for i, w in enumerate(items):
        part, budget = list(w), budget_of(len(w), 0.8)
        for _ in range(budget):
            p = int(rng.integers(0, len(part)))
            part[p : p + 1] = [[], ["zz"], [part[p], "yy"]][rng.integers(0, 3)]
        text = [*rng.choice(vocab, 50).tolist(), *part, *rng.choice(vocab, 50).tolist()]
        ids = np.array([ready.ids.get(x, 0) for x in text] + [0] * 64)
        item, place = ready.propose(ids)
        found += bool((np.abs(place[item == i] - 50) <= budget).any())
    assert found >= 0.97 * len(items)
    # Unrelated text: few places are proposed, and none stands.
    other = rng.choice(vocab, 20_000).tolist()
    assert len(ready.propose(np.array([ready.ids.get(x, 0) for x in other] + [0] * 64))[0]) < 200_000
    assert ready.match([other]) == [{}]


def test_long_items_ids_of_other_kinds_and_nulls(spark):
    import resource

    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(5000)]
    long = rng.choice(vocab, 50_000).tolist()
    short = [rng.choice(vocab, 40).tolist() for _ in range(200)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ready = Items([(0, " ".join(long)), *((k + 1, " ".join(w)) for k, w in enumerate(short))], 0.8)
    cut = [w for k, w in enumerate(long) if k % 10]
    assert [sorted(x) for x in ready.match([cut, short[3], short[5] + short[6]])] == [[0], [4], [6, 7]]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10  # KB
    docs = spark.createDataFrame([(None, " ".join(short[1]), 5), (2, None, 5), (None, " ".join(cut), 6)], "doc_id short, text string, text_key int")
    items = spark.createDataFrame([(7, " ".join(short[1])), (None, " ".join(long)), (9, None)], "item_id int, text string")
    got = find_leaks(docs, items)
    assert dict(got.dtypes)["item_id"] == "int" and dict(got.dtypes)["doc_id"] == "smallint"
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got.collect()), key=str) == [(None, 7, 0), (None, None, 5000)]
