import numpy as np

from vertexloom.llm.nearcopies import near_copy_groups, similar_groups

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}


def brute(rows, least=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, low[find(i)]) for i, (d, _) in enumerate(rows)]


def ids_of(df):
    return sorted((r.doc_id, r.component_id) for r in near_copy_groups(df).collect())


def test_near_copies_are_found_and_others_left(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(4000)] + ["the", "of", "and"] * 300
    rows = []
    for d in range(120):
        words = rng.choice(vocab, int(rng.integers(60, 400))).tolist()
        rows.append((d, " ".join(words)))
        if d % 3 == 0:
            copy = list(words)
            for _ in range(max(1, len(words) // 70)):
                copy[int(rng.integers(0, len(copy)))] = "changed"
            rows.append((1000 + d, " ".join(copy)))
        if d % 10 == 1:
            rows.append((2000 + d, " ".join(words[: len(words) // 2] + rng.choice(vocab, len(words) // 2).tolist())))
    rows += [(5000, None), (5001, " "), (5002, "one word"), (5003, "one word"), (5003, "one word"), (5004, "other words")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(4)
    got = ids_of(df)
    want, sure = sorted(brute(rows)), dict(brute(rows, 0.7))
    assert len(got) == len(rows)
    assert all(c == w or c == sure[d] for (d, c), (_, w) in zip(got, want, strict=True)) or sum(g != w for g, w in zip(got, want, strict=True)) <= 2
    assert near_copy_groups(df.limit(0)).count() == 0


def test_the_similarity_itself_decides(spark, monkeypatch):
    """Texts of one base with more and more words changed at the end: linked from 0.8 on, not at 0.79."""
    from vertexloom.llm import nearcopies

    rng = np.random.default_rng(3)
    rows, want = [], []
    for d in range(60):
        words = [f"v{x}" for x in rng.integers(0, 10**6, 304)]
        # 300 shingles, of which k change: similarity (300 - k) / (300 + k); k = 33 gives 0.802, k = 36 gives 0.786
        for i, k in enumerate((0, 33 if d % 2 else 36)):
            rows.append((1000 * i + d, " ".join(words[: len(words) - k] + [f"c{d}-{x}" for x in range(k)])))
            want.append((rows[-1][0], d if d % 2 or not i else rows[-1][0]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (1 << 20, 200):
        monkeypatch.setattr(nearcopies, "BLOCK_GRAMS", block)
        got = ids_of(df)
        wrong = [g for g, w in zip(got, sorted(want), strict=True) if g != w]
        assert not [g for g in wrong if g[1] != g[0]]  # none linked below 0.8
        assert len(wrong) <= 1


def all_pairs(sets):
    near = np.array([[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets])
    root = np.arange(len(sets))
    for _ in range(len(sets)):
        root = np.where(near, root[None], len(sets)).min(1)
    return near, root


def test_sets_equal_all_pairs():
    rng = np.random.default_rng(4)
    base = [rng.choice(10**6, 50, replace=False) for _ in range(12)]
    sets = []
    for _ in range(300):
        own = base[int(rng.integers(0, 12))].copy()
        own[rng.choice(50, int(rng.integers(0, 10)), replace=False)] = rng.integers(10**6, 2 * 10**6, 1)[0]
        sets.append(np.unique(own))
    near, root = all_pairs(sets)
    # Groups known before: each set by itself, or some already tied to one that they link with.
    tied = np.array([int(np.flatnonzero(near[i])[0]) if i % 3 else i for i in range(300)])
    tied = np.unique(np.array([tied[t] for t in tied]), return_inverse=True)[1]
    for group in (np.arange(300), tied):
        got = similar_groups(np.concatenate(sets), np.array(list(map(len, sets))), group)[group]
        assert all(len(set(got[root == r])) == 1 for r in np.unique(root)) and len(set(got)) == len(set(root))
    side = np.arange(300) % 2
    got = similar_groups(np.concatenate(sets), np.array(list(map(len, sets))), np.arange(300), side)
    half = np.where(near & (side[:, None] != side[None]), 1, 0) | np.eye(300, dtype=int)
    want = np.arange(300)
    for _ in range(300):
        want = np.where(half, want[None], 300).min(1)
    assert all(len(set(got[want == r])) == 1 for r in np.unique(want)) and len(set(got)) == len(set(want))


def test_a_chain_within_a_band_is_followed(spark, monkeypatch):
    """Texts of one template that part more and more: the first and the last are linked through those between only, and
    most share a band with a text that they aren't linked to."""
    from vertexloom.llm import nearcopies

    rng = np.random.default_rng(6)
    rows, want = [], []
    for t in range(8):
        words = [f"t{t}w{x}" for x in range(400)]
        for step in range(12):
            rows.append((int(rng.integers(0, 10**6)), " ".join(words)))
            for k in range(20):  # at the end, so that a step changes about 24 of 396 shingles
                words[(20 * step + k) % 400] = f"t{t}n{step}x{k}"
    want = sorted(brute(rows))
    df = spark.createDataFrame([(d, x, "") for d, x in rows], SCHEMA).repartition(4)
    for block in (1 << 20, 900):
        monkeypatch.setattr(nearcopies, "BLOCK_GRAMS", block)
        assert ids_of(df) == want


def test_null_ids_repeated_ids_and_long_texts(spark):
    long = " ".join(f"l{k}" for k in range(60_000))
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "only here"), (None, "only here"), (4, long), (2, long + " more"), (7, "x"), (7, "y"), (7, "y"), (8, None), (9, "")]
    got = near_copy_groups(spark.createDataFrame([(d, t, "z") for d, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, 3), (3, 3), (None, None), (None, None), (4, 2), (2, 2), (7, 7), (7, 7), (7, 7), (8, 8), (9, 8)], key=str)
    assert len({(r.component_id, r.component_key) for r in got}) == 6
