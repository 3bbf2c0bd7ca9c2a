import hashlib
from collections import Counter

import numpy as np

from vertexloom.llm.suffixes import anchors, common, covered, front_code, front_decode, merge_runs, suffix_dedup

SCHEMA = "doc_id long, text string, n_bytes long"


def brute(rows, length=200):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        spans = covered([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1])
        gone = sum(b - a for a, b in spans)
        kept = b"".join(t[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(t)], strict=True))
        out.append((d, len(t), gone, len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_anchors_hold_every_window_once():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 199, 200, 201, 5000)] + [b"a" * 700]
    own, at, first, last, _ = anchors(texts)
    got = Counter((int(d), w) for d, a, i, j in zip(own, at, first, last, strict=True) for w in range(i, j + 1))
    assert got == Counter((d, w) for d, t in enumerate(texts) for w in range(len(t) - 199))
    assert all(i <= a <= i + 168 and j <= a <= j + 168 for a, i, j in zip(at, first, last, strict=True))


def test_loser_tree_merges_and_knows_prefixes():
    rng = np.random.default_rng(1)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8)) for _ in range(rng.integers(0, 40))) for _ in range(k)]
        coded = [front_code(r) for r in runs]
        assert [front_decode(np.array(c, int), np.array([len(x) for x in r], int), t) for r, (c, t) in zip(runs, coded, strict=True)] == runs
        got = [(runs[r][i], n) for r, i, n in merge_runs([(r, c) for r, (c, _) in zip(runs, coded, strict=True)])]
        want = sorted(x for r in runs for x in r)
        assert [x for x, _ in got] == want
        assert [n for _, n in got] == [common(p, q, 0) for p, q in zip([b"", *want], want, strict=False)]


def test_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (45, 60, 130, 400)]
    rows = []
    for i in range(60):
        parts = [prose(int(rng.integers(0, 80)))]
        for _ in range(int(rng.integers(0, 3))):
            s = shared[rng.integers(0, 4)]
            a, b = sorted(rng.integers(0, len(s), 2))
            parts += [s[a:b], prose(int(rng.integers(0, 30)))]
        rows.append((i, "".join(parts)))
    near = prose(300)
    rows += [(100 + i, near[: 50 * i] + "#" + near[50 * i :]) for i in range(8)]
    rows += [(200, shared[3]), (201, shared[3]), (201, shared[3]), (202, None), (203, ""), (204, "x" * 199), (205, "x" * 199), (206, "ab" * 500), (207, "q" * 201)]
    rows += [(300, prose(5000) + shared[2] + prose(9000))]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA).repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect())
    assert got == brute(rows)


def test_hot_passages_are_dealt_out(spark, monkeypatch):
    """Passages that most texts have, whole, cut off or after one another; groups of at most a few suffixes."""
    from vertexloom.llm import suffixes

    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (50, 70, 140)]
    rows = []
    for i in range(90):
        s = shared[int(rng.integers(0, 3))]
        cut = int(rng.integers(0, len(s) // 2)) if i % 4 == 0 else 0
        rows.append((i, prose(int(rng.integers(0, 30))) + s[cut:] + ("" if i % 5 else s[: len(s) // 2]) + prose(int(rng.integers(0, 30)))))
    rows += [(500, rows[3][1]), (501, rows[3][1] + "!"), (502, "ab" * 900)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA).repartition(4)
    want = brute(rows)
    seen, deal = [], suffixes.deal_hot
    monkeypatch.setattr(suffixes, "deal_hot", lambda *a: seen.append(deal(*a)) or seen[-1])
    for hot in (6, 20):
        monkeypatch.setattr(suffixes, "HOT", hot)
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect())
        assert got == want
        rest = seen[-1][1].groupBy("key").count()
        assert 0 < rest.agg({"count": "max"}).first()[0] <= hot


def test_equal_hashes_are_not_enough():
    """Windows that share their right part and a hash of the left one, but not its bytes."""
    from vertexloom.llm import suffixes

    left = [b"abc" * 40, b"abd" * 40, b"abc" * 40]
    args = np.array([0, 150, 150]), np.array([150] * 3), left, np.array([60] * 3), np.array([50] * 3), 200
    who, off = suffixes.repeated_windows(*args)
    assert set(zip(who.tolist(), off.tolist(), strict=True)) == {(i, o) for i in (0, 2) for o in range(50, 61)}
    odd = suffixes._ODD.copy()
    suffixes._ODD[3] = 0  # every left part has one hash
    try:
        who, off = suffixes.repeated_windows(*args)
    finally:
        suffixes._ODD[:] = odd
    assert 1 not in who


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    from vertexloom.llm import suffixes

    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 6000).astype(np.uint8))
    text = (text + text[2000:2500] + text[:300]).decode()
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    own, at, first, last, h = anchors([b"", text.encode(), b"z" * 250])
    got = Counter((int(d), w) for d, i, j in zip(own, first, last, strict=True) for w in range(i, j + 1))
    assert got == Counter([(1, w) for w in range(len(text) - 199)] + [(2, w) for w in range(51)])
    df = spark.createDataFrame([(1, text, 0)], SCHEMA)
    assert sorted(tuple(r) for r in suffix_dedup(df).collect()) == brute([(1, text)])


def test_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r)[:4] for r in suffix_dedup(spark.createDataFrame([(None, None, 1)], SCHEMA)).collect()] == [(None, 0, 0, 0)]
