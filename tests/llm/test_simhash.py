import re

import numpy as np
import pytest
import xxhash

from vertexloom.llm.common import connected_components
from vertexloom.llm.simhash import fingerprint_batch, node_pairs, simhash_groups, trie_cut, trie_links

SCHEMA = "doc_id long, text string, fp string"


def brute_print(text, width=3):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, f"{fps[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows))


def test_fingerprints_equal_brute_force():
    texts = ["", "  ", "One", "One two", "a b c", "AÉ b\x0bc d\x1ce f g h i", "x " * 50, None, "ß ÀB c d e"]
    got = fingerprint_batch([t.encode() if t is not None else None for t in texts], 3)
    assert [int(x) for x in got] == [brute_print(t) for t in texts]


@pytest.mark.parametrize("budget", [0, 3, 5])
def test_trie_links_equal_all_pairs(budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**64, 60, np.uint64)
    near = base[rng.integers(0, 60, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    a = np.unique(np.concatenate([base, near, np.array([0, 1, 2**64 - 1], np.uint64)]))
    b = np.unique(near[:40] ^ np.uint64(5))
    for x, y, same in ((a, a, True), (a, b, False)):
        got = {(int(i), int(j)) for ia, ib in trie_links(x, y, budget, same, block=64) for i, j in zip(ia, ib, strict=True)}
        want = {(i, j) for i in range(len(x)) for j in range(i + 1 if same else 0, len(y)) if int(x[i] ^ y[j]).bit_count() <= budget}
        assert got == want


def test_cut_covers_and_pairs_keep_near_nodes():
    counts = {p: 1 for p in range(0, 1 << 16, 37)} | {5: 10**6}
    nodes = trie_cut(counts)
    assert all(any(p >> (16 - d) == q for d, q in nodes) for p in counts)
    assert max(d for d, _ in nodes) == 16
    pairs = node_pairs(nodes, 3)
    assert all(i in p for i, p in enumerate(pairs))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {500: 500, 501: 500}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        text = list(rng.choice(words, 300))
        for j in range(int(rng.integers(1, 5))):
            rows.append((i * 10 + j, " ".join(text)))
            text[int(rng.integers(0, 300))] = "changed"
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "one"), (904, "one"), (905, "long " * 30000)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(df).collect())
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    got = simhash_groups(spark.createDataFrame([(None, "a b c d", ""), (3, "a b c d", "")], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 3), (True, 3)]


def test_scratch_is_cleared(spark):
    from vertexloom.llm.common import clear_scratch, discard, staged

    clear_scratch(spark)
    one, two = staged(spark.range(3), "one"), staged(spark.range(4), "two")
    assert two.count() == 4
    discard(one)
    assert clear_scratch(spark) == 1 and clear_scratch(spark) == 0


def test_batches_are_bounded(spark):
    from vertexloom.llm.common import BATCH_BYTES, bounded_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, want in (("64m", str(BATCH_BYTES)), ("1m", "1m")):
        spark.conf.set(name, given)
        bounded_batches(spark)
        assert spark.conf.get(name) == want
    spark.conf.unset(name)
