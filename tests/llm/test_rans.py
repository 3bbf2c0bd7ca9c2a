import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vertexloom.llm.rans import Block, Encoder, Table, encode_corpus, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start long"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70_001])
def test_blocks_round_trip_and_start_at_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 40_000).astype(np.uint32)
    table = Table.of({int(i): int(c) for i, c in zip(*np.unique(np.concatenate([ids, [5, 9]]), return_counts=True), strict=True)})
    assert int(table.freq.sum()) == 1 << 18
    for lanes, every in ((1024, 128), (7, 3), (1, 10)):
        data = table.encode(ids, lanes, every)
        assert np.array_equal(table.decode(data), ids)
        k, block = max(1, min(lanes, n // 64)) * every, Block(table, data)
        assert block.sections == -(-n // k)
        for j in range(block.sections - 1, -1, -1):  # each from its own checkpoint
            assert np.array_equal(Block(table, data).section(j), ids[j * k : (j + 1) * k])
        for at, size in ((0, n), (n // 3, n // 2), (n - 1, 1)) if n else ():
            assert np.array_equal(block.ids(at, size), ids[at : at + size])
    spoilt = bytearray(table.encode(ids))
    spoilt[len(spoilt) // 2] ^= 1
    with pytest.raises(ValueError):
        table.decode(bytes(spoilt))


def test_compresses():
    ids = np.minimum(np.random.default_rng(0).zipf(1.5, 200_000), 5000).astype(np.uint32)
    table = Table.of({int(i): int(c) for i, c in zip(*np.unique(ids, return_counts=True), strict=True)})
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(table.encode(ids)) < 1.25 * len(ids) * -(p * np.log2(p)).sum() / 8 + 200


def test_encoder_equals_the_library():
    rng = np.random.default_rng(1)
    whole = Tokenizer.from_file(PATH)
    chars = [chr(c) for c in range(0x260)] + ["́", "Σ", "漢", "😀", "<|endoftext|>", "'s", " ", " ", "İ", "the ", "é", "é"]
    texts = ["".join(rng.choice(chars, int(rng.integers(0, 60)))) for _ in range(1500)]
    latin = [chr(c) for c in [*range(9, 14), *range(32, 0x250)]] + ["'re ", "don't", " the"]
    texts += ["".join(rng.choice(latin, int(rng.integers(0, 80)))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "a<|EndOfText|>b", " <|startoftext|>", "<| endoftext |>", "x <|endoftext|>\u6f22"]
    got = Encoder(PATH).encode(texts)
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == want


def test_corpus(spark):
    rng = np.random.default_rng(2)
    rows = [(int(d), " ".join(rng.choice(["The", "cat's", "on", "é,", "12"], int(rng.integers(0, 90))))) for d in rng.permutation(60)]
    rows += [(100, None), (101, ""), (102, "very long " * 3000), (103, "twice"), (103, "twice"), (104, "a <|endoftext|> b")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA).repartition(3)
    enc = Tokenizer.from_file(PATH)
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for block in (1 << 18, 1000):
        got = encode_corpus(df, PATH, 2, block=block, keep_ids=True).collect()
        assert sorted(tuple(r)[:4] for r in got) == want
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert encode_corpus(df.limit(0), PATH, 2).count() == 0


def test_a_folder_is_all_that_reading_needs(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(d, " ".join(rng.choice(["red", "green,", "blue", "12"], 900))) for d in range(80)] + [(200, "long text " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    write_tokens(df, f"{tmp_path}/corpus", PATH, 2, block=30_000)
    enc = Tokenizer.from_file(PATH)
    want = {d: np.array([*enc.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for d, t in rows}
    other = spark.newSession()
    assert {r.doc_id: bytes(r.ids) for r in read_tokens(other, f"{tmp_path}/corpus", keep_ids=True).collect()} == want
    some = read_tokens(other, f"{tmp_path}/corpus", keep_ids=True, wanted=lambda d: d.isin(7, 200)).collect()
    assert {r.doc_id: bytes(r.ids) for r in some} == {d: want[d] for d in (7, 200)}
    assert {r.doc_id: r.start for r in some} == {d: sum(len(want[e]) // 4 for e in want if e < d) for d in (7, 200)}


def test_few_sections_are_decoded_for_one_document():
    table = Table.of({k: 1 + k for k in range(300)})
    ids = np.random.default_rng(6).integers(0, 300, 200_000)
    block = Block(table, table.encode(ids, 512, 16))
    seen, section = [], block.section
    block.section = lambda k: seen.append(k) or section(k)
    assert np.array_equal(block.ids(100_000, 9000), ids[100_000:109_000])
    assert seen == [12, 13] and block.sections == 25
