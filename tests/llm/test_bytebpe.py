import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from vertexloom.llm.bytebpe import encode_texts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string"


def brute(rows):
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 512), (50, 20)])
def test_equals_the_library(spark, chunk, overlap):
    rng = np.random.default_rng(0)
    bits = ["the", " re", "'re", "'ll", "don't", "  ", "\n\n", "12", "345", "é", "ß", "漢字", "😀", "!?", "<|endoftext|>", "\t", " ", "x" * 30, "-"]
    rows = [(i, "".join(rng.choice(bits, int(rng.integers(0, 120))))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 400), (103, " " * 300 + "b"), (104, "word " * 100), (104, "word " * 100), (105, "\n" * 200), (106, "'" * 99 + "re" * 40), (None, "null id"), (107, "é" * 101 + " end" * 40)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    got = encode_texts(df, "doc_id", "text", PATH, public_tokenizers.PATTERN, chunk, overlap).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_and_ids(spark):
    assert encode_texts(spark.createDataFrame([], SCHEMA), "doc_id", "text", PATH, public_tokenizers.PATTERN).count() == 0
    got = encode_texts(spark.createDataFrame([(1, "hello world", "")], SCHEMA), "doc_id", "text", PATH, public_tokenizers.PATTERN, keep_ids=True).first()
    assert len(got.ids) == got.n_tokens > 0
