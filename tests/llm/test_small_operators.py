import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.llm.common import crc32_text
from vertexloom.llm.langid import identify, learn
from vertexloom.llm.licences import DIGESTS, KNOWN, known_licences, scan_licences
from vertexloom.llm.wordpiece import Automaton, count_tokens, vocabulary

SCHEMA = "doc_id long, text string, licence string"


def greedy(word, initial, rest):
    n, at = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in (initial if at == 0 else rest):
                at, n = end, n + 1
                break
        else:
            return 1
    return n


def test_automaton_equals_greedy_matching():
    rng = np.random.default_rng(0)
    for _ in range(60):
        make = lambda k: {bytes(rng.integers(97, 100, rng.integers(1, 6)).astype(np.uint8)) for _ in range(k)}
        initial, rest = make(int(rng.integers(1, 20))), make(int(rng.integers(1, 20)))
        a = Automaton(initial, rest)
        for _ in range(60):
            w = bytes(rng.integers(97, 100, rng.integers(0, 14)).astype(np.uint8))
            assert a.count(w) == greedy(w, initial, rest), (w, initial, rest)


def test_token_counts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Hello, unbelievable world!", ""), (2, None, ""), (3, "", ""), (None, "the the", ""), (3, "x" * 50_000, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, count_tokens(df, path).collect()), key=str)
    assert [g[:2] for g in got] == [(1, 5), (2, 0), (3, 0), (3, 1), (None, 2)] and got[0][2] >= 5 and got[4][2] == 2
    assert count_tokens(df.limit(0), path).count() == 0


def test_licences(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\nAll rights reserved.\n\n" + KNOWN["MIT"].upper().replace(" ", "  ").replace("HOLDERS  BE", "\n holders be").replace(",", " ;")
    rows = [(1, mit, "x"), (2, KNOWN["MIT"] + " and more", "x"), (3, "released under the mit licence", "x"), (4, None, "x"), (5, "", "x"), (6, "Copyright 2020", "x"), (None, KNOWN["ISC"], "x"), (1, mit, "x"), (7, KNOWN["MIT"] * 500, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.licence, r.digest is None) for r in scan_licences(df).collect()), key=str)
    assert got == sorted([(1, "MIT", False), (1, "MIT", False), (2, None, False), (3, "notice-MIT", False), (4, None, True), (5, None, False), (6, None, False), (None, "ISC", False), (7, None, False)], key=str)
    assert known_licences(spark).count() == len(KNOWN) + sum(map(len, DIGESTS.values()))
    assert scan_licences(df.limit(0)).count() == 0 and scan_licences(df, known_licences(spark).limit(0)).count() == len(rows)


def test_licence_variants(spark):
    bsd = KNOWN["BSD-3-Clause"].replace("copyright holder nor", "copyright owner nor").replace("source", "SOURCE")
    rows = [(1, "Copyright 2020 A\n\nThe BSD 3-Clause Licence\n\n" + bsd, "BSD-3-Clause"), (2, "licence licence licence", None), (3, "license license license", None), (4, "(c) me\n" + KNOWN["Zlib"].replace("acknowledgment", "acknowledgement"), "Zlib"), (5, KNOWN["BSL-1.0"], "BSL-1.0")]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.licence for i, r in got.items()} == {i: x for i, _, x in rows}
    assert got[2].digest == got[3].digest


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts on this machine")
def test_digests_of_long_licences(spark):
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    texts = {k: Path("/usr/share/common-licenses", f).read_text() for f, k in files.items()}
    filled = texts["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Some Body")
    rows = [*((n, t, k) for n, (k, t) in enumerate(texts.items())), (90, filled, "Apache-2.0"), (91, texts["MPL-2.0"].replace("http:", "https:").upper(), "MPL-2.0"), (92, texts["GPL-3.0"].split("How to Apply")[0], "GPL-3.0"), (93, texts["GPL-3.0"][:-3000], None)]
    got = {r.doc_id: r.licence for r in scan_licences(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {n: k for n, _, k in rows}


def test_token_counts_of_the_table_equal_greedy_matching(spark):
    from vertexloom.llm.queries import BYTE_LEVEL, QUERIES

    initial, rest = vocabulary(BYTE_LEVEL)
    words = re.compile(r"\w+|[^\w\s]")
    known = {}

    def pieces(w):
        if w not in known:
            known[w] = greedy(w.encode(), initial, rest)
        return known[w]

    texts = {r.doc_id: words.findall(r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in QUERIES["op9_wordpiece_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (len(ws), sum(map(pieces, ws))) for d, ws in texts.items()}


def test_clashing_columns_of_token_counts(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "a b", 9, 9), (1, "a b", 8, 8)], "doc_id long, text string, n_tokens int, n_words int")
    got = count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 2)] * 2


def test_languages_equal_plain_sets(spark):
    """The filters against sets of n-grams without false positives, on the same counts; and on the table's held-out rows."""
    from vertexloom.llm.queries import QUERIES

    data = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op5_language_filters"](spark, data).collect()}
    assert set(got) == set(docs)
    count = {}
    for d, r in docs.items():
        if not got[d].held_out and r.text and r.lang:
            for g in grams_of(r.text):
                own = count.setdefault(g, Counter())
                own[r.lang] += 1
    size = Counter()
    for own in count.values():
        size.update(own)
    sets = {lang: {g for g, own in count.items() if own[lang] > 1 and 4 * own[lang] / size[lang] >= max(n / size[k] for k, n in own.items())} for lang in size}
    same = total = right = 0
    for d, r in docs.items():
        own = grams_of(r.text or "")
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert (got[d].lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        if got[d].lang_pred != "und" and len(own) > 20:
            share = {lang: sum(g in s for g in own) for lang, s in sets.items()}
            total, same = total + 1, same + (got[d].lang_pred == max(share, key=share.get))
            right += got[d].lang_pred == r.lang
    assert total > 500 and same >= 0.98 * total and right >= 0.97 * total


def grams_of(text):
    flat = " " + "".join(f"{w} " for w in re.split(r"[\W\d_]+", text.lower()) if w)
    return [flat[i : i + 4] for i in range(len(flat) - 3)]


def test_languages_with_clashing_columns_and_ties(spark):
    df = spark.createDataFrame([(1, "aaaa aaaa", "x", "l", 1.0), (2, "bbbb bbbb", "y", "l", 2.0), (3, "zzzz", None, "l", 3.0), (3, "zzzz", None, "l", 3.0)], "doc_id long, text string, lang string, lang_pred string, score double")
    rows = df.unionByName(df.where("doc_id < 3"))
    got = identify(rows, learn(rows, F.lit(True)))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in got.collect()) == [(1, "x", 1.0)] * 2 + [(2, "y", 1.0)] * 2 + [(3, "x", 0.0)] * 2


def test_languages_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    parts = {"en": "th er on an re he in ed nd ha at", "fr": "eau oi ré é ai ou que tre ment eux", "de": "sch ung er ein ich tz pf ä ö ü"}
    rows = []
    for d in range(900):
        lang = list(parts)[d % 3]
        own = parts[lang].split()
        rows.append((d, " ".join("".join(rng.choice(own, int(rng.integers(1, 5)))) for _ in range(int(rng.integers(3, 60)))), lang))
    rows += [(2000, None, "en"), (2001, "", None), (2002, "12 34 !!", None), (2003, "the re " * 20_000, None), (None, "herein thand", None), (2004, "漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = F.coalesce(crc32_text("doc_id") % 5 == 0, F.lit(False))
    got = identify(df, learn(df, ~held)).withColumn("held", held).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    pairs = [(r.lang_pred, r.lang) for r in got if r.held and r.lang and r.text]
    assert len(pairs) > 100 and sum(p == y for p, y in pairs) >= 0.98 * len(pairs)
    by = {r.doc_id: r.lang_pred for r in got}
    assert (by[2000], by[2001], by[2002], by[2003]) == ("und", "und", "und", "en") and by[2004] in parts
    none = learn(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in identify(df, none).collect()} == {"und"} and identify(df.limit(0), none).count() == 0
