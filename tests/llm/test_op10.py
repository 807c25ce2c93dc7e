import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stranda.llm import op10_packing as op

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", "  a  b ", " a", "a\n b", "x<|endoftext|>y", "日本 語  🙂 é \x1c x\x85 y", "\t\t tab", "don't  I'LL it's", "a  b", "a  b"]


@pytest.fixture(scope="module")
def want():
    tok = Tokenizer.from_file(PATH)
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def check(rows, texts, want):
    ids = {d: want(t) for d, t in texts}
    got, windows = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        got.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, parts in got.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[d])
    assert set(got) == set(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= op.WINDOW
    return windows


def test_ids_equal_the_tokenizer_library(want):
    for text in ODD:
        assert op.encode(text or "", PATH).tolist() == want(text)


def test_query_on_the_whole_table(spark, want):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    windows = check(op.op10_packing(spark, "/root/testdata/sf0.001").collect(), texts, want)
    total = sum(len(want(t)) for _, t in texts)
    assert len(windows) == -(-total // op.WINDOW)


def test_odd_texts_repeats_and_empty(spark, want):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("start", F.lit("clash"))
    check(op.pack(df, shard=4).collect(), list(enumerate(ODD)), want)
    assert op.pack(df.limit(0)).count() == 0
    twice = op.pack(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert [r.doc_id for r in twice] == [None, None] and sorted(r.offset for r in twice) == [0, 3]


def test_neighbours_share_the_seeds_terms():
    rng = np.random.default_rng(0)
    docs = [rng.integers(100 * (i % 3), 100 * (i % 3) + 100, 600).astype("<u2") for i in range(30)]
    found = op.pack_shard(docs, np.ones(op.VOCABULARY, np.float32), 600.0)
    first = {d % 3 for d, _, _, s, _ in found if s == 0}
    assert first == {0}


def test_all_of_the_seeds_ids_are_asked_for():
    docs = [np.arange(100).astype("<u2"), np.arange(24).astype("<u2"), np.arange(24, 100).astype("<u2")]
    index = op.Index(docs, np.ones(op.VOCABULARY, np.float32), 70.0)
    score = index.scores(0)
    want = [sum((op.K1 + 1) / (1 + op.K1 * (1 - op.B + op.B * len(d) / 70)) for t in d if t < 100) for d in docs]
    assert np.allclose(score, want, rtol=1e-4) and score[2] > score[1]


def test_statistics_are_of_whole_documents(spark, want):
    texts = ["a b", "b c", " ".join(f"word{i}" for i in range(3000)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    idf, mean = op.statistics(op.tokenized(df))
    ids = [want(t) for t in texts]
    assert max(map(len, ids)) > op.WINDOW and mean == sum(map(len, ids)) / 4
    count = sum(np.isin(np.arange(op.VOCABULARY), x).astype(int) for x in ids)
    assert np.allclose(idf, np.log(1 + (4 - count + 0.5) / (count + 0.5)))


def test_long_runs_are_taken_as_the_tokenizer_takes_them():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for text in (" " * 300_000, "a" + "\n" * 50_000 + "b", " \t" * 20_000 + "x", "a" * 100_000, "7" * 100_000, "!" * 50_000):
        assert op.encode(text, path).tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1]
