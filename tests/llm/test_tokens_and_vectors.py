"""Token files and vector search against plain loops."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import token_files, topk
from riskframe.session import scratch_path
from tests.llm.conftest import make_docs

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(VOCABULARY)


def test_pieces_encode_like_whole_texts(tok):
    texts = [
        "", " ", "a", " a", "a ", "a  b", "a \n b", "x\x1c y\x85 z\xa0 w", "it's  we'll 'd x'y", "1 2 a1 b 2c", "Éa é ß ñandú",
        "end<|endoftext|> of text", "tab\t word \tword", "a | b | c", "日本 語 word", "emoji 🙂 word 🙂word", "word  word　 word",
        "\n\n a\n\n", "\n", "a\n", "a \nb", "a\n b", "a\n\nb", "a\n\n\nb", "a  ", "  a", "a:b,c 1a2 3.5", "a\x00b", "É.É", "x" * 9000 + " y", "THE!! END!! of %%% it###", "a b c", "x ǅ y ʰz w",
    ]
    e = token_files.Encoder(VOCABULARY)
    for _ in range(2):  # from the tokenizer, then from memory
        got = [np.frombuffer(b, e.kind).tolist() for b in e.encode(texts)]
        for t, ids in zip(texts, got):
            assert ids == tok.encode(t, add_special_tokens=False).ids, t
    rng = np.random.default_rng(7)
    noise = ["".join(rng.choice(list("ab  \n\n.,!1é's"), int(rng.integers(0, 40)))) for _ in range(3000)]
    for t, b in zip(noise, e.encode(noise)):
        assert np.frombuffer(b, e.kind).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_files_round_trip_on_odd_rows(spark, odd_rows, tok):
    df = make_docs(spark, odd_rows)
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(df, VOCABULARY, path)
    got = [tuple(r) for r in token_files.read_tokens(spark, path).collect()]
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [0]
    want = Counter((r[0], len(ids(r[1])), zlib.crc32(np.array(ids(r[1]), "<u4").tobytes())) for r in odd_rows)
    assert Counter((d, n, crc) for d, _, n, crc in got) == want
    # documents lie end to end, in ascending order of their ids, nulls first
    got.sort(key=lambda r: r[1])
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    keys = [-1 if r[0] is None else r[0] for r in got]
    assert keys == sorted(keys)
    # keyed access
    shards = [token_files.Shard(r.asDict()) for r in spark.read.parquet(path).collect()]
    by_id = {r[0]: r[1] for r in odd_rows}
    for doc in (1, 7, 11, 13, 45):
        found = [x for s in shards if (x := s.get(doc)) is not None]
        assert len(found) == 1 and found[0].tolist() == ids(by_id[doc])
    assert len([x for s in shards if (x := s.get(9, 1)) is not None]) == 1
    assert not [x for s in shards for i in range(1000, 1200) if (x := s.get(i)) is not None], "unknown keys are recognised"


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 65, 5000):
        h = token_files.hashed(rng.choice(10**9, n, replace=False), np.zeros(n, "u4"))
        _, _, slot = token_files.build_index(h)
        assert sorted(slot.tolist()) == list(range(n))


def test_many_shards(spark):
    rows = [(i * 3 % 101, f"text number {i} " * (i % 5)) for i in range(101)]
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(make_docs(spark, rows), VOCABULARY, path, shard_ids=40)
    got = sorted(tuple(r) for r in token_files.read_tokens(spark, path).collect())
    at = 0
    for i, (doc, start, n, _) in enumerate(got):
        assert doc == i and start == at
        at += n
    assert spark.read.parquet(path).count() > 10


def brute(rows, k):
    usable = sorted({(i, tuple(int(np.floor(64.0 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for i, q in usable:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


def test_top_k_on_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 12).round(1)]) for i in range(500)]
    rows += [(500 + i, rows[40][1]) for i in range(60)] + [rows[20], rows[60]]  # ties and repeated rows
    rows += [(None, rows[0][1]), (600, None), (620, [1.0, None]), (640, [float("nan")] * 12), (660, [float("inf")] * 12), (680, [0.5] * 5), (700, []), (720, [1e7] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as codes", "'x' as key", "'x' as asks")
    got = [tuple(r) for r in topk.top_k(topk.codes(df), F.col("vec_id") % 20 == 0, 20, shard_rows=100, query_rows=16).collect()]
    want = brute(rows, 20)
    assert sorted(got) == sorted(want)


def test_top_k_prunes_and_stays_exact():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (3000, 20)) * np.array([400, 200, 100, 50, 20, *[1] * 15])
    queries, ids = rows[:30], np.arange(3000)
    for q, (at, score) in zip(range(30), topk.search(rows, ids, queries, np.arange(30), 10)):
        full = rows @ queries[q]
        order = np.lexsort((ids, -full))
        order = order[order != q][:10]
        assert at.tolist() == order.tolist() and score.tolist() == full[order].tolist()


def test_top_k_of_an_empty_table(spark):
    assert topk.search_table(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []
