"""Operators on very long texts: they end within seconds, with the results of a plain version."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from findings_engine.llm import packing, simhash, token_counts
from findings_engine.llm.byte_vocab import load as load_bytes

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = {"spaces": " " * 2_000_000, "lines": "a" + "\n" * 2_000_000 + "b", "mixed": " x" * 9 + "\t \n　" * 500_000 + " y  z", "word": "x" * 500_000}


@pytest.mark.parametrize("name", LONG)
def test_byte_vocab_on_long_runs(name):
    v = load_bytes(BYTES)
    assert v.ids([LONG[name]])[0].tolist() == v.library.encode(LONG[name], add_special_tokens=False).ids


def test_byte_vocab_at_the_bound_of_runs():
    rng = np.random.default_rng(7)
    pieces = [" ", "\n", "\t", "\x85", "\xa0", "　", "\x1c", "a", "b.", "'s", "é", "7", "日", " \n", "  "]
    v = load_bytes(BYTES)
    for _ in range(150):
        t = "".join(str(rng.choice(pieces)) * int(rng.choice([1, 1, 2, 3, 999, 1000, 1001, 1500])) for _ in range(rng.integers(1, 7)))
        assert v.ids([t])[0].tolist() == v.library.encode(t, add_special_tokens=False).ids


def test_packing_and_counts_of_long_runs(spark):
    lib = load_bytes(BYTES).library
    df = spark.createDataFrame(list(enumerate(LONG.values())), "doc_id long, text string")
    pieces = packing.pack(df, BYTES).collect()
    for i, t in enumerate(LONG.values()):
        tokens = [*lib.encode(t, add_special_tokens=False).ids, 1]
        mine = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == tokens and all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    counted = token_counts.count_tokens(df, BYTES).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id: r.n for r in counted} == {r.doc_id: r["all"] for r in counted} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(LONG.values())}


def slow_labels(values, budget=3):
    i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= budget, 1))
    return simhash.forest(len(values), i, j)


def test_trie_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    near = lambda x, most: int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, most), replace=False))
    for width, leaf in ((64, 1), (8192, 64)):
        monkeypatch.setattr(simhash, "WIDTH", width)
        monkeypatch.setattr(simhash, "LEAF", leaf)
        for _ in range(8):
            base = rng.integers(0, 2**64, 20, dtype=np.uint64)
            values = np.unique(np.array([int(b) for b in base] + [near(b, 6) for b in base for _ in range(rng.integers(0, 20))], np.uint64))
            got = simhash.trie_links(values, (0, len(values)), (0, len(values)), 0).merge()
            assert got.tolist() == slow_labels(values).tolist()


def test_dense_ball_is_not_compared_pair_by_pair():
    rng = np.random.default_rng(2)
    ball = {sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)) for _ in range(60_000)}
    values = np.sort(np.array(list(ball), np.uint64))
    began = time.perf_counter()
    assert not simhash.trie_links(values, (0, len(values)), (0, len(values)), 0).merge().any() and time.perf_counter() - began < 10


def test_trie_under_a_heavy_prefix(spark):
    """Fingerprints under one prefix are split by further bits, and none of their links is lost."""
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 2**18, 3000, dtype=np.uint64) << np.uint64(20))
    values = np.unique(np.concatenate([values, values[:500] ^ np.uint64(1 << 63), rng.integers(0, 2**64, 50, dtype=np.uint64)]))
    df = spark.createDataFrame([(0, int(v)) for v in values.view(np.int64)], "family int, fp long")
    levels, _ = simhash.trie_levels(df, 100, 3)
    assert max(levels[0]) > 30 and all(n <= 100 for d, a, b in simhash.plan(levels[0], 100) for n in (levels[0][d][a], levels[0][d][b]))
    edges = simhash.links(df, limit=100).collect()
    place = {int(v): k for k, v in enumerate(values.view(np.int64))}
    got = simhash.forest(len(values), np.array([place[r.a] for r in edges]), np.array([place[r.b] for r in edges]))
    assert got.tolist() == slow_labels(values).tolist()
