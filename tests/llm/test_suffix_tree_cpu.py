"""What keeps the suffix tree's work small: one exact sort, no empty planes, one round for few tokens."""

import random

import numpy as np
import pytest

from foliospark.llm import suffix_tree
from foliospark.llm.common import Scratch
from tests.llm.helpers import documents, words
from tests.llm.test_suffix_tree_disk import Watched


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_one_sort_gives_distinct_keys(n):
    """Also where keys differ only in the bits that hold positions while they are sorted."""
    rng = np.random.default_rng(n)
    some = rng.integers(0, 1 << 64, 40, dtype="u8") & ~np.uint64(0xFFF)
    keys = some[rng.integers(0, 40, n)] + rng.integers(0, 6, n).astype("u8")
    keys = np.where(rng.random(n) < 0.5, keys, rng.integers(0, 1 << 64, n, dtype="u8"))
    got, which = suffix_tree.distinct(keys.copy())
    assert (got[1:] > got[:-1]).all() and (got[which] == keys).all() and len(got) == len(set(keys.tolist()))


def test_packed_arrays_come_back():
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, top, 1000, dtype="u8") for top in (1, 2, 256, 257, 1 << 40, 1 << 64)]
    arrays += [np.zeros(0, "<u4"), rng.random(9).astype("<f4"), -rng.random(9), np.array([1, 0], "u1"), np.arange(9, dtype="<u4")]
    data = suffix_tree.pack(*arrays)
    for a, b in zip(arrays, suffix_tree.unpack(memoryview(data)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
    left = suffix_tree.unpack(data, (1, 4))
    assert left[1] is None and left[4] is None and (left[5] == arrays[5]).all() and (left[8] == arrays[8]).all()


@pytest.mark.parametrize("buckets", [1, 3, 7, 1000])
def test_buckets_are_ranges_of_the_hash(buckets):
    keys = np.unique(np.concatenate([np.random.default_rng(buckets).integers(0, 1 << 64, 3000, dtype="u8"), np.array([0, (1 << 64) - 1], "u8")]))
    rows = suffix_tree._rows(0, 0, keys, buckets, np.arange(len(keys), dtype="u8"))
    found = [(r[2], key) for r in rows for key in np.cumsum(suffix_tree.unpack(r[5])[0], dtype="u8").tolist()]
    assert found == [(((key >> 32) * buckets) >> 32, key) for key in keys.tolist()]


def test_few_tokens_ask_in_one_round(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "SPLIT_BUCKETS", 0)
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 40, 100)), "s") for i in range(60)]
    scratch = Watched(spark)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(documents(spark, rows), scratch, chunk_tokens=300, bucket_tokens=500).collect()}
    asked = {tuple(map(int, name.split("-")[2:])) for name in scratch.names if name.startswith("lm-answers-")}
    last = max(length for length, _ in asked)
    assert (2, 1) in asked and last > 2 and (last, 1) not in asked
    monkeypatch.setattr(suffix_tree, "SPLIT_SHARE", 0)
    want = {r["doc_id"]: r["score"] for r in suffix_tree.score(documents(spark, rows), Scratch(spark, "t"), chunk_tokens=300, bucket_tokens=500).collect()}
    assert got == pytest.approx(want, rel=1e-12)
