"""What the suffix tree shuffles: never whole chunks, and one kind of questions at a time while there are many."""

import random

import pytest

from foliospark.llm import suffix_tree
from foliospark.llm.common import Scratch
from tests.llm.helpers import documents, words


class Watched(Scratch):
    """Scratch that notes the tables and how many shuffles plans with chunks have."""

    def __init__(self, spark):
        super().__init__(spark, "t")
        self.names, self.plans = [], []

    def save(self, df, name):
        self.names.append(name)
        return super().save(df, name)

    def save_bucketed(self, df, name, key, buckets):
        self.names.append(name)
        self.plans.append(df._jdf.queryExecution().executedPlan().toString())
        return super().save_bucketed(df, name, key, buckets)


@pytest.mark.parametrize("split", [0, 10**6])
def test_chunks_stay_and_rounds_agree(spark, split, monkeypatch):
    monkeypatch.setattr(suffix_tree, "SPLIT_BUCKETS", split)
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 40, 30)), "s") for i in range(60)]
    scratch = Watched(spark)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(documents(spark, rows), scratch, chunk_tokens=300, bucket_tokens=500).collect()}
    want = {r["doc_id"]: r["score"] for r in suffix_tree.score(documents(spark, rows), Scratch(spark, "t")).collect()}
    assert got == pytest.approx(want, abs=1e-4)
    # the first length: answers and words are shuffled to the chunks, which lie in their buckets already
    assert scratch.names.count("lm-chunks") == 1 and "lm-1" in scratch.names
    learned = [p for p in scratch.plans if "FlatMapCoGroupsInArrow" in p]
    assert learned and all(p.count("Exchange hashpartitioning(shard") == 1 for p in learned)
    assert any(name.startswith("lm-answers-2-1") for name in scratch.names) == (split == 0)
