import random
import re
from collections import defaultdict

import pytest

from foliospark.llm import common, near_dup
from foliospark.llm.common import Scratch, components
from tests.llm.helpers import SCHEMA, corpus, documents, words


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingle_set(t) for i, t, _ in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def result(spark, rows):
    out = near_dup.near_duplicates(documents(spark, rows), Scratch(spark, "t")).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}


def test_same_as_all_pairs(spark):
    rows = corpus()
    assert result(spark, rows) == brute(rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    """Nodes and groups far over their limits: a group of near copies, a chain, a shared passage."""
    monkeypatch.setattr(near_dup, "NODE", 6)
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    monkeypatch.setattr(near_dup, "LEADERS", 2)
    rng = random.Random(5)
    base, other = words(rng, 90, 5000), words(rng, 30, 5000)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w), "s"))
    chain = words(rng, 80, 5000)
    for i in range(25):
        rows.append((100 + i, " ".join(chain), "s"))
        chain = chain[2:] + words(rng, 2, 5000)
    rows += [(200 + i, " ".join(other + words(rng, 40, 5000)), "s") for i in range(30)]
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_null_id(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).collect() == []
    rows = [(None, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "a b c d e f", "s")]
    out = near_dup.near_duplicates(documents(spark, rows), Scratch(spark, "t")).collect()
    assert sorted((tuple(r) for r in out), key=repr) == [(1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]


def test_very_long_text(spark):
    rng = random.Random(2)
    w = words(rng, 60_000, 10**9)
    cut = w[:52_000]
    rows = [(1, " ".join(w), "s"), (2, " ".join(cut), "s"), (3, " ".join(w[:40_000]), "s")]
    assert {k: v[1] for k, v in result(spark, rows).items()} == {1: 1, 2: 1, 3: 1}


def test_drop_keeps_columns_and_smallest(spark):
    rows = corpus()
    kept = near_dup.drop_duplicates(documents(spark, rows), Scratch(spark, "t"))
    want = brute(rows)
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, _ in rows if want[i][2])


@pytest.mark.parametrize("local", [0, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed, local, monkeypatch):
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(7, 7)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for v in sorted(near):
        if v not in want:
            todo = [v]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = v
                    todo += near[x]
    got = components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component_id"] for r in got.collect()} == want


def met(spark, rows, paths=(1,)):
    """Classes of documents that must meet: rows of id, size and sketch, all in the same nodes."""
    reps = spark.createDataFrame([(i, n, list(paths), bytearray(b"".join(v.to_bytes(2, "little") for v in s))) for i, n, s in rows], "rep long, n long, paths array<long>, sketch binary")
    scratch = Scratch(spark, "t")
    found = components(scratch, near_dup.candidates(reps, scratch), "found")
    return {r["id"]: r["component_id"] for r in found.collect()}


def other(rng, sketch, k):
    """A sketch that differs in k values."""
    out = list(sketch)
    for at in rng.sample(range(near_dup.SKETCH), k):
        out[at] = rng.randrange(30_000, 60_000)
    return out


def test_close_to_a_pivot_and_still_met(spark):
    """A document near the pivots may be linked with one that no pivot fits, for its size."""
    rng = random.Random(8)
    base = [rng.randrange(30_000) for _ in range(near_dup.SKETCH)]
    rows = [(i, 100, other(rng, base, 2)) for i in range(300)]
    x = other(rng, base, 12)
    rows += [(1000, 80, x), (1001, 64, other(rng, x, 12))]
    got = met(spark, rows)
    assert got[1000] == 0 and got[1001] == 0


@pytest.mark.parametrize("rest", [16, 1024])
@pytest.mark.parametrize("levels", [1, 3])
def test_pairs_of_a_large_node_that_no_pivot_finds(spark, levels, rest, monkeypatch):
    monkeypatch.setattr(near_dup, "LEVELS", levels)
    monkeypatch.setattr(near_dup, "REST", rest)
    rng = random.Random(9)
    rows = []
    for k in range(200):
        one = [rng.randrange(30_000) for _ in range(near_dup.SKETCH)]
        rows += [(2 * k, 90, one), (2 * k + 1, 100, other(rng, one, 16))]
    # in one tree while nothing branches, in many where a pair may choose different values
    got = met(spark, rows, (1,) if levels == 1 or rest > 400 else range(1, 9))
    assert got == {i: i // 2 * 2 for i in range(400)}


def test_sets_met_at_once_and_one_by_one(monkeypatch):
    """A group whose texts share a template: the same links whether sets are met at once or one by one."""
    import numpy as np

    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(120)]
    rows = []
    for i in range(90):
        own = base[: rng.choice([60, 84, 104, 110])]
        s = np.unique(np.array(own + [rng.getrandbits(63) for _ in range(120 - len(own))], "u8"))
        rows.append((i, len(s), np.zeros(near_dup.SKETCH, "<u2").tobytes(), s.tobytes(), 0, i % 2))
    for work, cut in ((near_dup._whole_group, 4), (near_dup._two_sides, 6)):
        some = [(*r[:4], *([r[0], r[5]] if cut == 6 else [])) for r in rows]
        monkeypatch.setattr(near_dup, "NUMBERED", 10**6)
        at_once = work(some)
        monkeypatch.setattr(near_dup, "NUMBERED", 0)
        assert at_once and at_once == work(some)


def test_few_jobs_for_many_levels(spark, monkeypatch):
    """A level runs a bounded number of jobs and tables however small its nodes: with many partitions these are what it costs."""
    monkeypatch.setattr(near_dup, "NODE", 6)
    monkeypatch.setattr(near_dup, "REST", 16)
    monkeypatch.setattr(near_dup, "LEADERS", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    rng = random.Random(9)
    rows = []
    for k in range(60):
        one = [rng.randrange(30_000) for _ in range(near_dup.SKETCH)]
        rows += [(2 * k, 90, one), (2 * k + 1, 100, other(rng, one, 16))]
    saved = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, f=Scratch.save: saved.append(name) or f(self, df, name))
    got = met(spark, rows, range(1, 9))
    assert got == {i: i // 2 * 2 for i in range(120)}
    levels = {x.rsplit("-", 1)[1] for x in saved if x.startswith("sizes-")}
    assert "2" in levels and len([x for x in saved if re.search(r"-1(-|$)", x)]) <= 8


def test_small_tasks_look_for_no_cycles(monkeypatch):
    import pyarrow as pa

    asked = []
    monkeypatch.setattr(common, "release", lambda collect=True: asked.append(collect))
    for n in (10, 10**6):
        list(common.brief(lambda batches: batches)(iter([pa.record_batch({"a": pa.array(range(n))})])))
    assert asked == [False, True]
