"""Suffix tree, tokenizers, counts, packing, classifier and rules against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliospark.llm import bpe, packing, quality_rules, suffix_tree, token_counts, weak_labels
from foliospark.llm.common import Scratch
from tests.conftest import same_as_sql
from tests.llm.helpers import SCHEMA, corpus, documents

FOLDER = "/root/testdata/sf0.001"


def lowered(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]


# suffix tree


def test_base_scores_and_gain(spark):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in suffix_tree.score(d, Scratch(spark, "t")).collect()}
    texts = {r["doc_id"]: lowered(r["text"]) + [None] for r in d.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


class BruteTree:
    """The tree held in dictionaries: every context, its next tokens, and the states among them."""

    def __init__(self, texts, depth, floor, divergence):
        self.lines = [["<s>", *t, None] for t in texts]
        unigrams = Counter(w for x in self.lines for w in x[1:])
        n, v = sum(unigrams.values()), len(unigrams)
        self.root = lambda w: (unigrams[w] + 1) / (n + v + 1)
        self.nexts, self.states = {(): unigrams}, {}
        for d in range(1, depth + 1):
            found = defaultdict(Counter)
            for x in self.lines:
                for i in range(d, len(x)):
                    tail = self.nexts.get(tuple(x[i - d + 1 : i]))
                    if d == 1 or (tail and sum(tail.values()) >= floor and len(tail) >= 2):
                        found[tuple(x[i - d : i])][x[i]] += 1
            fresh = {}
            for ctx, c in found.items():
                t = sum(c.values())
                gain = sum(k * math.log(k / t / self.probability(w, ctx[1:])) for w, k in c.items())
                if t >= floor and gain >= divergence * len(c):
                    fresh[ctx] = c
            self.nexts.update(found)
            self.states.update(fresh)
            if not fresh:
                break

    def probability(self, w, ctx):
        p = self.root(w)
        for d in range(1, len(ctx) + 1):
            c = self.states.get(tuple(ctx[len(ctx) - d :]))
            if c:
                p = (c[w] + len(c) * p) / (sum(c.values()) + len(c))
        return p

    def score(self, text):
        x = ["<s>", *text, None]
        return sum(math.log10(self.probability(x[i], x[max(0, i - suffix_tree.DEPTH) : i])) for i in range(1, len(x)))


@pytest.mark.parametrize("divergence", [0.0, 1.0])
def test_scores_same_as_a_tree_in_dictionaries(spark, divergence):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefg", [9, 5, 3, 2, 1, 1, 1], k=rng.randrange(0, 25))), "s") for i in range(50)]
    rows += [(60 + i, "a b c a b d " * (i % 4) + "x y z", "s") for i in range(14)]
    train = [lowered(t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    tree = BruteTree(train, suffix_tree.DEPTH, 2, divergence)
    assert max(map(len, tree.states)) > 2
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(documents(spark, rows), Scratch(spark, "t"), divergence=divergence, chunk_tokens=150, bucket_tokens=100).collect()}
    for i, t, _ in rows:
        assert math.isclose(got[i], tree.score(lowered(t)), rel_tol=1e-5, abs_tol=1e-6), (i, t)
    vocabulary = {w for t in train for w in t} | {None, "never"}
    for ctx in (("<s>",), ("a",), ("a", "b"), ("x", "y"), ("c", "a", "b")):
        assert math.isclose(sum(tree.probability(w, ctx) for w in vocabulary), 1.0, rel_tol=1e-9)


def test_suffix_tree_edges(spark):
    rows = corpus(n=20)
    out = suffix_tree.score(documents(spark, rows), Scratch(spark, "t")).collect()
    assert len(out) == len(rows)
    by = defaultdict(set)
    for r in out:
        by[r["doc_id"]].add((r["n_tokens"], r["base_score"], r["score"]))
    assert all(len(x) == 1 for x in by.values())
    assert next(iter(by[200]))[0] == 1 and by[200] == by[201] == by[202]
    assert suffix_tree.score(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).collect() == []
    long = [(5, "one two three " * 70_000, "s"), (3, "four " * 200_000, "s"), (4, "four " * 200_000, "s")]
    got = {r["doc_id"]: r for r in suffix_tree.score(documents(spark, long), Scratch(spark, "t")).collect()}
    assert got[5]["n_tokens"] == 210_001 and got[3]["score"] == got[4]["score"] and got[5]["score"] > got[5]["base_score"] + 1000
    only = [r for r in corpus(n=30) if zlib.crc32(str(r[0]).encode()) % 7 == 2]
    got = suffix_tree.score(documents(spark, only), Scratch(spark, "t")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in got)


def test_contexts_grow_while_they_diverge(spark):
    """What follows "m m m" depends on the fourth word back."""
    pairs = {"p": "left", "q": "right", "r": "up", "s": "down"}
    rows = [(i, " ".join(f"{k} m m m {pairs[k]}" for k in random.Random(i).choices("pqrs", k=20)), "s") for i in range(60)]
    d = documents(spark, rows)
    whole, cut = ({r["doc_id"]: r for r in suffix_tree.score(d, Scratch(spark, "t"), **k).collect()} for k in ({}, {"depth": 2}))
    held = [i for i in whole if whole[i]["held_out"]]
    assert held and all(whole[i]["score"] > cut[i]["score"] + 1 for i in held)


def test_many_small_chunks_change_nothing(spark):
    rows = [(i, t, s) for i, t, s in corpus(n=25)]
    one = suffix_tree.score(documents(spark, rows), Scratch(spark, "t")).collect()
    many = suffix_tree.score(documents(spark, rows).repartition(3), Scratch(spark, "t"), chunk_tokens=50).collect()
    key = lambda r: (r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9))
    assert sorted(map(key, one)) == sorted(map(key, many))


# byte-level BPE and counts


def encoder():
    return bpe.encoding(bpe.rank_path(), bpe.default_pattern())


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "word " * 5000, "\n\n \t x  y  z " * 500, "it's 12345 ☃☃ é中文 <|endoftext|>" * 300, "no" * 40 + "   " * 400 + "end"])
def test_segments_do_not_change_ids(text):
    enc = encoder()
    whole = enc.encode_ordinary(text)
    for size in (1, 7, 100, 10**9):
        assert bpe.encode(enc, text, size).tolist() == whole
        assert "".join(bpe.segments(text, size)) == text
    assert bpe.decode(enc, np.array(whole, "u4")) == text.encode()


SPACES = [("", " ", ""), ("", "\n", ""), ("x", " ", "y"), ("", "\n \t", "it's"), ("end", "\u3000", "")]


@pytest.mark.parametrize(("before", "unit", "after"), SPACES)
def test_long_white_space(before, unit, after):
    """The ids of a long run are those of its match; short runs show what the matches are."""
    enc = encoder()
    text = before + unit * (2_000_000 // len(unit)) + after
    ids = bpe.encode(enc, text)
    assert bpe.decode(enc, ids) == text.encode()
    run = text[len(before) : len(text) - len(after) - (1 if after else 0)]
    rest = text[len(before) + len(run) :]
    assert ids.tolist() == [*enc.encode_ordinary(before), *enc._encode_single_piece(run), *enc.encode_ordinary(rest)]
    short = before + unit * 1500 + after
    assert bpe.encode(enc, short, 10).tolist() == enc.encode_ordinary(short)


@pytest.mark.parametrize("text", ["a" + " " * 5000 + "b c", "\n" * 4000 + " x", "a \u3000" * 2000 + " " * 1500 + "'s", "x" + "\x1c" * 3000 + " y!\x1c", " " * 1000 + "\x85" * 1200 + "é", "a\x1cb " * 3000])
def test_white_space_is_that_of_the_pattern(text):
    enc = encoder()
    for size in (1, 50, 10**9):
        assert bpe.encode(enc, text, size).tolist() == enc.encode_ordinary(text)


def test_long_white_space_in_tables(spark):
    rows = [(1, " " * 2_000_000, "s"), (2, "x" + "\n" * 1_500_000 + "y", "s"), (3, None, "s")]
    got = {r["doc_id"]: r for r in bpe.round_trip(documents(spark, rows)).collect()}
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t, _ in rows)
    counts = {r["n_tokens"]: r["n_docs"] for r in token_counts.token_counts(documents(spark, rows), Scratch(spark, "t")).collect()}
    assert counts == dict(Counter(r["n_tokens"] for r in got.values()))


def test_round_trip_digests(spark):
    rows = corpus(n=10)
    got = bpe.round_trip(documents(spark, rows)).collect()
    enc = encoder()
    want = sorted((i, len(k := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(k, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted(map(tuple, got)) == want
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
    ids = bpe.encode_documents(documents(spark, rows[:5]))
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode_documents(ids).collect()) == sorted((i, t.encode()) for i, t, _ in rows[:5])
    assert bytes(bpe.decode_documents(spark.createDataFrame([(1, [255, 128])], "doc_id long, ids array<int>")).first()["decoded"]) == enc.decode_bytes([255, 128])


def test_counts_answer_every_limit(spark):
    rows = corpus(n=30)
    enc = encoder()
    lengths = [len(enc.encode_ordinary(t or "")) for _, t, _ in rows]
    out = token_counts.token_counts(documents(spark, rows), Scratch(spark, "t")).collect()
    assert sorted(r["n_tokens"] for r in out) == sorted(set(lengths))
    for r in out:
        x = r["n_tokens"]
        assert r["n_docs"] == lengths.count(x) and r["docs_at_least"] == sum(k >= x for k in lengths) and r["tokens_at_least"] == sum(k for k in lengths if k >= x)
        assert r["truncated_tokens"] == sum(min(k, x) for k in lengths) and r["lost_tokens"] == sum(lengths) - r["truncated_tokens"]
    sums = token_counts.suffix_sums(token_counts.histogram(documents(spark, rows)), block=7)
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, out))
    for r in token_counts.totals_for(sums, [0, 5, 17, 10**6]).collect():
        c = r["context_limit"]
        assert (r["docs_cut"], r["kept_tokens"]) == (sum(k > c for k in lengths), sum(min(k, c) for k in lengths))
    for q in (0.1, 0.5, 0.99, 1.0):
        assert token_counts.quantile(sums, q) == min(x for x in lengths if sum(k <= x for k in lengths) >= q * len(lengths))
    empty = token_counts.token_counts(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"))
    assert empty.collect() == [] and token_counts.quantile(empty, 0.5) is None


# packing


def test_words_give_the_ids_of_the_text():
    tok = packing.Tokenizer(packing.vocabulary_path())
    odd = ["a\x1cb c d", "don't I'M x's 'S, a,'s b.'s,", "Ün̈ï ́x ☃ q☃ ", "<|endoftext|> x", "ΣΑΣ 12 ½ 中文字 İ ſ", "", "  ", None, "a" * 5000, " x y", "é, É. ñ!! ×, ÷. x×,", "a.b,c;d -- (e) [f]", "é, é"]
    assert [x.tolist() for x in tok.encode(odd)] == [tok._ids(x or "") + [1] for x in odd]
    packing_limit, packing.CACHE_WORDS = packing.CACHE_WORDS, 4
    try:
        assert [x.tolist() for x in tok.encode(odd * 2)] == [tok._ids(x or "") + [1] for x in odd * 2]
    finally:
        packing.CACHE_WORDS = packing_limit


def test_special_tokens_are_the_library_s():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    library, tok = Tokenizer.from_file(path), packing.tokenizer(path)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y. IT'S", "<|ENDOFTEXT|> upper", "<|endoftext|", "plain", None, "<|endoftext|>" * 3, "long words " * 100_000]
    for t, ids in zip(texts, tok.encode(texts), strict=True):
        assert ids.tolist() == [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID], t


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = packing.hilbert(grid, bits)
        assert sorted(key) == list(range(1 << (bits * dims)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("sequence", [2048, 64])
def test_pieces_cover_each_document(spark, sequence):
    rows = corpus(n=30)
    tok = packing.Tokenizer(packing.vocabulary_path())
    out = packing.pack(documents(spark, rows), Scratch(spark, "t"), sequence, with_ids=True).collect()
    want, got = Counter(), defaultdict(list)
    for i, t, _ in rows:
        want[i] += 1
    for r in out:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        got[r["doc_id"]].append(r)
    for i, t, _ in rows:
        ids = tok._ids(t or "") + [1]
        cover = Counter()
        for r in got[i]:
            assert r["doc_tokens"] == len(ids) and r["ids"] == ids[r["start"] : r["start"] + r["length"]]
            cover.update(range(r["start"], r["start"] + r["length"]))
        assert cover == Counter({k: want[i] for k in range(len(ids))})
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append(r)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= sequence and (at == sequence or at & (at - 1) == 0)
    assert packing.pack(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).collect() == []


def test_neighbours_on_the_curve_are_alike(spark):
    rows = [(i, " ".join(["alpha beta gamma"] * 20 if i % 2 else ["uno dos tres cuatro"] * 20) + f" {i}", "s") for i in range(40)]
    keys = [r["curve"] for r in packing.encode_documents(documents(spark, rows)).orderBy("curve").collect()]
    order = [r["doc_id"] % 2 for r in packing.encode_documents(documents(spark, rows)).orderBy("curve").collect()]
    assert len(keys) == 40 and sum(a != b for a, b in zip(order, order[1:])) <= 3


# classifier and rules


def test_classifier_on_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in weak_labels.classify(spark.read.parquet(f"{folder}/documents.parquet"), Scratch(spark, "t")).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    right = sum(rows[r["doc_id"]]["kept"] == bool(r["quality"]) for r in labels)
    lost = sum(not rows[r["doc_id"]]["kept"] for r in labels if r["quality"])
    assert right >= 0.98 * len(labels) and lost <= 0.005 * len(labels)


L = len(weak_labels.LABELLERS)


def planted_votes(n=6000):
    """Good texts on which labeller 0 is wrong one time in ten, and two kinds of junk seen by two labellers each."""
    rng, out = random.Random(4), []
    for _ in range(n):
        kind = rng.choices(("good", "loud", "torn"), (0.84, 0.1, 0.06))[0]
        at = {"good": {0: 0.1, 9: 0.02}, "loud": {0: 0.95, 1: 0.9}, "torn": {3: 0.9, 4: 0.85, 0: 0.1}}[kind]
        out.append((kind, "".join("-" if rng.random() < 0.1 else "b" if rng.random() < at.get(k, 0.01) else "g" for k in range(L))))
    return out


@pytest.mark.xfail(strict=True, reason="its last line asks for more than 97 % right; by the planted shares and accuracies themselves Bayes' rule gets 96.5 % of these votes")
def test_label_model_recovers_planted_accuracies():
    votes = planted_votes()
    m = weak_labels.LabelModel(dict(Counter(v for _, v in votes)))
    assert len(m.shares) == 3 and m.bad.sum() == 2
    for k, name in enumerate(weak_labels.LABELLERS):
        for bad in (False, True):
            cast = [v[k] for kind, v in votes if (kind != "good") == bad and v[k] != "-"]
            true = cast.count("b" if bad else "g") / len(cast)
            assert abs(m.accuracy()[name][bad] - true) < 0.06, (name, bad)
    right = sum((m.good(v) > 0.5) == (kind == "good") for kind, v in votes)
    any_bad = sum(("b" not in v) == (kind == "good") for kind, v in votes)
    assert right > 0.97 * len(votes) > any_bad + 0.1 * len(votes)


KINDS = [
    (4, (("good", 0.84, {0: 0.1, 9: 0.02}), ("loud", 0.1, {0: 0.95, 1: 0.9}), ("torn", 0.06, {3: 0.9, 4: 0.85, 0: 0.1}))),
    (5, (("good", 0.84, {0: 0.1, 9: 0.02}), ("loud", 0.1, {0: 0.95, 1: 0.9}), ("torn", 0.06, {3: 0.9, 4: 0.85, 0: 0.1}))),
    (1, (("good", 0.8, {0: 0.1, 9: 0.02}), ("loud", 0.08, {0: 0.95, 1: 0.9}), ("torn", 0.06, {3: 0.9, 4: 0.85, 0: 0.1}), ("odd", 0.06, {6: 0.9, 7: 0.8, 1: 0.3}))),
    (2, (("good", 0.8, {0: 0.1, 9: 0.02}), ("loud", 0.08, {0: 0.95, 1: 0.9}), ("torn", 0.06, {3: 0.9, 4: 0.85, 0: 0.1}), ("odd", 0.06, {6: 0.9, 7: 0.8, 1: 0.3}))),
]


@pytest.mark.parametrize("seed, kinds", KINDS)
def test_label_model_is_as_good_as_the_truth(seed, kinds):
    """Numbers of kinds and accuracies of planted votes, and as many right as by Bayes' rule with what was planted."""
    rng, votes = random.Random(seed), []
    for _ in range(6000):
        name, _, at = rng.choices(kinds, [share for _, share, _ in kinds])[0]
        votes.append((name, "".join("-" if rng.random() < 0.1 else "b" if rng.random() < at.get(k, 0.01) else "g" for k in range(L))))
    m = weak_labels.LabelModel(dict(Counter(v for _, v in votes)))
    assert len(m.shares) == len(kinds) and m.bad.sum() == len(kinds) - 1
    for k, name in enumerate(weak_labels.LABELLERS):
        for bad in (False, True):
            cast = [v[k] for kind, v in votes if (kind != "good") == bad and v[k] != "-"]
            assert abs(m.accuracy()[name][bad] - cast.count("b" if bad else "g") / len(cast)) < 0.06, (name, bad)

    def truth(v, name):
        share, at = next((share, at) for n, share, at in kinds if n == name)
        for k, x in enumerate(v):
            share *= 1.0 if x == "-" else at.get(k, 0.01) if x == "b" else 1 - at.get(k, 0.01)
        return share

    by_truth = {v: truth(v, "good") > sum(truth(v, name) for name, _, _ in kinds[1:]) for _, v in votes}
    right = sum((m.good(v) > 0.5) == (kind == "good") for kind, v in votes)
    best = sum(by_truth[v] == (kind == "good") for kind, v in votes)
    assert right > best - 0.005 * len(votes) and right > sum(("b" not in v) == (kind == "good") for kind, v in votes)


def test_label_model_edges():
    assert weak_labels.LabelModel({}).good("-" * L) == 1.0
    m = weak_labels.LabelModel({"g" * L: 5})
    assert m.good("g" * L) > 0.9 and all(0 <= x <= 1 for pair in m.accuracy().values() for x in pair)


def test_kinds_of_words_are_bounded():
    kinds = weak_labels.Kinds(most=20)
    for k in range(200):
        kinds.trim()
        assert kinds[b"#" * (1 + k % 2) + b"a%" * (k % 30 + 1)] < len(kinds.rows) <= 22
        kinds.settle()
        assert len(kinds.flags) == len(kinds.hashes) == len(kinds.rows)


def test_classifier_edges(spark):
    rows = corpus(n=20) + [(400, "a long text of words " * 100_000, "s0"), (300, "BUY NOW!! " * 40, "s0"), (301, "cheap### pills$$$ " * 30, "s0"), (302, "same " * 80, "s0")]
    out = weak_labels.classify(documents(spark, rows), Scratch(spark, "t")).collect()
    assert len(out) == len(rows) and {r["doc_id"]: r["votes"] for r in out}[200] == "-" * L
    assert weak_labels.classify(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).collect() == []
    kept = weak_labels.keep_documents(documents(spark, rows), Scratch(spark, "t"))
    assert kept.columns == documents(spark, rows).columns and {r["doc_id"] for r in out if r["kept"]} == {r["doc_id"] for r in kept.collect()}


def plain_counts(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    cover = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_rule_counts(spark):
    texts = ["", None, "a", "a b c", "a b c a b c", "a a a a", "a a a", "x\n\nx\n \nx\ny", "#*$%&|<> é 中", "a b c d " * 30, " lead  trail ", "\x0ba\x0cb\x1cc d", " ".join(f"w{i % 37}" for i in range(400)), " ".join(f"w{i * i % 97}" for i in range(900))]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.base_counts(df).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_rules_same_as_sql(spark):
    from foliospark.llm.queries import ORACLES, QUERIES

    same_as_sql(spark, FOLDER, QUERIES["op8_quality_rules"], ORACLES["op8_quality_rules"])


def test_bad_hosts_lose_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good + f" {i}", "fine") for i in range(60)] + [(100 + i, "short", "bad") for i in range(60)] + [(500, good, "bad"), (501, good, None), (502, "short", None), (503, good, "rare")]
    out = {r["doc_id"]: r for r in quality_rules.verdicts(documents(spark, rows), Scratch(spark, "t")).collect()}
    assert out[1]["kept"] and not out[100]["kept"] and not out[500]["kept"] and out[501]["kept"] and not out[502]["kept"] and out[503]["kept"]
    assert 0.1 < out[503]["host_rate"] <= 0.5 and out[1]["host_rate"] < 0.1 < 0.9 < out[100]["host_rate"]
    assert quality_rules.verdicts(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).collect() == []
    kept = quality_rules.keep_documents(documents(spark, rows), Scratch(spark, "t"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in out.items() if r["kept"])


def test_rules_are_native(spark):
    plan = quality_rules.base_counts(documents(spark, [(1, "a", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
