"""Embedding near-dedup by a random-projection tree forest.

Each tree splits the vectors of a label by random directions at the middle of a sample; a
vector within a margin of the cut goes to both sides.  Vectors are compared only within
leaves, every pair found is checked by its exact cosine, and links are united.
Equal vectors of a label are one vector with a multiplicity to all of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, Scratch, components, lean, shuffle_width

#: Cosine from which vectors of a label are linked.
COSINE = 0.93
#: Trees, vectors a leaf should hold, and the margin either side of a cut that goes both ways, in
#: standard deviations of how far a pair at the threshold lies apart along a random direction (its
#: distance, 0.374, over the root of the dimensions).  Whatever the dimensions, a split then parts such a
#: pair with a probability of 0.043 and doubles one vector in ten; all trees miss it with one
#: of 2e-6 after 7 splits and 0.005 after 20.
TREES, LEAF, SPILL = 10, 256, 0.35
#: Trees are fitted on a sample of about so many vectors; every vector is indexed.
SAMPLE = 20_000
#: Sampled vectors that a label needs for trees of its own, and a node for a fitted split.
OWN_TREES, FIT_NODE = 64, 16
#: Vectors of a leaf that one task compares at once; a larger leaf is compared block by block.
BLOCK = 1024

SEED = 11


def unit(rows: list) -> np.ndarray:
    """Vectors scaled to length one in double precision, whatever their size."""
    x = np.array(rows, dtype=float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _direction(tree: int, path: int, dims: int) -> np.ndarray:
    v = np.random.default_rng([SEED, tree, path, dims]).standard_normal(dims)
    return v / np.linalg.norm(v)


def margin(dims: int, spill: float = SPILL, least: float = COSINE) -> float:
    return spill * float(np.sqrt(2 - 2 * least)) / max(dims, 1) ** 0.5


class Tree:
    """Splits of one tree: by node, a direction and where to cut.

    A node is its path from the root, a leading one and a bit a level.  Below the sample's
    reach, nodes share a direction a level and cut where the last fitted node has its mean.
    """

    def __init__(self, number: int, sample: np.ndarray, depth: int):
        self.number, self.dims = number, sample.shape[1]
        self.margin = margin(self.dims)
        self.cut: dict[int, tuple[np.ndarray, float]] = {}
        self.mean: dict[int, np.ndarray] = {}
        todo = [(1, sample)]
        while todo:
            node, x = todo.pop()
            if len(x) < FIT_NODE or node.bit_length() > depth:
                self.mean[node] = x.mean(axis=0) if len(x) else np.zeros(self.dims)
                continue
            d = _direction(number, node, self.dims)
            p = x @ d
            at = float(np.median(p))
            self.cut[node] = (d, at)
            todo += [(2 * node, x[p <= at]), (2 * node + 1, x[p > at])]

    def leaves(self, x: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(path, rows)`` of every leaf that a vector reaches, ``depth`` splits down."""
        todo = [(1, np.arange(len(x)), None)]
        while todo:
            node, rows, mean = todo.pop()
            if not len(rows):
                continue
            if node.bit_length() > depth:
                yield node, rows
                continue
            if mean is None and node not in self.cut:
                mean = self.mean[node]
            if mean is None:
                d, at = self.cut[node]
            else:
                d = _direction(self.number, -node.bit_length() % (1 << 31), self.dims)
                at = float(mean @ d)
            p = x[rows] @ d
            todo += [(2 * node, rows[p <= at + self.margin], mean), (2 * node + 1, rows[p >= at - self.margin], mean)]


def _usable(vectors: DataFrame) -> DataFrame:
    """Distinct vectors that can link: ``grp`` (label and length), ``f`` (fingerprint), ``rep``, ``mult``, ``v``."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))


def _read(vectors: DataFrame) -> DataFrame:
    v = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    return v.withColumns({"grp": F.xxhash64("label", F.size("v")), "f1": F.xxhash64("label", "v"), "f2": F.xxhash64(F.lit(1), "v")})


def _assign(reps: DataFrame, forest, depths) -> DataFrame:
    """A row for each leaf that a vector reaches, and one with all its leaves."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, common = forest.value
        for b in batches:
            grp = np.array(b.column(0).to_pylist(), "i8")
            rows = b.column(2).to_pylist()
            out_row, out_leaf = [], []
            for g in np.unique(grp):
                at = np.flatnonzero(grp == g)
                x = unit([rows[i] for i in at])
                trees = own.get(int(g)) or common[x.shape[1]]
                for t in trees:
                    for path, hit in t.leaves(x, depths.value.get(int(g), 0)):
                        out_row.append(at[hit])
                        out_leaf.append(np.full(len(hit), (t.number << 40) | path, "i8"))
            if not out_row:
                continue
            row, leaf = np.concatenate(out_row), np.concatenate(out_leaf)
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            cuts = np.searchsorted(row, np.arange(len(rows) + 1))
            every = [leaf[a:z].tobytes() for a, z in zip(cuts, cuts[1:], strict=False)]
            taken = b.take(pa.array(row))
            none = len(leaf)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([taken.column(0), b.column(0)]), pa.concat_arrays([pa.array(leaf, pa.int64()), pa.nulls(len(rows), pa.int64())]), pa.concat_arrays([taken.column(1), b.column(1)]), pa.concat_arrays([pa.nulls(none, pa.binary()), pa.array(every, pa.binary())])],
                ["grp", "leaf", "rep", "leaves"],
            )

    return reps.select("grp", "rep", "v").mapInArrow(run, "grp long, leaf long, rep long, leaves binary")


def _first_meeting(leaves: list[bytes], leaf: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether this leaf is the first that the two vectors of each pair share."""
    rows = np.unique(np.concatenate([a, b]))
    before = [np.frombuffer(leaves[i], "i8") for i in rows]
    before = [x[x < leaf] for x in before]
    a, b = np.searchsorted(rows, a), np.searchsorted(rows, b)
    width = max(map(len, before))
    if not width:
        return np.ones(len(a), bool)
    if len(a) <= 4000:
        # no leaf has a negative number, so what fills up one side never meets the other
        left, right = np.full((len(rows), width), -1, "i8"), np.full((len(rows), width), -2, "i8")
        for k, x in enumerate(before):
            left[k, : len(x)] = right[k, : len(x)] = x
        met = np.zeros(len(a), bool)
        for j in range(width):
            met |= (left[a, j][:, None] == right[b]).any(axis=1)
        return ~met
    names, where = np.unique(np.concatenate(before), return_inverse=True)
    m = np.zeros((len(rows), len(names)), "f4")
    m[np.repeat(np.arange(len(rows)), [len(x) for x in before]), where] = 1
    return ~((m @ m.T) > 0)[a, b]


def _leaf(rows: list[tuple], least: float) -> list[tuple]:
    """Rows: leaf, side (0 or 1), block pair kind, rep, mult, leaves, v.  Yields (rep, n, null) for
    links and (a, null, b) for a spanning forest of them."""
    leaf, same = rows[0][0], rows[0][2]
    x = unit([r[6] for r in rows])
    side = np.array([r[1] for r in rows])
    mult = np.array([r[4] for r in rows], "i8")
    left = np.arange(len(rows)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return []
    i, j = np.nonzero(x[left] @ x[right].T >= least)
    i, j = left[i], right[j]
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return []
    first = _first_meeting([r[5] for r in rows], leaf, i, j)
    n = np.bincount(i[first], weights=mult[j[first]], minlength=len(rows)) + np.bincount(j[first], weights=mult[i[first]], minlength=len(rows))
    out = [(rows[k][3], int(n[k]), None) for k in np.flatnonzero(n)]
    forest = Forest(len(rows))
    out += [(rows[p][3], None, rows[q][3]) for p, q in zip(i.tolist(), j.tolist(), strict=True) if forest.join(p, q)]
    return out


def near_duplicates(vectors: DataFrame, scratch: Scratch, least: float = COSINE, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    ``n_links`` counts the other rows of the label with a cosine of at least ``least`` that share
    a leaf with the row in any tree; ``component_id`` is the smallest id reachable by links.  A
    vector that is null, empty, zero, or holds a null or a non-finite number, or has no label,
    links with nothing; lengths that differ are not compared.  Repeated rows are equal
    vectors and link with each other.  A row without id counts for no one: no links, null
    component, kept.  An empty table gives no rows; other columns, whatever their names, are not
    read.  Memory: a task holds at most two blocks of a leaf.
    """
    spark = vectors.sparkSession
    base = scratch.save(_read(vectors), "vectors")
    id_type = dict(base.dtypes)["vec_id"]
    key = ["grp", "f1", "f2"]
    reps = scratch.save(_usable(base).groupBy(*key).agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v")), "distinct-vectors")
    sizes = reps.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("v")).alias("dims"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # labels that need no split are left out: what is broadcast has at most total / leaf rows, and
    # those above the sample's reach are as few
    split = {r["grp"]: r["n"] for r in sizes.where(F.col("n") > leaf).collect()}
    depths = {g: int(np.ceil(np.log2(n / leaf))) for g, n in split.items()}
    share = min(1.0, SAMPLE / max(total, 1))
    drawn = reps.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("grp", "v").limit(2 * SAMPLE).collect()
    by_group: dict[int, list] = {}
    by_dims: dict[int, list] = {}
    for r in drawn:
        by_group.setdefault(r["grp"], []).append(r["v"])
        by_dims.setdefault(len(r["v"]), []).append(r["v"])
    deepest = max(depths.values(), default=0)
    own = {g: [Tree(t, unit(x), depths[g]) for t in range(trees)] for g, x in by_group.items() if g in depths and len(x) >= OWN_TREES}
    dims = [r["dims"] for r in sizes.select("dims").distinct().collect()]
    common = {d: [Tree(t, unit(by_dims[d]) if d in by_dims else np.zeros((0, d)), deepest) for t in range(trees)] for d in dims}
    # without splits one tree is as good as all
    if not depths:
        common = {d: t[:1] for d, t in common.items()}
    assigned = scratch.save(_assign(reps, spark.sparkContext.broadcast((own, common)), spark.sparkContext.broadcast(depths)), "leaves")
    entries = assigned.where("leaf IS NOT NULL").select("grp", "leaf", "rep")
    full = entries.groupBy("grp", "leaf").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("q", F.ceil(F.col("m") / block).cast("int"))
    met = entries.join(full, ["grp", "leaf"])
    mine = F.pmod(F.xxhash64("rep", F.lit(4)), F.col("q")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    met = met.select("grp", "leaf", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), (F.col("mine") > F.col("other")).cast("int").alias("side"), (F.col("mine") == F.col("other")).alias("same"), "rep")
    # a vector and the list of its leaves are sent to each block they meet in, and nowhere else
    whole = assigned.where("leaf IS NULL").select("rep", "leaves").join(reps.select("rep", "mult", "v"), "rep")
    met = met.join(whole, "rep").select("grp", "leaf", "b1", "b2", "side", "same", "rep", "mult", "leaves", "v")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 4):
            out = _leaf([(r[1], *r[4:]) for r in rows], least)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "n", "b"])

    order = ["grp", "leaf", "b1", "b2"]
    width = max(shuffle_width(spark), 1)
    found = scratch.save(met.repartition(width, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, n long, b long"), "links")
    links = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    classes = components(scratch, found.where("b IS NOT NULL").select("a", "b"), "vectors").select(F.col("id").alias("rep"), "component_id")
    scratch.keep("vectors", "distinct-vectors", "links", "vectors-components")
    named = reps.select(*key, "rep", "mult").join(links, "rep", "left").join(classes, "rep", "left").select(*key, (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    plain = _usable(base).select("vec_id", *key).join(named, key).select("vec_id", "n_links", "component_id")
    rest = base.join(reps.select(*key).withColumn("hit", F.lit(True)), key, "left").where("hit IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = plain.union(rest).select("vec_id", "n_links", F.col("component_id").cast(id_type).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that share their first columns; their last one, a vector, as a view of the batch."""
    now, rows = None, []
    for b in batches:
        vectors = b.column(b.num_columns - 1)
        flat, cuts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *vectors.value_lengths().to_pylist()]).tolist()
        views = [flat[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        for row in zip(*(c.to_pylist() for c in b.columns[:-1]), views, strict=True):
            if row[:keys] != now:
                if rows:
                    yield rows
                now, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield rows
