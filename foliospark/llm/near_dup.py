"""MinHash near-dedup by a chosen-path set similarity join.

After Christiani and Pagh's Chosen Path and its recursive form, CPSJoin.  Independent
trees branch documents by minwise shingles: a node holds the documents that chose the same
shingles on the way to it.  Small nodes are compared exhaustively on sketches.  A large
node is compared in blocks that share pivots; then what is not yet in its largest class is compared
with all of the node, or, while that is many documents, all of the node branches again by
further shingles.  No document stops before its node is done, and on the last level nothing branches:
everything is compared.  The pairs found only say
which documents must meet: these are brought together and every link is confirmed on the full
shingle sets.  Documents with equal sets are one document to all of this.

No pair list is ever built: nodes and groups give spanning forests, so what is emitted
is linear in the documents.  A large group meets in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Forest, Scratch, brief, components, lean, without

#: Words of a shingle, and the similarity in hundredths from which documents are linked.
SHINGLE = 5
PERCENT = 75
#: Independent trees.  A pair at the threshold is missed by all of them with probability 0.25 ** TREES.
TREES = 10
#: Minwise values of a sketch.  A pair is dropped if fewer than ``AGREE`` agree: at the
#: threshold 48 of 64 do on average, with a standard deviation of 3.5.
SKETCH, AGREE = 64, 28
#: Documents of a small node and of a block; pivots that meet every block of a large one; its children by
#: branch; levels of a tree.
NODE, PIVOTS, BRANCHES, LEVELS = 128, 8, 2, 4
#: Documents outside its largest class with which a node branches, and of each side where they meet all of it.
REST = 1024
#: Documents and bytes of sets that one confirming task holds at once.
BLOCK, BLOCK_BYTES = 256, 48_000_000
#: Pivots that meet every block of a large group.
LEADERS = 16
#: A document meets more than ``FEW`` others at once, by numbers in place of hashes, where a task's sets hold
#: at most ``NUMBERED`` together; else one by one.
FEW, NUMBERED = 8, 1_000_000
#: What the hashes are made of by which pivots lead: of nodes, and of groups.
_PIVOT, _LEADER = ("rep", "node"), ("rep",)

_RNG = np.random.default_rng(20240607)
_ODD = lambda n: _RNG.integers(1, 1 << 63, n, dtype="u8") * np.uint64(2) + np.uint64(1)
_STEP = _ODD(SHINGLE)
_SHORT = _ODD(SHINGLE)
_MUL, _ADD = _ODD(SKETCH), _RNG.integers(0, 1 << 63, SKETCH, dtype="u8")
_TREE_MUL, _TREE_ADD = _ODD(TREES), _RNG.integers(0, 1 << 63, TREES, dtype="u8")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class WordHashes(dict):
    """64-bit hashes of words met in a task; emptied when it has grown large."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z is lower-cased and words lie between ASCII white space.  A text of one to four words
    is one shingle; a text without words has none.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, "u8")
    h = np.fromiter(map(cache.__getitem__, words), "u8", n)
    if n < SHINGLE:
        return mix((h * _SHORT[:n]).sum(dtype="u8", keepdims=True) + _SHORT[n - 1 : n])
    s = h[: n - SHINGLE + 1] * _STEP[0]
    for k in range(1, SHINGLE):
        s = s + h[k : n - SHINGLE + 1 + k] * _STEP[k]
    return np.unique(mix(s))


def signature(sh: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minwise values of a set under each function."""
    out = np.full(len(mul), np.iinfo("u8").max, "u8")
    for at in range(0, len(sh), 2048):
        out = np.minimum(out, (sh[at : at + 2048, None] * mul + add).min(axis=0))
    return out


def summaries(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, f1, f2`` (fingerprint of the set), ``paths`` (a node per tree), ``sketch``."""
    picked = docs.select("doc_id", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            out = []
            for cell in b.column(1):
                sh = shingles(cell.as_py(), cache)
                if not len(sh):
                    out.append((0, 0, 0, [], b""))
                    continue
                a, z = mix(sh + _U(0x632BE59BD9B4E019)), mix(sh ^ _U(0x9E3779B97F4A7C15))
                paths = mix(signature(sh, _TREE_MUL, _TREE_ADD) + np.arange(TREES, dtype="u8"))
                sketch = (signature(sh, _MUL, _ADD) >> _U(40)).astype("<u2")
                out.append((len(sh), int(a.sum(dtype="u8").astype("i8")), int(np.bitwise_xor.reduce(z).astype("i8")), paths.astype("i8"), sketch.tobytes()))
            c = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["doc_id", "n_shingles", "f1", "f2", "paths", "sketch"])

    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, n_shingles long, f1 long, f2 long, paths array<long>, sketch binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that share their first ``keys`` columns, from rows sorted by them."""
    now, rows = None, []
    for b in batches:
        # a few rows at a time: each may hold the set of a long text
        for at in range(0, b.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                if row[:keys] != now:
                    if rows:
                        yield rows
                    now, rows = row[:keys], []
                rows.append(row)
    if rows:
        yield rows


def _edges(batches_of: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    for edges in batches_of:
        held += edges
        if len(held) > 20_000:
            yield _edge_batch(held)
            held = []
    if held:
        yield _edge_batch(held)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _alike(sketches: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, size: int) -> np.ndarray:
    """Which documents may be linked with one that has a sketch and a size."""
    # the bytes of a row of truths are added up eight at a time
    agree = (sketches == sketch).view("u8").sum(axis=1) * _U(0x0101010101010101) >> _U(56)
    return (agree >= AGREE) & (100 * np.minimum(sizes, size) >= PERCENT * np.maximum(sizes, size))


class _Node:
    """Documents of a node or a part of it, by sketches; rows: id, size, sketch."""

    def __init__(self, rows: list[tuple], classes: list | None = None):
        self.ids = [r[0] for r in rows]
        self.sizes = np.array([r[1] for r in rows])
        self.sketches = np.frombuffer(b"".join(r[2] for r in rows), "<u2").reshape(len(rows), SKETCH)
        self.cls = np.arange(len(rows)) if classes is None else np.unique(np.array(classes, "i8"), return_inverse=True)[1]
        self.edges: list[tuple[int, int]] = []

    def meet(self, i: int, sketches: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> None:
        """Join document i with those of ``others``, which have ``sketches`` and ``sizes``, that may be linked with it."""
        cls = self.cls
        j = others[_alike(sketches, sizes, self.sketches[i], self.sizes[i])]
        j = j[cls[j] != cls[i]]
        while len(j):
            self.edges.append((self.ids[i], self.ids[j[0]]))
            cls[cls == cls[j[0]]] = cls[i]
            j = j[cls[j] != cls[i]]


def _small_node(rows: list[tuple]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a node, or of a block with its pivots, that may be linked."""
    node, every = _Node(rows), np.arange(len(rows))
    for i in range(len(rows) - 1):
        node.meet(i, node.sketches[i + 1 :], node.sizes[i + 1 :], every[i + 1 :])
    return node.edges


def _rest_of_node(rows: list[tuple]) -> list[tuple[int, int]]:
    """Rows: id, size, sketch, class so far, side.  Edges that span classes across the sides."""
    node = _Node(rows, [r[3] for r in rows])
    right = np.array([i for i, r in enumerate(rows) if r[4]], "i8")
    sketches, sizes = node.sketches[right], node.sizes[right]
    for i, r in enumerate(rows):
        if not r[4] and len(right):
            node.meet(i, sketches, sizes, right)
    return node.edges


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out


def _heads(n: int, seeds: tuple[str, ...]) -> list:
    """Aggregates: the least hashes of a group's documents, each that of the document which leads by it."""
    return [F.min(F.xxhash64(*seeds, F.lit(j))).alias(f"p{j}") for j in range(n)]


def _blocks(n: int, seeds: tuple[str, ...]):
    """The blocks of a document among ``q``: its own, or all if it leads by one of ``n`` hashes."""
    leads = F.lit(False)
    for j in range(n):
        leads = leads | (F.xxhash64(*seeds, F.lit(j)) == F.col(f"p{j}"))
    return F.explode(F.when(leads, F.sequence(F.lit(0), F.col("q") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("q")).cast("int"))))


def _sides(rows: DataFrame) -> DataFrame:
    """Where the rest of a group meets all of it: ``rb``, ``block``, ``side``.  A row of the rest (its ``cls``
    is not ``main``) stands on side 0 of every of ``q`` blocks, each row on side 1 of every of ``rq`` parts of the rest."""
    place = lambda rb, block, side: F.struct(rb.cast("int").alias("rb"), block.cast("int").alias("block"), F.lit(side).alias("side"))
    part, block = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rq")), F.pmod(F.xxhash64("rep"), F.col("q"))
    left = F.when(F.col("cls") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda x: place(part, x, 0))).otherwise(F.array())
    right = F.transform(F.sequence(F.lit(0), F.col("rq") - 1), lambda x: place(x, block, 1))
    return rows.withColumn("at", F.explode(F.concat(left, right))).select("*", "at.*").drop("at")


def _rest(known: DataFrame, key: str) -> DataFrame:
    """Of each group: ``c`` documents, its largest class ``main``, and ``r`` documents outside it."""
    classes = known.groupBy(key, "cls").agg(F.count(F.lit(1)).alias("k"))
    most = classes.groupBy(key).agg(F.sum("k").alias("c"), F.max(F.struct("k", "cls")).alias("m"))
    return most.select(key, "c", F.col("m.cls").alias("main"), (F.col("c") - F.col("m.k")).alias("r")).where("r > 0")


def candidates(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)``: pairs that span the groups of documents which must be compared in full.

    ``reps`` has ``rep, n, paths, sketch``.  Small nodes and the blocks of large ones, which share pivots, are
    compared together.  What is then outside a large node's largest class meets all of
    the node, block by block.  A node where that is more than ``REST`` documents
    branches instead, with all its documents, unless the level is the last.
    """
    sketches = reps.select("rep", "n", "sketch")
    fields = ["rep", "n", "sketch"]
    entries = reps.select(F.explode("paths").alias("node"), "rep")
    found: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        nodes = scratch.save(entries.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), f"sizes-{level}")
        met = entries.join(nodes.where(F.col("c") <= NODE).select("node"), "node").select("node", "rep", F.lit(0).alias("block"))
        large = nodes.where(F.col("c") > NODE)
        some = bool(large.limit(1).count())
        if some:
            own = scratch.save(entries.join(large.select("node"), "node").select("node", "rep"), f"large-{level}")
            heads = own.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / NODE).cast("int").alias("q"), *_heads(PIVOTS, _PIVOT))
            met = met.union(own.join(heads, "node").select("node", "rep", _blocks(PIVOTS, _PIVOT).alias("block")))
        found.append(scratch.save(_confirm(met.join(sketches, "rep"), ["node", "block"], fields, _small_node), f"found-{level}"))
        if not some:
            break
        labels = components(scratch, _union(found), f"classes-{level}")
        found = [labels.select(F.col("id").alias("a"), F.col("component_id").alias("b"))]
        known = own.join(sketches, "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        known = scratch.save(known.select("node", *fields, F.coalesce("component_id", "rep").alias("cls")), f"node-classes-{level}")
        scratch.drop(f"large-{level}")
        branching = F.lit(False) if level == LEVELS else F.col("r") > REST
        rest = scratch.save(_rest(known, "node").withColumn("branching", branching), f"rest-sizes-{level}")
        kinds = {r["branching"] for r in rest.select("branching").distinct().collect()}
        if False in kinds:
            ends = rest.where("NOT branching").select("node", "main", F.ceil(F.col("r") / REST).cast("int").alias("rq"), F.ceil(F.col("c") / REST).cast("int").alias("q"))
            found.append(scratch.save(_confirm(_sides(known.join(ends, "node")), ["node", "rb", "block"], [*fields, "cls", "side"], _rest_of_node), f"rests-{level}"))
        if True in kinds:
            entries = scratch.save(_children(known.join(rest.where("branching").select("node"), "node").select("node", "rep", "sketch")), f"nodes-{level + 1}")
        scratch.drop(f"node-classes-{level}")
        if True not in kinds:
            break
    return _union(found)


def _children(members: DataFrame) -> DataFrame:
    """The nodes to which documents branch, by the values of their sketches at places that a node chooses."""

    @brief
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            seed = mix(b.column(0).to_numpy().view("u8"))
            own = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u2").reshape(-1, SKETCH)
            for j in range(BRANCHES):
                at = (seed >> _U(8 * j)) % _U(SKETCH)
                value = own[np.arange(len(own)), at.astype("i8")].astype("u8")
                node = mix(seed ^ (value << _U(20) | at << _U(8) | _U(j))).view("i8")
                yield pa.RecordBatch.from_arrays([pa.array(node), b.column(1)], ["node", "rep"])

    return members.mapInArrow(run, "node long, rep long")


class _Group:
    """Documents of one confirming task."""

    def __init__(self, rows: list[tuple]):
        """Rows: id, size, sketch, set."""
        self.ids = [r[0] for r in rows]
        self.sizes = np.array([r[1] for r in rows])
        self.sketches = np.frombuffer(b"".join(r[2] for r in rows), "<u2").reshape(len(rows), SKETCH)
        self.sets = [np.frombuffer(r[3], "<u8") for r in rows]
        self.lengths = np.array([len(x) for x in self.sets])
        self.numbers: list[np.ndarray] | None = None
        self.forest = Forest(len(rows))
        self.edges: list[tuple[int, int]] = []

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum())
        return 100 * both >= PERCENT * (len(a) + len(b) - both)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """The sizes of the intersections of set i with those of ``others``, at once."""
        if self.numbers is None:
            ends = np.cumsum(self.lengths)
            at = np.unique(np.concatenate(self.sets), return_inverse=True)[1].astype("i4")
            self.numbers, self.marked = np.split(at, ends[:-1]), np.zeros(int(at.max()) + 1, bool)
        self.marked[self.numbers[i]] = True
        hits = self.marked[np.concatenate([self.numbers[j] for j in others.tolist()])]
        self.marked[self.numbers[i]] = False
        return np.add.reduceat(hits, np.cumsum(self.lengths[others]) - self.lengths[others], dtype="i8")

    def confirm(self, i: int, others: np.ndarray) -> None:
        """Link document i with those of ``others`` that are not yet in its class and are similar."""
        alike = others[_alike(self.sketches[others], self.sizes[others], self.sketches[i], self.sizes[i])].tolist()
        mine = self.forest.root(i)
        alike = [j for j in alike if self.forest.root(j) != mine]
        sure = len(alike) > FEW and self.lengths.sum() <= NUMBERED
        if sure:
            j = np.array(alike)
            both = self.common(i, j)
            alike = j[100 * both >= PERCENT * (self.lengths[i] + self.lengths[j] - both)].tolist()
        for j in alike:
            if self.forest.root(i) != self.forest.root(j) and (sure or self.linked(i, j)):
                self.forest.join(i, j)
                self.edges.append((self.ids[i], self.ids[j]))


def _whole_group(rows: list[tuple]) -> list[tuple[int, int]]:
    """All pairs of a group, or of a block with its leaders."""
    group = _Group(rows)
    every = np.arange(len(rows))
    for i in range(len(rows) - 1):
        group.confirm(i, every[i + 1 :])
    return group.edges


def _two_sides(rows: list[tuple]) -> list[tuple[int, int]]:
    """Rows: id, size, sketch, set, class so far, side.  Pairs of different classes across the sides."""
    group, first = _Group(rows), {}
    for i, r in enumerate(rows):
        group.forest.join(first.setdefault(r[4], i), i)
    right = np.array([i for i, r in enumerate(rows) if r[5]], "i8")
    for i in range(len(rows)):
        if not rows[i][5] and len(right):
            group.confirm(i, right)
    return group.edges


def _confirm(rows: DataFrame, keys: list[str], fields: list[str], work) -> DataFrame:
    dealt = rows.select(*keys, *fields).repartition(*keys).sortWithinPartitions(*keys)
    n = len(keys)
    return dealt.mapInArrow(brief(lambda it: _edges(work([r[n:] for r in g]) for g in _groups(it, n))), "a long, b long")


def confirmed(sets: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges that span the classes of really linked documents, within each group.

    ``sets`` has ``grp, rep, n, sketch, sh``, ``groups`` ``grp, rep, n``, a row per document.  A group of at most
    ``BLOCK`` documents is compared as a whole.  A larger one is cut into blocks: each is compared within and with
    the group's leaders; then what is not yet linked to the group's largest class
    is compared with all of the group, block by block.  Pairs already connected are skipped.
    """
    fields = ["rep", "n", "sketch", "sh"]
    width = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    sizes = scratch.save(groups.groupBy("grp").agg(width.alias("q"), *_heads(LEADERS, _LEADER)), "group-sizes")
    blocks = sets.join(sizes, "grp").select("grp", *fields, _blocks(LEADERS, _LEADER).alias("block"))
    edges = scratch.save(_confirm(blocks, ["grp", "block"], fields, _whole_group), "confirmed-blocks")
    big = sizes.where("q > 1").select("grp", "q")
    if not big.limit(1).count():
        return edges
    labels = components(scratch, edges, "blocks")
    known = groups.join(big, "grp").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("grp", "rep", "q", F.coalesce("component_id", "rep").alias("cls"))
    known = scratch.save(known, "block-classes")
    rest = scratch.save(_rest(known, "grp").select("grp", "main", F.ceil(F.col("r") / BLOCK).cast("int").alias("rq")), "unlinked")
    edges = labels.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    if not rest.limit(1).count():
        return edges
    left = _sides(sets.join(known.join(rest, "grp").select("rep", "q", "cls", "main", "rq"), "rep"))
    return edges.union(scratch.save(_confirm(left, ["grp", "rb", "block"], [*fields, "cls", "side"], _two_sides), "confirmed-rest"))


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Texts are linked if 100 * |intersection| >= 75 * |union| of their shingle sets;
    ``component_id`` is the smallest id reachable by links, ``kept`` whether that is the
    document's own.  Null, empty and wordless texts have no shingles and are linked with
    nothing.  Rows that repeat an id and its text fall together.  A row without id takes
    no part: its component is null and it is kept.  An empty table gives no rows.  Ids
    are taken to name one text each.  Texts are read whole, however long; other columns, whatever their
    names, are neither read nor returned.
    """
    spark = docs.sparkSession
    all_rows = scratch.save(summaries(docs), "summaries")
    usable = all_rows.where("n_shingles > 0 AND doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    key = ["n_shingles", "f1", "f2"]
    reps = scratch.save(usable.groupBy(*key).agg(F.min(F.struct("doc_id", "paths", "sketch")).alias("r")).select(*key, F.col("r.doc_id").alias("rep"), F.col("n_shingles").alias("n"), "r.paths", "r.sketch"), "representatives")
    pairs = candidates(reps.select("rep", "n", "paths", "sketch"), scratch)
    found = components(scratch, pairs, "candidates").select(F.col("id").alias("rep"), F.col("component_id").alias("grp"))
    groups = scratch.save(found.join(reps.select("rep", "n", "sketch"), "rep").select("grp", "rep", "n", "sketch"), "groups")
    # candidate documents are picked from the texts by a broadcast of checked size, else by shuffle
    side = groups.select(F.col("rep").alias("__rep"))
    if groups.count() <= BROADCAST_IDS:
        side = F.broadcast(side)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, F.col("doc_id") == F.col("__rep")).select("doc_id", "text")

    @lean
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            sets = [shingles(cell.as_py(), cache).astype("<u8") for cell in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "k", "sh"])

    whole = texts.mapInArrow(full, "rep long, k long, sh binary").join(groups, "rep").where("k = n").select("grp", "rep", "n", "sketch", "sh")
    links = confirmed(scratch.save(whole, "full-sets"), groups.select("grp", "rep", "n"), scratch)
    classes = components(scratch, links, "links").select(F.col("id").alias("rep"), "component_id")
    scratch.keep("summaries", "representatives", "links-components")
    named = reps.select(*key, "rep").join(classes, "rep", "left").select(*key, F.coalesce("component_id", "rep").alias("component_id"))
    id_type = dict(all_rows.dtypes)["doc_id"]
    base = all_rows.select("doc_id", *key)
    joined = base.where("n_shingles > 0").join(named, key, "left")
    out = joined.select("doc_id", "n_shingles", "component_id").union(base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").cast("long")))
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("component_id").cast(id_type))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One document of each group of near-duplicates: the row with the smallest id.

    Rows that repeat a kept id with the same text are one document and are kept as they are.
    """
    return without(docs, near_duplicates(docs, scratch).where("NOT kept").select("doc_id"), scratch, "copies")
