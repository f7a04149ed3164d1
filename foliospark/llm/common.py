"""What the training-data operators share: shared tables, word rules, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: The word separator of every contract here: ASCII white space only.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most, while an operator of this subpackage runs.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(run):
    """A task function that gives memory back when it ends, for workers are used again."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


#: Bytes that a task reads before a cyclic collection at its end is worth its time, some hundredths of a second.
COLLECT_BYTES = 1_000_000


def brief(run):
    """``lean`` for stages with many small tasks: what read little looks for no cycles at its end."""

    @wraps(run)
    def wrapped(batches):
        read = 0

        def counted():
            nonlocal read
            for b in batches:
                read += b.nbytes
                yield b

        try:
            yield from run(counted())
        finally:
            release(read > COLLECT_BYTES)

    return wrapped


def slices(column: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Texts of a column, some megabytes at a time, each with the row it starts at."""
    sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        done = sizes[first - 1] if first else 0
        last = max(int(np.searchsorted(sizes, done + most, side="right")), first + 1)
        yield first, column.slice(first, last - first)
        first = last


def split_words(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased and split at each ASCII white space character, which leaves empty words where
    several stand together; a null text is empty."""
    texts = pc.ascii_lower(texts).fill_null("")
    for c in "\n\t\r\x0b\x0c":
        if pc.any(pc.match_substring(texts, c)).as_py():
            texts = pc.replace_substring(texts, c, " ")
    return pc.split_pattern(texts, " ")


def release(collect: bool = True) -> None:
    """Give freed memory back to the system; without ``collect``, only what no cycle holds."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Scratch:
    """Parquet tables in the folder that all executors share (``spark.checkpoint.dir``).

    Writing a stage out and reading it again cuts lineage: a lost executor costs
    the running stage only.  Where the session names no folder (tests on one
    machine) a temporary one is made and set as the checkpoint directory.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.saved: set[str] = set()
        self.tables: set[str] = set()
        self.codec = "zstd"
        ship(spark)
        # whole texts are wide rows: fewer of them a batch bound what JVM and Python hold at once
        if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
            spark.conf.set(_BATCH, BATCH_ROWS)
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            top = _own_dir(spark)
        self.root = f"{top.rstrip('/')}/foliospark-{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.saved.add(name)
        # an explicit schema spares the job that infers it and lets empty tables be read
        path = self.path(name)
        df.write.mode("overwrite").option("compression", self.codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """A table whose rows lie by ``key``, so that what groups or joins by it need not shuffle it again."""
        table = self._table(name)
        self.tables.add(name)
        df.write.mode("overwrite").option("compression", self.codec).option("path", self.path(name)).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        return self.spark.table(table)

    def _table(self, name: str) -> str:
        return f"foliospark_{self.root.rsplit('-', 1)[1]}_{name}".replace("-", "_")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            self.saved.discard(name)
            if name in self.tables:
                self.tables.discard(name)
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def keep(self, *names: str) -> None:
        """Delete all tables saved so far but these, which a result still reads."""
        self.drop(*self.saved.difference(names))

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of jobs that are done: it does so once the driver's
        garbage collector has seen that nothing refers to them."""
        gc.collect()
        self.spark._jvm.System.gc()

    @contextmanager
    def plain(self) -> Iterator[None]:
        """Tables as they are, where their columns are compressed already."""
        before, self.codec = self.codec, "uncompressed"
        try:
            yield
        finally:
            self.codec = before

    @contextmanager
    def batches(self, rows: int) -> Iterator[None]:
        """Arrow batches of at most so many rows for the jobs that run inside; the session's own size afterwards."""
        before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, min(rows, int(before)) if int(before) > 0 else rows)
        try:
            yield
        finally:
            self.spark.conf.set(_BATCH, before)


def _own_dir(spark: SparkSession) -> str:
    """A temporary folder where the session names none: on one machine only, where executors share it."""
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark, "_foliospark_dir", None)
    if made is None:
        made = f"file://{tempfile.mkdtemp(prefix='foliospark-')}"
        spark._foliospark_dir = made
    return made


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rejected ids up to this many are broadcast (8 MB of longs); beyond it rows and ids meet in a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is not in ``gone(doc_id)``.

    Rows keep their own columns and never multiply; a row without id stays.
    """
    ids = scratch.save(gone.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct(), name)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids["__gone"], "left_anti")


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", most: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(id, component_id)``.

    Only vertices with an edge are returned; ``component_id`` is the smallest id of
    the component.  Each task first joins the edges it has, which leaves at most one a vertex.
    If then no more than ``LOCAL_EDGES`` are left (counted; 16 bytes each), one task on an
    executor joins them all.  Beyond that the graph is contracted in rounds by shuffles.
    """
    thin = edges.where("a <> b").select("a", "b").mapInArrow(_stars(500_000), "a long, b long")
    left = scratch.save(thin, f"{name}-edges")
    if left.count() <= LOCAL_EDGES:
        whole = left.coalesce(1).mapInArrow(_stars(None), "id long, component_id long")
        return scratch.save(whole, f"{name}-components")
    return _contract(scratch, left, name, most)


#: Edges that one task may join at once, see ``components``.
LOCAL_EDGES = 1_000_000


def _stars(most: int | None):
    """Edges of a task as (vertex, smallest vertex of its class); with ``most``, in runs of about so many
    vertices and without the smallest vertices themselves."""

    @brief
    def run(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up[x]) != x:
                up[x] = x = up[y]
            return x

        def batch(names: list[str]) -> pa.RecordBatch:
            rows = [(x, r) for x in up if (r := root(x)) != x or most is None]
            columns = list(zip(*rows, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                up.setdefault(x, x)
                up.setdefault(y, y)
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if most is not None and len(up) > most:
                yield batch(["a", "b"])
                up.clear()
        yield batch(["a", "b"] if most is not None else ["id", "component_id"])

    return run


def _contract(scratch: Scratch, edges: DataFrame, name: str, most: int) -> DataFrame:
    """Components by contraction: every vertex points to the neighbour (or itself) whose
    hash is least, edges are drawn between what their ends point to, and what is left, a
    fraction of it, goes on until no edge is left; then the pointers are followed back.  Each
    round is written out.  A hot vertex is a hot join key only, which AQE splits,
    and minima are taken map-side first.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    left = scratch.save(edges.where("a <> b").select(*ends("a", "b")).distinct(), f"{name}-edges-0")
    found: DataFrame | None = None
    for k in range(most):
        near = left.select("a", rank("b").alias("r")).union(left.select(F.col("b").alias("a"), rank("a").alias("r")))
        points = scratch.save(near.groupBy(F.col("a").alias("v")).agg(F.least(rank("a"), F.min("r"))["v"].alias("to")), f"{name}-points-{k}")
        if found is None:
            found = points.select(F.col("v").alias("id"), "to")
        else:
            found = found.join(points.select(F.col("v").alias("to"), F.col("to").alias("__next")), "to", "left").select("id", F.coalesce("__next", "to").alias("to"))
        drawn = left.join(points.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(points.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        left = scratch.save(drawn.where("x <> y").select(*ends("x", "y")).distinct(), f"{name}-edges-{k + 1}")
        scratch.drop(f"{name}-edges-{k}")
        if not left.limit(1).count():
            break
    else:
        raise RuntimeError(f"components: edges are left after {most} rounds")
    roots = scratch.save(found, f"{name}-roots")
    least = roots.groupBy("to").agg(F.min("id").alias("component_id"))
    return scratch.save(roots.join(least, "to").select("id", "component_id"), f"{name}-components")


class Forest:
    """Union-find over row numbers, for the work inside one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        if j < i:
            i, j = j, i
        self.up[j] = i
        return True
