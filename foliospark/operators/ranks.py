"""Exact places in an order, and the value at a place, over tables of any size."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Shared, shuffle_width

#: Groups up to this many are broadcast (some 50 bytes each); beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 200_000

#: Bits of a row's number within its range, as ``monotonically_increasing_id`` lays it out.
_ROW_BITS = 33


def _with_groups(rows: DataFrame, groups: DataFrame, on: list[str], few: bool) -> DataFrame:
    """Rows with the columns of their group; null groups are groups."""
    renamed = groups.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in groups.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(F.broadcast(renamed) if few else renamed, same).drop(*[f"__{c}" for c in on])


def places(rows: DataFrame, order: list[Column], group: str | None = None, name: str = "place", ranges: int | None = None) -> DataFrame:
    """Rows with their place (from 1) in ``order``, over the whole table or within each value of ``group``.

    Rows are dealt into ranges of (group, order), sorted there, numbered and written.  A range's
    first place is the number of rows before it: a count for each range, which is all the driver gets.
    Places within a group are counted from the group's first.  A task holds a range, never a group, so a
    group with most of the rows lies in many ranges.

    Rows that ``order`` does not tell apart are placed by a hash of all their columns, so they split, too;
    rows equal in every column get consecutive places in one range.  A null group is a group.  An empty
    table gives no rows.  Columns named like ``name`` are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop(name)
    shared = Shared(spark, "places")
    # a struct of the columns hashes whatever they are; maps and variants have no hash and go as text
    plain = [F.to_json(F.struct(c)) if t.startswith("map") or "variant" in t else F.col(c) for c, t in rows.dtypes]
    keys = ([F.col(group)] if group else []) + list(order) + [F.xxhash64(*plain)]
    dealt = rows.repartitionByRange(ranges or shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    numbered = shared.save(dealt.withColumn("__at", F.monotonically_increasing_id()), "sorted")
    the_range = F.shiftright("__at", _ROW_BITS)
    sizes = sorted((r["r"], r["n"]) for r in numbered.groupBy(the_range.alias("r")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = dict(zip([r for r, _ in sizes], accumulate([n for _, n in sizes], initial=0)))
    row = F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    if not before:
        return numbered.drop("__at").withColumn(name, F.lit(None).cast("long"))
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    placed = numbered.withColumn(name, (row + 1 + F.element_at(offsets, the_range)).cast("long")).drop("__at")
    if group is None:
        return placed
    starts = placed.groupBy(group).agg((F.min(name) - 1).alias("__first"))
    starts = shared.save(starts, "starts")
    few = starts.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return _with_groups(placed, starts, [group], few).withColumn(name, F.col(name) - F.col("__first")).drop("__first").select(*rows.columns, name)


def upper_median(n: Column) -> Column:
    """Place of the upper median of ``n`` values in ascending order."""
    return F.floor(n / 2) + 1


def percentile_place(share: float) -> Callable[[Column], Column]:
    """Place of the least value that ``share`` of the values do not exceed."""
    return lambda n: F.greatest(F.ceil(n * F.lit(share)), F.lit(1))


def _bucket(kind: str, buckets: int) -> Column:
    """Bucket of ``__v`` between ``lo`` and ``hi``: ascending in the value, with ``lo`` and ``hi`` apart."""
    if kind in ("float", "double"):
        v, lo, hi = (F.col(c).cast("double") for c in ("__v", "lo", "hi"))
        # halves keep the difference of two huge values finite
        half = F.when((F.abs(lo) > 1e300) | (F.abs(hi) > 1e300), 0.5).otherwise(1.0)
        part = F.nanvl(F.coalesce(F.try_divide(v * half - lo * half, hi * half - lo * half), F.lit(0.0)), F.lit(0.0))
        inner = F.least(F.floor(F.greatest(F.least(part, F.lit(1.0)), F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("long")
        infinite = F.lit(float("inf"))
        return F.when(F.isnan(v), buckets + 1).when(v == infinite, buckets).when(v == -infinite, -1).otherwise(inner)
    wide = "decimal(38,0)" if not kind.startswith("decimal") else kind
    v, lo, hi = (F.col(c).cast(wide) for c in ("__v", "lo", "hi"))
    return F.least(F.floor((v - lo).cast("double") / (hi - lo).cast("double") * buckets), F.lit(buckets - 1)).cast("long")


def at_place(rows: DataFrame, group: str, value: str, place: Callable[[Column], Column] = upper_median, name: str = "median", buckets: int = 1024, passes: int = 400) -> DataFrame:
    """``group, n, name``: for each group the number of its values and the value at a place in ascending order.

    ``place`` gives the place from the number of values.  Exact, without sorting: each pass counts the
    values that are still in question in ``buckets`` equal parts of each group's span, map-side first, and
    goes on in the part that holds the place, until its least and largest value are equal.  A pass reads
    the rows and shuffles a row per group and bucket; a group has ``buckets`` rows in a task, whatever its size.

    Null values are left out, a group of nulls only has no row, and a null group is a group.  Of doubles
    NaN is the largest.  Columns must be numbers; doubles that spread over many powers of ten take a pass
    for every three of these.
    """
    kind = dict(rows.dtypes)[value]
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kind.startswith("decimal"):
        raise TypeError(f"{value} is {kind}, not a number")
    shared = Shared(rows.sparkSession, "at-place")
    values = rows.select(F.col(group).alias("g"), F.col(value).alias("__v")).where("__v IS NOT NULL")
    state = values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    state = shared.save(state.select("g", "n", place(F.col("n")).cast("long").alias("k"), "lo", "hi"), "state-0")
    few = state.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    # equal in the order of values: NaN equals NaN
    done, todo = F.col("lo").eqNullSafe(F.col("hi")), ~F.col("lo").eqNullSafe(F.col("hi"))
    left = state
    for turn in range(1, passes + 1):
        open_ = left.where(todo)
        if not open_.limit(1).count():
            break
        asked = _with_groups(values, open_.select("g", "lo", "hi"), ["g"], few).where("__v >= lo AND __v <= hi")
        parts = asked.groupBy("g", _bucket(kind, buckets).alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("from"), F.max("__v").alias("to"))
        upto = F.sum("c").over(Window.partitionBy("g").orderBy("b"))
        held = _with_groups(parts.withColumn("upto", upto), open_.select("g", "n", "k"), ["g"], few).where("upto >= k AND upto - c < k")
        nearer = held.select("g", "n", (F.col("k") - F.col("upto") + F.col("c")).alias("k"), F.col("from").alias("lo"), F.col("to").alias("hi"))
        left = shared.save(left.where(done).unionByName(nearer), f"state-{turn}")
        shared.drop(f"state-{turn - 1}")
    else:
        raise RuntimeError(f"{value} is not settled after {passes} passes")
    return left.select(F.col("g").alias(group), "n", F.col("lo").alias(name))
