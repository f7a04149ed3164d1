"""Joins, windows, sorts and set operations that carry a meaning of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# joins


def lookup(rows: DataFrame, dimension: DataFrame, on: str, ordinal: str | None = None) -> DataFrame:
    """Left join to a dimension in which the last row of a key counts, so rows never multiply.

    Without ``ordinal`` the last is that with the largest columns, in their order."""
    others = [c for c in dimension.columns if c not in (on, ordinal)]
    if not others:
        return rows
    last = F.max_by(F.struct(*others), ordinal) if ordinal else F.max(F.struct(*others))
    one = dimension.groupBy(on).agg(last.alias("__last"))
    return rows.join(one, on, "left").select(*rows.columns, *[F.col(f"__last.`{c}`").alias(c) for c in others])


def overlay(rows: DataFrame, curated: DataFrame, on: str, flag: str = "curated") -> DataFrame:
    """Columns of a curated row replace those of the row with its key, nulls included."""
    fresh = curated.withColumn(flag, F.lit(True))
    shared = [c for c in curated.columns if c != on]
    joined = rows.join(fresh.select(on, flag, *[F.col(c).alias(f"__{c}") for c in shared]), on, "left")
    picked = [F.when(F.col(flag), F.col(f"__{c}")).otherwise(F.col(c) if c in rows.columns else F.lit(None)).alias(c) for c in shared]
    kept = [F.col(c) for c in rows.columns if c not in shared]
    return joined.select(*kept, *picked, F.coalesce(F.col(flag), F.lit(False)).alias(flag))


def first_link(bridge: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the order of a bridge."""
    w = Window.partitionBy(key).orderBy(*order)
    return bridge.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def gather(rows: DataFrame, key: str, ordinal: str, value: str, name: str) -> DataFrame:
    """Values of a key as an array in ordinal order."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, value))), lambda x: x[value]).alias(name))


def follow(rows: DataFrame, id_col: str, links: str, name: str, value: str | None = None) -> DataFrame:
    """Rows with the rows their ``links`` array names, in its order; dangling ids are dropped."""
    value = value or id_col
    target = rows.select(F.col(id_col).alias("__to"), F.col(value).alias("__v"))
    pairs = rows.select(F.col(id_col), F.posexplode(links).alias("__pos", "__to")).join(target, "__to")
    return rows.join(gather(pairs, id_col, "__pos", "__v", name), id_col, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def overlapping(rows: DataFrame, id_col: str, links: str, wanted: DataFrame) -> DataFrame:
    """Rows one of whose links is among ``wanted(id)``."""
    hit = rows.select(F.col(id_col), F.explode(links).alias("__to")).join(wanted.select(F.col("id").alias("__to")).distinct(), "__to", "left_semi").select(id_col).distinct()
    return rows.join(hit, id_col, "left_semi")


def add_new(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``existing`` and those rows of ``fresh`` whose key it lacks; twice is the same as once."""
    return existing.unionByName(fresh.join(existing.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def replace_partition(rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of every key that ``fresh`` holds replaced by its rows; other keys stay."""
    return rows.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def as_of(events: DataFrame, marks: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """Events with the value of the latest mark of their key at or before them.

    Both sides are sorted together once by key and time; no range join is made.
    """
    cols = [c for c in events.columns if c not in (key, at)]
    a = marks.select(F.col(key), F.col(at), F.lit(0).alias("__s"), F.col(value).alias(name), *[F.lit(None).cast(t).alias(c) for c, t in events.dtypes if c in cols])
    b = events.select(F.col(key), F.col(at), F.lit(1).alias("__s"), F.lit(None).cast(dict(marks.dtypes)[value]).alias(name), *cols)
    w = Window.partitionBy(key).orderBy(at, "__s").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(name, F.last(name, ignorenulls=True).over(w)).where("__s = 1").drop("__s")


def within(left: DataFrame, right: DataFrame, key: str, at: str, width: int, suffix: str = "_other") -> DataFrame:
    """Pairs of a key whose numbers differ by at most ``width``.

    Numbers are cut into buckets of that width; a row of the right side goes to its bucket and
    its neighbours, so pairs meet on an equal key.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    r = right.select(*[F.col(c).alias(c if c == key else c + suffix) for c in right.columns])
    r = r.withColumn("__b", F.explode(F.array(*[bucket(at + suffix) + k for k in (-1, 0, 1)])))
    return left.withColumn("__b", bucket(at)).join(r, [key, "__b"]).where(F.abs(F.col(at) - F.col(at + suffix)) <= width).drop("__b")


# windows


def carry(rows: DataFrame, key: str, order: list[str], value: Column, name: str, own: bool = True) -> DataFrame:
    """The last value seen so far in each key, the row's own included or not."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def number_duplicates(rows: DataFrame, key: str, order: list[str], every: bool = True) -> DataFrame:
    """Keys made unique with a number: all of a duplicate's rows from 1, or only those after the first from 2."""
    w = Window.partitionBy(key).orderBy(*order)
    n, total = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(key))
    out = rows.withColumn("__n", n).withColumn("__t", total)
    numbered = F.concat(F.col(key), F.lit("-"), F.col("__n").cast("string"))
    need = F.col("__t") > 1 if every else F.col("__n") > 1
    return out.withColumn(key, F.when(need, numbered).otherwise(F.col(key))).drop("__n", "__t")


def prefer(rows: DataFrame, key: str, order: str, is_preferred: Column) -> DataFrame:
    """One row a key: the first preferred one, else the last; at the place of the key's first row."""
    w = Window.partitionBy(key)
    ranked = rows.withColumns({"__p": is_preferred.cast("int"), "__first": F.min(order).over(w)})
    pick = Window.partitionBy(key).orderBy(F.desc("__p"), F.when(F.col("__p") == 1, F.col(order)).otherwise(-F.col(order)))
    return ranked.withColumn("__n", F.row_number().over(pick)).where("__n = 1").drop("__n", "__p", order).withColumnRenamed("__first", order)


def top_k(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def drop_repeats(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value equals that of the row before are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__b", F.lag(value).over(w)).withColumn("__f", F.row_number().over(w)).where((F.col("__f") == 1) | ~F.col(value).eqNullSafe(F.col("__b"))).drop("__b", "__f")


def running_offset(rows: DataFrame, key: str, order: list[str], length: Column, name: str) -> DataFrame:
    """Where each piece starts: the lengths before it, summed."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0)))


def longest(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The row with the longest text of each key, the earliest among equals.

    By one grouped maximum, which combines map-side."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(F.length(text).alias("n"), (-F.col(order)).alias("o"), F.struct(*others).alias("r")))["r"].alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in others])


# orders: lists of columns, so that sorts and ranks share them


def headcount_order(label: str = "label") -> list[Column]:
    return [F.desc(F.coalesce("headcount", F.lit(0))), F.col(label)]


def term_order(year: str, label: str = "label") -> list[Column]:
    """Ascending years; none and zero last."""
    return [F.coalesce(F.nullif(F.col(year), F.lit(0)), F.lit(9999)), F.col(label)]


def largest_order(value: str, *ties: str) -> list[Column]:
    """Largest first, nothing counting as zero; ties in the order of their rows."""
    return [F.desc(F.coalesce(F.col(value), F.lit(0))), *map(F.col, ties)]


def clause_order(contract: str = "contract_id", page: str = "page", key: str = "id") -> list[Column]:
    """Documents, their pages (none first) and ids as text, so that ``x__10`` comes before ``x__2``."""
    return [F.col(contract), F.coalesce(F.col(page), F.lit(0)), F.col(key)]


def by_headcount(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.orderBy(*headcount_order(label))


def by_term(rows: DataFrame, year: str, label: str = "label") -> DataFrame:
    return rows.orderBy(*term_order(year, label))


def expiry_key(end_date: Column, term_end: Column) -> Column:
    return F.coalesce(end_date, F.concat(F.coalesce(F.nullif(term_end, F.lit(0)), F.lit(9999)).cast("string"), F.lit("-12-31")))
