"""Fields of JSON records that come and go: which there are, of what kinds, and records put over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def records(rows: DataFrame, text: str, name: str = "record") -> DataFrame:
    """Rows with their JSON text as a variant, null where there is none or it is broken."""
    return rows.withColumn(name, F.try_parse_json(text))


def _kind(value: Column) -> Column:
    """null, boolean, number, string, array or object; times and bytes are ``other``."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema == "VOID", "null").when(schema == "BOOLEAN", "boolean").when(schema == "STRING", "string")
        .when(schema.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").otherwise("other")
    )


def field_kinds(rows: DataFrame, record: str = "record", depth: int = 3) -> DataFrame:
    """``path, kind, n``: how many records have a field, by the kind of its value, down to ``depth`` names.

    A field whose value is null is one of kind ``null``, one that is absent does not count; so the two are told
    apart.  Null and broken records and records that are no objects have no fields.  Names join with
    dots.  Values are exploded and counted map-side, whatever the fields are, so none is listed beforehand.
    A record is parsed once: every level is exploded from the one above, and a field with fields of its own
    counts in the first row of these.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(record).alias("v"), _kind(F.col(record)).alias("kind")).where("kind = 'object'")
    done: list[str] = []
    for k in range(depth):
        opened = level.withColumn("v", F.when(F.col("kind") == "object", F.col("v"))).lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
        path = F.concat(F.col(f"path{k - 1}"), F.lit("."), F.col("key")) if k else F.col("key")
        first = F.coalesce(F.col("pos"), F.lit(0)) == 0
        kept = [F.when(first, F.col(f"f{j}")).alias(f"f{j}") for j in range(k)]
        below = opened.select(*kept, path.alias(f"path{k}"), F.col("value").alias("v"), F.when(F.col("pos").isNotNull(), _kind(F.col("value"))).alias("kind"))
        done.append(f"f{k}")
        level = below.withColumn(f"f{k}", F.when(F.col("kind").isNotNull(), F.struct(F.col(f"path{k}").alias("path"), F.col("kind").alias("kind"))))
    every = level.select(F.explode(F.array(*done)).alias("f")).where("f IS NOT NULL")
    return every.groupBy("f.path", "f.kind").agg(F.count(F.lit(1)).alias("n"))


def field(record: str, path: str, kind: str) -> Column:
    """A field of a record as ``kind``; null if it is absent, null, or of another kind that does not convert."""
    return F.try_variant_get(record, F.lit("$." + path if not path.startswith("$") else path), kind)


def state(record: str, name: str) -> Column:
    """``absent``, ``null``, ``empty`` (text, list or object without content) or ``present``."""
    have = F.col(record).try_cast("map<string,variant>")
    value = F.try_element_at(have, F.lit(name))
    json = F.to_json(value)
    return F.when(value.isNull(), "absent").when(F.is_variant_null(value), "null").when(json.isin('""', "[]", "{}"), "empty").otherwise("present")


def laid_over(base: Column, over: Column) -> Column:
    """JSON text of a record whose fields are replaced by those of another, nulls included; all others stay, known
    or not.  A side that is no object counts as an empty one."""
    whole = lambda v: F.coalesce(v.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    b, o = whole(base), whole(over)
    kept = F.map_filter(b, lambda k, _: ~F.array_contains(F.map_keys(o), k))
    return F.to_json(F.map_concat(kept, o))
