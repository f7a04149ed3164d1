"""Search that opens only files which can hold a hit.

A skipping table has a Bloom filter for every file of a Parquet table, built once by Spark.  A
query is turned into grams that any match must have; files whose filters lack one are not read.
Hits are decided on the text, so the result is that of a full scan.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.query import Query

#: Bits of a file's filter (512 KB before compression) and positions of a gram.  With 400,000 different grams
#: a file, one absent gram in 60 is taken for present.
BITS, HASHES = 1 << 22, 4
#: Letters at the start of a word that a filter tells apart, and letters of a gram inside a word.
PREFIX, INSIDE = 10, 3

_RUN = "[a-z0-9]+"


def _lower(text: Column) -> Column:
    """A-Z only, as the search's patterns ignore case."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _positions(gram: Column) -> Column:
    """Bits of a gram, from 1 as Spark's bitmaps count."""
    return F.array(*[F.pmod(F.xxhash64(gram, F.lit(k)), F.lit(BITS)) + 1 for k in range(HASHES)])


def needed(text: str) -> list[str]:
    """Grams that a match of a literal has, whatever its spaces, hyphens and apostrophes.

    Letters and digits stand side by side in a run.  The first run starts a word, so its beginning is
    asked for as a prefix, marked ``^``; of every run the grams inside are asked for."""
    runs = re.findall(_RUN, text.translate(str.maketrans(ascii_uppercase, ascii_lowercase)))
    found = {r[i : i + INSIDE] for r in runs for i in range(len(r) - INSIDE + 1)}
    if runs and re.match("[A-Za-z0-9]", text.strip()):
        found.add("^" + runs[0][:PREFIX])
    return sorted(found)


def _grams(word: Column) -> Column:
    """Every prefix of a word and what stands inside it."""
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length(word), F.lit(PREFIX))), lambda n: F.concat(F.lit("^"), F.substring(word, F.lit(1), n)))
    inner = F.transform(F.sequence(F.lit(1), F.length(word) - INSIDE + 1), lambda i: F.substring(word, i, F.lit(INSIDE)))
    return F.concat(prefixes, F.when(F.length(word) >= INSIDE, inner).otherwise(F.array().cast("array<string>")))


def _plain(path: Column) -> Column:
    """A path as file listings write it: without escapes and with one slash behind ``file:``."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def build(spark: SparkSession, source: str, table: str, columns: list[str]) -> None:
    """Write the skipping table of ``source`` to ``table``: ``file, size, changed, part, bits``.

    Words of a file, then their grams, are made distinct map-side before anything is hashed, so what is
    shuffled follows the files' vocabularies.  Null texts have no words; a file without any has a row all the same, so
    it is known."""
    rows = spark.read.parquet(source)
    key = ["file", "size", "changed"]
    about = [_plain(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed")]
    runs = F.array_distinct(F.regexp_extract_all(_lower(F.concat_ws("\n", *columns)), F.lit(_RUN), F.lit(0)))
    words = rows.select(*about, F.explode(runs).alias("word")).distinct()
    grams = words.select(*key, F.explode(_grams(F.col("word"))).alias("gram")).distinct()
    grams = grams.union(rows.select(*about, F.lit("").alias("gram")).distinct())
    bits = grams.select(*key, F.explode(_positions(F.col("gram"))).alias("at"))
    parts = bits.groupBy("file", "size", "changed", F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    parts.write.mode("overwrite").option("compression", "zstd").parquet(table)


def files(spark: SparkSession, source: str, table: str, query: Query | None) -> list[str]:
    """Files of ``source`` that may hold a match, in order of their names.

    A file passes if it has all grams of some spelling of every term, or if the table does not know it as it
    is now (by name, size and time of change).  Terms without a letter or digit skip nothing."""
    now = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(source).select(F.regexp_replace("path", "^file:/+", "file:/").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))
    asked = [(t, s, gram) for t, term in enumerate(query.terms if query else ()) for s, text in enumerate(term.texts or ("",)) for gram in needed(text) or [None]]
    open_terms = {t for t, _, gram in asked if gram is None}
    asked = [x for x in asked if x[0] not in open_terms]
    if not asked:
        return sorted(r["file"] for r in now.select("file").collect())
    wanted = spark.createDataFrame(asked, "term int, spelling int, gram string")
    bits = wanted.select("term", "spelling", F.explode(_positions(F.col("gram"))).alias("at")).withColumn("part", F.bitmap_bucket_number("at")).withColumn("bit", F.bitmap_bit_position("at"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.expr("getbit(byte, cast(bit % 8 AS int))") == 1
    met = spark.read.parquet(table).join(F.broadcast(bits), "part").withColumn("byte", byte).where(on)
    full = met.groupBy("file", "size", "changed", "term", "spelling").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(bits.groupBy("term", "spelling").agg(F.count(F.lit(1)).alias("n"))), ["term", "spelling", "n"])
    passed = full.groupBy("file", "size", "changed").agg(F.count_distinct("term").alias("terms")).where(F.col("terms") == len({t for t, _, _ in asked}))
    seen = spark.read.parquet(table).select("file", "size", "changed").distinct()
    key = ["file", "size", "changed"]
    kept = now.join(passed.select(key), key, "left_semi").union(now.join(seen, key, "left_anti"))
    return sorted(r["file"] for r in kept.select("file").collect())


def read(spark: SparkSession, source: str, table: str, query: Query | None) -> DataFrame:
    """The rows of the files that may hold a match; filter them by ``search.matches`` as always."""
    whole = spark.read.parquet(source)
    found = files(spark, source, table, query)
    return spark.read.schema(whole.schema).parquet(*found) if found else whole.where(F.lit(False))
