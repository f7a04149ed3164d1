"""Text of pages from positioned pieces: tables first, then what lies outside them, column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a grid cell in points; a page has some 200 cells.
CELL = 50.0
#: Points by which a piece may stick out of a table and still belong to it.
SLACK = 1.0
#: Pieces whose tops differ by no more share a line; a wider gap between pieces is a space.
LINE_GAP, WORD_GAP = 2.0, 2.0


def _cell(value: Column) -> Column:
    return F.floor(value / CELL).cast("long")


def outside(pieces: DataFrame, boxes: DataFrame, page: str = "page", slack: float = SLACK) -> DataFrame:
    """Pieces (``page, x0, x1, top, bottom``) that lie in none of the ``boxes`` of their page, a point of slack allowed.

    A piece is in the grid cell of its upper left corner, a box in all cells where such a corner may be, so they
    meet on page and cell; the comparison of corners is left to the pairs of a cell.  A page with very many
    pieces is many keys.  Pieces or boxes without a coordinate or page meet nothing: such a piece stays.  Boxes may overlap
    and repeat, no piece is multiplied.
    """
    b = boxes.select(F.col(page).alias("__p"), *[F.col(c).cast("double").alias(f"__{c}") for c in ("x0", "x1", "top", "bottom")])
    b = b.where("__x0 <= __x1 AND __top <= __bottom")
    across = lambda low, high: F.sequence(_cell(F.col(low) - slack), _cell(F.col(high) + slack))
    b = b.withColumn("__cx", F.explode(across("__x0", "__x1"))).withColumn("__cy", F.explode(across("__top", "__bottom")))
    inside = (F.col("x0") >= F.col("__x0") - slack) & (F.col("x1") <= F.col("__x1") + slack) & (F.col("top") >= F.col("__top") - slack) & (F.col("bottom") <= F.col("__bottom") + slack)
    same = (F.col(page) == F.col("__p")) & (_cell(F.col("x0")) == F.col("__cx")) & (_cell(F.col("top")) == F.col("__cy"))
    return pieces.join(b, same & inside, "left_anti")


def column_counts(pieces: DataFrame, pages: DataFrame, page: str = "page", width: float = 612) -> DataFrame:
    """``pages(page, width)`` with ``columns``: 2 where at least 200 pieces lie balanced in both halves and
    the gutter is nearly empty, else 1.  One map-side aggregation; a page without width has the default."""
    wide = pages.select(page, F.coalesce(F.col("width"), F.lit(width)).cast("double").alias("width"))
    middle = (F.col("x0") + F.col("x1")) / 2
    half = F.col("width") / 2
    n = pieces.join(wide, page).groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.count_if(middle < half).alias("left"), F.count_if(F.abs(middle - half) < F.col("width") * 0.04).alias("near"))
    right = F.col("n") - F.col("left")
    two = (F.col("n") >= 200) & (F.least("left", right) > 0.4 * F.greatest("left", right)) & (F.col("near") < 0.05 * F.col("n"))
    return wide.join(n, page, "left").select(page, "width", F.when(two, 2).otherwise(1).alias("columns"))


def lines(pieces: DataFrame, page: str = "page", side: str = "side") -> DataFrame:
    """``page, side, top, line``: pieces of a page's side joined to lines.

    Tops that follow each other without a gap form a line; its pieces stand from left to right, with a
    space where they are apart.  A page is sorted once, in one task; what follows is grouped where it lies.
    """
    order = Window.partitionBy(page).orderBy(side, "top")
    fresh = F.coalesce((F.col(side) != F.lag(side).over(order)) | (F.col("top") - F.lag("top").over(order) > LINE_GAP), F.lit(True))
    numbered = pieces.withColumn("__new", fresh.cast("int")).withColumn("__line", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.array_sort(F.collect_list(F.struct("x0", "x1", "text")))
    with_spaces = lambda r: F.transform(r, lambda c, i: F.concat(F.when((i > 0) & (c["x0"] - F.get(r, i - 1)["x1"] > WORD_GAP), F.lit(" ")).otherwise(F.lit("")), c["text"]))
    joined = numbered.groupBy(page, side, "__line").agg(F.min("top").alias("top"), row.alias("__row"))
    return joined.select(page, side, "top", F.trim(F.regexp_replace(F.array_join(with_spaces(F.col("__row")), ""), " +", " ")).alias("line")).where("line <> ''")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def page_texts(pieces: DataFrame, boxes: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    """``page, columns, text``: the tables of a page (``boxes.markdown``, by top and left, each between line breaks),
    then the lines outside them, the left column before the right.

    ``pieces(page, x0, x1, top, bottom, text)`` are characters or words; columns are judged by all of them,
    tables included.  Tables without text mask nothing.  Null texts are empty; a page of ``pages`` without
    pieces and tables has an empty text.
    """
    shown = boxes.where("coalesce(markdown, '') <> ''")
    pieces = pieces.withColumn("text", F.coalesce("text", F.lit("")))
    counted = column_counts(pieces, pages, page)
    free = outside(pieces, shown, page).join(counted, page)
    side = F.when((F.col("columns") == 2) & ((F.col("x0") + F.col("x1")) / 2 >= F.col("width") / 2), 1).otherwise(0)
    rows = lines(free.select(page, side.alias("side"), "x0", "x1", "top", "text"), page)
    body = rows.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "top", "line"))), lambda x: x["line"]), "\n").alias("__body"))
    tables = shown.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "markdown"))), lambda x: F.concat(F.lit("\n"), x["markdown"], F.lit("\n"))).alias("__tables"))
    out = counted.join(tables, page, "left").join(body, page, "left")
    parts = F.concat(F.coalesce("__tables", F.array().cast("array<string>")), F.when(F.col("__body").isNotNull(), F.array("__body")).otherwise(F.array().cast("array<string>")))
    return out.select(page, "columns", _strip(F.array_join(parts, "\n")).alias("text"))
