"""Column functions on tables, which are arrays of rows of cells, the header first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What joins rows of a table told in words, and what names a column without a header.
ROW_JOINT, CELL_JOINT, UNNAMED = "；", ", ", "column "


def _width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def _padded(row: Column, width: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))


def is_complex(rows: Column) -> Column:
    """Rows of unequal length, or a blank header: then words can't stand for the table."""
    blank = F.exists(F.get(rows, F.lit(0)), lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")
    return F.coalesce((F.size(F.array_distinct(F.transform(rows, F.size))) > 1) | blank, F.lit(False))


def to_markdown(rows: Column) -> Column:
    """A pipe table as wide as the longest row; pipes in cells are escaped. No rows: empty."""
    width = _width(rows)
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(_padded(r, width), lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), row)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(row(F.get(rows, F.lit(0))), rule), body), "\n")).otherwise("")


def to_words(rows: Column) -> Column:
    """Each row as header=value pairs; a header without rows tells its own names; a cell beyond a blank header gets a number."""
    header = F.get(rows, F.lit(0))
    name = lambda i: F.when(F.trim(F.coalesce(F.get(header, i), F.lit(""))) == "", F.concat(F.lit(UNNAMED), (i + 1).cast("string"))).otherwise(F.get(header, i))
    told = lambda r: F.array_join(F.transform(r, lambda c, i: F.concat(name(i), F.lit("="), F.coalesce(c, F.lit("")))), CELL_JOINT)
    body = F.when(F.size(rows) > 1, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).otherwise(rows)
    return F.when(F.size(rows) > 0, F.array_join(F.transform(body, told), ROW_JOINT)).otherwise("")


def with_caption(words: Column, caption: Column) -> Column:
    """The caption on a line of its own before the words; no caption, no line."""
    return F.when(F.trim(F.coalesce(caption, F.lit(""))) != "", F.concat(caption, F.lit("\n"), words)).otherwise(words)


def table_block(rows: Column, caption: Column, hint: Column) -> Column:
    """The block that a parser makes of a table."""
    return F.struct(
        F.lit("table").alias("kind"), with_caption(to_words(rows), caption).alias("text"), to_markdown(rows).alias("raw_table"), (F.coalesce(hint, F.lit(False)) | is_complex(rows)).alias("table_complex")
    )
