"""Tables that a parser left as lines of text, rebuilt as sets of lines by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import is_complex, to_markdown, to_words
from ..functions.text import cells, is_pipe_row, is_separator_row, pipes

SUSPECT_PIPES = 3


def _islands(lines: DataFrame, flag: str, out: str) -> DataFrame:
    """Lines with the number of the unbroken run of ``flag`` that they are in; null outside runs."""
    along = Window.partitionBy("doc_id").orderBy("line_no")
    begins = F.col(flag) & ~F.coalesce(F.lag(flag).over(along), F.lit(False))
    return lines.withColumn(out, F.when(F.col(flag), F.sum(begins.cast("int")).over(along)))


def table_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) that belong to a table that can be rebuilt: with run, table_no, part (header, rule, data) and cells.

    A run is two pipe rows or more with equally many cells, two at least. A separator row has
    its header before it and its data behind it; the line before the next separator is the next header.
    """
    shaped = lines.select("doc_id", "line_no", "line", is_pipe_row(F.col("line")).alias("_pipe"), is_separator_row(F.col("line")).alias("_rule"), cells(F.col("line")).alias("cells"))
    runs = _islands(shaped, "_pipe", "run").where("run IS NOT NULL")
    whole = Window.partitionBy("doc_id", "run")
    along = whole.orderBy("line_no")
    counted = runs.select(
        "*", F.count(F.lit(1)).over(whole).alias("_n"), F.min(F.size("cells")).over(whole).alias("_least"), F.max(F.size("cells")).over(whole).alias("_most"),
        F.sum(F.col("_rule").cast("int")).over(whole).alias("_rules"), F.sum(F.col("_rule").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 1)).alias("_reached"),
        F.sum(F.col("_rule").cast("int")).over(along).alias("_passed"),
    ).where("_n >= 2 AND _least = _most AND _least >= 2 AND _rules >= 1")
    # table t reaches from the line before its separator; the first from the run's start
    numbered = counted.withColumn("table_no", F.greatest("_reached", F.lit(1)) - 1)
    own = F.col("_rule") & (F.col("_passed") == F.col("table_no") + 1)
    part = F.when(F.col("_passed") <= F.col("table_no"), "header").when(own, "rule").when(~F.col("_rule"), "data").otherwise("skip")
    parted = numbered.withColumn("part", part)
    table = Window.partitionBy("doc_id", "run", "table_no")
    full = F.max((F.col("part") == "header").cast("int")).over(table) + F.max((F.col("part") == "data").cast("int")).over(table)
    return parted.withColumn("_full", full).where("_full = 2").select("doc_id", "line_no", "line", "run", "table_no", "part", "cells")


def recovered_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, run, table_no, line_start, line_end, rows, markdown, words, table_complex): ends are exclusive."""
    kept = table_lines(lines)
    row = F.when(F.col("part").isin("header", "data"), F.struct("line_no", "cells"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"])
    made = kept.groupBy("doc_id", "run", "table_no").agg(F.min("line_no").alias("line_start"), (F.max("line_no") + 1).alias("line_end"), rows.alias("rows"))
    return made.select("*", to_markdown(F.col("rows")).alias("markdown"), to_words(F.col("rows")).alias("words"), is_complex(F.col("rows")).alias("table_complex"))


def suspects(lines: DataFrame) -> DataFrame:
    """(doc_id, line_start, line_end, reasons): runs of lines with many pipes, and every condition that keeps them from being a table."""
    shaped = lines.select("doc_id", "line_no", (pipes(F.col("line")) >= SUSPECT_PIPES).alias("_many"), is_separator_row(F.col("line")).alias("_rule"), F.size(cells(F.col("line"))).alias("_cells"))
    runs = _islands(shaped, "_many", "run").where("run IS NOT NULL").groupBy("doc_id", "run").agg(
        F.min("line_no").alias("line_start"), (F.max("line_no") + 1).alias("line_end"), F.count(F.lit(1)).alias("_n"), F.bool_or("_rule").alias("_ruled"), F.count_distinct("_cells").alias("_widths"), F.min_by("_cells", "line_no").alias("_first")
    )
    reasons = F.array_compact(F.array(F.when(~F.col("_ruled"), "no separator row"), F.when(F.col("_widths") > 1, "rows of unequal width"), F.when(F.col("_first") < 2, "too few columns")))
    return runs.where("_n >= 2").select("doc_id", "line_start", "line_end", F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("incomplete").alias("reasons"))


def recover_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with pipe tables in runs of paragraphs rebuilt as table blocks, and the lines around them left to their paragraphs.

    A table may reach over several paragraphs; it takes the page of the first. Headings, tables and code part the runs.
    """
    paragraph = F.col("kind") == "paragraph"
    along = Window.partitionBy("document_id").orderBy("pos")
    stretch = F.sum((~paragraph).cast("int")).over(along)
    marked = blocks.withColumn("_stretch", stretch)
    pieces = marked.where(paragraph).select("document_id", "_stretch", "pos", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("_k", "line"))
    order = Window.partitionBy("document_id", "_stretch").orderBy("pos", "_k")
    lines = pieces.withColumn("line_no", F.row_number().over(order) - 1).withColumn("doc_id", F.struct("document_id", "_stretch"))
    in_table = table_lines(lines.select("doc_id", "line_no", "line")).select("doc_id", "line_no", "run", "table_no", "part", "cells")
    tagged = lines.join(in_table, ["doc_id", "line_no"], "left").withColumn("_table", F.when(F.col("run").isNotNull(), F.struct("run", "table_no")))
    along_lines = Window.partitionBy("document_id", "_stretch").orderBy("line_no")
    begins = (F.lag("pos").over(along_lines).isNull()) | ~F.lag("_table").over(along_lines).eqNullSafe(F.col("_table")) | (F.col("_table").isNull() & (F.lag("pos").over(along_lines) != F.col("pos")))
    grouped = tagged.withColumn("_piece", F.sum(begins.cast("int")).over(along_lines)).groupBy("document_id", "_stretch", "_piece").agg(
        F.min("pos").alias("pos"), F.min_by("page", "line_no").alias("page"), F.max(F.col("_table").isNotNull()).alias("_is"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("_lines"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isin("header", "data"), F.struct("line_no", "cells")))), lambda x: x["cells"]).alias("_rows"),
    )
    text = F.array_join("_lines", "\n")
    remade = grouped.where(F.col("_is") | (F.trim(text) != "")).select(
        "document_id", "pos", "_piece", F.when(F.col("_is"), "table").otherwise("paragraph").alias("kind"), F.when(F.col("_is"), to_words(F.col("_rows"))).otherwise(text).alias("text"), "page",
        F.when(F.col("_is"), to_markdown(F.col("_rows"))).alias("raw_table"), (F.col("_is") & is_complex(F.col("_rows"))).alias("table_complex"), F.col("_is").alias("recovered"),
    )
    others = marked.where(~paragraph).select("document_id", "pos", F.lit(0).cast("long").alias("_piece"), "kind", "text", "page", "raw_table", "table_complex", F.lit(False).alias("recovered"))
    both = remade.unionByName(others)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("document_id").orderBy("pos", "_piece")) - 1).drop("_piece")
