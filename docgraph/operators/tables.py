"""Repair of markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.text import PAGE_BREAK, collapse, is_numeric, is_table_line, strip


def row_cells(line: Column) -> Column:
    """Cells of a table line, trimmed, without its outer pipes."""
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), "[|]", -1), strip)


def filled(cells: Column) -> Column:
    return F.filter(F.transform(cells, collapse), lambda c: c != "")


def is_separator_row(cells: Column) -> Column:
    """More than four fifths of its characters are dashes."""
    text = F.array_join(F.transform(cells, collapse), "")
    return F.coalesce((F.length(text) - F.length(F.replace(text, F.lit("-"), F.lit("")))) / F.nullif(F.length(text), F.lit(0)) > 0.8, F.lit(False))


def is_header_like(cells: Column) -> Column:
    """More than 0.7 of its cells are filled and not numeric."""
    return F.size(F.filter(filled(cells), lambda c: ~is_numeric(c))) / F.greatest(F.size(cells), F.lit(1)) > 0.7


def is_group_header(cells: Column) -> Column:
    """A number with a full stop first, something second, nothing last, of three cells or more."""
    return (F.size(cells) >= 3) & F.get(cells, F.lit(0)).rlike(r"^\d+\.$") & (collapse(F.get(cells, F.size(cells) - 1)) == "") & (collapse(F.get(cells, F.lit(1))) != "")


def is_child_row(cells: Column) -> Column:
    return (collapse(F.get(cells, F.lit(0))) == "") & (collapse(F.get(cells, F.size(cells) - 1)) != "")


def blank_repeats(cells: Column) -> Column:
    """A cell that equals the one before is blank."""
    return F.transform(cells, lambda c, i: F.when((i > 0) & (collapse(c) == collapse(F.get(cells, i - 1))), F.lit("")).otherwise(c))


def table_rows(lines_df: DataFrame) -> DataFrame:
    """Rows of tables: doc_id, run (of adjacent table lines), line_no, row_no, cells, and what they are.

    Only table lines are shuffled, once and by document: the windows over runs and their parts find them together.
    """
    run = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = lines_df.where(is_table_line(F.col("text"))).withColumn("run", run).withColumn("cells", row_cells(F.col("text")))
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("line_no")) - 1)
    c = F.col("cells")
    return rows.select("doc_id", "run", "line_no", "row_no", "cells", is_separator_row(c).alias("is_separator"), is_header_like(c).alias("is_header_like"), is_group_header(c).alias("is_group"), is_child_row(c).alias("is_child"))


def split_tables(rows: DataFrame) -> DataFrame:
    """Adds sub: a row of one distinct filled value that isn't the first begins another table."""
    begins = (F.col("row_no") > 0) & ~F.col("is_separator") & (F.size(F.array_distinct(filled(F.col("cells")))) == 1)
    return rows.withColumn("sub", F.sum(begins.cast("int")).over(Window.partitionBy("doc_id", "run").orderBy("line_no")).cast("int"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """doc_id, run, sub, line_no, cells: without separators, children marked, repeats blanked, empty last columns cut, widths equal."""
    by_sub = Window.partitionBy("doc_id", "run", "sub")
    split = split_tables(rows).where("NOT is_separator")
    kind = F.when(F.col("is_group"), "group").when(~F.col("is_child"), "other")
    split = split.withColumn("under", F.last(kind, ignorenulls=True).over(by_sub.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)))
    c = F.col("cells")
    child = ~F.col("is_group") & F.col("is_child") & (F.coalesce(F.col("under"), F.lit("")) == "group")
    marked = F.transform(c, lambda x, i: F.when(i == 1, F.concat(F.lit("↳ "), x)).otherwise(x))
    changed = split.withColumn("cells", F.when(F.col("is_group"), c).when(child, marked).when(F.col("is_header_like"), blank_repeats(c)).otherwise(c))
    place = F.array_max(F.transform(c, lambda x, i: F.when(collapse(x) != "", i + 1).otherwise(0)))
    cut = changed.withColumn("last", F.max(place).over(by_sub)).withColumn("cells", F.when(F.col("last") > 0, F.slice(c, F.lit(1), F.col("last"))).otherwise(c))
    wide = cut.withColumn("width", F.max(F.size("cells")).over(by_sub))
    return wide.select("doc_id", "run", "sub", "line_no", F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells"))).alias("cells"))


def repair_markdown(lines_df: DataFrame) -> DataFrame:
    """doc_id, markdown with every table rebuilt: one separator after its first row, a blank line between its parts, page-break lines bare."""
    rows = repaired_rows(table_rows(lines_df))
    written = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda x: F.lit("---")), " | "), F.lit(" |"))
    first = F.row_number().over(Window.partitionBy("doc_id", "run", "sub").orderBy("line_no")) == 1
    begins = F.col("first") & (F.lag("sub").over(Window.partitionBy("doc_id", "run").orderBy("line_no")).isNotNull())
    of_tables = rows.withColumn("first", first).withColumn("begins", begins)
    out = F.concat(F.when(F.col("begins"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), F.array(written), F.when(F.col("first"), F.array(rule)).otherwise(F.array().cast("array<string>")))
    tables = of_tables.select("doc_id", "line_no", out.alias("out"))
    others = lines_df.where(~is_table_line(F.col("text"))).select("doc_id", "line_no", F.array(F.when(F.col("text").contains(PAGE_BREAK), F.lit(PAGE_BREAK)).otherwise(F.col("text"))).alias("out"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "out")))
    return tables.unionByName(others).groupBy("doc_id").agg(F.array_join(F.flatten(F.transform(ordered, lambda x: x["out"])), "\n").alias("markdown"))
