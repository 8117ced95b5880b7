"""Lines, pages, headers and table ranges of markdown documents (doc_id, markdown).

What one document's text alone decides is computed within its row, without a shuffle;
windows over lines partition by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.text import IMAGE, PAGE_BREAK, is_table_line, let, scan, strip

HEADER = r"^(#+)\s+(.+)$"


def by_line():
    return Window.partitionBy("doc_id").orderBy("line_no")


def lines(md: DataFrame) -> DataFrame:
    """doc_id, line_no from 1, text; only the line feed separates lines."""
    return md.select("doc_id", F.posexplode(F.split("markdown", "\n", -1)).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "text")


def line_pages(lines_df: DataFrame) -> DataFrame:
    """Adds page_number: a line that holds the page-break comment belongs to the page it ends."""
    is_break = F.col("text").contains(PAGE_BREAK).cast("int")
    return lines_df.withColumn("page_number", (1 + F.coalesce(F.sum(is_break).over(by_line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"))


def page_spans(paged: DataFrame) -> DataFrame:
    """doc_id, page_number, start_line, end_line (0-based, inclusive); a page of a marker line alone has no span."""
    spans = paged.groupBy("doc_id", "page_number").agg((F.min("line_no") - 1).alias("start_line"), (F.max("line_no") - 1).alias("end_line"), F.max(~F.col("text").contains(PAGE_BREAK)).alias("real"))
    return spans.where("real").drop("real")


def page_counts(md: DataFrame) -> DataFrame:
    """doc_id, total_pages: lines with a marker, and one."""
    return md.select("doc_id", (F.size(F.filter(F.split("markdown", "\n", -1), lambda x: x.contains(PAGE_BREAK))) + 1).alias("total_pages"))


def approximate_pages(md: DataFrame, lines_per_page: int = 50) -> DataFrame:
    """doc_id, page_number, start_line, end_line, total_pages where no page breaks are known: a page each so many lines."""
    n = F.size(F.split("markdown", "\n", -1))
    page = F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / lines_per_page).cast("int")))
    made = md.select("doc_id", n.alias("n")).select("doc_id", "n", page.alias("page_number"))
    return made.select("doc_id", "page_number", ((F.col("page_number") - 1) * lines_per_page).alias("start_line"), F.least(F.col("page_number") * lines_per_page, F.col("n")).alias("end_line0"), (F.floor(F.col("n") / lines_per_page) + 1).cast("int").alias("total_pages")).select(
        "doc_id", "page_number", "start_line", (F.col("end_line0") - 1).alias("end_line"), "total_pages"
    )


def join_fragments(fragments: DataFrame) -> DataFrame:
    """(doc_id, page_number, seq, text) -> (doc_id, page_number, text): fragments in order, one per line."""
    return fragments.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, text) -> (doc_id, markdown) with a page-break line between pages."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), f"\n{PAGE_BREAK}\n").alias("markdown"))


def split_pages(md: DataFrame) -> DataFrame:
    """doc_id, nonblank_page_no, page_number, text: pages between markers, trimmed; blank ones are dropped before the first numbering."""
    pages = F.transform(F.split("markdown", PAGE_BREAK, -1), lambda p, i: F.struct((i + 1).alias("page_number"), strip(p).alias("text")))
    kept = F.filter(pages, lambda p: p["text"] != "")
    return md.select("doc_id", F.posexplode(kept).alias("k", "p")).select("doc_id", (F.col("k") + 1).alias("nonblank_page_no"), "p.page_number", "p.text")


def header_array(markdown: Column) -> Column:
    """Headers of a text in order, with their place: array of (line, level, title)."""
    at = lambda x, i: let(strip(x), lambda s: F.struct((i + 1).alias("line"), F.length(F.regexp_extract(s, HEADER, 1)).alias("level"), F.regexp_extract(s, HEADER, 2).alias("title")))
    found = F.transform(F.split(markdown, "\n", -1), lambda x, i: F.when(x.contains("#"), at(x, i)))  # other lines need no pattern
    return F.filter(found, lambda h: h["level"] > 0)


def path_array(headers: Column) -> Column:
    """Array of (line, level, title, section_path): the titles above a header are those of the last headers of smaller levels.

    The open sections are carried from header to header; a header is pushed after closing those of its level and deeper.
    """
    open_type = "array<struct<level:int,title:string>>"
    out_type = "struct<line:int,level:int,title:string,section_path:string>"

    def push(opened: Column, h: Column) -> Column:
        above = F.filter(opened, lambda o: o["level"] < h["level"])
        path = F.array_join(F.concat(F.transform(above, lambda o: o["title"]), F.array(h["title"])), " > ")
        state = F.concat(above, F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))
        return F.struct(state.alias("state"), F.struct(h["line"].alias("line"), h["level"].alias("level"), h["title"].alias("title"), path.alias("section_path")).alias("out"))

    return scan(headers, F.array(), open_type, out_type, push)


def headers(md: DataFrame) -> DataFrame:
    """doc_id, line, level, title, section_path of every header."""
    return md.select("doc_id", F.inline(path_array(header_array(F.col("markdown")))))


def table_ranges(lines_df: DataFrame) -> DataFrame:
    """doc_id, start_line, end_line, section (title of the last header before): runs of table lines; one still open at the end of the text isn't one."""
    tagged = lines_df.withColumns(
        {
            "is_table": is_table_line(F.col("text")),
            "title": F.when(strip(F.col("text")).rlike(HEADER), F.regexp_extract(strip(F.col("text")), HEADER, 2)),
            "last_line": F.max("line_no").over(Window.partitionBy("doc_id")),
        }
    )
    tagged = tagged.withColumn("section", F.last("title", ignorenulls=True).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id", "is_table").orderBy("line_no"))
    runs = tagged.withColumn("island", island).where("is_table").groupBy("doc_id", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max("last_line").alias("last_line"), F.min("section").alias("section"))
    return runs.where("end_line < last_line").select("doc_id", "start_line", "end_line", "section")


def level_histogram(headers_df: DataFrame) -> DataFrame:
    return headers_df.groupBy("doc_id", "level").agg(F.count("*").alias("n_headers"))


def deepest_sections(lines_df: DataFrame, headers_df: DataFrame) -> DataFrame:
    """doc_id, line_no, section_path, level, start_line: among headers up to a line the deepest, then the latest; null before the first.

    Both sides meet in one union sorted by line, so there is no range join.
    """
    both = lines_df.select("doc_id", "line_no", F.lit(None).cast("struct<level:int,line:int,path:string>").alias("h")).unionByName(
        headers_df.select("doc_id", F.col("line").alias("line_no"), F.struct("level", "line", F.col("section_path").alias("path")).alias("h"))
    )
    running = Window.partitionBy("doc_id").orderBy("line_no").rangeBetween(Window.unboundedPreceding, 0)
    best = both.withColumn("best", F.max("h").over(running)).where("h IS NULL")
    return best.select("doc_id", "line_no", F.col("best.path").alias("section_path"), F.col("best.level").alias("level"), F.col("best.line").alias("start_line"))


def image_only(md: DataFrame) -> DataFrame:
    """doc_id, image_only: nothing but blanks, page breaks and images."""
    return md.select("doc_id", F.forall(F.split("markdown", "\n", -1), lambda x: strip(x).isin("", PAGE_BREAK, IMAGE)).alias("image_only"))
