"""Page text out of word boxes and tables: nested tables, column groups, reading order.

words: source_document, source_page, text, x0, x1, top, bottom.  tables: source_document, source_page, table_no, x0, top, x1, bottom, cells
(array<array<string>>).  Pages are the partitions of all windows here, so a page's words meet in one task, and no more than a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.conf import EngineConf
from veriloom.functions.text import strip

PAGE = ["source_document", "source_page"]


def kept_tables(tables: DataFrame, slack: float = 1.0) -> DataFrame:
    """Tables that no other table of the page contains; of two that contain each other neither stays."""
    box = lambda t, c: F.col(f"{t}.{c}")
    inside = (
        (box("o", "x0") - slack <= box("i", "x0")) & (box("o", "top") - slack <= box("i", "top"))
        & (box("i", "x1") <= box("o", "x1") + slack) & (box("i", "bottom") <= box("o", "bottom") + slack)
    )
    same = (box("o", "source_document") == box("i", "source_document")) & (box("o", "source_page") == box("i", "source_page")) & (box("o", "table_no") != box("i", "table_no"))
    return tables.alias("i").join(tables.alias("o"), same & inside, "left_anti")


def serialized(cells: Column) -> Column:
    """Rows as lines, cells joined by bars, empty cells and rows left out."""
    clean = F.transform(cells, lambda row: F.filter(F.transform(row, lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))), lambda c: c != ""))
    return F.array_join(F.transform(F.filter(clean, lambda row: F.size(row) > 0), lambda row: F.array_join(row, " | ")), "\n")


def outside_tables(words: DataFrame, tables: DataFrame, pad: float = 2.0) -> DataFrame:
    """Words whose centre lies in no table (padded)."""
    rects = tables.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "top", "x1", "bottom")).alias("__rects"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    hit = F.exists("__rects", lambda r: x.between(r["x0"] - pad, r["x1"] + pad) & y.between(r["top"] - pad, r["bottom"] + pad))
    return words.join(rects, PAGE, "left").where(~F.coalesce(hit, F.lit(False))).drop("__rects")


def blocks(words: DataFrame, conf: EngineConf = EngineConf()) -> DataFrame:
    """Words with line, block (its number in the line) and grouped: whether the line belongs to a column group.

    Gaps wider than max(column_gap, 2.2 * upper median of a page's gaps) part a line's blocks; lines of two blocks or more
    with equal numbers of blocks and block starts (to tens) make a group if there are column_min_lines of them.  Pages of under eight words have none.
    """
    line = Window.partitionBy(*PAGE, "line").orderBy("x0", "x1", "text")
    page = Window.partitionBy(*PAGE)
    rows = words.withColumn("line", F.bround("top", 1)).withColumn("gap", F.col("x0") - F.lag("x1").over(line))
    ranked = rows.where("gap > 0").select(*PAGE, "gap", F.row_number().over(page.orderBy("gap")).alias("k"), F.count(F.lit(1)).over(page).alias("n"))
    median = ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select(*PAGE, F.greatest(F.lit(conf.column_gap), F.lit(2.2) * F.col("gap")).alias("threshold"))
    rows = rows.withColumn("in_page", F.count(F.lit(1)).over(page)).join(median, PAGE, "left")
    part = F.coalesce(F.col("gap") > F.col("threshold"), F.lit(False)).cast("int")
    rows = rows.withColumn("block", F.sum(part).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    starts = F.array_sort(F.collect_set(F.struct("block", "start")))
    first = rows.groupBy(*PAGE, "line", "block").agg(F.min(F.struct("x0", F.bround("x0", -1).alias("start")))["start"].alias("start"))
    lines = first.groupBy(*PAGE, "line").agg(starts.alias("signature")).where(F.size("signature") >= 2)
    group = Window.partitionBy(*PAGE, "signature")
    lines = lines.withColumn("lines", F.count(F.lit(1)).over(group)).where(F.col("lines") >= conf.column_min_lines).select(*PAGE, "line", F.lit(True).alias("grouped"))
    out = rows.join(lines, [*PAGE, "line"], "left")
    return out.withColumn("grouped", F.coalesce("grouped", F.lit(False)) & (F.col("in_page") >= 8)).drop("gap", "threshold", "in_page")


def rendered(words: DataFrame) -> DataFrame:
    """source_document, source_page, text, columns: lines from top to bottom, blocks of grouped lines joined by bars."""
    spoken = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda w: w["text"]), " ")
    one = words.groupBy(*PAGE, "line", "grouped", F.when(F.col("grouped"), F.col("block")).otherwise(F.lit(0)).alias("block")).agg(spoken(F.collect_list(F.struct("x0", "x1", "text"))).alias("piece"))
    pieces = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda b: b["piece"]), " | ")
    lines = one.groupBy(*PAGE, "line").agg(pieces(F.collect_list(F.struct("block", "piece"))).alias("written"), F.max("grouped").alias("columns"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "written"))), lambda r: r["written"]), "\n")
    return lines.groupBy(*PAGE).agg(text.alias("text"), F.max("columns").alias("columns"))


def page_text(words: DataFrame, tables: DataFrame, conf: EngineConf = EngineConf()) -> DataFrame:
    """source_document, source_page, text: prose (all words, where columns were found; else those outside tables), then tables, then words that neither holds."""
    kept = kept_tables(tables)
    free = outside_tables(words, kept, conf.table_pad)
    marked = blocks(free, conf)
    grouped = marked.where("grouped").select(*PAGE, "line", "x0", "x1", "text", "block").distinct()
    every = words.withColumn("line", F.bround("top", 1)).join(grouped, [*PAGE, "line", "x0", "x1", "text"], "left")
    # a line of a group is written by its blocks, so words of it that lie in tables are left to these
    group_lines = grouped.select(*PAGE, "line").distinct().withColumn("grouped", F.lit(True))
    every = every.join(group_lines, [*PAGE, "line"], "left").withColumn("grouped", F.coalesce("grouped", F.lit(False))).where("not grouped or block is not null")
    plain = rendered(free.withColumn("line", F.bround("top", 1)).withColumns({"grouped": F.lit(False), "block": F.lit(0)})).select(*PAGE, F.col("text").alias("plain"))
    wide = rendered(every).where("columns").select(*PAGE, F.col("text").alias("wide"))
    block = F.array_sort(F.collect_list(F.struct("table_no", serialized(F.col("cells")).alias("block"))))
    written = kept.groupBy(*PAGE).agg(F.array_join(F.filter(F.transform(block, lambda b: b["block"]), lambda b: b != ""), "\n\n").alias("tables"))
    pages = words.select(*PAGE).union(tables.select(*PAGE)).distinct()
    out = pages.join(plain, PAGE, "left").join(wide, PAGE, "left").join(written, PAGE, "left")
    out = out.withColumn("body", F.concat_ws("\n\n", strip(F.coalesce("wide", "plain", F.lit(""))), F.nullif("tables", F.lit(""))))
    lost = free.join(out.select(*PAGE, "body"), PAGE).where((F.trim("text") != "") & ~F.contains(F.lower("body"), F.lower("text")))
    orphans = lost.groupBy(*PAGE, F.bround("top", 1).alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda w: w["text"]), " ").alias("t"))
    orphans = orphans.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda r: r["t"]), "\n").alias("orphans"))
    return out.join(orphans, PAGE, "left").select(*PAGE, strip(F.concat_ws("\n\n", "body", "orphans")).alias("text"))
