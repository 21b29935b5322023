"""Tables over cells: blocks of sheets, header detection and hierarchy, rendering, row and table chunks; Word spans and votes.

A table is keyed by (doc_id, sheet, table_id); ``sheet`` is null in Word files. Repeated cells count once. Rows are held as
one array of values each, filled to the table's width, so that rendering needs no further shuffle than the one by table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import or_empty, shown, strip

KEY = ["doc_id", "sheet", "table_id"]
BLOCK = [*KEY, "block_no"]
MOST_HEADER_ROWS = 3
# Words that mark a merged header cell, and words that mark a header row.
MERGED_HEADER_WORDS = ("营业总收入", "净利润", "每股收益", "净资产", "现金流量")
HEADER_WORDS = ("年度", "年份", "学校", "名称", "情况", "人数", "合计", "备注")
# The wording of context and table information.
ROW_BEFORE, ROW_AFTER = "上一行：", "。下一行："
HEADER_IS, MERGES_ARE = "表头: ", " 合并单元格: "
NUMERIC = r"^\s*((\d+\.?\d*|\.\d+)([eE]\d+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def dedup(cells: DataFrame) -> DataFrame:
    """One row per cell. Cells are dealt out by table once; what follows, by table, row or block, needs no further shuffle."""
    return cells.repartition("doc_id", "table_id").groupBy(*KEY, "r", "c").agg(
        F.min("text").alias("text"), F.coalesce(F.max("grid_span"), F.lit(1)).alias("grid_span"), F.min("v_merge").alias("v_merge")
    )


def same_table(a: DataFrame, b: DataFrame, keys: list[str] = KEY, how: str = "inner") -> DataFrame:
    """Join on a table's key with null sheets equal."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.join(b, on, how).drop(*[f"_{k}" for k in keys])


def table_rows(cells: DataFrame) -> DataFrame:
    """(key, r, vals): every row that has a cell, as an array over all columns of its table; a missing cell is null."""
    rows = cells.groupBy(*KEY, "r").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("c", "text")))).alias("m"), F.max("c").alias("last"))
    last = F.max("last").over(Window.partitionBy(*KEY))
    vals = F.transform(F.sequence(F.lit(0), F.col("width")), lambda c: F.col("m")[c])
    return rows.withColumn("width", last).select(*KEY, "r", vals.alias("vals"))


def distinct_merges(merges: DataFrame) -> DataFrame:
    return merges.where("min_row <= max_row AND min_col <= max_col").select("doc_id", "sheet", "min_row", "max_row", "min_col", "max_col").distinct()


def merge_cover(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Rows with ``merges``: the number of merge ranges of the sheet that cover the row."""
    spots = rows.select(*KEY, "r")
    ranges = distinct_merges(merges).withColumnsRenamed({"doc_id": "_d", "sheet": "_s"})
    hit = spots.join(ranges, (F.col("doc_id") == F.col("_d")) & F.col("sheet").eqNullSafe(F.col("_s")) & (F.col("r") + 1).between(F.col("min_row"), F.col("max_row")))
    return same_table(rows, hit.groupBy(*KEY, "r").agg(F.count(F.lit(1)).alias("merges")), [*KEY, "r"], "left").fillna(0, ["merges"])


def table_blocks(rows: DataFrame) -> DataFrame:
    """Covered rows (``merge_cover``) with block_no, start_row, end_row: maximal runs of rows with data or merge cover."""
    kept = rows.where(F.exists("vals", lambda v: v.isNotNull()) | (F.col("merges") > 0))
    w = Window.partitionBy(*KEY).orderBy("r")
    kept = kept.withColumn("island", F.col("r") - F.row_number().over(w))
    kept = kept.withColumn("block_no", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("island")))
    own = Window.partitionBy(*BLOCK)
    return kept.withColumn("start_row", F.min("r").over(own)).withColumn("end_row", F.max("r").over(own)).drop("island")


def frames(blocks: DataFrame) -> DataFrame:
    """Blocks without their all-null columns: (block, start_row, end_row, i, merges, vals, cols, header_rows).

    ``i`` is the row's place in its block, ``cols`` the sheet columns kept. header_rows: the rows from the top, up to
    three, that a merge covers without a gap, 1 at least.
    """
    filled = F.filter(F.transform("vals", lambda v, c: F.when(v.isNotNull(), c)), lambda c: c.isNotNull())
    own = Window.partitionBy(*BLOCK)
    cols = F.array_sort(F.array_distinct(F.flatten(F.collect_list(filled).over(own))))
    i = F.col("r") - F.col("start_row")
    gap = F.min(F.when(F.col("merges") == 0, i)).over(own)
    header = F.greatest(F.lit(1), F.least(F.coalesce(gap, F.col("end_row") - F.col("start_row") + 1), F.lit(MOST_HEADER_ROWS)))
    x = blocks.withColumn("cols", cols).withColumn("header_rows", header.cast("int")).withColumn("i", i)
    return x.select(*BLOCK, "start_row", "end_row", "i", "merges", F.transform("cols", lambda c: F.get("vals", c)).alias("vals"), "cols", "header_rows")


def cell_colspans(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(key, r, c, text, colspan): width of the merge range that holds a cell, 1 if none does."""
    m = distinct_merges(merges).withColumnsRenamed({"doc_id": "_d", "sheet": "_s"})
    on = (F.col("doc_id") == F.col("_d")) & F.col("sheet").eqNullSafe(F.col("_s"))
    on = on & (F.col("r") + 1).between(F.col("min_row"), F.col("max_row")) & (F.col("c") + 1).between(F.col("min_col"), F.col("max_col"))
    width = F.max(F.col("max_col") - F.col("min_col") + 1)
    return cells.join(m, on, "left").groupBy(*KEY, "r", "c", "text").agg(F.coalesce(width, F.lit(1)).cast("int").alias("colspan"))


def header_merges(frame: DataFrame, cells: DataFrame, merges: DataFrame, words: tuple[str, ...] = MERGED_HEADER_WORDS) -> DataFrame:
    """(block, i, c, colspan, text) of header cells that hold one of ``words`` and span several columns."""
    hits = cell_colspans(cells.where(F.col("text").rlike("|".join(words))), merges).where("colspan > 1")
    area = frame.where(F.col("i") < F.col("header_rows")).select(*BLOCK, "i", (F.col("start_row") + F.col("i")).alias("r"))
    return same_table(area, hits, [*KEY, "r"]).select(*BLOCK, "i", "c", "colspan", "text")


def headers(frame: DataFrame, merged: DataFrame) -> DataFrame:
    """(block, header): one text per kept column: its non-blank header cells joined by "/", under the text of a merged
    header cell above it unless that is among them. Columns are the sheet's, so dropped ones don't shift the parents."""
    top = frame.where(F.col("i") < F.col("header_rows")).select(*BLOCK, "i", F.explode(F.arrays_zip("cols", "vals")).alias("z"))
    part = F.when(shown(F.col("z.vals")), F.struct("i", F.col("z.vals").alias("v")))
    by_col = top.groupBy(*BLOCK, F.col("z.cols").alias("c")).agg(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["v"]).alias("parts"))
    span = merged.select(*BLOCK, F.explode(F.sequence("c", F.col("c") + F.col("colspan") - 1)).alias("c"), "i", F.col("c").alias("c0"), "text")
    parent = span.groupBy(*BLOCK, "c").agg(F.max_by("text", F.struct("i", "c0")).alias("parent"))
    x = same_table(by_col, parent, [*BLOCK, "c"], "left")
    parts = F.when(F.col("parent").isNull() | F.array_contains("parts", F.col("parent")), F.col("parts")).otherwise(F.concat(F.array("parent"), F.col("parts")))
    x = x.select(*BLOCK, "c", F.array_join(parts, "/").alias("h"))
    return x.groupBy(*BLOCK).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "h"))), lambda s: s["h"]).alias("header"))


def _line(values) -> Column:
    return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))


def _dash(v) -> Column:
    return F.coalesce(v, F.lit("-"))


def markdown_row(vals) -> Column:
    """One row by itself; blank cells show a dash."""
    return _line(F.transform(vals, lambda v: F.when(shown(v), v).otherwise("-")))


def html_row(vals) -> Column:
    """One row by itself; only missing cells show a dash."""
    return F.concat(F.lit("<table border='1'><tr>"), F.array_join(F.transform(vals, lambda v: F.concat(F.lit("<td>"), _dash(v), F.lit("</td>"))), ""), F.lit("</tr></table>"))


def _ordered(cond: Column, text: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("i", text.alias("t"))))), lambda s: s["t"]), "\n")


def markdown_tables(frame: DataFrame, heads: DataFrame) -> DataFrame:
    """(block, markdown): header line, alignment line (first column left, others right), body rows that aren't all null."""
    body = (F.col("i") >= F.col("header_rows")) & F.exists("vals", lambda v: v.isNotNull())
    rows = frame.groupBy(*BLOCK).agg(_ordered(body, _line(F.transform("vals", _dash))).alias("body"))
    x = same_table(rows, heads, BLOCK)
    marks = _line(F.transform("header", lambda h, k: F.when(k == 0, "---").otherwise("---:")))
    return x.select(*BLOCK, F.concat_ws("\n", _line(F.col("header")), marks, F.when(F.col("body") != "", F.col("body"))).alias("markdown"))


def html_tables(frame: DataFrame, merged: DataFrame) -> DataFrame:
    """(block, html). A merged header column is shown once, with its span, in every header row; blank rows stay."""
    span = merged.select(*BLOCK, F.explode(F.sequence("c", F.col("c") + F.col("colspan") - 1)).alias("k"), "c", "colspan", "text", "i")
    cover = span.groupBy(*BLOCK, "k").agg(F.max_by(F.struct("c", "colspan", "text"), F.struct("i", "c")).alias("m"))
    cover = cover.groupBy(*BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("cover"))
    x = same_table(frame, cover, BLOCK, "left")

    def head(z):
        m = F.col("cover")[z["cols"]]
        plain = F.concat(F.lit("<th>"), _dash(z["vals"]), F.lit("</th>"))
        shown_once = F.when(m["c"] == z["cols"], F.concat(F.lit('<th colspan="'), m["colspan"], F.lit('">'), m["text"], F.lit("</th>"))).otherwise("")
        return F.when(m.isNull(), plain).otherwise(shown_once)

    th = F.transform(F.arrays_zip("cols", "vals"), head)
    td = F.transform("vals", lambda v: F.concat(F.lit("<td>"), _dash(v), F.lit("</td>")))
    # one cell a line, as rows are
    cells = F.filter(F.when(F.col("i") < F.col("header_rows"), th).otherwise(td), lambda s: s != "")
    row = F.array_join(F.concat(F.array(F.lit("<tr>")), cells, F.array(F.lit("</tr>"))), "\n")
    body = x.groupBy(*BLOCK).agg(_ordered(F.lit(True), row).alias("rows"))
    return body.select(*BLOCK, F.concat(F.lit("<table border='1'>\n"), F.col("rows"), F.lit("\n</table>")).alias("html"))


def row_chunks(frame: DataFrame) -> DataFrame:
    """(block, row_no, content, html, context) of body rows: 1-based sheet row, and the rows before and after it; the row
    before the first body row is a header and isn't named."""
    plain = F.when(F.exists("vals", lambda v: v.isNotNull()), F.array_join(F.transform("vals", lambda v: F.coalesce(v, F.lit(""))), " | ")).otherwise("")
    w = Window.partitionBy(*BLOCK).orderBy("i")
    x = frame.withColumn("plain", plain).withColumn("prev", F.lag("plain").over(w)).withColumn("next", F.lead("plain").over(w))
    prev = F.when(F.col("i") > F.col("header_rows"), F.col("prev"))
    context = F.concat(F.lit(ROW_BEFORE), or_empty(prev), F.lit(ROW_AFTER), or_empty(F.col("next")))
    row_no = (F.col("start_row") + F.col("i") + 1).cast("int")
    return x.where("i >= header_rows").select(*BLOCK, row_no.alias("row_no"), markdown_row("vals").alias("content"), html_row("vals").alias("html"), context.alias("context"))


def merge_list(merges: DataFrame) -> DataFrame:
    """(doc_id, sheet, merged_cells): the sheet's ranges as JSON, in order of place."""
    one = F.to_json(F.struct("min_row", "max_row", "min_col", "max_col"))
    at = F.struct("min_row", "min_col", "max_row", "max_col", one.alias("j"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["j"]), ",")
    return distinct_merges(merges).groupBy("doc_id", "sheet").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("merged_cells"))


def full_tables(frame: DataFrame, heads: DataFrame, merges: DataFrame) -> DataFrame:
    """(block, chunk_table_id, start_row, end_row, header_rows, header, content, context, parent_table_info) of each block.

    A block is bounded by blank rows, so its context is always empty.
    """
    one = frame.groupBy(*BLOCK).agg(F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row"), F.max("header_rows").alias("header_rows"))
    x = same_table(same_table(one, heads, BLOCK), markdown_tables(frame, heads), BLOCK)
    x = same_table(x, merge_list(merges), ["doc_id", "sheet"], "left")
    info = F.concat(F.lit(HEADER_IS), F.to_json("header"), F.lit(MERGES_ARE), F.coalesce("merged_cells", F.lit("[]")))
    return x.select(
        *BLOCK, F.concat_ws("_table_", "sheet", "block_no").alias("chunk_table_id"), "start_row", "end_row", "header_rows", F.array_join("header", ", ").alias("header"),
        F.col("markdown").alias("content"), F.lit(ROW_BEFORE + ROW_AFTER).alias("context"), info.alias("parent_table_info"),
    )


# Word tables


def merge_type() -> Column:
    """none, horizontal, vertical, both or merged, from a cell's own attributes."""
    wide = F.coalesce(F.col("grid_span"), F.lit(1)) > 1
    return (
        F.when(F.col("v_merge") == "restart", F.when(wide, "both").otherwise("vertical")).when(F.col("v_merge").isNotNull(), "merged")
        .when(wide, "horizontal").otherwise("none")
    )


def resolved(cells: DataFrame) -> DataFrame:
    """Cells with the text, span and merge of the cell that covers them: to the left by a span, above by a continued merge."""
    left = Window.partitionBy(*KEY, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    wide = F.last(F.when(F.col("grid_span") > 1, F.struct("c", "grid_span", "text", "v_merge")), ignorenulls=True).over(left)
    x = cells.withColumn("o", wide)
    x = x.withColumn("o", F.when(F.col("o.c") + F.col("o.grid_span") > F.col("c"), F.col("o")))
    for col in ("grid_span", "text", "v_merge"):
        x = x.withColumn(col, F.when(F.col("o").isNotNull(), F.col(f"o.{col}")).otherwise(F.col(col)))
    up = Window.partitionBy(*KEY, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("v_merge") == "restart", F.struct("text")), ignorenulls=True).over(up)
    text = F.when((F.col("v_merge") == "continue") & start.isNotNull(), start["text"]).otherwise(F.col("text"))
    return x.withColumn("text", text).drop("o")


def cell_spans(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, r, c, merge_type, rowspan, colspan): a restarted merge runs on over continued and blank cells."""
    ahead = Window.partitionBy(*KEY, "c").orderBy("r")
    stops = ((F.col("v_merge").isNotNull()) & (F.col("v_merge") != "continue")) | (F.col("v_merge").isNull() & shown(F.col("text")))
    stop = F.min(F.when(stops, F.col("r"))).over(ahead.rowsBetween(1, Window.unboundedFollowing))
    last = F.max("r").over(ahead.rowsBetween(0, Window.unboundedFollowing))
    span = F.when(F.col("v_merge") == "restart", F.coalesce(stop, last + 1) - F.col("r")).when(F.col("v_merge").isNotNull(), 0).otherwise(1)
    return cells.select("doc_id", "table_id", "r", "c", merge_type().alias("merge_type"), span.cast("int").alias("rowspan"), F.col("grid_span").alias("colspan"))


def numeric(text) -> Column:
    return F.coalesce(F.translate(text, ",%+-", "").rlike(NUMERIC), F.lit(False))


def header_votes(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, merge_vote, content_vote, structure_vote, header_rows) of each Word table.

    Each vote counts passing rows from the top, three at most, one at least. merge: a cell takes part in a merge.
    content: over 30 % of the cells hold a header word, or under 30 % are numbers. structure: a merge, or under half of the
    cells blank; it abstains (null) where it meets the start of a vertical merge. The majority wins; else the middle vote,
    or the larger of two.
    """
    t = strip(or_empty(F.col("text")))
    rows = resolved(cells).groupBy("doc_id", "table_id", "r").agg(
        F.max((merge_type() != "none").cast("int")).alias("merged"), F.max((F.col("v_merge") == "restart").cast("int")).alias("starts"),
        F.avg(t.rlike("|".join(HEADER_WORDS)).cast("int")).alias("words"), F.avg(numeric(t).cast("int")).alias("numbers"), F.avg((t == "").cast("int")).alias("blank"),
    )
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy("r")) - 1)
    passes = {
        "merge_vote": F.col("merged") == 1,
        "content_vote": (F.col("words") > 0.3) | (F.col("numbers") < 0.3),
        "structure_vote": (F.col("merged") == 1) | (F.col("blank") < 0.5),
    }
    fails = [F.min(F.when(~p, F.col("i"))).alias(f"{k}_fail") for k, p in passes.items()]
    x = rows.groupBy("doc_id", "table_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("starts") == 1, F.col("i"))).alias("start"), *fails)
    vote = {k: F.greatest(F.lit(1), F.least(F.coalesce(f"{k}_fail", "n"), F.lit(MOST_HEADER_ROWS))).cast("int") for k in passes}
    met = (F.col("start") < MOST_HEADER_ROWS) & (F.col("start") <= F.coalesce("structure_vote_fail", "n"))
    vote["structure_vote"] = F.when(~F.coalesce(met, F.lit(False)), vote["structure_vote"])
    x = x.select("doc_id", "table_id", *[v.alias(k) for k, v in vote.items()])
    a, b, c = (F.col(k) for k in passes)
    agreed = F.when(c.isNull(), F.greatest(a, b)).when((a == b) | (a == c), a).when(b == c, b).otherwise(F.element_at(F.array_sort(F.array(a, b, c)), 2))
    return x.withColumn("header_rows", agreed)


def word_headers(cells: DataFrame, votes: DataFrame) -> DataFrame:
    """(doc_id, table_id, header, valid): one text per column, joined by "/".

    Parents are put in front for columns under a started vertical merge. The result holds if at most half of the columns
    are blank and none has over three levels; else the first row's texts are taken.
    """
    g = resolved(cells).withColumn("t", strip(or_empty(F.col("text")))).withColumn("i", F.dense_rank().over(Window.partitionBy("doc_id", "table_id").orderBy("r")) - 1)
    width = g.groupBy("doc_id", "table_id").agg(F.max(F.when(F.col("i") == 0, F.col("c"))).alias("last"))
    h = g.join(votes.select("doc_id", "table_id", "header_rows"), ["doc_id", "table_id"])
    part = F.when((F.col("i") < F.col("header_rows")) & (F.col("t") != ""), F.struct("i", "t"))
    cols = h.groupBy("doc_id", "table_id", "c").agg(
        F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"]).alias("parts"), F.coalesce(F.max(F.when(F.col("i") == 0, F.col("t"))), F.lit("")).alias("first")
    )
    starts = g.where("v_merge = 'restart'").select("doc_id", "table_id", F.explode(F.sequence("c", F.col("c") + F.col("grid_span") - 1)).alias("c"), "i", F.col("c").alias("c0"), "t")
    above = starts.groupBy("doc_id", "table_id", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c0", "t"))), lambda s: s["t"]).alias("parents"))
    x = cols.join(above, ["doc_id", "table_id", "c"], "left").join(width, ["doc_id", "table_id"]).where("c <= last")
    fresh = F.reverse(F.array_except(F.coalesce("parents", F.array().cast("array<string>")), "parts"))
    mapped = F.when(F.size("parts") > 0, F.array_join(F.concat(fresh, F.col("parts")), "/")).otherwise(F.coalesce(F.element_at(F.col("parents"), -1), F.lit("")))
    x = x.select("doc_id", "table_id", "c", mapped.alias("h"), "first")
    tab = x.groupBy("doc_id", "table_id").agg(F.array_sort(F.collect_list(F.struct("c", "h", "first"))).alias("z"))
    hs = F.transform("z", lambda s: s["h"])
    valid = (F.size(F.filter(hs, lambda v: ~shown(v))) <= F.size("z") * 0.5) & ~F.exists(hs, lambda v: F.size(F.split(v, "/")) > 3)
    return tab.select("doc_id", "table_id", F.when(valid, hs).otherwise(F.transform("z", lambda s: s["first"])).alias("header"), valid.alias("valid"))


def word_tables(cells: DataFrame, votes: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, table_id, markdown, html) of Word tables; blank cells show a dash, blank body rows are left out of Markdown."""
    g = resolved(cells).groupBy("doc_id", "table_id", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", strip(or_empty(F.col("text"))).alias("t")))), lambda s: s["t"]).alias("vals"))
    g = g.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy("r")) - 1)
    g = g.join(votes.select("doc_id", "table_id", "header_rows"), ["doc_id", "table_id"])
    dashed = F.transform("vals", lambda v: F.when(v == "", "-").otherwise(v))

    def tags(tag: str) -> Column:
        return F.concat(F.lit(f"<tr><{tag}>"), F.array_join(dashed, f"</{tag}><{tag}>"), F.lit(f"</{tag}></tr>"))

    body = (F.col("i") >= F.col("header_rows")) & F.exists("vals", lambda v: v != "")
    row = F.when(F.col("i") < F.col("header_rows"), tags("th")).otherwise(tags("td"))
    x = g.groupBy("doc_id", "table_id").agg(_ordered(body, _line(dashed)).alias("body"), _ordered(F.lit(True), row).alias("rows"))
    x = x.join(heads, ["doc_id", "table_id"])
    marks = _line(F.transform("header", lambda h, k: F.when(k == 0, "---").otherwise("---:")))
    md = F.concat_ws("\n", _line(F.col("header")), marks, F.when(F.col("body") != "", F.col("body")))
    return x.select("doc_id", "table_id", md.alias("markdown"), F.concat(F.lit("<table border='1'>\n"), F.col("rows"), F.lit("\n</table>")).alias("html"))
