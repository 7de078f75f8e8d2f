"""From positioned spans to the elements of a page, and to the plain text of a paper.

Spans have ``paper_id``, ``page_no`` (from 0), ``block_no``, ``line_no``, ``span_no``, ``text``, ``size``, ``font`` and their box.
They are dealt out by page once; lines, blocks and page statistics follow in place. Numbered equations are not cut out of the
blocks that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import blocks as B
from folioflow.functions import text as T
from folioflow.operators.layout import PAGE, upper_median


def is_footnote_marker(text: Column, size: Column, y0: Column, line_size: Column, line_top: Column) -> Column:
    """Raised signs or numbers of two digits at most, smaller than their line by 2 or more."""
    t = T.strip(text)
    return (t.isin("+", "*", "†", "‡") | T.has(t, r"^\d{1,2}$")) & (line_size - size >= 2) & (y0 <= line_top + 3)


def text_blocks(spans: DataFrame, page=PAGE) -> DataFrame:
    """One row a block: its cleaned text (empty if all its lines are), largest size, ``bold``, box, and ``page_size``, the upper
    median of the page's sizes over 0, or 10. Null texts are empty, null sizes and fonts count for nothing."""
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    font = F.lower(F.coalesce("font", F.lit("")))
    rows = spans.repartition(*page).withColumns({"text": F.coalesce("text", F.lit("")), "size": F.coalesce("size", F.lit(0.0)).cast("double"), "bold": F.contains(font, F.lit("bold"))})
    span = F.struct("span_no", "text", "size", "y0")
    lines = rows.groupBy(*page, "block_no", "line_no").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.max("size").alias("size"), F.max("bold").alias("bold"), *box)  # a line's spans
    kept = F.filter("spans", lambda s: ~F.coalesce(is_footnote_marker(s["text"], s["size"], s["y0"], F.col("size"), F.col("y0")), F.lit(False)))
    lines = lines.withColumn("text", T.strip(F.array_join(F.transform(kept, lambda s: s["text"]), "")))
    line = F.when(F.col("text") != "", F.struct("line_no", "text"))
    blocks = lines.groupBy(*page, "block_no").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.max("size").alias("size"), F.max("bold").alias("bold"), *box)  # a block's lines
    blocks = blocks.withColumn("text", T.clean_text(F.array_join(F.transform("lines", lambda l: l["text"]), "\n"))).drop("lines")
    sizes = F.collect_list(F.when(F.col("size") > 0, F.col("size"))).over(Window.partitionBy(*page))  # a page's blocks
    return blocks.withColumn("page_size", F.coalesce(upper_median(sizes), F.lit(10.0)))


def elements(blocks: DataFrame, width: Column, height: Column) -> DataFrame:
    """Blocks that hold text and are no page furniture, with ``kind`` (text or equation), ``heading_level`` and ``caption_kind``."""
    text = F.col("text")
    rows = blocks.where((text != "") & ~(T.is_noise(text, F.col("y0"), height, F.col("size"), ("NeurIPS", "Proceedings")) | B.is_venue_line(text)))
    rows = rows.withColumn("kind", F.when(T.is_formula(text, F.col("x0"), F.col("x1"), width), "equation").otherwise("text"))
    level = T.heading_level(text, F.col("size"), F.col("bold"), F.col("page_size"))
    return rows.withColumns({"heading_level": F.when(F.col("kind") == "text", level), "caption_kind": T.caption_kind(text)})


def without_front_matter(rows: DataFrame, height: Column, first_page: int = 0, page=PAGE) -> DataFrame:
    """The elements, on first pages only those from the abstract on; without one, from the first long text of the upper part on.
    First pages with neither keep all."""
    whole, text = Window.partitionBy(*page), T.strip(F.col("text"))
    at = lambda found: F.min_by(F.when(found, F.col("y0")), F.when(found, F.col("block_no"))).over(whole)
    abstract = T.has(T.sub(text, r"\s+", " "), r"^(?:abstract|摘要)\b", True)
    body = (F.length(text) >= 180) & F.col("heading_level").isNull() & (F.col("y0") < height * 0.65)
    start = F.coalesce(F.nullif(at(abstract), F.lit(0.0)), at(body))
    rows = rows.withColumn("_start", F.when(F.col("page_no") == first_page, start))
    return rows.where(F.col("_start").isNull() | ((F.col("y0") >= F.col("_start") - 3) & ~F.col("text").startswith("Project Page:"))).drop("_start")


def start_pages(rows: DataFrame, first_page: int = 0) -> DataFrame:
    """paper_id and ``start``: the first page if an element there has 180 characters or more, else the first page that names an
    abstract or introduction, else the first page."""
    long = (F.col("page_no") == first_page) & (F.length(T.strip(F.col("text"))) >= 180)
    named = F.when(T.has(F.col("text"), r"\b(?:abstract|introduction)\b", True), F.col("page_no"))
    return rows.groupBy("paper_id").agg(F.when(F.max(long), F.lit(first_page)).otherwise(F.coalesce(F.min(named), F.lit(first_page))).cast("long").alias("start"))


def plain_text(rows: DataFrame) -> DataFrame:
    """paper_id and ``text``: the elements' texts by page and block, cleaned and without citations."""
    texts = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "text"))), lambda x: x["text"]), "\n\n")
    pages = rows.groupBy("paper_id", "page_no").agg(texts("block_no").alias("text"))  # a page's blocks
    pages = pages.withColumn("text", T.strip_inline_citations(T.clean_text(F.col("text")))).where("text <> ''")
    return pages.groupBy("paper_id").agg(texts("page_no").alias("text"))  # a paper's pages


def equation_ids(rows: DataFrame) -> DataFrame:
    """``id`` equation_1, equation_2, ... through a paper's pages and blocks; null for other elements."""
    order = Window.partitionBy("paper_id").orderBy("page_no", "block_no")
    equation = F.col("kind") == "equation"
    return rows.withColumn("id", F.when(equation, F.concat(F.lit("equation_"), F.sum(equation.cast("int")).over(order).cast("string"))))
