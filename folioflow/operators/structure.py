"""From the elements of pages, and what is drawn on them, to the blocks of a paper.

Elements have the columns that ``pages.elements`` gives, and the page's ``width`` and ``height``; drawn things have the page,
``insert_no``, ``kind`` (drawing or image) and their box. All joins are equi-joins on the page, and only a page's rows meet.
Null boxes meet nothing; pages without captions give their texts alone; empty tables give no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import notation, tables
from folioflow.functions import text as T
from folioflow.functions.geometry import area, center_inside, expanded, intersection_area, overlap_ratio, rect, x_overlap_ratio
from folioflow.operators import layout, repair
from folioflow.operators.layout import PAGE
from folioflow.session import Scratch

SIDES = ("x0", "y0", "x1", "y1")
#: Words of running text.
LABEL_PROSE = "the|this|that|these|those|we|our|method|model|result|results|experiment|training|dataset|therefore|however|because|which|where"
#: Labels come after what is drawn.
_AFTER = 1 << 40


def is_visual_label(text: Column, caption_kind: Column, box_width: Column, page_width: Column) -> Column:
    """Short texts that belong to a drawing or a table rather than to a paragraph."""
    t = T.strip(T.sub(text, r"\s+", " "))
    words = F.regexp_count(t, F.lit(r"[A-Za-z0-9]+|[一-鿿]"))
    lines = F.size(F.filter(T.lines(text), lambda l: T.strip(l) != ""))
    wide = (box_width > page_width * 0.42) & (words > 6)
    sentence = T.has(t, T.SENTENCE_END) & (words > 4)
    prose = T.has(t, rf"\b({LABEL_PROSE})\b", True) & (words > 7)
    return (t != "") & caption_kind.isNull() & (F.length(t) <= 90) & (lines <= 4) & (words <= 14) & ~wide & ~sentence & ~prose


def primitives(drawn: DataFrame, rows: DataFrame, page=PAGE) -> DataFrame:
    """What crops grow over: drawings of 2 units or more, given a width and height of 1 where thinner, images, and labels."""
    sizes = rows.select(*page, "width", "height").distinct()
    d = drawn.join(sizes, list(page))
    x, y = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    thin = F.col("kind") == "drawing"
    d = d.where((F.col("kind") == "image") | (x >= 2) | (y >= 2)).withColumns({"_x": F.when(thin & (x < 1), 0.5).otherwise(0.0), "_y": F.when(thin & (y < 1), 0.5).otherwise(0.0)})
    clipped = [F.greatest(F.col("x0") - F.col("_x"), F.lit(0.0)), F.greatest(F.col("y0") - F.col("_y"), F.lit(0.0)), F.least(F.col("x1") + F.col("_x"), F.col("width")), F.least(F.col("y1") + F.col("_y"), F.col("height"))]
    d = d.select(*page, F.col("insert_no").cast("long"), "kind", *(c.alias(s) for c, s in zip(clipped, SIDES)))
    label = is_visual_label(F.col("text"), F.col("caption_kind"), F.col("x1") - F.col("x0"), F.col("width"))
    texts = rows.where(label).select(*page, (F.col("block_no") + _AFTER).cast("long").alias("insert_no"), F.lit("text").alias("kind"), *SIDES)
    return d.where("kind = 'drawing' OR (x0 < x1 AND y0 < y1)").unionByName(texts)


def caption_blocks(rows: DataFrame, page=PAGE) -> tuple[DataFrame, DataFrame]:
    """The captions with their ``group_no``, and a row a group: its kind, caption, box and the boxes of its captions."""
    captions = rows.where("caption_kind IS NOT NULL").select(*page, F.col("block_no").cast("long").alias("insert_no"), F.col("caption_kind").alias("kind"), "text", *SIDES, "width", "height")
    members = layout.caption_groups(captions)
    part = F.struct("insert_no", "text", *SIDES)
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    groups = members.groupBy(*page, "group_no").agg(  # a group's captions
        F.min("insert_no").alias("insert_no"), F.min_by("kind", "insert_no").alias("kind"), F.first("width").alias("width"), F.first("height").alias("height"), F.array_sort(F.collect_list(part)).alias("members"), *box
    )
    texts = F.filter(F.transform("members", lambda m: T.strip(m["text"])), lambda t: t != "")
    return members, groups.withColumn("caption", T.clean_text(F.array_join(texts, " ")))


def _same(left: str, right: str, page) -> list[Column]:
    return [F.col(f"{left}.{p}") == F.col(f"{right}.{p}") for p in page]


def inside_crop(element, crop) -> Column:
    """Whether an element's middle or over 8 % of its area lie in a crop."""
    return (area(element) > 0) & (intersection_area(element, crop) > 0) & (center_inside(element, crop) | (overlap_ratio(element, crop) > 0.08))


def valid_figures(crops: DataFrame, drawn: DataFrame, rows: DataFrame, page=PAGE) -> DataFrame:
    """Crops of figures (page, ``insert_no``, ``members``, box, ``width``, ``height``) of 900 square units or more and 72 % of the
    page at most, that hold over 8 % of something drawn and no long text, the figure's captions aside."""
    whole = F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    sized = crops.where((area(rect()) >= 900) & (area(rect()) / whole <= 0.72)).alias("c")
    shown = sized.join(drawn.where("kind <> 'text'").alias("d"), [*_same("c", "d", page), overlap_ratio(rect("d."), rect("c.")) > 0.08], "left_semi").alias("c")
    long = rows.where((F.length("text") > 260) | (F.regexp_count("text", F.lit(r"[A-Za-z]{2,}|[一-鿿]")) > 55)).where("caption_kind IS NULL").alias("e")
    own = F.exists("c.members", lambda m: overlap_ratio(rect("e."), tuple(m[s] for s in SIDES)) > 0.75)
    return shown.join(long, [*_same("c", "e", page), inside_crop(rect("e."), rect("c.")), ~own], "left_anti").select(*page, "insert_no")


def table_bodies(groups: DataFrame, rows: DataFrame, above: float = 170.0, below: float = 120.0, page=PAGE) -> DataFrame:
    """Pairs of a group (``insert_no``) and an element (``block_no``) of its table: in the crop, if there is one (``crop``, a
    struct), or close above or below the caption, over it, and with a digit or several lines."""
    body = rows.where("heading_level IS NULL AND kind <> 'equation' AND caption_kind IS NULL").select(*page, "block_no", "text", *SIDES)
    g, b = groups.alias("g"), body.alias("b")
    crop = tuple(F.col("g.crop")[s] for s in SIDES)
    drawn = F.coalesce(intersection_area(rect("b."), crop) > 0, F.lit(False))
    near = (F.col("g.y0") - F.col("b.y1")).between(0, above) | (F.col("b.y0") - F.col("g.y1")).between(0, below)
    listed = F.contains(F.col("b.text"), F.lit("\n")) | F.col("b.text").rlike(r"\d")
    return g.join(b, [*_same("g", "b", page), drawn | (near & listed & (x_overlap_ratio(rect("b."), rect("g.")) > 0.18))]).select(*(F.col(f"g.{p}") for p in page), "g.insert_no", "b.block_no", "b.text", "b.x0", "b.y0")


def explanations(groups: DataFrame, rows: DataFrame, page=PAGE) -> DataFrame:
    """For each group of captions the nearest line close above it, over it, that reads like an explanation: (page,
    ``insert_no``, ``block_no``, ``explanation``). Of equally near ones the first counts; an element may explain several."""
    t = T.strip(F.col("text"))
    digits = F.length(t) - F.length(F.regexp_replace(t, r"\d", ""))
    fits = F.length(t).between(12, 260) & ~F.contains(t, F.lit("\n")) & t.rlike("[A-Za-z]") & (digits <= F.length(t) * 0.35)
    lines = rows.where(fits).where("caption_kind IS NULL AND heading_level IS NULL").alias("e")
    gap = F.col("g.y0") - F.col("e.y1")
    pairs = groups.alias("g").join(lines, [*_same("g", "e", page), gap.between(0, 22), x_overlap_ratio(rect("e."), rect("g.")) > 0.25])
    best = F.min(F.struct(gap.alias("gap"), F.col("e.block_no").alias("block_no"), F.col("e.text").alias("text"))).alias("best")
    return pairs.groupBy(*(F.col(f"g.{p}") for p in page), "g.insert_no").agg(best).select(*page, "insert_no", F.col("best.block_no").alias("block_no"), F.col("best.text").alias("explanation"))  # a caption's lines


def structured_blocks(rows: DataFrame, drawn: DataFrame, page=PAGE) -> DataFrame:
    """The blocks of papers in reading order (``seq`` on a page): figures with the box of their picture (``clip``), tables with
    their cells, headings, paragraphs and equations. Texts inside figures and tables are no blocks of their own.

    Numbers come from captions, else from the count of the kind so far in the paper; equations are counted.
    """
    scratch = Scratch(rows.sparkSession)
    rows = scratch.table("elements", rows)  # read by every join below
    seen = primitives(drawn, rows, page)
    members, groups = caption_blocks(rows, page)
    crops = layout.visual_clusters(members.drop("text"), seen, page).where("x0 IS NOT NULL").select(*page, "insert_no", F.struct(*SIDES).alias("crop"))
    groups = scratch.table("crops", groups.join(crops, [*page, "insert_no"], "left"))
    figures = groups.where("kind = 'figure' AND crop IS NOT NULL").select(*page, "insert_no", "members", "width", "height", *(F.col("crop")[s].alias(s) for s in SIDES))
    valid = valid_figures(figures, seen, rows, page).withColumn("valid", F.lit(True))
    groups = groups.join(valid, [*page, "insert_no"], "left").withColumn("crop", F.when((F.col("kind") != "figure") | F.col("valid"), F.col("crop")))
    groups = scratch.table("groups", groups)

    bodies = table_bodies(groups.where("kind <> 'figure'"), rows, page=page)
    texts = bodies.groupBy(*page, "insert_no").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "block_no", "text"))).alias("body"))  # a table's elements
    texts = texts.select(*page, "insert_no", T.clean_text(F.array_join(F.transform("body", lambda b: b["text"]), "\n")).alias("content"))
    cut, free = groups.where("kind = 'figure' AND crop IS NOT NULL").alias("c"), rows.where("caption_kind IS NULL").alias("e")
    inner = free.join(cut, [*_same("e", "c", page), inside_crop(rect("e."), tuple(F.col("c.crop")[s] for s in SIDES))], "left_semi")
    taken = bodies.select(*page, "block_no").unionByName(inner.select(*page, "block_no"))

    counted = Window.partitionBy("paper_id", "kind").orderBy("page_no", "group_no")
    name = F.concat_ws("_", "kind", T.caption_number(F.col("caption"), F.row_number().over(counted)))
    shown = groups.join(texts, [*page, "insert_no"], "left").withColumns({"id": name, "content": F.when(F.col("kind") != "figure", F.coalesce("content", F.lit(""))), "cut": F.col("crop").isNotNull()})
    shown = shown.withColumn("cells", F.when(F.col("kind") != "figure", tables.parsed(F.col("content")))).withColumn("html", tables.to_html(F.col("cells.columns"), F.col("cells.rows")))
    shown = shown.withColumn("html", F.coalesce("html", F.when(F.col("content") != "", tables.raw_html(F.col("content")))))
    figure, full = F.col("kind") == "figure", F.size("cells.rows") > 0
    low = [(F.least if s in ("x0", "y0") else F.greatest)(F.col(s), F.coalesce(F.col("crop")[s], F.col(s))) for s in SIDES]
    clip = expanded(tuple(F.col("crop")[s] for s in SIDES), (F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height")))
    shown = shown.select(
        *page, F.lit(0).alias("_kind"), F.col("group_no").cast("long").alias("_no"), low[0].alias("_x"), low[1].alias("_y"), F.when(figure, "figure").otherwise("table").alias("type"), "id", "caption", "content",
        F.when(figure, F.when(F.col("cut"), F.concat(F.lit("figures/"), "id", F.lit(".png"))).otherwise("")).alias("path"),
        F.when(full, F.col("cells.columns")).alias("columns"), F.when(full, F.col("cells.rows")).alias("rows"), F.when(F.col("html").isNotNull(), F.concat(F.lit("tables/"), "id", F.lit(".html"))).alias("html_path"), "html",
        F.when(figure & F.col("cut"), F.struct(*(c.alias(s) for c, s in zip(clip, SIDES)))).alias("clip"),
    )

    plain = rows.where("caption_kind IS NULL").join(taken, [*page, "block_no"], "left_anti")
    equation, body = F.col("kind") == "equation", notation.prepared(T.strip(F.col("text")))
    raw = F.when(equation, T.strip_inline_citations(T.clean_text(T.strip(F.col("text")))))
    plain = plain.withColumns({"raw_text": raw, "text": F.when(~equation, F.when(F.col("heading_level").isNotNull(), T.sub(body, r"\s+", " ")).otherwise(body))})
    plain = repair.latex_of(plain.where("coalesce(raw_text, text) <> ''"), "raw_text")
    numbered = F.sum((F.col("kind") == "equation").cast("int")).over(Window.partitionBy("paper_id").orderBy("page_no", "block_no"))
    kind = F.when(F.col("kind") == "equation", "equation").when(F.col("heading_level").isNotNull(), "heading").otherwise("paragraph")
    plain = plain.withColumn("type", kind).select(
        *page, F.lit(1).alias("_kind"), F.col("block_no").cast("long").alias("_no"), F.col("x0").alias("_x"), F.col("y0").alias("_y"), "type", F.when(F.col("type") == "heading", F.least(F.greatest("heading_level", F.lit(2)), F.lit(4))).alias("level"),
        F.when(F.col("type") == "equation", F.concat(F.lit("equation_"), numbered.cast("string"))).alias("id"), "text", "raw_text", F.nullif("latex", F.lit("")).alias("latex"),
    )
    order = Window.partitionBy(*page).orderBy(F.floor(F.col("_y") / 8), F.bround("_x", 1), "_kind", "_no")
    out = shown.unionByName(plain, allowMissingColumns=True).withColumn("seq", F.row_number().over(order))
    return out.select(*page, "seq", "type", "level", "id", "text", "content", "raw_text", "latex", "caption", "path", "columns", "rows", "html_path", "html", "clip")


def serialized(blocks: DataFrame) -> DataFrame:
    """paper_id and ``blocks``: a paper's blocks as a JSON array, without null fields."""
    fields = [c for c in blocks.columns if c not in ("paper_id", "page_no", "seq", "clip")]
    rows = blocks.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "seq", F.to_json(F.struct(*fields)).alias("json")))).alias("b"))  # a paper's blocks
    return rows.select("paper_id", F.concat(F.lit("["), F.array_join(F.transform("b", lambda b: b["json"]), ","), F.lit("]")).alias("blocks"))
