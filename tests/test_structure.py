"""Blocks of papers from elements and drawings against small cases."""

import json
import time

import pytest
from pyspark.sql import functions as F

from folioflow.functions import tables
from folioflow.operators import structure

ELEMENT = "paper_id long, page_no long, block_no long, text string, kind string, heading_level int, caption_kind string, x0 double, y0 double, x1 double, y1 double, width double, height double"
DRAWN = "paper_id long, page_no long, insert_no long, kind string, x0 double, y0 double, x1 double, y1 double"
BODY = "Words of a paragraph that tells what was found and how it was measured. "


def elements(spark, rows):
    """(page, block, text, kind, level, caption kind, box)"""
    return spark.createDataFrame([(1, p, b, t, k, l, c, *map(float, box), 600.0, 800.0) for p, b, t, k, l, c, box in rows], ELEMENT)


def drawn(spark, rows):
    return spark.createDataFrame([(1, p, i, k, *map(float, box)) for p, i, k, box in rows], DRAWN)


PAGE = [
    (0, 0, "1 Intro", "text", 2, None, (50, 40, 300, 55)),
    (0, 1, BODY * 2 + "where x , and [3] ends", "text", None, None, (50, 60, 550, 100)),
    (0, 2, "axis", "text", None, None, (150, 240, 200, 250)),
    (0, 3, "Figure 7: A plot", "text", None, "figure", (100, 310, 400, 322)),
    (0, 4, "k | v\na | 1\nb | 2", "text", None, None, (100, 400, 400, 440)),
    (0, 5, "Table: Sizes", "text", None, "table", (100, 450, 400, 462)),
    (0, 6, "a = b + c\n(2)", "equation", None, None, (200, 500, 400, 520)),
    (1, 0, "d = e + f", "equation", None, None, (200, 50, 400, 70)),
    (1, 1, "Fig.: none", "text", None, "figure", (100, 700, 400, 712)),
]
LINES = [(0, 1, "drawing", (120, 150, 380, 300)), (0, 2, "drawing", (0, 0, 1, 1)), (1, 1, "drawing", (0, 80, 600, 690))]


def test_blocks_of_a_paper(spark):
    rows = structure.structured_blocks(elements(spark, PAGE), drawn(spark, LINES))
    got = {(r.page_no, r.seq): r for r in rows.collect()}
    assert {k: (r.type, r.id) for k, r in got.items()} == {
        (0, 1): ("heading", None), (0, 2): ("paragraph", None), (0, 3): ("figure", "figure_7"), (0, 4): ("table", "table_1"), (0, 5): ("equation", "equation_1"),
        (1, 1): ("equation", "equation_2"), (1, 2): ("figure", "figure_2"),
    }
    figure, table, equation = got[0, 3], got[0, 4], got[0, 5]
    assert (figure.path, tuple(figure.clip), figure.caption) == ("figures/figure_7.png", (116.0, 146.0, 384.0, 304.0), "Figure 7: A plot")
    assert (table.columns, table.rows, table.content, table.html_path) == (["k", "v"], [["a", "1"], ["b", "2"]], "k | v\na | 1\nb | 2", "tables/table_1.html")
    assert table.html == "<table>\n<tr><th>k</th><th>v</th></tr>\n<tr><td>a</td><td>1</td></tr>\n<tr><td>b</td><td>2</td></tr>\n</table>\n"
    assert (equation.raw_text, equation.latex) == ("a = b + c\n(2)", r"a = b + c\tag{2}")
    assert got[0, 2].text.endswith("where $x$, and ends") and got[0, 1].level == 2
    assert (got[1, 2].path, got[1, 2].clip) == ("", None)  # the crop is most of the page
    (paper,) = structure.serialized(rows).collect()
    blocks = json.loads(paper.blocks)
    assert [b["type"] for b in blocks] == [got[k].type for k in sorted(got)] and blocks[3]["rows"] == [["a", "1"], ["b", "2"]]


def test_no_captions_and_no_rows(spark):
    rows = elements(spark, PAGE)
    assert [r.type for r in structure.structured_blocks(rows.where("caption_kind IS NULL"), drawn(spark, LINES).limit(0)).orderBy("page_no", "seq").collect()] == ["heading", "paragraph", "paragraph", "paragraph", "equation", "equation"]
    assert structure.structured_blocks(rows.limit(0), drawn(spark, LINES)).count() == 0


def test_long_text_in_a_crop_is_no_figure(spark):
    long = [(0, 9, BODY * 6, "text", None, None, (130, 160, 370, 290))]
    got = {r.id: r.path for r in structure.structured_blocks(elements(spark, PAGE + long), drawn(spark, LINES)).where("type = 'figure'").collect()}
    assert got["figure_7"] == ""


def test_explanations(spark):
    rows = elements(spark, PAGE + [(0, 8, "All runs, two seeds", "text", None, None, (100, 295, 400, 300)), (0, 9, "short", "text", None, None, (100, 301, 400, 309)), (0, 10, "1 2 3 4 5 6 7 8 a", "text", None, None, (100, 301, 400, 309))])
    _, groups = structure.caption_blocks(rows)
    assert [(r.page_no, r.insert_no, r.block_no, r.explanation) for r in structure.explanations(groups, rows).collect()] == [(0, 3, 8, "All runs, two seeds")]


@pytest.mark.parametrize(
    "text, width, want",
    [("axis label", 100, True), ("", 100, False), ("a" * 91, 100, False), ("a\nb\nc\nd\ne", 100, False), ("one two three four five six seven", 300, False), ("This ends as a sentence.", 100, False), ("we show our six new and old runs", 100, False)],
)
def test_visual_labels(spark, text, width, want):
    rows = spark.createDataFrame([(text, float(width))], "t string, w double")
    assert rows.select(structure.is_visual_label(F.col("t"), F.lit(None).cast("string"), F.col("w"), F.lit(600.0)).alias("x")).first().x is want


@pytest.mark.parametrize(
    "text, want",
    [
        ("a | b\n<td>1</td> | 2 | 3\nnone\n4 | &lt;i&gt;5", (["a", "b"], [["1", "2 3"], ["4", "5"]])), ("a | b | c\n1 | 2 | 3\nx | y", (["a", "b", "c"], [["1", "2", "3"]])),
        ("a | b\n1 | 2 | 3", None), ("a b\nc d", None), ("", None), (None, None),
    ],
)
def test_raw_tables(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(tables.raw_rows(F.col("t")).alias("x")).first().x
    assert (got and (got["columns"], got["rows"])) == want


def test_tall_raw_tables_are_read_once(spark):
    text = "\n".join(f"<td>a{i}</td> | <x|y>b{i}" + (" | c" if i % 3 == 0 else " | c | d" if i % 100 == 1 else "") for i in range(1200))
    want = [[f"a{i}", f"b{i}" + (" c" if i % 3 == 0 else " c d" if i % 100 == 1 else "")] for i in range(1200)]
    began = time.monotonic()
    got = spark.createDataFrame([(text,)], "t string").select(tables.raw_rows(F.col("t")).alias("x")).first().x
    assert (got["columns"], got["rows"]) == (want[0], want[1:]) and time.monotonic() - began < 20
