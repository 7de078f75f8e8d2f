"""Page elements, titles and block lengths against small cases."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.functions import blocks as B
from folioflow.functions import text as T
from folioflow.operators import pages

SPANS = "paper_id long, page_no long, block_no long, line_no long, span_no long, text string, size double, font string, x0 double, y0 double, x1 double, y1 double"
BODY = "Words of a first paragraph that goes on and on. " * 5


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr.alias("x")).first().x


def spans(spark, rows):
    """(page, block, line, span, text, size, font, y0[, x0])"""
    return spark.createDataFrame([(1, p, b, l, s, t, size, font, float(*x0 or (40,)), float(y), 500.0, float(y) + 10) for p, b, l, s, t, size, font, y, *x0 in rows], SPANS)


def test_blocks_of_spans(spark):
    rows = [
        (0, 0, 0, 0, "A Ti", 14.0, "X", 10), (0, 0, 0, 1, "1", 7.0, "X", 11), (0, 0, 0, 2, "tle", 14.0, "X-SemiBold", 10),
        (0, 1, 0, 0, "two-", 10.0, "X", 40), (0, 1, 1, 0, "fold", 10.0, None, 52), (0, 1, 2, 0, "x", 10.0, "X", 64), (0, 1, 2, 1, "2", 9.0, "X", 64),
        (0, 2, 0, 0, " ", 10.0, "X", 90), (0, 2, 1, 0, None, None, "X", 95), (1, 0, 0, 0, "y", None, "X", 10),
    ]
    got = {(r.page_no, r.block_no): (r.text, r.size, r.bold, r.page_size) for r in pages.text_blocks(spans(spark, rows)).collect()}
    assert got == {(0, 0): ("A Title", 14.0, True, 10.0), (0, 1): ("twofold\nx2", 10.0, False, 10.0), (0, 2): ("", 10.0, False, 10.0), (1, 0): ("y", 0.0, False, 10.0)}
    assert pages.text_blocks(spans(spark, rows).limit(0)).count() == 0


def test_elements_and_front_matter(spark):
    rows = [
        (0, 0, 0, 0, "Some Author", 10.0, "X", 10), (0, 1, 0, 0, "Abstract", 12.0, "X", 100), (0, 2, 0, 0, BODY + "[3]", 10.0, "X", 120),
        (0, 3, 0, 0, "a = b + c (1)", 10.0, "X", 200, 200), (0, 4, 0, 0, "7", 10.0, "X", 790), (0, 5, 0, 0, "NeurIPS 2025", 10.0, "X", 30), (0, 6, 0, 0, "Project Page: z", 10.0, "X", 300),
        (1, 0, 0, 0, "Figure 2: things", 10.0, "X", 10), (1, 1, 0, 0, "d = e + f (2)", 10.0, "X", 50, 200),
    ]
    found = pages.elements(pages.text_blocks(spans(spark, rows)), F.lit(600.0), F.lit(800.0))
    kept = pages.without_front_matter(found, F.lit(800.0))
    got = {(r.page_no, r.block_no): (r.kind, r.heading_level, r.caption_kind, r.id) for r in pages.equation_ids(kept).collect()}
    assert got == {(0, 1): ("text", 2, None, None), (0, 2): ("text", None, None, None), (0, 3): ("equation", None, None, "equation_1"), (1, 0): ("text", None, "figure", None), (1, 1): ("equation", None, None, "equation_2")}
    assert pages.plain_text(kept).collect() == [(1, "Abstract\n\n" + BODY.strip() + "\n\na = b + c (1)\n\nFigure 2: things\n\nd = e + f (2)")]
    assert pages.start_pages(kept).collect() == [(1, 0)]
    assert pages.start_pages(kept.where("block_no <> 2 AND text <> 'Abstract'").withColumn("text", F.when(F.col("page_no") == 1, "1 Introduction").otherwise(F.col("text")))).collect() == [(1, 1)]
    body = pages.without_front_matter(found.where("text <> 'Abstract'"), F.lit(800.0)).where("page_no = 0")
    assert {r.block_no for r in body.collect()} == {2, 3}
    assert pages.without_front_matter(found.where("block_no = 0"), F.lit(800.0)).count() == 2


@pytest.mark.parametrize(
    "text, want",
    [("(12)", True), ("G max", True), ("argmin x", True), ("Q", True), ("p(x) = σ", True), ("x = y", False), ("a word", False), ("", False), ("θ = " + "b" * 300, False)],
)
def test_formula_lines(spark, text, want):
    assert one(spark, B.is_formula_line(F.col("t")), t=text) is want


@pytest.mark.parametrize("text, x0, want", [("(3)", 0, True), ("(see below)", 0, True), ("x_i + 1", 0, True), ("plain", 200, False), ("where f(x) is the model that we fit", 200, False), ("f(x) " * 20, 0, False), ("f(x) " * 20, 200, True)])
def test_equation_fragments(spark, text, x0, want):
    assert one(spark, B.is_equation_fragment(F.col("t"), F.col("x"), F.lit(600.0)), t=text, x=x0) is want


@pytest.mark.parametrize("text, want", [("x = a + b", True), ("see (3)", True), ("[1] = + a", False), ("x", False)])
def test_formulas(spark, text, want):
    assert one(spark, T.is_formula(F.col("t"), F.lit(200.0), F.lit(400.0), F.lit(600.0)), t=text) is want


@pytest.mark.parametrize("text, want", [("5 References", True), ("Bibliography:", True), ("参考文献", True), ("Referenced", False)])
def test_references_headings(spark, text, want):
    assert one(spark, T.is_references_heading(F.col("t")), t=text) is want


@pytest.mark.parametrize(
    "meta, page, want",
    [
        ("A Real Title", "x", "A Real Title"), (None, "On Large\nThings\nJane Doe, MIT\nmore", "On Large Things"), ("abc", "Abstract\nlonger line here", "Abstract"),
        ("", "a@b.c long enough\nrest", "a@b.c long enough"), (None, "ab", "stem"), (None, None, "stem"), ("", "\n".join(f"Line {c}" for c in "abcdefghij"), " ".join(f"Line {c}" for c in "abcdefgh")),
    ],
)
def test_titles(spark, meta, page, want):
    got = spark.createDataFrame([(meta, page)], "meta string, page string").select(B.title(F.col("meta"), F.col("page"), F.lit("stem")).alias("t")).first().t
    assert got == want


def test_block_lengths(spark):
    columns, rows = ["k", 'v "q"'], [["a", "1"], ["b", "22", "é"]]
    ddl = "b struct<text:string,content:string,raw_text:string,latex:string,caption:string,columns:array<string>,rows:array<array<string>>>"
    df = spark.createDataFrame([(("abc", None, "d", None, "ef", columns, rows),), ((None,) * 7,), (("x", None, None, None, None, [], []),)], ddl)
    got = df.select(B.source_length(F.col("b")), B.rendered_length(F.col("b"))).collect()
    cells = sum(map(len, columns)) + sum(len(c) for r in rows for c in r)
    dumped = sum(len(json.dumps(x, ensure_ascii=False)) for x in (columns, rows))
    assert [tuple(r) for r in got] == [(6 + cells, 6 + dumped), (0, 0), (1, 5)]
