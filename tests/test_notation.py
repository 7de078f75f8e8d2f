"""Inline formulas, formula lines and generated sections against small cases."""

import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import notation as N

CONTEXT = "struct<field:string,subfield:string,terminology_notes:string>"


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("T = {(x, yt)} here", r"$T = \{(x, y_t)\}$ here"), ("D( G ( x ) ) and G(x), D([x, y])", "$D(G(x))$ and $G(x)$, $D([x,y])$"), ("V(G, D)", "$V(G,D)$"),
        ("qG(· | x) yt y_t", r"$q_G(\cdot\mid x)$ $y_t$ $y_t$"), ("β = 0.5 and σ(·)", r"$\beta = 0.5$ and $\sigma(\cdot)$"), ("x, y x.y x-y xy max", "$x$, $y$ x.y x-y xy max"),
        ("`x` $y$ ![x](y) x", "`x` $y$ ![x](y) $x$"), ("G", "$G$"), ("$ x open", "$ x open"), ("$x$G", "$x$G$"), ("über Öx", "über Öx"), ("", ""), (None, None),
    ],
)
def test_inline_math(spark, text, want):
    assert one(spark, N.inline_math(F.col("t").cast("string")), t=text) == want


def test_prepared(spark):
    assert one(spark, N.prepared(F.col("t")), t="see x [3] ,") == "see $x$,"


@pytest.mark.parametrize(
    "text, kind, level, want",
    [(" a = x ", "equation", None, "$$\na = $x$\n$$"), ("1 Intro\nduction", "text", 3, "### 1 Intro duction"), (" words [2]", "text", None, "words"), ("Fig [1]", "caption_marker", 2, "Fig")],
)
def test_elements(spark, text, kind, level, want):
    assert one(spark, N.element_markdown(F.col("t"), F.col("k"), F.col("l").cast("int")), t=text, k=kind, l=level) == want


def test_caption_marker(spark):
    texts = F.array(F.lit("a"), F.lit("b"))
    mark = "#" * 80
    assert one(spark, N.caption_marker(texts, F.lit("why")), t=0) == f"{mark}\nwhy\na\nb\n{mark}"
    assert one(spark, N.caption_marker(texts, F.lit(None).cast("string")), t=0) == f"{mark}\na\nb\n{mark}"


@pytest.mark.parametrize(
    "text, want",
    [("text\n (1) \nQ\nmore", "text\n\n(1)\nQ\n\nmore"), ("(1)\n\nmore", "(1)\n\nmore"), ("\n(1)", "\n(1)"), ("plain\n line", "plain\n line"), ("", ""), (None, None)],
)
def test_spaced_formula_lines(spark, text, want):
    assert one(spark, N.spaced_formula_lines(F.col("t").cast("string")), t=text) == want


def test_sections_and_summaries(spark):
    text = "# 论文阅读摘要\n\n## 一句话概括\nx\ny\n## Kept\nz\n## 可能的疑问与后续阅读建议\nw"
    context = F.struct(F.lit("A").alias("field"), F.lit("B").alias("subfield"), F.lit("C").alias("terminology_notes"))
    tags = "## 论文领域标签\n- 领域：A\n- 子领域：B\n- 关键词/术语提示：C\n"
    assert one(spark, N.summary(F.col("t"), context), t=text) == f"# 论文阅读摘要\n\n{tags}\n\n## Kept\nz\n"
    assert one(spark, N.summary(F.col("t"), context), t="plain") == f"# 论文阅读摘要\n\n{tags}\n\nplain\n"
    assert one(spark, N.summary(F.col("t"), context), t="# 论文阅读摘要\n## 论文领域标签\nq") == "# 论文阅读摘要\n## 论文领域标签\nq\n"
    assert one(spark, N.without_section(F.col("t"), "a.b"), t="## a.b\nx\n## axb\ny") == "## axb\ny"
    assert one(spark, N.context_lines(context), t=0) == "领域：A\n子领域：B\n术语注意事项：C"


@pytest.mark.parametrize(
    "json, kind, want",
    [
        ('{"choices":[{"message":{"content":" hi "}}]}', "chat", "hi"), ('{"choices":[]}', "chat", None), ("no json", "chat", None),
        ('{"content":[{"type":"text","text":"a"},{"type":"tool","text":"b"},{"text":"c "}]}', "messages", "ac"), ('{"content":[]}', "messages", None), ("no json", "messages", None),
    ],
)
def test_answers(spark, json, kind, want):
    assert one(spark, N.answer(F.col("t"), kind), t=json) == want
