"""Whole-document repairs as Arrow functions over text and blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import markdown
from folioflow.functions import text as T
from folioflow.session import ship


def _text_function(function):
    @F.arrow_udf("string")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())

    return apply


def sanitized(docs: DataFrame, text_col: str = "text", blocks_col: str = "blocks", out_col: str = "markdown") -> DataFrame:
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def sanitize_markdown(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, blocks in batches:
            yield pa.array([None if t is None else markdown.sanitize(t, b or []) for t, b in zip(texts.to_pylist(), blocks.to_pylist())], pa.string())

    return docs.withColumn(out_col, sanitize_markdown(text_col, blocks_col))


def html_of(docs: DataFrame, text_col: str = "text", out_col: str = "html") -> DataFrame:
    ship(docs.sparkSession)
    return docs.withColumn(out_col, _text_function(markdown.to_html)(F.col(text_col)))


def formula_lines(raw: Column) -> Column:
    """Cleaned lines of an extracted formula: those that are its number or no prose and hold something of a formula."""
    clean = lambda l: T.strip(T.sub(F.translate(F.regexp_replace(l, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""), "−∗", "-*"), r"\s+", " "))
    part = lambda l: T.has(l, r"^\(?\d+(?:_\d+)*\)?$") | (~T.is_equation_prose(l) & (T.formula_score(l) > 0))
    return F.filter(F.transform(T.lines(raw), clean), lambda l: (l != "") & part(l))


def latex_of(docs: DataFrame, raw_col: str, out_col: str = "latex") -> DataFrame:
    """Extracted formulas as LaTeX, without the prose between their lines; empty where no line is part of a formula."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def latex(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array([None if lines is None else markdown.formula_of_lines(lines) for lines in rows.to_pylist()], pa.string())

    return docs.withColumn(out_col, latex(formula_lines(F.col(raw_col))))


def previewed(docs: DataFrame, text_col: str = "text", blocks_col: str = "blocks", out_col: str = "markdown") -> DataFrame:
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def preview(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, blocks in batches:
            yield pa.array([None if t is None else markdown.preview(t, b or []) for t, b in zip(texts.to_pylist(), blocks.to_pylist())], pa.string())

    return docs.withColumn(out_col, preview(text_col, blocks_col))


def plain_of(docs: DataFrame, latex_col: str, out_col: str = "plain") -> DataFrame:
    ship(docs.sparkSession)
    return docs.withColumn(out_col, _text_function(markdown.latex_to_plain)(F.col(latex_col)))


def covered(source: Column, output: Column, least: int = 600, share: float = 0.25) -> Column:
    """The output, with the source appended where a long source left hardly a trace."""
    short = (F.length(source) >= least) & (F.length(F.regexp_replace(output, r"\s+", "")) < F.length(F.regexp_replace(source, r"\s+", "")) * share)
    return F.when(short, F.concat_ws("\n\n", F.nullif(output, F.lit("")), source)).otherwise(output)


def structures_found(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = 10_000) -> DataFrame:
    """``docs`` with ``found``, the ids of the items whose text they hold, in order, and ``n_missing``, how many they don't.

    Each document is tested against all items in one pass; the items, ``most`` at most, are part of the plan. Items
    without a text are left out; a null text holds none.
    """
    known = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("id"), F.col(item_text).alias("part")).orderBy("id").limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} items")
    kind = items.schema[item_id].dataType.simpleString()
    listed = F.array(*(F.struct(F.lit(r.id).cast(kind).alias("id"), F.lit(r.part).alias("part")) for r in known)) if known else F.expr(f"cast(array() AS array<struct<id:{kind},part:string>>)")
    hits = F.transform(F.filter(listed, lambda x: F.coalesce(F.contains(F.col(text_col), x["part"]), F.lit(False))), lambda x: x["id"])
    return docs.withColumn("found", hits).withColumn("n_missing", F.lit(len(known)) - F.size("found"))
