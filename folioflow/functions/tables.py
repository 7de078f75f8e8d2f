"""Table text to cells, and cells to Markdown or HTML, with array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import LINE_END, html_escape, is_complex_cell, is_numeric_cell, lines, pyre, strip, sub


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: lambdas evaluate a whole expression anew wherever it is named."""
    return F.get(F.transform(F.array(value), body), 0)


def cells(line: Column) -> Column:
    """Cells between pipes, or else between two or more blanks; empty ones are left out."""
    piped = F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|")
    spaced = F.split(line, pyre(r"\s{2,}|\t+"))
    parts = F.when(F.contains(line, F.lit("|")), piped).otherwise(spaced)
    return F.filter(F.transform(parts, strip), lambda c: c != "")


def parsed(text: Column) -> Column:
    """struct(columns, rows): rows of two cells at least, padded on the right."""
    rows = F.filter(F.transform(F.filter(F.transform(lines(text), strip), lambda l: l != ""), cells), lambda r: F.size(r) >= 2)
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    rows = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    first = F.get(rows, 0)
    digits = F.size(F.filter(first, lambda c: c.rlike(r"\d")))
    named = (F.size(rows) > 1) & (digits < F.greatest(F.lit(1), F.floor(width / 2)))
    numbered = F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.concat(F.lit("列 "), i.cast("string")))
    none = F.array().cast("array<string>")
    columns = F.when(F.size(rows) == 0, none).when(named, first).otherwise(numbered)
    body = F.when(named, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).otherwise(rows)
    return F.struct(columns.alias("columns"), body.alias("rows"))


def md_cell(cell: Column) -> Column:
    return strip(F.replace(F.replace(cell, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|")))


def pipe_row(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(row, md_cell), " | "), F.lit(" |"))


def to_html(columns: Column, rows: Column) -> Column:
    tag = lambda row, t: F.concat(F.lit("<tr>"), F.array_join(F.transform(row, lambda c: F.concat(F.lit(f"<{t}>"), html_escape(c), F.lit(f"</{t}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(rows, lambda r: tag(r, "td")), "\n")
    return F.when((F.size(columns) > 0) & (F.size(rows) > 0), F.concat(F.lit("<table>\n"), tag(columns, "th"), F.lit("\n"), body, F.lit("\n</table>\n")))


def raw_html(text: Column) -> Column:
    """A table's text in one cell, for tables whose cells are not known."""
    return F.concat(F.lit("<table>\n<tr><td>"), F.replace(html_escape(text), F.lit("\n"), F.lit("<br>")), F.lit("</td></tr>\n</table>\n"))


def raw_rows(text: Column) -> Column:
    """struct(columns, rows) of the piped lines of a raw table, tags left out: rows of the commonest width (of equally common
    ones the first) and longer ones, whose last cells are joined. Null unless two rows or more have that width."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    plain = F.transform(F.filter(F.split(text, LINE_END), lambda l: F.contains(l, F.lit("|"))), lambda l: strip(sub(sub(l, "<[^>]+>", " "), r"\s+", " ")))
    rows = F.filter(F.transform(F.filter(plain, lambda l: F.contains(l, F.lit("|"))), cells), lambda r: F.size(r) >= 2)
    return let(rows, lambda rows: let(commonest(F.transform(rows, F.size)), lambda best: F.when(best["n"] >= 2, let(fitted(rows, best["width"]), lambda out: F.struct(F.get(out, 0).alias("columns"), F.slice(out, F.lit(2), F.size(out)).alias("rows"))))))


def commonest(widths: Column) -> Column:
    """struct(n, first, width) of the commonest width, of equally common ones the first; null of no widths."""
    count = lambda of: F.transform(F.array_distinct(of), lambda w, i: F.struct(F.size(F.filter(of, lambda x: x == w)).alias("n"), (-i).alias("first"), w.alias("width")))
    return F.array_max(let(widths, count))


def fitted(rows: Column, width: Column) -> Column:
    """The rows of a width and longer ones, whose last cells are joined."""
    joined = lambda r: F.concat(F.slice(r, F.lit(1), width - 1), F.array(F.array_join(F.slice(r, width, F.size(r) - width + 1), " ")))
    return F.transform(F.filter(rows, lambda r: F.size(r) >= width), lambda r: F.when(F.size(r) == width, r).otherwise(joined(r)))


def to_markdown(columns: Column, rows: Column) -> Column:
    """A pipe table with numeric columns set right; HTML where a cell can't be one line of a pipe table."""
    numeric = F.transform(F.sequence(F.lit(0), F.size(columns) - 1), lambda i: F.forall(rows, lambda r: is_numeric_cell(F.coalesce(F.get(r, i), F.lit("")))))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(numeric, lambda n: F.when(n, "---:").otherwise("---")), " | "), F.lit(" |"))
    plain = F.concat(pipe_row(columns), F.lit("\n"), rule, F.lit("\n"), F.array_join(F.transform(rows, pipe_row), "\n"))
    hard = F.exists(rows, lambda r: F.exists(r, is_complex_cell)) | F.exists(columns, is_complex_cell)
    return F.when((F.size(columns) > 0) & (F.size(rows) > 0), F.when(hard, to_html(columns, rows)).otherwise(plain))
