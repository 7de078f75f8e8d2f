"""Titles, formula lines and lengths of blocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import text as T

#: Symbols and words that mark a line as a formula, and venue lines that are furniture wherever they stand.
LINE_SYMBOLS = "=∼∈∑∏√σθπβλμϕΦΨℓ≤≥≠≈→←↔∀∃"
LINE_RELATIONS = "=∼∈σθβλ"
FRAGMENT_SYMBOLS = "=∑∼|{}()[]_\\^+-/*σβθλμ"
OPERATOR_LINE = r"^(?:\(?\d+\)?|[A-Z]|[A-Z]\s+(?:max|min)|(?:arg)?(?:max|min)\s*[A-Za-z𝑨-𝒁𝐀-𝐙]?)$"
VENUE_LINES = r"Conference on Neural Information Processing Systems|NeurIPS\s*2025|第\s*\d+\s*届\s*神经信息处理系统大会"
TEXT_FIELDS = ("text", "content", "raw_text", "latex", "caption")


def is_formula_line(line: Column) -> Column:
    """Short lines that are an operator, a number or a letter, or hold two symbols with a relation among them."""
    t = T.strip(line)
    symbolic = (T.symbols_in(t, LINE_SYMBOLS) >= 2) & (T.symbols_in(t, LINE_RELATIONS) >= 1)
    return (t != "") & (F.length(t) <= 260) & (T.has(t, OPERATOR_LINE) | symbolic)


def is_equation_fragment(text: Column, x0: Column, page_width: Column) -> Column:
    """Pieces of a displayed equation: its number, a word in brackets, a formula line, or symbols set in or short."""
    t = T.strip(text)
    c = T.compact(t)
    set_in = (x0 > page_width * 0.16) | (F.length(c) <= 28)
    symbolic = T.has(c, r"[A-Za-z][_=^({]|[{}]|\\[A-Za-z]+|∑|∼") & (T.symbols_in(c, FRAGMENT_SYMBOLS) >= 1)
    return (t != "") & ~T.is_equation_prose(t) & (T.has(t, r"^\((?:\d+|[A-Za-z][A-Za-z ]+)\)$") | is_formula_line(t) | (set_in & symbolic))


def is_venue_line(text: Column) -> Column:
    return T.has(text, VENUE_LINES, True)


def title(meta: Column, first_page: Column, fallback: Column) -> Column:
    """The metadata's title if it has more than 5 characters; else the lines that open the first page, as long as they look
    like a title; else its first line of 8 to 180 characters among 12; else ``fallback``. Nulls count as empty."""
    meta, first_page = F.coalesce(meta, F.lit("")), F.coalesce(first_page, F.lit(""))
    lines = F.filter(F.transform(T.lines(first_page), T.strip), lambda l: l != "")

    def fits(line: Column) -> Column:
        return F.length(line).between(4, 90) & ~T.has(line, r"^(?:abstract|introduction)\b", True) & ~T.has(line, r"[@{},\d]|https?://")

    head = F.slice(lines, 1, 8)
    stop = F.array_position(F.transform(head, fits), F.lit(False)).cast("int")
    opening = F.when(stop > 0, F.slice(head, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(head)
    line = F.get(F.filter(F.slice(lines, 1, 12), lambda l: F.length(l).between(8, 180)), 0)
    return (
        F.when(F.length(T.strip(meta)) > 5, F.substring(T.clean_text(meta), 1, 120))
        .when(F.size(opening) > 0, F.substring(T.clean_text(F.array_join(opening, " ")), 1, 160))
        .otherwise(F.coalesce(line, fallback))
    )


def _texts(block: Column) -> Column:
    return sum((F.coalesce(F.length(block[f]), F.lit(0)) for f in TEXT_FIELDS), F.lit(0))


def _sum(lengths: Column) -> Column:
    return F.coalesce(F.aggregate(lengths, F.lit(0), lambda n, x: n + x), F.lit(0))


def source_length(block: Column) -> Column:
    """Characters of a block's texts and cells. Nulls have none."""
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    cells = F.flatten(F.filter(block["rows"], lambda r: r.isNotNull()))
    return _texts(block) + _sum(F.transform(block["columns"], length)) + _sum(F.transform(cells, length))


def _json_length(items: Column) -> Column:
    """As JSON with a blank after each comma between items."""
    return F.length(F.to_json(items)) + F.greatest(F.size(items) - 1, F.lit(0))


def rendered_length(block: Column) -> Column:
    """Characters of a block's texts, and of its columns and rows as JSON. Nulls have none."""
    blanks = _sum(F.transform(block["rows"], lambda r: F.greatest(F.size(r) - 1, F.lit(0))))
    return _texts(block) + F.coalesce(_json_length(block["columns"]), F.lit(0)) + F.coalesce(_json_length(block["rows"]) + blanks, F.lit(0))
