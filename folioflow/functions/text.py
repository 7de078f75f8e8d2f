"""Text cleaning and classification as Column expressions.

Patterns are Java regular expressions; ``pyre`` switches them to Unicode classes and Unix line ends, as Python has them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists and character sets of the classifiers.
SECTION_WORDS = ("abstract", "introduction", "background", "related work", "method", "methods", "model", "algorithm", "experiment", "experiments", "results", "discussion", "conclusion", "appendix")
PROSE_WORDS = (
    "the", "this", "that", "where", "which", "therefore", "because", "indicates", "shows", "suggests", "formulation", "provides", "relationship", "between", "empirical",
    "data", "fit", "model", "sampled", "denotes", "follows", "given", "obtained", "contains", "we", "our", "their", "from", "with",
)
FORMULA_SYMBOLS = "=+-*/∑∫√∞≈≠≤≥±×÷∂∇∈∀∃→←↔αβγδθλμσπφωΓΔΘΛΣΦΩ"
SCORE_SYMBOLS = "=+-*/_\\^{}()[]|<>∑∫√≈≠≤≥πβθφτσµ"
REFERENCE_HEADINGS = ("references", "bibliography", "reference", "参考文献")
STRICT_CITATION = r"\s*\[(?:[A-Za-z][A-Za-z0-9]*\+?\d{2,4}(?:\s*[,;]\s*[A-Za-z][A-Za-z0-9]*\+?\d{2,4})*|\d{1,4}(?:\s*[,;]\s*\d{1,4})*)\]"
BROAD_CITATION = r"\s*[\[［](?=[^\]］]{1,80}(?:\d|\+|[,;，；]))[A-Za-z0-9][A-Za-z0-9+.\-]*(?:\s*[,;，；]\s*[A-Za-z0-9][A-Za-z0-9+.\-]*)*[\]］]"
SENTENCE_END = r"[.!?。！？]\s*$"


#: Java form of all the line ends Python knows.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def pyre(pattern: str, ignore_case: bool = False) -> str:
    return ("(?Uiud)" if ignore_case else "(?Ud)") + pattern


def sub(text: Column, pattern: str, to: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, pyre(pattern, ignore_case), to)


def has(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(pyre(pattern, ignore_case))


def strip(text: Column) -> Column:
    return sub(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines without a trailing empty one, at all the line ends Python knows."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def symbols_in(text: Column, symbols: str) -> Column:
    """How many characters of ``text`` are in ``symbols``."""
    return F.length(text) - F.length(F.translate(text, symbols, ""))


def compact(text: Column) -> Column:
    return sub(text, r"\s+", "")


def clean_text(text: Column) -> Column:
    out = F.replace(text, F.lit("\0"), F.lit(""))
    out = F.regexp_replace(out, "-\n([a-z])", "$1")
    out = F.regexp_replace(out, "[ \t]+\n", "\n")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def strip_inline_citations(text: Column) -> Column:
    out = F.regexp_replace(sub(text, STRICT_CITATION, ""), " {2,}", " ")
    return F.regexp_replace(out, " +([,.;:，。；：])", "$1")


def strip_reference_citations(text: Column) -> Column:
    return sub(text, BROAD_CITATION, "")


def remove_reference_urls(text: Column) -> Column:
    return sub(text, r"(?m)^\s*\d+\s*https?://\S+\s*$", "")


def safe_name(name: Column, default: str = "untitled-paper") -> Column:
    out = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]+', "_"), r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def field_tag(field: Column, subfield: Column, default: str) -> Column:
    known = lambda c: F.when(~F.lower(strip(c)).isin("", "unknown"), strip(c))
    return F.coalesce(F.nullif(F.concat_ws(" / ", known(field), known(subfield)), F.lit("")), F.lit(default))


def marker_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^[ \t]*#{7,}[ \t]*$", "#" * 80)


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def caption_kind(text: Column) -> Column:
    word = F.lower(F.regexp_extract(strip(text), pyre(CAPTION, True), 1))
    return F.when(word.startswith("fig"), "figure").when(word.startswith("table"), "table").when(word != "", "algorithm")


CAPTION = r"^(fig(?:ure)?\.?|table|algorithm)\s*\d+"


def caption_number(text: Column, fallback: Column) -> Column:
    token = F.regexp_extract(strip(text), pyre(r"^(?:fig(?:ure)?\.?|table|algorithm)\s*([A-Za-z0-9][A-Za-z0-9_.-]*)", True), 1)
    token = F.regexp_replace(F.regexp_replace(token, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(token, F.lit("")), fallback.cast("string"))


def heading_level(text: Column, size: Column, bold: Column, page_size: Column) -> Column:
    t = strip(text)
    sentence = has(t, SENTENCE_END) & ~has(t, r"^\d+(\.\d+)*\s+\S+")
    numbered = has(t, r"^\d+(\.\d+)*\s+[A-Z][A-Za-z0-9 /,&()\-]+")
    section = has(t, r"^(" + "|".join(SECTION_WORDS) + r")\b", True)
    level = F.when(has(t, r"^\d+\.\d+"), 3).otherwise(2)
    return F.when((t != "") & (F.length(t) <= 160) & caption_kind(t).isNull() & ~sentence & (numbered | section | bold | (size >= page_size + 1.0)), level)


def is_references_heading(text: Column) -> Column:
    t = F.regexp_replace(sub(strip(text), r"^\d+(\.\d+)*\s+", ""), "^[ .:：]+|[ .:：]+$", "")
    return F.lower(t).isin(*REFERENCE_HEADINGS)


def is_noise(text: Column, y0: Column, page_height: Column, size: Column, venues: tuple[str, ...] = ("Proceedings", "Conference on")) -> Column:
    """Page furniture: page numbers, running footers, small footnotes with links, preprint marks."""
    t = strip(text)
    footer = "|".join([*venues, "arXiv", "Equal contribution", "Contact person", "Corresponding author", "Project Page", "Code:", "https?://"])
    note = has(t, r"^\d+\s+") | F.contains(t, F.lit("http://")) | F.contains(t, F.lit("https://"))
    return (
        (t == "")
        | (has(t, r"^\d+$") & (y0 > page_height * 0.88))
        | ((y0 > page_height * 0.82) & has(t, f"({footer})", True))
        | ((size > 0) & (size <= 9.2) & (y0 > page_height * 0.84) & note)
        | F.contains(t, F.lit("arXiv:"))
        | has(t, r"^[∗*]Equal contribution")
    )


def is_formula(text: Column, x0: Column, x1: Column, page_width: Column) -> Column:
    t = strip(text)
    c = compact(t)
    marked = has(t, r"\(\s?\d+\s?\)$")
    symbolic = F.contains(c, F.lit("=")) & (symbols_in(c, FORMULA_SYMBOLS) >= 2)
    fits = (t != "") & ~t.startswith("[") & (F.size(F.split(t, pyre(r"\s+"))) <= 18) & F.length(c).between(4, 220)
    return fits & (x0 > page_width * 0.12) & (x1 < page_width * 0.88) & (marked | symbolic)


def formula_score(text: Column) -> Column:
    c = compact(F.coalesce(text, F.lit("")))
    n = symbols_in(c, SCORE_SYMBOLS)
    operator = has(c, r"[=≈≤≥<>]|\\[A-Za-z]+|[A-Za-z][_^{]")
    return (
        F.when((c == "") | has(c, r"^\(\d+\)$"), 0)
        .when(has(c, r"^\d+(?:\.\d+)?$"), 1)
        .when(has(c, r"^[A-Za-zα-ωΑ-Ωϕφπβθτσµ]$"), 2)
        .when(~operator & (n < 2), F.floor(F.length(c) / 4).cast("int"))
        .otherwise(F.length(c) + n * 4)
    )


def is_equation_prose(text: Column) -> Column:
    t = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    t = strip(sub(F.translate(t, "−∗", "-*"), r"\s+", " "))
    words = F.regexp_count(t, F.lit("[A-Za-z]{2,}"))
    hits = F.regexp_count(t, F.lit(pyre(r"\b(" + "|".join(PROSE_WORDS) + r")\b", True)))
    core = has(t, r"[=+\-*/]|\\[A-Za-z]+|[A-Za-z][_^]|[∼~≤≥≈]|[α-ωϕ]")
    prose = ((hits >= 1) & (words >= 5)) | ((F.length(t) > 220) & (words >= 14) & ~core)
    return F.when((t == "") | has(t, r"^\(?\d+\)?$"), False).otherwise(prose)


def is_formula_artifact(text: Column) -> Column:
    return has(compact(text), r"^[|{}zZ]*$")


def is_numeric_cell(value: Column) -> Column:
    v = strip(value)
    return v.isin("", "-", "—", "–") | has(v, r"^[<>≈~+\-]?\d+(?:\.\d+)?%?(?:\s*[kKmMbBhHsS])?$")


def is_complex_cell(value: Column) -> Column:
    out = F.lit(False)
    for token in ("\n", "|", "<", ">", "$$", "\\begin", "\\end"):
        out = out | F.contains(value, F.lit(token))
    return out


def numeric_tokens(text: Column) -> Column:
    parts = F.transform(F.split(strip(text), pyre(r"\s+")), lambda x: F.regexp_replace(x, r"^[,;:()\[\]]+|[,;:()\[\]]+$", ""))
    return F.size(F.filter(parts, lambda x: x.rlike(r"^[+\-]?\d+(?:\.\d+)?%?$")))


def is_flat_table_line(line: Column) -> Column:
    parts = F.filter(F.split(strip(line), pyre(r"\s+")), lambda x: x != "")
    n, numbers = F.size(parts), numeric_tokens(line)
    return (numbers >= 3) | ((n >= 6) & (numbers >= 1)) | ((n >= 8) & F.forall(parts, lambda x: F.length(x) <= 12))


def display_math_paired(text: Column) -> Column:
    """The text with one more ``$$`` if their number is odd."""
    return F.when(F.regexp_count(text, F.lit(r"\$\$")) % 2 == 1, F.concat(text, F.lit("\n$$"))).otherwise(text)


def strip_fence(text: Column) -> Column:
    """The inside of a fence that wraps the whole document."""
    inner = F.regexp_extract(strip(text), r"(?s)^```[A-Za-z]*\n(.*)\n```$", 1)
    return F.when(inner != "", inner).otherwise(text)
