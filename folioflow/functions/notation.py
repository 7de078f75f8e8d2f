"""Inline formulas, formula lines, and sections of generated text as Column expressions. Null texts stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import blocks as B
from folioflow.functions import text as T

#: Formulas as extracted text spells them and as they are written, in this order. What a group holds stands between the last two.
SPELLINGS = (
    (r"\bT\s*=\s*\{\(x,\s*y[tT]\)\}", r"$T = \{(x, y_t)\}$", ""),
    (r"\(x,\s*y[tT]\)", r"$(x, y_t)$", ""),
    (r"\bV\s*\(\s*G\s*,\s*D\s*\)", r"$V(G,D)$", ""),
    (r"\bD\s*\(\s*\[\s*x\s*,\s*y\s*\]\s*\)", r"$D([x,y])$", ""),
    (r"\bD\s*\(\s*G\s*\(\s*x\s*\)\s*\)", r"$D(G(x))$", ""),
    (r"\bG\s*\(\s*x\s*\)", r"$G(x)$", ""),
    (r"\bqG\s*\(\s*·\s*\|\s*x\s*\)", r"$q_G(\cdot\mid x)$", ""),
    (r"\byt\b", r"$y_t$", ""),
    (r"\by_t\b", r"$y_t$", ""),
    (r"\bβ\s*=\s*([0-9.]+)", r"$\beta = ", "$"),
    (r"\bσ\s*\(·\)", r"$\sigma(\cdot)$", ""),
)
#: Letters that are variables where they stand alone.
VARIABLES = (r"\b([GDT])\b", r"(?<![\w.-])([xy])(?![\w.-])")
#: What inline formulas are not looked for in, and what opens a part that is left alone.
KEPT = r"`[^`]*`|\$[^$]*\$|!\[[^\]]*\]\([^)]+\)"
KEPT_OPENING = r"^(?:`|\$|!\[)"
MARKER_LINE = "#" * 80
#: Headings of a summary.
SUMMARY_HEADING, FIELD_HEADING = "# 论文阅读摘要", "## 论文领域标签"
UNWANTED_SECTIONS = ("一句话概括", "可能的疑问与后续阅读建议")
FIELD_LINES = (("field", "领域"), ("subfield", "子领域"), ("terminology_notes", "关键词/术语提示"))
PROMPT_LINES = (("field", "领域"), ("subfield", "子领域"), ("terminology_notes", "术语注意事项"))
#: Where the noncharacters of Unicode begin, which stand for formulas while letters are looked for.
_MARK = 0xFDD0


def _written(part: Column) -> Column:
    end = chr(_MARK + len(SPELLINGS))
    for k, (spelling, _, close) in enumerate(SPELLINGS):
        part = T.sub(part, spelling, chr(_MARK + k) + (f"$1{end}" if close else ""))
    for letters in VARIABLES:
        part = T.sub(part, letters, r"\$$1\$")
    for k, (_, formula, close) in enumerate(SPELLINGS):
        part = F.replace(part, F.lit(chr(_MARK + k)), F.lit(formula))
        part = F.replace(part, F.lit(end), F.lit(close)) if close else part
    return part


def inline_math(text: Column) -> Column:
    """Formulas and variables of running text between dollar signs; code, formulas and images stay as they are."""
    parts, kept = F.split(text, T.pyre(KEPT)), F.regexp_extract_all(text, F.lit(T.pyre(KEPT)), F.lit(0))
    changed = F.transform(parts, lambda p: F.when(p.rlike(KEPT_OPENING), p).otherwise(_written(p)))
    whole = F.array_join(F.zip_with(changed, kept, lambda p, k: F.concat(p, F.coalesce(k, F.lit("")))), "")
    return F.regexp_replace(whole, r"\${2,}", r"\$")


def prepared(text: Column) -> Column:
    """A text as a model gets it: without citations, with inline formulas."""
    return inline_math(T.strip_inline_citations(text))


def element_markdown(text: Column, kind: Column, level: Column) -> Column:
    """A page element as Markdown: equations as displayed formulas, headings on one line."""
    body = prepared(T.strip(text))
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), T.strip(T.sub(body, r"\s+", " ")))
    return F.when(kind == "equation", F.concat(F.lit("$$\n"), body, F.lit("\n$$"))).when((kind != "caption_marker") & (level > 0), heading).otherwise(body)


def caption_marker(texts: Column, explanation: Column) -> Column:
    """A group's captions, and what explains them if that is known, between marker lines."""
    mark = F.array(F.lit(MARKER_LINE))
    return F.array_join(F.concat(mark, F.when(explanation != "", F.array(explanation)).otherwise(F.array().cast("array<string>")), texts, mark), "\n")


def spaced_formula_lines(text: Column) -> Column:
    """Formula lines without blanks around them; runs of them are set off from the text above and below by an empty line."""
    lines = T.lines(text)
    facts = F.transform(lines, lambda l: F.struct(l.alias("line"), B.is_formula_line(l).alias("formula"), (T.strip(l) != "").alias("full")))
    n, none = F.size(lines), F.array(F.struct(F.lit("").alias("line"), F.lit(False).alias("formula"), F.lit(False).alias("full")))
    before, after = F.slice(F.concat(none, facts), F.lit(1), n), F.concat(F.slice(facts, F.lit(2), n), none)

    def placed(row: Column) -> Column:
        fact = row["fact"]
        gap = lambda other: F.when(fact["formula"] & other["full"] & ~other["formula"], F.lit("\n")).otherwise(F.lit(""))
        return F.concat(gap(row["before"]), F.when(fact["formula"], T.strip(fact["line"])).otherwise(fact["line"]), gap(row["after"]))

    rows = F.arrays_zip(facts.alias("fact"), before.alias("before"), after.alias("after"))
    return F.array_join(F.transform(rows, placed), "\n")


def without_section(text: Column, heading: str) -> Column:
    """The text without the second-level sections of this heading."""
    return T.strip(T.sub(text, rf"(?ms)^##\s+\Q{heading}\E\s*$.*?(?=^##\s+|\z)", ""))


def summary(text: Column, context: Column) -> Column:
    """A summary without its unwanted sections, under its heading, with the paper's field; ``context`` is a struct."""
    for heading in UNWANTED_SECTIONS:
        text = without_section(text, heading)
    tags = F.concat(F.lit(f"{FIELD_HEADING}\n"), *(F.concat(F.lit(f"- {label}："), context[name], F.lit("\n")) for name, label in FIELD_LINES))
    opened = F.concat(F.lit(f"{SUMMARY_HEADING}\n\n"), tags)
    n = len(SUMMARY_HEADING)
    headed = F.concat(opened, F.substring(text, n + 1, 2**31 - 1))
    out = F.when(~text.startswith(SUMMARY_HEADING), F.concat(opened, F.lit("\n\n"), text)).when(F.contains(text, F.lit(FIELD_HEADING)), text).otherwise(headed)
    return F.concat(T.strip(out), F.lit("\n"))


def context_lines(context: Column) -> Column:
    """A field context as lines of a prompt."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}："), context[name]) for name, label in PROMPT_LINES))


def answer(response: Column, kind: str) -> Column:
    """The text in a provider's JSON response, ``chat`` or ``messages``; null where there is none."""
    if kind == "chat":
        return T.strip(F.get_json_object(response, "$.choices[0].message.content"))
    parts = F.from_json(response, "content array<struct<type:string,text:string>>")["content"]
    texts = F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) == "text")
    return F.nullif(T.strip(F.array_join(F.transform(texts, lambda p: F.coalesce(p["text"], F.lit(""))), "")), F.lit(""))
