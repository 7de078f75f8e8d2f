"""The registered queries of the document engine, each with its SQL where SQL can say it.

The tables hold no citations, captions or boxes, so queries decorate texts and make boxes from ids, the same way in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import blocks as B
from folioflow.functions import notation, tables
from folioflow.functions import text as T
from folioflow.operators import chunking, layout, pages, repair, structure
from folioflow.sources import library

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_CITED = "concat(replace(text, ' and ', concat(' [', cast(doc_id % 97 AS string), '; 3] and ')), ' [Abc', cast(20 + doc_id % 70 AS string), '] [v2] , end [3]')"
_CITED_SQL = _CITED.replace("AS string", "AS varchar")


@query(
    r"""
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(text, ' and ', concat('-', chr(10), 'and ')), chr(10), concat('  ', chr(10), chr(10), chr(10))),
  '-\n([a-z])', '\1', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', concat(chr(10), chr(10)), 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM documents)"""
)
def clean_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(r"replace(replace(text, ' and ', '-\nand '), '\n', '  \n\n\n')").alias("text"))
    t = T.clean_text(F.col("text"))
    return docs.select("doc_id", t.alias("t")).select("doc_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(
    rf"""
SELECT doc_id, length(s) - length(t) AS removed, md5(t) AS digest FROM (SELECT doc_id, s, regexp_replace(regexp_replace(regexp_replace(s,
  '\s*\[(?:[A-Za-z][A-Za-z0-9]*\+?\d{{2,4}}(?:\s*[,;]\s*[A-Za-z][A-Za-z0-9]*\+?\d{{2,4}})*|\d{{1,4}}(?:\s*[,;]\s*\d{{1,4}})*)\]', '', 'g'), ' {{2,}}', ' ', 'g'), ' +([,.;:，。；：])', '\1', 'g') AS t
  FROM (SELECT doc_id, {_CITED_SQL} AS s FROM documents))"""
)
def strip_citations_strict(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CITED).alias("s"))
    rows = docs.withColumn("t", T.strip_inline_citations(F.col("s")))
    return rows.select("doc_id", (F.length("s") - F.length("t")).alias("removed"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(
    rf"""
SELECT doc_id, length(s) - length(t) AS removed, md5(t) AS digest FROM (SELECT doc_id, s, regexp_replace(s,
  '\s*\[(?:[A-Za-z0-9][A-Za-z0-9+.\-]*(?:\s*[,;]\s*[A-Za-z0-9][A-Za-z0-9+.\-]*)+|[A-Za-z0-9][A-Za-z0-9+.\-]*[0-9+][A-Za-z0-9+.\-]*|[A-Za-z0-9][0-9+])\]', '', 'g') AS t
  FROM (SELECT doc_id, {_CITED_SQL} AS s FROM documents))"""
)
def strip_citations_broad(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CITED).alias("s"))
    rows = docs.withColumn("t", T.strip_reference_citations(F.col("s")))
    return rows.select("doc_id", (F.length("s") - F.length("t")).alias("removed"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("SELECT tag AS type, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<(h1|h2|p|li|nav|footer|script|style)[ >]', 1)) AS tag FROM pages) GROUP BY tag")
def block_counts(spark, sf_dir):
    tags = F.regexp_extract_all("html", F.lit("<(h1|h2|p|li|nav|footer|script|style)[ >]"), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.explode(tags).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


#: Every line of every text, numbered.
_LINES_SQL = "(SELECT doc_id, i AS line_no, l AS text FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda l, i: struct_pack(l := l, i := i)), recursive := true) FROM documents))"


def lines(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.withColumn("line_no", (F.col("line_no") + 1).cast("long"))


_LINE = "concat(CASE (doc_id + line_no) % 8 WHEN 0 THEN '2.1 Alpha ' WHEN 1 THEN '3 Beta ' WHEN 2 THEN 'Results ' WHEN 3 THEN 'Figure 4: ' WHEN 4 THEN 'table A2 ' WHEN 5 THEN 'Table 12. ' WHEN 6 THEN 'fig. 7b ' ELSE '' END, text)"


@query(
    rf"""
SELECT doc_id, line_no, CASE WHEN t <> '' AND length(t) <= 160 AND NOT regexp_matches(t, '^(?i:fig(?:ure)?\.?|table|algorithm)\s*\d+')
  AND NOT (regexp_matches(t, '[.!?]\s*$') AND NOT regexp_matches(t, '^\d+(\.\d+)*\s+\S+'))
  AND (regexp_matches(t, '^\d+(\.\d+)*\s+[A-Z][A-Za-z0-9 /,&()\-]+') OR regexp_matches(t, '^(?i:abstract|introduction|background|related work|method|methods|model|algorithm|experiment|experiments|results|discussion|conclusion|appendix)\b')
       OR (doc_id + line_no) % 7 = 0 OR 10 + ((doc_id + line_no) % 3) * 0.5 >= 10.9)
  THEN CASE WHEN regexp_matches(t, '^\d+\.\d+') THEN 3 ELSE 2 END END AS level
FROM (SELECT doc_id, line_no, regexp_replace({_LINE}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS t FROM {_LINES_SQL})"""
)
def heading_levels(spark, sf_dir):
    rows, n = lines(spark, sf_dir).select("doc_id", "line_no", F.expr(_LINE).alias("t")), F.col("doc_id") + F.col("line_no")
    return rows.select("doc_id", "line_no", T.heading_level(F.col("t"), 10 + (n % 3) * F.lit(0.5), n % 7 == 0, F.lit(9.9)).alias("level"))


@query(
    rf"""
SELECT doc_id, line_no, CASE WHEN k LIKE 'fig%' THEN 'figure' WHEN k LIKE 'table%' THEN 'table' WHEN k <> '' THEN 'algorithm' END AS kind,
  coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(t, '^(?i:fig(?:ure)?\.?|table|algorithm)\s*([A-Za-z0-9][A-Za-z0-9_.\-]*)', 1), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), cast(line_no AS varchar)) AS number
FROM (SELECT doc_id, line_no, t, lower(regexp_extract(t, '^((?i:fig(?:ure)?\.?|table|algorithm))\s*\d+', 1)) AS k
  FROM (SELECT doc_id, line_no, regexp_replace({_LINE}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS t FROM {_LINES_SQL}))"""
)
def caption_kind(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.expr(_LINE).alias("t"))
    return rows.select("doc_id", "line_no", T.caption_kind(F.col("t")).alias("kind"), T.caption_number(F.col("t"), F.col("line_no")).alias("number"))


_FOOT = "CASE (doc_id + line_no) % 6 WHEN 0 THEN cast(line_no AS string) WHEN 1 THEN concat('arXiv:', text) WHEN 2 THEN concat('1 see https://x.org ', text) WHEN 3 THEN concat('Proceedings of ', text) ELSE text END"


@query(
    rf"""
SELECT doc_id, line_no, y0 FROM (SELECT doc_id, line_no, ((doc_id + line_no) * 37) % 800 AS y0, 8.0 + (doc_id + line_no) % 3 AS size, regexp_replace({_FOOT.replace("string", "varchar")}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS t FROM {_LINES_SQL})
WHERE NOT (t = '' OR (regexp_matches(t, '^\d+$') AND y0 > 704)
  OR (y0 > 656 AND regexp_matches(t, '(?i)(Proceedings|Conference on|arXiv|Equal contribution|Contact person|Corresponding author|Project Page|Code:|https?://)'))
  OR (size <= 9.2 AND y0 > 672 AND (regexp_matches(t, '^\d+\s+') OR contains(t, 'http://') OR contains(t, 'https://'))) OR contains(t, 'arXiv:') OR regexp_matches(t, '^[∗*]Equal contribution'))"""
)
def noise_filter(spark, sf_dir):
    n = F.col("doc_id") + F.col("line_no")
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.expr(_FOOT).alias("t"), ((n * 37) % 800).alias("y0"), (8.0 + n % 3).alias("size"))
    return rows.where(~T.is_noise(F.col("t"), F.col("y0"), F.lit(800.0), F.col("size"))).select("doc_id", "line_no", "y0")


_FORMULA = "CASE (doc_id + line_no) % 7 WHEN 0 THEN concat('(', cast(doc_id AS string), ')') WHEN 1 THEN '3.14' WHEN 2 THEN 'x' WHEN 3 THEN concat('y_i = a + b * ', text) WHEN 4 THEN 'zz||' WHEN 5 THEN concat('p(x) ≤ q(x)', text) ELSE text END"


@query(
    rf"""
SELECT doc_id, line_no, CASE WHEN c = '' OR regexp_matches(c, '^\(\d+\)$') THEN 0 WHEN regexp_matches(c, '^\d+(?:\.\d+)?$') THEN 1 WHEN regexp_matches(c, '^[A-Za-zα-ωΑ-Ωϕφπβθτσµ]$') THEN 2
  WHEN NOT regexp_matches(c, '[=≈≤≥<>]|\\[A-Za-z]+|[A-Za-z][_^{{]') AND n < 2 THEN length(c) // 4 ELSE length(c) + n * 4 END AS score, regexp_matches(c, '^[|{{}}zZ]*$') AS artifact
FROM (SELECT doc_id, line_no, c, length(c) - length(translate(c, '=+-*/_\^{{}}()[]|<>∑∫√≈≠≤≥πβθφτσµ', '')) AS n FROM (SELECT doc_id, line_no, regexp_replace({_FORMULA.replace("string", "varchar")}, '[\s\p{{Z}}]+', '', 'g') AS c FROM {_LINES_SQL}))"""
)
def formula_score(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.expr(_FORMULA).alias("t"))
    return rows.select("doc_id", "line_no", T.formula_score(F.col("t")).alias("score"), T.is_formula_artifact(F.col("t")).alias("artifact"))


@query(
    rf"""
SELECT doc_id, line_no, t <> '' AND length(t) <= 260 AND (regexp_matches(t, '{B.OPERATOR_LINE}')
  OR (length(t) - length(translate(t, '{B.LINE_SYMBOLS}', '')) >= 2 AND length(t) > length(translate(t, '{B.LINE_RELATIONS}', '')))) AS formula
FROM (SELECT doc_id, line_no, regexp_replace({_FORMULA.replace("string", "varchar")}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS t FROM {_LINES_SQL})"""
)
def formula_lines(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.expr(_FORMULA).alias("t"))
    return rows.select("doc_id", "line_no", B.is_formula_line(F.col("t")).alias("formula"))


@query(
    r"""
WITH l AS (SELECT doc_id, lang, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda l: regexp_replace(l, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda l: l <> '') AS v FROM documents),
h AS (SELECT *, list_position(list_transform(v[1:8], lambda l: length(l) BETWEEN 4 AND 90 AND NOT regexp_matches(l, '^(?i:abstract|introduction)\b') AND NOT regexp_matches(l, '[@{},\d]|https?://')), false) AS stop FROM l)
SELECT doc_id, CASE WHEN len(o) > 0 THEN substr(array_to_string(o, ' '), 1, 160) ELSE coalesce(list_filter(v[1:12], lambda l: length(l) BETWEEN 8 AND 180)[1], lang) END AS title
FROM (SELECT *, CASE WHEN stop > 0 THEN v[1:least(8, stop - 1)] ELSE v[1:8] END AS o FROM h)"""
)
def titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", B.title(F.lit(""), F.col("text"), F.col("lang")).alias("title"))


#: Texts as pages of 40 lines, blocks of three; each line has a raised mark and every third a second part.
_SPANS = """explode(array(struct(0 AS span_no, text, 9.0D + n % 4 AS size, if(n % 5 = 0, 'Serif-Bold', 'Serif') AS font),
  struct(1 AS span_no, '†' AS text, 5.0D AS size, 'Serif' AS font), struct(2 AS span_no, if(line_no % 3 = 0, ' end', '') AS text, 9.0D AS size, 'Serif' AS font))) AS s"""


def spans(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("n", F.col("doc_id") + F.col("line_no"))
    rows = rows.selectExpr("doc_id AS paper_id", "(line_no - 1) div 40 AS page_no", "((line_no - 1) % 40) div 3 AS block_no", "line_no", "n", _SPANS)
    return rows.selectExpr("paper_id", "page_no", "block_no", "line_no", "s.*", "40.0D + n % 3 * 40 AS x0", "(line_no - 1) % 40 * 19.0D AS y0", "400.0D + n % 2 * 150 AS x1", "(line_no - 1) % 40 * 19.0D + 12 AS y1")


@query(
    rf"""
WITH l AS (SELECT doc_id AS paper_id, line_no, (line_no - 1) // 40 AS page_no, ((line_no - 1) % 40) // 3 AS block_no, 9.0 + (doc_id + line_no) % 4 AS size, (doc_id + line_no) % 5 = 0 AS bold, (line_no - 1) % 40 * 19.0 AS y0,
  regexp_replace(concat(text, CASE WHEN line_no % 3 = 0 THEN ' end' ELSE '' END), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS t FROM {_LINES_SQL}),
b AS (SELECT paper_id, page_no, block_no, coalesce(string_agg(t, chr(10) ORDER BY line_no) FILTER (t <> ''), '') AS t, max(size) AS size, bool_or(bold) AS bold, min(y0) AS y0 FROM l GROUP BY ALL),
p AS (SELECT paper_id, page_no, list_sort(list(size)) AS v FROM b GROUP BY ALL)
SELECT paper_id, page_no, block_no, size::double AS size, bold, y0::double AS y0, v[len(v) // 2 + 1]::double AS page_size, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  t, '-\n([a-z])', '\1', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', concat(chr(10), chr(10)), 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS digest FROM b JOIN p USING (paper_id, page_no)"""
)
def text_blocks(spark, sf_dir):
    return pages.text_blocks(spans(spark, sf_dir)).select("paper_id", "page_no", "block_no", "size", "bold", "y0", "page_size", F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def page_elements(spark, sf_dir):
    rows = pages.elements(pages.text_blocks(spans(spark, sf_dir)), F.lit(600.0), F.lit(800.0))
    kept = pages.equation_ids(pages.without_front_matter(rows, F.lit(800.0)))
    return kept.select("paper_id", "page_no", "block_no", "kind", "heading_level", "caption_kind", "id")


#: Captions among the elements, and three drawings a page.
_CAPTIONED = "CASE block_no % 5 WHEN 2 THEN concat('Figure ', paper_id, ': ', left(text, 40)) WHEN 4 THEN concat('Table: ', left(text, 40)) ELSE text END"


@query()
def structured_blocks(spark, sf_dir):
    found = pages.text_blocks(spans(spark, sf_dir)).withColumn("text", F.expr(_CAPTIONED))
    rows = pages.elements(found, F.lit(600.0), F.lit(800.0)).withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    drawn = rows.select("paper_id", "page_no").distinct().select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("insert_no"))
    drawn = drawn.selectExpr("paper_id", "page_no", "insert_no", "if(insert_no = 3, 'image', 'drawing') AS kind", "100.0D AS x0", "insert_no * 200.0D AS y0", "400.0D AS x1", "insert_no * 200.0D + 60 AS y1")
    blocks = structure.structured_blocks(rows, drawn)
    return blocks.select("paper_id", "page_no", "seq", "type", "level", "id", "path", F.size("rows").alias("n_rows"), F.md5(F.coalesce("text", "raw_text", "caption").cast("binary")).alias("digest"))


_NOTED = "concat('D(G(x)) of ', replace(replace(text, ' and ', ' yt, x and '), '$', ''), ' β = 0.', cast(doc_id % 10 AS string), ' for G')"


@query(
    rf"""
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  s, '(^|{{n}})D\(G\(x\)\)', '\1' || chr(1), 'g'), '(^|{{n}})yt($|{{n}})', '\1' || chr(2) || '\2', 'g'), '(^|{{n}})β = ([0-9.]+)', '\1' || chr(3) || ' = \2$', 'g'),
  '(^|{{n}})([GDT])($|{{n}})', '\1$\2$\3', 'g'), '(^|{{n}})([GDT])($|{{n}})', '\1$\2$\3', 'g'), '(^|{{v}})([xy])($|{{v}})', '\1$\2$\3', 'g'), '(^|{{v}})([xy])($|{{v}})', '\1$\2$\3', 'g'),
  chr(1), '$D(G(x))$'), chr(2), '$y_t$'), chr(3), '$\beta'), '[$]{{{{2,}}}}', '$', 'g') AS t
FROM (SELECT doc_id, replace(replace({_NOTED.replace("string", "varchar")}, '`', ''), '![', '') AS s FROM documents))""".replace("{n}", r"[^\p{L}\p{N}_]").replace("{v}", r"[^\p{L}\p{N}_.\-]").replace("{{", "{").replace("}}", "}")
)
def inline_math(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace(F.expr(_NOTED), F.lit("`"), F.lit("")), F.lit("!["), F.lit("")).alias("s"))
    rows = docs.select("doc_id", notation.inline_math(F.col("s")).alias("t"))
    return rows.select("doc_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE nullif(trim(concat(text, ' ', role)), '') END AS answer, CASE WHEN role = 'system' THEN NULL ELSE trim(concat(text, role)) END AS message FROM conversations"""
)
def provider_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    known, text = F.col("role") != "system", F.concat("text", F.lit(" "), "role")
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    messages = F.to_json(F.struct(F.array(part("text", F.col("text")), part("tool", F.lit("no")), part(None, F.col("role"))).alias("content")))
    return rows.select("conv_id", "turn", notation.answer(F.when(known, chat), "chat").alias("answer"), notation.answer(F.when(known, messages), "messages").alias("message"))


@query(
    r"""SELECT doc_id, md5(concat('# 论文阅读摘要', chr(10), chr(10), '## 论文领域标签', chr(10), '- 领域：', lang, chr(10), '- 子领域：', source, chr(10), '- 关键词/术语提示：none', chr(10), chr(10), chr(10),
  regexp_replace(concat('## Kept', chr(10), text), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), chr(10))) AS digest FROM documents"""
)
def summaries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.col("lang").alias("field"), F.col("source").alias("subfield"), F.lit("none").alias("terminology_notes")).alias("c"), F.expr(r"concat('## 一句话概括\n', replace(text, '\n#', '\n'), '\n## Kept\n', text)").alias("s"))
    return docs.select("doc_id", F.md5(notation.summary(F.col("s"), F.col("c")).cast("binary")).alias("digest"))


@query(
    """SELECT o_custkey, c[1][1] AS first, len(c) - 1 AS n_rows, array_to_string(c[len(c)], '/') AS last FROM (SELECT o_custkey, list([o_orderstatus, o_orderpriority, concat(cast(o_orderkey AS varchar), CASE WHEN o_orderkey % 3 = 0 THEN ' more' ELSE '' END)] ORDER BY o_orderkey) AS c
FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 3 <> 0) >= 2 AND count(*) FILTER (o_orderkey % 3 <> 0) > count(*) FILTER (o_orderkey % 3 = 0))"""
)
def raw_table_rows(spark, sf_dir):
    line = F.concat(F.lit("<tr><td>"), "o_orderstatus", F.lit("</td> | "), "o_orderpriority", F.lit(" |  "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "| more").otherwise(""))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))).alias("v"), F.count_if(F.col("o_orderkey") % 3 != 0).alias("n"), F.count(F.lit(1)).alias("all"))  # a customer's orders
    rows = rows.where("n >= 2 AND 2 * n > all").select("o_custkey", tables.raw_rows(F.array_join(F.transform("v", lambda x: x["l"]), "\n")).alias("t"))
    return rows.select("o_custkey", F.get("t.columns", F.lit(0)).alias("first"), F.size("t.rows").cast("long").alias("n_rows"), F.array_join(F.element_at(F.concat(F.array("t.columns"), "t.rows"), -1), "/").alias("last"))


@query(
    """WITH w AS (SELECT conv_id, turn, role, text, string_split(text, ' ') AS v FROM conversations)
SELECT conv_id, turn, length(text) + length(role) + 2 * list_sum(list_transform(v, lambda x: length(x)))::bigint AS n_source, length(text) + length(role) + 2 * (length(to_json(v)::varchar) + len(v) - 1) + 2 AS n_rendered FROM w"""
)
def block_lengths(spark, sf_dir):
    words, none = F.split("text", " "), F.lit(None).cast("string")
    block = F.struct("text", none.alias("content"), none.alias("raw_text"), none.alias("latex"), F.col("role").alias("caption"), words.alias("columns"), F.array(words).alias("rows"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", block.alias("b"))
    return rows.select("conv_id", "turn", B.source_length(F.col("b")).cast("long").alias("n_source"), B.rendered_length(F.col("b")).cast("long").alias("n_rendered"))


@query("SELECT l_orderkey, v[len(v) // 2 + 1] AS median FROM (SELECT l_orderkey, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY l_orderkey)")
def upper_median_font(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))  # a page's lines
    return rows.select("l_orderkey", layout.upper_median(F.col("v")).alias("median"))


_BOX = {"paper_id": "l_orderkey % 50", "page_no": "l_orderkey", "insert_no": "l_linenumber", "x0": "l_linenumber * 40.25", "y0": "(l_orderkey * 37 + l_linenumber * 11) % 97 * 8.0", "x1": "l_linenumber * 40.25 + 20 + l_quantity", "y1": "(l_orderkey * 37 + l_linenumber * 11) % 97 * 8.0 + 10"}
_BOXES_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _BOX.items()) + ", l_partkey FROM lineitem)"


def boxes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*(F.expr(e).cast("double" if c in ("x0", "y0", "x1", "y1") else "long").alias(c) for c, e in _BOX.items()), "l_partkey")


@query(f"SELECT paper_id, page_no, insert_no, row_number() OVER (PARTITION BY paper_id, page_no ORDER BY floor(y0 / 8), round_even(x0, 1), insert_no) AS read_no FROM {_BOXES_SQL}")
def reading_order(spark, sf_dir):
    return layout.reading_order(boxes(spark, sf_dir)).select("paper_id", "page_no", "insert_no", "read_no")


@query(f"SELECT paper_id, page_no, min(x0)::double AS x0, min(y0)::double AS y0, max(x1)::double AS x1, max(y1)::double AS y1 FROM {_BOXES_SQL} GROUP BY paper_id, page_no")
def bbox_union(spark, sf_dir):
    return layout.bounding_boxes(boxes(spark, sf_dir), ["paper_id", "page_no"])


@query(
    f"""SELECT c.page_no, c.insert_no AS caption, b.insert_no AS block FROM {_BOXES_SQL} c JOIN {_BOXES_SQL} b ON c.paper_id = b.paper_id AND c.page_no = b.page_no
WHERE c.insert_no = 1 AND b.insert_no > 1 AND ((b.y1 <= c.y0 AND c.y0 - b.y0 <= 170) OR (b.y0 >= c.y1 AND b.y0 - c.y1 <= 120)) AND greatest(0, least(b.x1, c.x1) - greatest(b.x0, c.x0)) / greatest(b.x1 - b.x0, 1) > 0.18"""
)
def caption_range_join(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    pairs = layout.captions_with_body(rows.where("insert_no = 1"), rows.where("insert_no > 1"))
    return pairs.select(F.col("c.page_no"), F.col("c.insert_no").alias("caption"), F.col("b.insert_no").alias("block"))


@query(
    f"""SELECT page_no, insert_no, number_no, distance FROM (SELECT l.page_no, l.insert_no, r.insert_no AS number_no, abs((l.y0 + l.y1) / 2 - (r.y0 + r.y1) / 2)::double AS distance,
  row_number() OVER (PARTITION BY l.paper_id, l.page_no, l.insert_no ORDER BY abs((l.y0 + l.y1) / 2 - (r.y0 + r.y1) / 2), r.insert_no) AS nth
  FROM {_BOXES_SQL} l JOIN {_BOXES_SQL} r ON l.paper_id = r.paper_id AND l.page_no = r.page_no WHERE l.insert_no % 2 = 0 AND r.insert_no % 2 = 1 AND abs((l.y0 + l.y1) / 2 - (r.y0 + r.y1) / 2) <= 200) WHERE nth = 1"""
)
def nearest_number(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    found = layout.nearest(rows.where("insert_no % 2 = 0"), rows.where("insert_no % 2 = 1"), limit=200.0)
    return found.select("l.page_no", "l.insert_no", F.col("r.insert_no").alias("number_no"), "distance")


#: Crops reach beyond their box, so that they cover neighbours.
_CROP = {"x0": "x0 - 60", "y0": "y0 - 100", "x1": "x1 + 60", "y1": "y1 + 100"}
_COVER = f"""(SELECT paper_id, page_no, insert_no, {", ".join(f"{e} AS {c}" for c, e in _CROP.items())} FROM {_BOXES_SQL}) c WHERE c.insert_no = 2 AND c.paper_id = b.paper_id AND c.page_no = b.page_no AND least(b.x1, c.x1) > greatest(b.x0, c.x0) AND least(b.y1, c.y1) > greatest(b.y0, c.y0)
  AND (least(b.x1, c.x1) - greatest(b.x0, c.x0)) * (least(b.y1, c.y1) - greatest(b.y0, c.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) > 0.1"""


def crops(spark, sf_dir) -> DataFrame:
    return boxes(spark, sf_dir).where("insert_no = 2").selectExpr("paper_id", "page_no", "insert_no", *(f"{e} AS {c}" for c, e in _CROP.items()))


@query(f"SELECT page_no, insert_no FROM {_BOXES_SQL} b WHERE insert_no <> 2 AND EXISTS (SELECT 1 FROM {_COVER})")
def skip_semi(spark, sf_dir):
    return layout.inside(boxes(spark, sf_dir).where("insert_no <> 2"), crops(spark, sf_dir), 0.1).select("page_no", "insert_no")


@query(f"SELECT page_no, insert_no FROM {_BOXES_SQL} b WHERE insert_no <> 2 AND NOT EXISTS (SELECT 1 FROM {_COVER})")
def skip_anti(spark, sf_dir):
    return layout.outside(boxes(spark, sf_dir).where("insert_no <> 2"), crops(spark, sf_dir), 0.1).select("page_no", "insert_no")


@query(
    """SELECT user_id, event_id, group_no FROM (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY event_id) AS group_no FROM (SELECT user_id, event_id,
  CASE WHEN number = lag(number) OVER w + 1 AND top - lag(bottom) OVER w <= 26 THEN 0 ELSE 1 END AS starts FROM (SELECT user_id, event_id, event_id % 5 AS number, event_id * 0.5 AS top, event_id * 0.5 + 3 AS bottom FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id)))"""
)
def equation_islands(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_id % 5 AS number", "event_id * 0.5 AS top", "event_id * 0.5 + 3 AS bottom")
    return layout.islands(rows, "number", ["user_id"], ["event_id"], "top", "bottom").select("user_id", "event_id", "group_no")


@query()  # SQL has no form of cutting long lines at sentence ends
def pack_blocks(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda l: l != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    long = F.coalesce(F.exists("lines", lambda l: F.length(l) > 2700), F.lit(False))
    short = docs.where(~long).select("doc_id", F.transform("lines", lambda l: F.length(l) + 40).alias("v"))
    blocks = docs.where(long).select("doc_id", F.posexplode("lines").alias("seq", "text"), F.lit("paragraph").alias("type"))
    pieces = chunking.split_blocks(blocks, 2700).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece", F.length("text").alias("n")))).alias("p"))  # a document's lines
    docs = short.union(pieces.select("doc_id", F.transform("p", lambda p: p["n"] + 40)))
    docs = docs.withColumn("c", chunking.packed(F.col("v"), 3500))
    sizes = docs.select("doc_id", F.explode_outer(F.arrays_zip("v", "c")).alias("z")).groupBy("doc_id", "z.c").agg(F.count("z.v").alias("n"), (F.sum(F.col("z.v") + 4) + 2).alias("size"))
    return sizes.groupBy("doc_id").agg(F.sum("n").alias("n_blocks"), F.count("c").alias("n_chunks"), F.coalesce(F.max("size"), F.lit(0)).alias("max_chars"))


@query(
    r"""
WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS v FROM documents),
b AS (SELECT doc_id, list_transform(v, lambda x, i: struct_pack(seq := i, required := (length(x) + i) % 5 = 0, n := least(length(x), 1402))) AS v FROM l),
r AS (SELECT doc_id, list_filter(v, lambda x: NOT x.required) AS v, (2 + coalesce(list_sum(list_transform(list_filter(v, lambda x: x.required), lambda x: x.n + 4)), 0))::bigint AS need, len(list_filter(v, lambda x: x.required)) AS k FROM b),
f(doc_id, i, size, taken) AS (SELECT doc_id, 0, need, k::bigint FROM r UNION ALL SELECT f.doc_id, i + 1, CASE WHEN size + v[i + 1].n + 4 <= 2000 THEN size + v[i + 1].n + 4 ELSE size END, CASE WHEN size + v[i + 1].n + 4 <= 2000 THEN taken + 1 ELSE taken END
  FROM f JOIN r ON f.doc_id = r.doc_id WHERE i < len(v))
SELECT doc_id, max(taken) AS n_taken FROM f GROUP BY doc_id"""
)
def budget_select(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda l: l != "")
    block = lambda l, i: F.struct((i + 1).alias("seq"), ((F.length(l) + i + 1) % 5 == 0).alias("required"), F.least(F.length(l), F.lit(1402)).alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(lines, block).alias("b"))
    return docs.select("doc_id", F.size(chunking.within_budget(F.col("b"), 2000)).cast("long").alias("n_taken"))


_RETRY = " OR ".join(f"contains(o, '{m}')" for m in chunking.CUT_MARKERS)


@query(
    f"""SELECT conv_id, turn, depth, (depth < 6 AND n >= 900 AND (({_RETRY}) OR (kind AND length(trim(o)) < n * CASE WHEN n < 5000 THEN 0.42 ELSE 0.34 END))) AS retry FROM
(SELECT conv_id, turn, turn % 8 AS depth, length(text) * 5 AS n, role <> 'system' AS kind, CASE conv_id % 3 WHEN 0 THEN concat(text, ' (continued)') WHEN 1 THEN concat(text, text, text) ELSE text END AS o FROM conversations)"""
)
def split_retry_predicate(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "turn % 8 AS depth", "length(text) * 5 AS n", "role <> 'system' AS kind", "CASE conv_id % 3 WHEN 0 THEN concat(text, ' (continued)') WHEN 1 THEN concat(text, text, text) ELSE text END AS o")
    return rows.select("conv_id", "turn", "depth", chunking.needs_retry(F.col("n"), F.col("kind"), F.col("o"), F.col("depth")).alias("retry"))


@query(
    r"""SELECT doc_id, length(CASE WHEN length(text) >= 600 AND length(regexp_replace(o, '\s+', '', 'g')) < length(regexp_replace(text, '\s+', '', 'g')) * 0.25 THEN concat_ws(chr(10) || chr(10), nullif(o, ''), text) ELSE o END) AS n
FROM (SELECT doc_id, text, substr(text, 1, (length(text) * (doc_id % 10)) // 12) AS o FROM documents)"""
)
def coverage_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("o", F.expr("substr(text, 1, cast((length(text) * (doc_id % 10)) div 12 AS int))"))
    return rows.select("doc_id", F.length(repair.covered(F.col("text"), F.col("o"))).alias("n"))


@query(
    r"""WITH m AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Z][a-z]+', 0), lambda w, i: struct_pack(k := i, w := w))) AS s FROM documents),
e AS (SELECT l_orderkey AS doc_id, l_partkey AS eq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
SELECT m.doc_id, m.s.k AS k, m.s.w AS markup, e.eq FROM m JOIN e ON m.doc_id = e.doc_id AND m.s.k = e.k"""
)
def positional_join(spark, sf_dir):
    marks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("k", "markup")).withColumn("k", (F.col("k") + 1).cast("long"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    eq = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("eq"), F.row_number().over(order).cast("long").alias("k"))
    return marks.join(eq, ["doc_id", "k"])


@query(
    """WITH a AS (SELECT item_id % 30 AS number, max(item_id) AS item_id FROM benchmark GROUP BY 1), p AS (SELECT length(text) AS path, max(item_id) AS item_id FROM benchmark GROUP BY 1)
SELECT d.doc_id, coalesce(a.item_id, p.item_id) AS item_id FROM documents d LEFT JOIN a ON d.doc_id % 60 = a.number LEFT JOIN p ON d.n_chars % 400 = p.path"""
)
def link_lookup_fallback(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    a = items.groupBy((F.col("item_id") % 30).alias("number")).agg(F.max("item_id").alias("by_number"))
    p = items.groupBy(F.length("text").alias("path")).agg(F.max("item_id").alias("by_path"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 60).alias("number"), (F.col("n_chars") % 400).alias("path"))
    return docs.join(a, "number", "left").join(p, "path", "left").select("doc_id", F.coalesce("by_number", "by_path").alias("item_id"))


@query("SELECT d.doc_id, coalesce('cached ' || l.quality, concat('computed ', d.n_chars % 7)) AS field FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def cache_miss(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    cache = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("cached "), F.col("quality").cast("string")).alias("field"))
    return library.with_cache(docs, cache, "doc_id", lambda rows: rows.select("doc_id", F.concat(F.lit("computed "), (F.col("n_chars") % 7).cast("string")).alias("field")))


@query(
    """SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS system, count(*) FILTER (role <> 'system') AS n_messages,
  coalesce(string_agg(CASE role WHEN 'assistant' THEN 'a' ELSE 'u' END, '' ORDER BY turn) FILTER (role <> 'system'), 'u') AS roles FROM conversations GROUP BY conv_id"""
)
def chat_system_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))  # a conversation's turns
    system, others = F.filter("m", lambda x: x["role"] == "system"), F.filter("m", lambda x: x["role"] != "system")
    roles = F.array_join(F.transform(others, lambda x: F.when(x["role"] == "assistant", "a").otherwise("u")), "")
    return rows.select("conv_id", F.array_join(F.transform(system, lambda x: x["text"]), "\n\n").alias("system"), F.size(others).cast("long").alias("n_messages"), F.coalesce(F.nullif(roles, F.lit("")), F.lit("u")).alias("roles"))


@query(
    r"""WITH r AS (SELECT doc_id, i, len(list_filter(list_transform(string_split(l, '|'), lambda c: trim(c)), lambda c: c <> '')) AS width FROM
  (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda l, i: struct_pack(l := l, i := i)), recursive := true) FROM documents) WHERE contains(l, '|')),
c AS (SELECT doc_id, width, count(*) AS n, min(i) AS first FROM r WHERE width >= 2 GROUP BY doc_id, width)
SELECT doc_id, width FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM c) WHERE k = 1 AND n >= 2"""
)
def table_width_mode(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).where("contains(l, '|')")
    rows = rows.withColumn("width", F.size(tables.cells(F.col("l"))).cast("long")).where("width >= 2").groupBy("doc_id", "width").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1 AND n >= 2").select("doc_id", "width")


@query()
def table_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("contains(text, '|')").select("doc_id", tables.parsed(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t.columns").alias("n_columns"), F.size("t.rows").alias("n_rows"), F.length(tables.to_markdown(F.col("t.columns"), F.col("t.rows"))).alias("n_chars"))


@query(
    """SELECT p_brand, concat('| part | size | price |', chr(10), '| --- | ---: | ---: |', chr(10), string_agg(concat('| ', p_name, ' | ', p_size, ' | ', cast(round(p_retailprice) AS bigint), ' |'), chr(10) ORDER BY p_partkey)) AS md
FROM (SELECT * REPLACE (trim(replace(p_name, '|', '/')) AS p_name) FROM part) GROUP BY p_brand"""
)
def render_table_md(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.array(F.trim(F.replace("p_name", F.lit("|"), F.lit("/"))), F.col("p_size").cast("string"), F.round("p_retailprice").cast("long").cast("string")).alias("cells"))
    rows = part.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "cells"))).alias("r")).select("p_brand", F.col("r.cells").alias("rows"))  # one table's rows
    return rows.select("p_brand", tables.to_markdown(F.array(F.lit("part"), F.lit("size"), F.lit("price")), F.col("rows")).alias("md"))


@query("""SELECT doc_id, len(found) AS n_found, n - len(found) AS n_missing, found FROM (SELECT doc_id, (SELECT count(*) FROM benchmark WHERE text IS NOT NULL) AS n,
  coalesce((SELECT list(item_id ORDER BY item_id) FROM benchmark b WHERE contains(d.text, b.text)), []) AS found FROM documents d)""")
def missing_structures(spark, sf_dir):
    return repair.structures_found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", F.size("found").cast("long").alias("n_found"), F.col("n_missing").cast("long").alias("n_missing"), "found")


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(lang), 'src1') OR contains(lower(text), 'src1')")
def library_search(spark, sf_dir):
    return library.matching(table(spark, sf_dir, "documents"), ["source", "lang", "text"], F.lit(" SRC1 ")).select("doc_id")


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'untitled-paper') AS name FROM pages""")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("SELECT page_id, substr(sha1(concat_ws('|', url, cast(length(html) AS varchar), cast(page_id * 1000 AS varchar))), 1, 16) AS key FROM pages")
def path_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", library.cache_key(F.col("url"), F.length("html"), F.col("page_id") * 1000).alias("key"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 80")
def recent_log_topk(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(80).select("event_id", "event_type")


_TAGS = "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}>" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li"))


@query(f"SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s){_TAGS}', 0)) FROM pages) GROUP BY page_id")
def page_blocks(spark, sf_dir):
    return library.html_blocks(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


_BLOCKS = """array(named_struct('type', 'equation', 'id', 'equation_1', 'latex', 'a = b', 'caption', '', 'path', '', 'columns', array(''), 'rows', array(array(''))),
  named_struct('type', 'table', 'id', 'table_2', 'latex', '', 'caption', 'Sizes', 'path', '', 'columns', array('k', 'v'), 'rows', array(array('a', '1'), array('b', '2'))),
  named_struct('type', 'figure', 'id', 'figure_3', 'latex', '', 'caption', 'Plot', 'path', 'figures/3.png', 'columns', array(''), 'rows', array(array(''))))"""


@query()
def sanitize_markdown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(r"concat('```markdown\nHere is the text.\n\n', text, ' [12; 3]\n\n![e](equations/equation_1.png)\n```')").alias("text"), F.expr(_BLOCKS).alias("blocks"))
    rows = repair.sanitized(docs)
    return rows.select("doc_id", F.length("markdown").alias("n"), F.contains("markdown", F.lit("[12; 3]")).alias("cited"), F.contains("markdown", F.lit("$$\na = b\n$$")).alias("formula"), F.contains("markdown", F.lit("| a | 1 |")).alias("tabled"))


@query()
def latex_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(r"concat('θ ≤ ', text, ' × σ\n(', doc_id, ')')").alias("raw"))
    rows = repair.latex_of(docs, "raw")
    return repair.plain_of(rows, "latex").select("doc_id", "latex", "plain")


@query()
def md_to_html(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(r"concat('## Part ', doc_id, '\n\n', text, '\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n$$\nx\n$$')").alias("text"))
    return repair.html_of(docs).select("doc_id", F.length("html").alias("n"), F.contains("html", F.lit("<table>")).alias("tabled"))


@query()
def visual_cluster(spark, sf_dir):
    rows = boxes(spark, sf_dir).drop("l_partkey")
    captions = rows.where("insert_no = 1").selectExpr("*", "if(page_no % 2 = 0, 'figure', 'table') AS kind", "400.0D AS width", "800.0D AS height")
    primitives = rows.where("insert_no > 1").selectExpr("*", "if(insert_no % 3 = 0, 'text', 'drawing') AS kind")
    return layout.visual_clusters(layout.caption_groups(captions), primitives)


@query()
def caption_groups(spark, sf_dir):
    rows = boxes(spark, sf_dir).drop("l_partkey").withColumn("kind", F.when(F.col("insert_no") % 3 == 0, "figure").otherwise("table"))
    return layout.caption_groups(rows).select("page_no", "insert_no", "group_no")


@query()
def translate_stub(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.respond(docs, _stub).select("doc_id", F.length("output").alias("n"))


def _stub(text: str) -> str:
    """Stands in for a text generator: refuses long prompts, else gives the text back."""
    return "output truncated" if len(text) > 4200 else text
