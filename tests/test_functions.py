"""Column expressions and Markdown repair against small cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import markdown, tables
from folioflow.functions import text as T
from folioflow.operators import chunking, layout
from folioflow.sources import library

TABLE = {"type": "table", "id": "table_2", "caption": "Sizes", "columns": ["name", "n"], "rows": [["a", "1"], ["b", "22"]]}
EQUATION = {"type": "equation", "id": "equation_1", "latex": "a = b"}


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("Figure 3: x", "figure"), ("fig. 7", "figure"), (" TABLE 2", "table"), ("Algorithm 1", "algorithm"), ("Tablet", None), ("", None)],
)
def test_caption_kind(spark, text, want):
    assert one(spark, T.caption_kind(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("(12)", 0), ("3.5", 1), ("x", 2), ("α", 2), ("word", 1), ("a = b", 7), ("", 0)])
def test_formula_score(spark, text, want):
    assert one(spark, T.formula_score(F.col("t")), t=text) == want


def test_citation_grammars_differ(spark):
    assert one(spark, T.strip_inline_citations(F.col("t")), t="a [3] b [v2] c [Abc24, X+19] .") == "a b [v2] c."
    assert one(spark, T.strip_reference_citations(F.col("t")), t="a [3] b [v2] c [a, b]") == "a [3] b c"


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.col("t")), t=" de-\nhyphen  \n\n\n\nend\0 ") == "dehyphen\n\nend"


def test_safe_name_and_lines(spark):
    assert one(spark, T.safe_name(F.col("t")), t='a<b>:c?. ') == "a_b_c_"
    assert one(spark, T.safe_name(F.col("t")), t=" . ") == "untitled-paper"
    assert one(spark, T.lines(F.col("t")), t="a\r\nb\u2028c\n") == "a\r\nb\u2028c\n".splitlines()


def test_parsed_table(spark):
    got = one(spark, tables.parsed(F.col("t")), t="| k | v |\n| a | 1 | x |\nnoise")
    assert (got["columns"], got["rows"]) == (["k", "v", ""], [["a", "1", "x"]])
    assert one(spark, tables.parsed(F.col("t")), t="1  2\n3  4")["columns"] == ["列 1", "列 2"]
    assert one(spark, tables.parsed(F.col("t")), t="nothing")["rows"] == []


def test_upper_median(spark):
    assert one(spark, layout.upper_median(F.array(*map(F.lit, (4.0, 1.0, 3.0, 2.0)))), t=0) == 3.0


def test_sanitize_repairs():
    raw = "```markdown\nSure, here it is.\n\nText [12; 3] uses \\alpha_{i}.\n\n![e](equations/equation_1.png)\n\nkey：1\nkey：2\nkey：3\nkey：4\n```"
    out = markdown.sanitize(raw, [EQUATION, TABLE])
    assert "[12; 3]" not in out and "Sure" not in out and "```" not in out
    assert "$$\na = b\n$$" in out and "| a | 1 |" in out and "key：1" not in out
    assert "\\(\\alpha_{i}\\)" in out and out.count("$$") % 2 == 0


def test_raw_equations_never_replace_latex():
    out = markdown.sanitize("$$\nx^2\n$$", [{"type": "equation", "id": "equation_1", "raw_text": "x 2"}])
    assert "x^2" in out and "x 2" not in out


def test_formula_to_latex_and_back():
    assert markdown.formula_of_lines(["a ≤ θ", "(3)"]) == r"a ≤ \theta\tag{3}"
    assert markdown.formula_of_lines([]) == "" and markdown.formula_of_lines(["(3)"]) == ""
    assert markdown.latex_to_plain(r"\frac{\frac{a}{b}}{\text{c}} \le \theta") == "((a)/(b))/(c) ≤ θ"
    assert markdown.plain_fractions(r"\frac{a}{") == r"\frac{a}{"


def test_html():
    out = markdown.to_html("# T\n\n| a | b |\n|---|---|\n| 1 | 2 | 3 |\n\n- x\n- y\n\n$$\nz<1\n$$\n\np **b**")
    assert "<h1>T</h1>" in out and "<td>2 | 3</td>" in out and "<li>x</li><li>y</li>" in out and "z&lt;1" in out and "<strong>b</strong>" in out


@given(st.text(alphabet="ab .\n!", max_size=400), st.integers(5, 60))
@settings(max_examples=80, deadline=None)
def test_split_keeps_all_words(text, limit):
    parts = chunking.split_for_prompt(text, limit)
    assert all(0 < len(p) <= limit for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_long_paragraph_is_split(spark):
    rows = spark.createDataFrame([("paragraph", "A sentence here. " * 500), ("heading", "H" * 4000)], "type string, text string")
    got = chunking.split_blocks(rows, 1000).collect()
    assert max(len(r.text) for r in got if r.type == "paragraph") <= 1000 and sum(r.type == "heading" for r in got) == 1


def test_packing_and_budget(spark):
    assert one(spark, chunking.packed(F.array(*map(F.lit, (10, 10, 90, 5))), 40), t=0) == [0, 0, 1, 2]
    b = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(r).alias("required"), F.lit(n).alias("n")) for i, r, n in ((1, False, 90), (2, True, 50), (3, False, 20), (4, False, 200), (5, False, 6))))
    assert one(spark, chunking.within_budget(b, 100), t=0) == [2, 3, 5]


def test_short_answers_are_asked_for_again(spark):
    calls = spark.createDataFrame([("a sentence of words. " * 400,), ("short",), (None,)], "text string")
    got = [r.output for r in chunking.respond(calls, lambda t: "output truncated" if len(t) > 4200 else t).collect()]
    assert "truncated" not in got[0] and got[0].count("sentence") == 400 and got[1:] == ["short", None]


def test_context_and_blocks(spark):
    got = one(spark, library.context(F.col("t")), t='\ufeff{"tag": "x", "context": {"field": "bio"}}')
    assert (got.field, got.subfield) == ("bio", "unknown")
    assert one(spark, library.context(F.col("t")), t='{"field": "old"}').field == "old"
    assert one(spark, library.context(F.col("t")), t="no json").field == "unknown"
    assert one(spark, library.blocks(F.col("t")), t='[{"type": "table", "columns": ["a"]}]')[0]["columns"] == ["a"]


def test_metadata_merge(spark):
    old = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"c": "3"})], "paper_id int, metadata map<string,string>")
    new = spark.createDataFrame([(1, {"b": "9"}), (3, {"d": "4"})], "paper_id int, metadata map<string,string>")
    assert {r.paper_id: r.metadata for r in library.merged_metadata(old, new).collect()} == {1: {"a": "1", "b": "9"}, 2: {"c": "3"}, 3: {"d": "4"}}


def test_library_listing(spark, tmp_path):
    for name in ("f/p/b.pdf", "f/p/a.PDF", "f/p/translated.md", "f/p/.hidden.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = library.papers(library.files(spark, str(tmp_path))).collect()
    assert [(r.folder, r.paper, r.pdf, r.translated.endswith("translated.md"), r.summary) for r in got] == [("f", "p", "a.PDF", True, None)]


def test_stream_of_dropped_files(spark, sf_dir, tmp_path):
    import shutil

    from folioflow.streaming import drop

    shutil.copy(f"{sf_dir}/documents.parquet", tmp_path / "d.parquet")
    rows = drop.cleaned(drop.dropped(spark, str(tmp_path), "doc_id long, text string"))
    q = rows.writeStream.format("memory").queryName("dropped").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM dropped").count() == 200


def clusters(spark, captions, primitives):
    """captions: (page, insert_no, kind, box); primitives the same. Gives (page, insert_no) -> (box, direction)."""
    ddl = "paper_id long, page_no long, insert_no long, kind string, x0 double, y0 double, x1 double, y1 double"
    seeds = spark.createDataFrame([(1, p, i, k, *map(float, b)) for p, i, k, b in captions], ddl)
    seeds = seeds.withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))
    found = layout.visual_clusters(layout.caption_groups(seeds), spark.createDataFrame([(1, p, i, k, *map(float, b)) for p, i, k, b in primitives], ddl)).collect()
    return {(r.page_no, r.insert_no): (None if r.x0 is None else (r.x0, r.y0, r.x1, r.y1), r.direction) for r in found}


def test_visual_clusters(spark):
    line = (100, 400, 300, 410)
    captions = [(p, 1, "figure", line) for p in range(1, 8)] + [(8, 1, "table", (50, 400, 150, 410)), (8, 2, "table", (300, 405, 400, 415)), (9, 1, "table", line), (10, 1, "figure", line)]
    primitives = [
        (1, 2, "drawing", (100, 300, 300, 390)), (1, 3, "drawing", (100, 420, 300, 500)),  # above wins
        (2, 2, "drawing", (100, 420, 300, 500)), (2, 3, "drawing", (100, 520, 300, 540)),  # below, and grows downwards
        (3, 2, "drawing", (100, 100, 300, 300)), (3, 3, "drawing", (100, 430, 300, 500)),  # over 80 units above, so below
        (4, 2, "drawing", (100, 100, 300, 300)),  # too far
        (5, 2, "drawing", (320, 300, 420, 390)),  # 5 % of it over the window
        (6, 2, "text", (100, 370, 300, 390)), (6, 3, "text", (100, 310, 300, 330)),  # texts only: gap of 40
        (7, 2, "drawing", (100, 300, 300, 390)), (7, 3, "text", (100, 250, 380, 296)), (7, 4, "text", (120, 285, 160, 297)),  # body text stays out, a label does not
        (8, 3, "drawing", (50, 380, 150, 390)), (8, 4, "drawing", (300, 290, 400, 300)),  # a band of the group
        (9, 2, "drawing", (100, 300, 300, 390)), (9, 3, "text", (100, 250, 380, 296)),  # near a table every text counts
    ]
    assert clusters(spark, captions, primitives) == {
        (1, 1): ((100, 300, 300, 390), "above"), (2, 1): ((100, 420, 300, 540), "below"), (3, 1): ((100, 430, 300, 500), "below"), (4, 1): (None, "above"), (5, 1): (None, "above"),
        (6, 1): ((100, 310, 300, 390), "above"), (7, 1): ((100, 285, 300, 390), "above"), (8, 1): ((50, 290, 400, 390), "above"), (9, 1): ((100, 250, 380, 390), "above"), (10, 1): (None, "above"),
    }


def test_braces_and_styles():
    assert markdown.plain_fractions(r"\frac {a} {b} + \frac{\frac{1}{2}}{c}") == "(a)/(b) + ((1)/(2))/(c)"
    assert markdown.plain_fractions(r"\frac{a}") == r"\frac{a}" and markdown.plain_fractions(r"\frac{a}{b") == r"\frac{a}{b"
    assert markdown.unwrapped(r"\boldsymbol{x} \mathbb {R} \text{a \mathrm{b}}") == "x R a b" and markdown.unwrapped(r"\text{open") == r"\text{open"
    assert markdown.symbols_to_latex("ρ = ε + Ω Δ").split() == [r"\rho", "=", r"\epsilon", "+", r"\Omega", r"\Delta"]


def test_halves():
    text = "a" * 700 + ". " + "b" * 200 + ". " + "c" * 700
    assert chunking.split_index(text) == 903 and chunking.split_index("x" * 10) == 5 and chunking.split_index("") == 0


def test_structures_found(spark):
    from folioflow.operators import repair

    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "two"), (4, "one"), (6, "six"), (7, None)], "item_id long, text string")
    assert [(r.doc_id, r.found, r.n_missing) for r in repair.structures_found(docs, items).orderBy("doc_id").collect()] == [(1, [4, 5], 1), (2, [], 3), (3, [], 3)]
    assert repair.structures_found(docs, items.limit(0)).first().found == []


RAW = [
    "ORL(π) = E(x,τ)∼Dπ [rθ(x, τ) -βDKL(π(τ|x)||πinit(τ|x))].\nThe high R value of the fit indicates prose and must not enter the formula.\n(2)",
    "rθ(x, τ)\n1\nπ*(τ|x) =\nZ(x)πinit(τ|x) exp\nβ\n(3)",
    "L = 0.9 · N -.0425.\n(9)",
    None,
    "",
    "(4)",
]


def test_extracted_formulas(spark):
    from folioflow.operators import repair

    rows = spark.createDataFrame(list(enumerate(RAW)), "i int, raw string")
    first, torn, power, *rest = [r.latex for r in repair.latex_of(rows, "raw").orderBy("i").collect()]
    for part in (r"O_{\mathrm{RL}}(\pi)", r"\mathbb{E}_{(x,\tau)\sim D_{\pi}}\left[", r"\beta D_{\mathrm{KL}}", r"\pi_{\mathrm{init}}", r"\tag{2}"):
        assert part in first
    assert "high R value" not in first
    assert r"\frac{1}{Z(x)}" in torn and r"\exp\left(\frac{r_\theta(x,\tau)}{\beta}\right)" in torn and torn.endswith(r"\tag{3}")
    assert r"N^{-0.0425}" in power and power.endswith(r"\tag{9}")
    assert rest == [None, "", ""]


def test_bare_formulas_and_failures():
    out = markdown.sanitize("\n令 \\phi 参数化策略 \\pi_{\\phi}，提示分布为 D_x。\n\n$$\n公式未能可靠识别\n$$\n", [])
    assert r"\(\phi\)" in out and r"\(\pi_{\phi}\)" in out and r"\(D_x\)" in out and "公式未能可靠识别" not in out
    kept = "| a_b | c |\n<table>\n<tr><td>x_1</td></tr>\n</table>\n$$\ny_2\n$$\nC:\\x_3 `z_4` [l_5](u_6) $v_7$"
    assert markdown.wrap_inline(kept) == kept
    assert markdown.wrap_inline("a_1 after") == r"\(a_1\) after"


def test_torn_tables():
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert markdown.without_table_rests(f"{table}\n\n3 4 5\nMethod 7\n\nA sentence follows here, and it ends.\n1 2 3") == f"{table}\n\nA sentence follows here, and it ends.\n1 2 3"
    assert markdown.without_table_rests(f"{table}\n\n\n3 4 5") == f"{table}\n\n\n3 4 5"
    assert markdown.without_table_rests("<table>\n<tr></tr>\n</table>\n# 1 2 3") == "<table>\n<tr></tr>\n</table>\n# 1 2 3"
    assert markdown.placed_tables(f"x\n{table}\ny", [TABLE]).count("| b | 22 |") == 1
    assert markdown.table_count(f"{table}\n\n<table></table>") == 2


def test_missing_structures_of_a_document():
    assert [p[:4] for p in markdown.missing("", [EQUATION, TABLE, {"type": "figure", "path": "f.png"}])] == ["$$\na", "**表 ", "![图]"]
    assert markdown.missing("a = b f.png\n| x | y |\n| - | - |", [EQUATION, TABLE, {"type": "figure", "path": "f.png"}]) == []
    assert "### 公式 1\n\n$$\na = b\n$$\n\n## 实验设计" in markdown.with_equations("x\n## 实验设计\ny", [EQUATION])
    out = markdown.sanitize("# 摘要\n\ntext", [EQUATION], append_missing=False, all_equations=True)
    assert "### 补充公式" in out and "a = b" in out


def test_plain_inline_formulas():
    assert markdown.inline_to_plain(r"\(\pi_{\phi}^2 \leq \mathbb{R}\)") == "π₍φ₎^(2) ≤ R"
    assert markdown.inline_to_plain("$x_i$") == "x₍i₎" and markdown.inline_to_plain("") == ""
    assert markdown.latex_to_plain("$$\\left( x \\tag{3}$$") == "( x (3)"


def test_preview():
    out = markdown.preview("'![a] (b.png)\n&lt;table>&lt;tr>&lt;td>1&lt;/td&gt;&lt;br /&gt;\n公式无法读取\nx_1", [])
    assert out == "![a](b.png)\n<table><tr><td>1</td><br />\n\nx_1"
