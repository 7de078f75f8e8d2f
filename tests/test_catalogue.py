"""Each registered query against its SQL, run by DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__
from folioflow.operators import chunking

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert len(rows) == len(want)
    assert [r for r in zip(rows, want) if r[0] != r[1]][:3] == []


@pytest.mark.parametrize("name", ["sanitize_markdown", "latex_normalize", "md_to_html", "visual_cluster", "caption_groups", "translate_stub", "table_parse", "page_elements", "structured_blocks"])
def test_runs(spark, sf_dir, name):
    assert __spark_entry__.queries()[name](spark, sf_dir).count() > 0


def test_pack_blocks_counts_all_of_long_lines(spark, tmp_path):
    texts = ["a b. " * 1000, "x" * 24_647, "short\n\n" + "Some words. " * 700 + "\nend", "y" * 2700, "", None, "z" * 2701 + "\n" + " " * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_blocks, r.n_chunks, r.max_chars) for r in __spark_entry__.queries()["pack_blocks"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        sizes = []
        for line in filter(None, (text or "").split("\n")):
            pieces = chunking.split_for_prompt(line, 2700) or [line] if len(line) > 2700 else [line]
            sizes += [len(p) + 40 for p in pieces]
        chunks = []
        for n in sizes:
            if chunks and chunks[-1] + n + 4 <= 3500:
                chunks[-1] += n + 4
            else:
                chunks.append(2 + n + 4)
        assert got[i] == (len(sizes), len(chunks), max(chunks, default=0))
    assert got[1][0] == 10


def test_latex_normalize_reads_whole_texts(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(500))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = __spark_entry__.queries()["latex_normalize"](spark, str(tmp_path)).first()
    assert "w499" in row.latex and "w499" in row.plain


def test_crops_cover_some_blocks_and_not_others(spark, sf_dir):
    inside, outside = (__spark_entry__.queries()[q](spark, sf_dir).count() for q in ("skip_semi", "skip_anti"))
    assert inside > 100 and outside > 100
