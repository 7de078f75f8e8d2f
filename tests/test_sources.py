"""Providers and collections against small cases."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.sources import library, provider

MESSAGES = "m array<struct<role:string,content:string>>"


def test_requests(spark):
    rows = spark.createDataFrame([([("system", "a"), ("user", "b"), ("system", "c"), ("tool", None), ("assistant", "d")],), ([("system", "a")],), ([],)], MESSAGES)
    got = [(json.loads(r.chat), json.loads(r.other)) for r in rows.select(provider.request(F.col("m"), "x", "chat").alias("chat"), provider.request(F.col("m"), "x", "messages", 0.0).alias("other")).collect()]
    assert got[0][0] == {"model": "x", "temperature": 0.2, "messages": [{"role": r, "content": c} for r, c in (("system", "a"), ("user", "b"), ("system", "c"), ("tool", ""), ("assistant", "d"))]}
    assert got[0][1] == {"model": "x", "temperature": 0.0, "max_tokens": 8192, "system": "a\n\nc", "messages": [{"role": r, "content": c} for r, c in (("user", "b"), ("user", ""), ("assistant", "d"))]}
    assert got[1][1]["messages"] == [{"role": "user", "content": ""}] and "system" not in got[2][1]


def test_prompts(spark):
    row = spark.createDataFrame([("T", "B {{title}}")], "t string, b string").select(provider.prompt("{{title}}: {{blocks}}", title=F.col("t"), blocks=F.col("b")).alias("p")).first()
    assert row.p == "T: B {{title}}"


@pytest.mark.parametrize(
    "answer, want",
    [
        ('```json\n{"field": "Bio", "subfield": "Cells"}\n```', ("Bio", "Cells", "按通用学术中文术语翻译。")), ('{"terminology_notes": "n"}', ("未知领域", "未知子领域", "n")),
        ("no json", ("未知领域", "未知子领域", "no json")), (None, ("未知领域", "未知子领域", "")), ("x" * 2000, ("未知领域", "未知子领域", "x" * 1000)),
    ],
)
def test_contexts(spark, answer, want):
    assert tuple(spark.createDataFrame([(answer,)], "a string").select(provider.context(F.col("a")).alias("c")).first().c) == want


def test_tries():
    asked, pauses = [], []

    def sender(*results):
        left = list(results)

        def send(body):
            asked.append(body)
            result = left.pop(0)
            if isinstance(result, Exception):
                raise result
            return result

        return send

    assert provider.trying(sender((500, ""), ConnectionError("x"), (200, "ok")), sleep=pauses.append)("b") == "ok" and pauses == [1.5, 3.0] and len(asked) == 3
    asked.clear()
    with pytest.raises(provider.ProviderError):
        provider.trying(sender((401, "")), sleep=pauses.append)("b")
    assert len(asked) == 1
    with pytest.raises(provider.ProviderError):
        provider.trying(sender(*[(429, "")] * 3), sleep=pauses.append)("b")
    with pytest.raises(provider.Cancelled):
        provider.trying(sender(), cancelled=lambda: True)("b")


def test_asked(spark):
    rows = spark.createDataFrame([("a",), (None,)], "body string")
    assert [r.answer for r in provider.asked(rows, lambda b: (200, b + "!")).collect()] == ["a!", None]


def test_collections(spark, tmp_path):
    folders = library.Folders(spark, str(tmp_path / "root"))
    assert [folders.create(n) for n in ("My Papers", "论文 Ⅳ", "?!")] == ["my-papers", "论文-iv", "未命名文件夹"]
    assert folders.names() == ["my-papers", "未命名文件夹", "论文-iv"]
    folders.write("my-papers", "a.md", "one")
    folders.write("my-papers", "a.md", "two é")
    assert (tmp_path / "root/my-papers/a.md").read_text() == "two é"
    assert folders.rename("my-papers", "Other") == "other" and folders.unused("other") == "other-2" and folders.unused("new") == "new"
    with pytest.raises(FileExistsError):
        folders.rename("other", "论文 Ⅳ")
    with pytest.raises(ValueError):
        folders.delete("..")
    folders.delete("other")
    assert folders.names() == ["未命名文件夹", "论文-iv"]


def test_listing(spark):
    papers = spark.createDataFrame([("f", p) for p in "abcd"], "folder string, paper string")
    metadata = spark.createDataFrame([("f", "a", '﻿{"display_name": "A"}'), ("f", "b", "no json"), ("f", "c", '{"display_name": ""}')], "folder string, paper string, json string")
    assert {r.paper: r.name for r in library.named(papers, metadata).collect()} == {"a": "A", "b": "b", "c": "c", "d": "d"}
    assert library.folders(papers).collect() == [("f",)]
    names = spark.createDataFrame([("x.PDF",), ("translated.md",), ("z",)], "n string")
    assert [r.x for r in names.select(library.file_label(F.col("n")).alias("x")).collect()] == ["原论文.pdf", "中文译文.md", "z"]
    paths = spark.createDataFrame([("/a/b", "/a/"), ("/a", "/a"), ("/ab", "/a"), ("/a", "/a/b")], "p string, r string")
    assert [tuple(r) for r in paths.select(library.is_inside(F.col("p"), F.col("r")), library.overlap(F.col("p"), F.col("r"))).collect()] == [(True, True), (True, True), (False, False), (False, True)]
