"""A library of papers on a file system: listing, search, metadata and structured blocks."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import safe_name

#: The wide row that covers all block types.
BLOCK = (
    "type string, level int, id string, text string, content string, raw_text string, latex string, caption string, path string, "
    "columns array<string>, rows array<array<string>>, html_path string, html string"
)
CONTEXT = "field string, subfield string, terminology_notes string"


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, folder, paper, name, length and modified time of files below ``root/folder/paper/``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    part = F.split("path", "/")
    return rows.select("path", F.element_at(part, -3).alias("folder"), F.element_at(part, -2).alias("paper"), F.element_at(part, -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def papers(files: DataFrame) -> DataFrame:
    """One row for each paper: its first PDF by name and its Markdown files."""
    name = F.col("name")
    return files.where(~name.startswith(".")).groupBy("folder", "paper").agg(
        F.min(F.when(F.lower(name).endswith(".pdf"), name)).alias("pdf"),
        F.max(F.when(name == "translated.md", F.col("path"))).alias("translated"),
        F.max(F.when(name == "summary.md", F.col("path"))).alias("summary"),
    )


def folders(files: DataFrame) -> DataFrame:
    """folder: the collections that hold a paper."""
    return files.select("folder").distinct()


def named(papers: DataFrame, metadata: DataFrame) -> DataFrame:
    """Papers with ``name``: the metadata's (folder, paper, ``json``) display name, or the paper's where it is missing, empty or no
    JSON. Of several metadata rows of a paper the one with the least JSON counts."""
    known = metadata.groupBy("folder", "paper").agg(F.min("json").alias("json"))  # a paper's metadata
    name = F.nullif(F.get_json_object(F.regexp_replace("json", "^\ufeff", ""), "$.display_name"), F.lit(""))
    return papers.join(known.select("folder", "paper", name.alias("name")), ["folder", "paper"], "left").withColumn("name", F.coalesce("name", "paper"))


#: How a paper's files are called in a listing.
FILE_LABELS = {"translated.md": "中文译文.md", "summary.md": "Summary.md"}
PDF_LABEL = "原论文.pdf"


def file_label(name: Column) -> Column:
    out = F.when(F.lower(name).endswith(".pdf"), PDF_LABEL)
    for known, label in FILE_LABELS.items():
        out = out.when(name == known, label)
    return out.otherwise(name)


def folder_name(name: str, default: str = "未命名文件夹") -> str:
    """A collection's folder: lower case, words of any script joined by hyphens."""
    return re.sub(r"[\W_]+", "-", unicodedata.normalize("NFKC", name).lower()).strip("-") or default


def is_inside(path: Column, root: Column) -> Column:
    """Whether a normalised path is ``root`` or lies below it."""
    base = F.regexp_replace(root, "/+$", "")
    return (path == base) | path.startswith(F.concat(base, F.lit("/")))


def overlap(a: Column, b: Column) -> Column:
    return is_inside(a, b) | is_inside(b, a)


class Folders:
    """Collections below a root on any file system that Spark knows; it is made if it is not there."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _at(self, name: str):
        if name in ("", ".", "..") or "/" in name:
            raise ValueError(f"not the name of a collection: {name!r}")
        return self._path(f"{self.root}/{name}")

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(self.root)) if f.isDirectory())

    def create(self, name: str) -> str:
        self._fs.mkdirs(self._at(folder_name(name)))
        return folder_name(name)

    def rename(self, old: str, new: str) -> str:
        """The new folder; nothing is overwritten."""
        target = folder_name(new, old)
        if target != old and (self._fs.exists(self._at(target)) or not self._fs.rename(self._at(old), self._at(target))):
            raise FileExistsError(target)
        return target

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def unused(self, name: str) -> str:
        """The name, or with the first number from 2 on that no folder has."""
        taken, k = set(self.names()), 2
        found = name
        while found in taken:
            found, k = f"{name}-{k}", k + 1
        return found

    def write(self, folder: str, name: str, text: str) -> None:
        """A file that readers see whole or not at all."""
        at = self._at(folder).toString()
        draft, final = self._path(f"{at}/.{name}.draft"), self._path(f"{at}/{name}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self._fs.exists(final):
            self._fs.delete(final, False)
        if not self._fs.rename(draft, final):
            raise OSError(f"cannot write {final.toString()}")


def matching(papers: DataFrame, columns: list[str], query: Column) -> DataFrame:
    """Rows with the query in any of the columns, whatever the case."""
    wanted = F.lower(F.trim(query))
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), wanted)
    return papers.where((wanted == "") | found)


def cache_key(path: Column, size: Column, modified: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", path, size.cast("string"), modified.cast("string"))), 1, 16)


def context(json: Column) -> Column:
    """A field context from its JSON, current or flat form; bad JSON gives the defaults."""
    text = F.regexp_replace(json, "^\ufeff", "")
    new, old = F.from_json(text, f"context struct<{CONTEXT.replace(' string', ':string')}>"), F.from_json(text, CONTEXT)
    pick = lambda c, d: F.coalesce(new["context"][c], old[c], F.lit(d)).alias(c)
    return F.struct(pick("field", "unknown"), pick("subfield", "unknown"), pick("terminology_notes", ""))


def blocks(chunk: Column) -> Column:
    """The blocks of an encoded chunk; null if it is no JSON array."""
    fields = ",".join(f"{name}:{kind}" for name, kind in (c.split(" ", 1) for c in BLOCK.split(", ")))
    return F.from_json(chunk, f"array<struct<{fields}>>")


def merged_metadata(old: DataFrame, new: DataFrame, key: str = "paper_id", column: str = "metadata") -> DataFrame:
    """Full outer merge of string maps; new keys win and unknown ones stay."""
    o, n = old.select(key, F.col(column).alias("_o")), new.select(key, F.col(column).alias("_n"))
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("_o", none), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(F.col("_n"), none)), k))
    return o.join(n, key, "full_outer").select(key, F.map_concat(kept, F.coalesce("_n", none)).alias(column))


def with_cache(rows: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """Cached rows as they are; rows the cache lacks through ``compute`` (DataFrame to DataFrame, same columns)."""
    hit = rows.select(key).distinct().join(cache, key)
    return hit.unionByName(compute(rows.join(cache, key, "left_anti")).select(*hit.columns))


def html_blocks(pages: DataFrame, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """Blocks of raw pages: heading, list and paragraph elements in order, with their text."""
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r"(?s)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</\1>"), F.lit(0))
    rows = pages.select(key, F.posexplode(tags).alias("seq", "element"))
    tag = F.regexp_extract("element", r"^<(h[1-6]|p|li)", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("element", "<[^>]+>", " "), r"\s+", " "))
    return rows.select(key, "seq", F.when(tag.startswith("h"), "heading").when(tag == "li", "list").otherwise("paragraph").alias("type"), F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int")).alias("level"), text.alias("text"))


def decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    """Rows that a decoder plug-in (iterator of record batches to iterator of record batches) makes of binary files."""
    return files.mapInArrow(decode, schema)


__all__ = ["BLOCK", "blocks", "cache_key", "context", "decoded", "file_label", "files", "folder_name", "Folders", "folders", "html_blocks", "is_inside", "matching", "merged_metadata", "named", "overlap", "papers", "safe_name", "with_cache"]
