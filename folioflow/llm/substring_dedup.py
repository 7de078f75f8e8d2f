"""Substring dedup: repeated windows of words, found on a compacted sparse De Bruijn graph.

Wanted are the words covered by a window of ``window`` consecutive words whose sequence also starts anywhere else.

1. *Edges.* Token k-mers, k = window // 2 + 1, become edges. Of the k-mers inside any window the one with the smallest
   hash (the leftmost on ties) is selected, so equal windows select equal k-mers at equal places, and a text keeps only the
   selected edges, about one in nine. A window can repeat only if its selected edge does.
2. *Compaction.* An edge whose occurrences all have the same neighbour edges at the same distances is interior to a
   nonbranching path. Joins bring repeated edges and this mark back to their source coordinates; runs of interior edges
   compact to one path occurrence, and all windows inside it repeat, because every occurrence of an interior edge goes
   along the whole run.
3. *Verification.* Windows with a repeated edge that is not interior, or that no path covers, those around branches and
   text ends, are compared themselves: their hashes are counted over all source coordinates.
4. The union of both is removed, judged on the input texts.

Equal texts are one text with a count: with two or more copies and at least one window, all of it repeats. Edges, windows
and texts are compared by 64-bit hashes (texts by two). Null and empty texts lose nothing and keep the empty text. Nothing
depends on ids, so null and repeated ids are as good as any. Ties between equal k-mers go to the leftmost. A very long text
is one text like any other. An empty table gives an empty result. Other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.words import HASHES, byte_list, fresh, keep_only, mix64, window_hashes
from folioflow.session import Scratch, ship



def selected(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For word hashes: the k-mer hashes, and the place of the selected k-mer of each window."""
    k = window // 2 + 1
    kmers = window_hashes(h, k)
    per = window - k + 1
    if len(kmers) < per:
        return kmers, np.empty(0, np.int64)
    return kmers, np.lib.stride_tricks.sliding_window_view(kmers, per).argmin(axis=1) + np.arange(len(kmers) - per + 1)


def edges_of(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The selected edges of a text: places, hashes, and a code of each one's neighbours and distances."""
    kmers, chosen = selected(h, window)
    at = np.unique(chosen)
    e = kmers[at]
    before, after = np.zeros_like(e), np.zeros_like(e)
    if len(e) > 1:
        gap = np.diff(at).astype(np.uint64)
        before[1:], after[:-1] = mix64(e[:-1] ^ mix64(gap)), mix64(e[1:] + gap)
    return at, e, mix64(before * np.uint64(3) ^ mix64(after))


def settle(h: np.ndarray, window: int, at: np.ndarray, interior: np.ndarray) -> tuple[list[int], np.ndarray]:
    """From the places of repeated edges and their marks: removed word spans [a, b) of path occurrences, flat, and the
    starts of the windows that must be compared."""
    k = window // 2 + 1
    _, chosen = selected(h, window)
    places = np.unique(chosen)
    repeated, inside = np.zeros(len(h), bool), np.zeros(len(h), bool)
    repeated[at] = True
    inside[at[interior]] = True
    flags = inside[places]
    spans, settled = [], np.zeros(len(chosen), bool)
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    for first, stop in zip(edge[::2], edge[1::2]):
        a, b = places[max(first - 1, 0)], places[min(stop, len(places) - 1)] + k
        if b - a >= window:
            spans += [int(a), int(b)]
            settled[a : b - window + 1] = True
    # a window whose own edge is interior is settled wherever it occurs; one that only ends in a path here may not be
    return spans, np.flatnonzero(repeated[chosen] & ~(settled & inside[chosen]))


def merged(spans: list[int], starts: list[int], window: int) -> list[int]:
    """Sorted disjoint spans, flat, of the given spans and of the windows at ``starts``."""
    out: list[int] = []
    for a, b in sorted([*zip(spans[::2], spans[1::2]), *((s, s + window) for s in starts)]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _edges_udf(window: int):
    @F.arrow_udf("struct<n:int,at:array<int>,e:array<bigint>,code:array<bigint>>")
    def selected_edges(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep_only(HASHES)
        for texts in batches:
            n, at, e, code, offsets = [], [], [], [], [0]
            for text in byte_list(texts):
                words = (text or b"").split()
                places, hashes, codes = edges_of(HASHES.of(words), window) if len(words) >= window else (np.empty(0, np.int64),) * 3
                n.append(len(words))
                at.append(places.astype(np.int32))
                e.append(hashes.view(np.int64))
                code.append(codes.view(np.int64))
                offsets.append(offsets[-1] + len(places))
            off = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x) if x else np.empty(0, np.int64), kind)) for x, kind in ((at, pa.int32()), (e, pa.int64()), (code, pa.int64()))]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int32()), *lists], names=["n", "at", "e", "code"])

    return selected_edges.asNondeterministic()


def _settle_udf(window: int):
    @F.arrow_udf("struct<spans:array<int>,starts:array<int>,w:array<bigint>>")
    def settled_windows(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places, marks in batches:
            spans, starts, hashes = [], [], []
            for text, at, inside in zip(byte_list(texts), places.to_pylist(), marks.to_pylist()):
                h = HASHES.of(text.split())
                done, todo = settle(h, window, np.array(at, np.int64), np.array(inside, bool))
                spans.append(done)
                starts.append(todo)
                hashes.append(window_hashes(h, window)[todo].view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(spans, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], names=["spans", "starts", "w"])

    return settled_windows.asNondeterministic()


def _merge_udf(window: int):
    @F.arrow_udf("array<int>")
    def merged_spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for spans, starts in batches:
            yield pa.array([merged(a or [], b or [], window) for a, b in zip(spans.to_pylist(), starts.to_pylist())], pa.list_(pa.int32()))

    return merged_spans.asNondeterministic()


def _keep_udf():
    @F.arrow_udf("struct<n:bigint,removed:bigint,kept:string>")
    def kept_words(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, removed in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(byte_list(texts), removed.to_pylist()):
                words = (text or b"").split()
                n.append(len(words))
                for a, b in reversed(list(zip(spans[::2], spans[1::2])) if spans else []):
                    del words[a:b]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["n", "removed", "kept"])

    return kept_words.asNondeterministic()


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(5), text).alias("t2")]


def matched(rows: DataFrame, counted: DataFrame, key: str, total: int, hot_keys: int) -> DataFrame:
    """``rows`` joined with ``counted`` (``key``, unique; ``rows``: how many of ``rows`` hold it; any other columns).

    Keys that hold more than one in ``hot_keys`` of the ``total`` rows, fewer than ``hot_keys`` of them, go to all
    executors, so that a passage which a third of all texts share isn't dealt to one task. The others are dealt out.
    """
    hot = F.col("rows") * hot_keys > total
    here = rows.join(F.broadcast(counted.where(hot)), key)
    rest = rows.join(F.broadcast(counted.where(hot).select(key)), key, "left_anti").join(counted.where(~hot), key)
    return here.unionByName(rest).drop("rows")


def repeated_spans(texts: DataFrame, *, window: int = 35, broadcast_bytes: int = 64 << 20, hot_keys: int = 1024) -> DataFrame:
    """(t1, t2, spans): the word spans that repeat, for each distinct text of column ``_text`` that has any."""
    spark = texts.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = texts.select(*_keys(F.col("_text")), _edges_udf(window)(F.col("_text")).alias("s")).select("t1", "t2", "s.*").where(F.col("n") >= window)
    # copies are counted before anything is dealt out
    rows = rows.groupBy("t1", "t2").agg(F.first("n").alias("n"), F.first("at").alias("at"), F.first("e").alias("e"), F.first("code").alias("code"), F.count(F.lit(1)).alias("copies"))
    rows = scratch.table("texts", rows.withColumn("id", F.monotonically_increasing_id()), "snappy")

    single = F.col("copies") == 1
    edges = rows.select(F.inline(F.arrays_zip("e", "code")), "copies")
    edges = edges.groupBy("e").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("code").alias("lo"), F.max("code").alias("hi")).where("n > 1")
    edges = scratch.table("edges", edges.select("e", "rows", (F.col("lo") == F.col("hi")).alias("interior")))

    def entries(table: DataFrame, column: str) -> int:
        return table.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]

    places = matched(rows.select("id", F.inline(F.arrays_zip("e", "at"))), edges, "e", entries(rows, "e"), hot_keys)
    places = places.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "interior"))).alias("p"))  # as many as a text has edges
    marked = rows.select("id", "t1", "t2", "copies").join(places, "id").select("id", "t1", "t2", F.col("p.at").alias("at"), F.col("p.interior").alias("interior"))
    marked = scratch.table("marked", marked)

    def beside(table: DataFrame, weight: Column) -> DataFrame:
        """Sent to all executors if it is small enough; beyond that both sides are shuffled."""
        size = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
        return F.broadcast(table) if size <= broadcast_bytes else table

    whole, near = texts.select(*_keys(F.col("_text")), "_text"), beside(marked, 40 + 5 * F.size("at"))
    if near is marked:  # then texts are dealt out, copies of one once a task
        whole = whole.groupBy("t1", "t2").agg(F.first("_text").alias("_text"))
    found = whole.join(near, ["t1", "t2"])
    found = found.select("id", _settle_udf(window)("_text", "at", "interior").alias("s")).select("id", "s.*")
    # copies of a text give the same row, which is kept once
    found = scratch.table("settled", found.groupBy("id").agg(*(F.first(c).alias(c) for c in ("spans", "starts", "w"))))
    windows = found.select("id", F.inline(F.arrays_zip("w", "starts")))
    windows = windows.select("id", "w", F.col("starts").alias("at"), F.xxhash64("id", "starts").alias("o"))
    again = windows.groupBy("w").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi").select("w", "rows")
    again = scratch.table("again", again)
    starts = matched(windows.select("id", "w", "at"), again, "w", entries(found, "w"), hot_keys).groupBy("id").agg(F.collect_set("at").alias("starts"))
    spans = found.select("id", "spans").join(starts, "id", "left")
    part = spans.select("id", _merge_udf(window)("spans", "starts").alias("spans"))
    out = rows.select("id", "t1", "t2", "n", "copies").join(part, "id", "left")
    all_of_it = F.array(F.lit(0), F.col("n"))
    out = out.select("t1", "t2", F.when(single, F.col("spans")).otherwise(all_of_it).alias("spans")).where("size(spans) > 0")
    out = scratch.table("spans", out)
    scratch.drop("texts", "edges", "marked", "settled", "again")
    return out


def remove_repeats(docs: DataFrame, *, text_col: str = "text", out_col: str = "repeats", window: int = 35, broadcast_bytes: int = 64 << 20, hot_keys: int = 1024) -> DataFrame:
    """All rows of ``docs`` as they are, with a struct ``out_col``, a name that ``docs`` doesn't have: n (words), removed,
    kept (the words left, joined by one space) and spans (removed word spans, flat)."""
    if fresh(docs, out_col) != [out_col]:
        raise ValueError(f"there is a column {out_col} already")
    if window < 2:
        raise ValueError("a window has two words at least")
    text = F.col(text_col).cast("string")
    spans = repeated_spans(docs.select(text.alias("_text")).where("_text IS NOT NULL"), window=window, broadcast_bytes=broadcast_bytes, hot_keys=hot_keys)
    size = spans.agg(F.coalesce(F.sum(32 + 4 * F.size("spans")), F.lit(0))).first()[0]
    d1, d2, t1, t2, cut, kept = fresh(docs, "_d1", "_d2", "_t1", "_t2", "_spans", "_kept")
    spans = spans.withColumnsRenamed({"t1": t1, "t2": t2, "spans": cut})
    keyed = docs.withColumns({d1: _keys(text)[0], d2: _keys(text)[1]})
    found = keyed.join(F.broadcast(spans) if size <= broadcast_bytes else spans, (F.col(d1) == F.col(t1)) & (F.col(d2) == F.col(t2)), "left")
    found = found.withColumn(kept, _keep_udf()(text, F.col(cut)))
    return found.select(*docs.columns, F.struct(F.col(f"{kept}.n").alias("n"), F.col(f"{kept}.removed").alias("removed"), F.col(f"{kept}.kept").alias("kept"), F.col(cut).alias("spans")).alias(out_col))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    rows = remove_repeats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), window=window)
    return rows.select("doc_id", F.col("repeats.n").alias("n_words"), F.col("repeats.removed").alias("n_removed"), F.sha2(F.col("repeats.kept").cast("binary"), 256).alias("kept_sha256"))
