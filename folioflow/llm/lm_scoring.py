"""LM scoring with an Elias-Fano n-gram trie.

*Blocks.* Texts are read once into blocks of tokens: a dictionary of word hashes and numbers into it. Later passes work
on blocks. *Unigrams.* Each block's dictionary, with its training counts, is dealt out by hash into shards; a shard adds
up, numbers its words by frequency and answers each block with the totals and numbers of the words it asked for. So exact
counts of all words reach every block, no table of all words exists in one place, and a frequent word costs one entry a
block. *N-grams.* At each level a block deals its distinct n-grams, as word numbers with their training counts, out by
context; a shard adds up, builds the trie of its contexts and answers with the codes it finds there. Every word is numbered
and every n-gram of training texts is kept, once or often seen, so the model grows with the corpus and nothing of it is sent
to all executors. There is a shard for each block, so a shard's size doesn't grow. The n-grams of a hot context, with
over a 1024th of all tokens (less with more shards, down to a 65,536th), are dealt out one by one, and its back-off weight is
added up from the shards; the list of hot contexts, 65,536 at most, is what all executors get.

*Scores.* Unigrams are smoothed by absolute discounting, with the discounted mass for unseen words, as one event. A trie
holds the discounted probability of each n-gram and the back-off weight of each context, as codes on a logarithmic grid,
rounded down; the weight is what the rounded probabilities leave. p(w | context) is the discounted probability plus the
weight times p(w | context one word shorter), so that probabilities over all events add up to one, or up to 0.3 % less.

Words are compared by 64-bit hashes, n-grams by their word numbers. A null or empty text is its end token. A null id
belongs to the fold of the empty text. Repeated rows count as often as they are there. A text longer than a block makes a
block of its own. Without training texts every token is unseen, with probability 1. An empty table gives an empty result.
Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.elias_fano import Trie, grid_code, grid_value
from folioflow.llm.words import byte_list, fold, mix64
from folioflow.session import Scratch, ship

#: No word holds a space, so no word has this hash by construction.
END = xxhash.xxh3_64_intdigest(b" end ")
_HOT = (1024, 65_536)
_OFTEN = pa.list_(pa.struct([("gram", pa.list_(pa.int64())), ("n", pa.int64())]))
_PARTS = pa.list_(pa.struct([("place", pa.int32()), ("taken", pa.float64())]))
_ANSWER = "shard int, block long, a binary, b binary, size long, often array<struct<gram:array<long>,n:long>>"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _zip(a: np.ndarray) -> bytes:
    """An array, the lowest bytes of all values first, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _unzip(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order that puts entries of a shard together, and the order's parts, one for each shard that has entries."""
    order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    return order, [part for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(part)]


def _blocks(block_tokens: int):
    """(id, text, train) rows to blocks."""

    def flush(seq, ids, train, tokens, numbers):
        hashes = np.fromiter((END if w is None else xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        lengths = [len(t) for t in tokens]
        flat = np.concatenate(tokens)
        counts = np.bincount(flat[np.repeat(np.array(train, bool), lengths)], minlength=len(hashes)).astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() << 20 | seq], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([train], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())),
             pa.array([_zip(flat)], pa.binary()), pa.array([hashes.tobytes()], pa.binary()), pa.array([_zip(counts)], pa.binary())],
            names=["block", "ids", "train", "lengths", "tokens", "words", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, train, tokens, numbers, held = 0, [], [], [], _Numbers(), 0
        for batch in batches:
            learns = batch.column(2).to_pylist()
            for k, text in enumerate(byte_list(batch.column(1))):
                words = (text or b"").lower().split()
                words.append(None)
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                ids.append(batch.column(0).slice(k, 1))
                train.append(learns[k])
                held += len(words)
                if held >= block_tokens:
                    yield flush(seq, ids, train, tokens, numbers)
                    seq, ids, train, tokens, numbers, held = seq + 1, [], [], [], _Numbers(), 0
        if tokens:
            yield flush(seq, ids, train, tokens, numbers)

    return run


def _word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _ask(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts"))):
                h, c = np.frombuffer(words, np.uint64), _unzip(counts, np.uint32)
                shard = _word_shard(h, shards)
                parts = _by_shard(shard, shards)[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard[p[0]]) for p in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([h[p].tobytes() for p in parts], pa.binary()), pa.array([_zip(c[p]) for p in parts], pa.binary())],
                    names=["shard", "block", "words", "counts"],
                )

    return run


def _answer(shards: int):
    """A shard's totals and numbers: an answer for each block, and one row with what the shard holds."""

    def run(table: pa.Table) -> pa.Table:
        blocks, words = table.column("block").to_pylist(), [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
        counts = np.concatenate([_unzip(c, np.uint32) for c in table.column("counts").to_pylist()])
        distinct, back = np.unique(np.concatenate(words), return_inverse=True)
        totals = np.bincount(back, weights=counts, minlength=len(distinct)).astype(np.int64)
        cut = np.cumsum([len(w) for w in words])[:-1]
        shard = table.column("shard")[0].as_py()
        number = np.empty(len(distinct), np.int64)  # frequent words get small numbers, which take less space
        number[np.argsort(-totals, kind="stable")] = np.arange(len(distinct)) * shards + shard
        seen = totals[totals > 0]
        stats = [len(seen), int(seen.sum()), int((seen == 1).sum()), int((seen == 2).sum())]
        n, often = len(blocks), np.flatnonzero(totals * _HOT[1] > seen.sum())  # those of all shards are among them
        return pa.table({
            "shard": pa.array([shard] * (n + 1), pa.int32()), "block": pa.array([*blocks, None], pa.int64()), "a": pa.array([*(_zip(x) for x in np.split(totals[back].astype(np.uint64), cut)), None], pa.binary()),
            "b": pa.array([*(_zip(x) for x in np.split(number[back].astype(np.uint32), cut)), None], pa.binary()), "size": pa.array([None] * n + [len(distinct)], pa.int64()),
            "often": pa.array([None] * n + [[{"gram": [int(number[i])], "n": int(totals[i])} for i in often]], _OFTEN), "stats": pa.array([None] * n + [stats], pa.list_(pa.int64())),
        })

    return run


def _number(shards: int):
    """Blocks with their words' answers to blocks whose dictionaries hold numbers and totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.select(["words", "answers"]).slice(k, 1).to_pylist()[0]
                h = np.frombuffer(row["words"], np.uint64)
                order, _ = _by_shard(_word_shard(h, shards), shards)
                answers = sorted(row["answers"], key=lambda x: x["shard"])
                totals, number = np.empty(len(h), np.uint64), np.empty(len(h), np.uint32)
                totals[order] = np.concatenate([_unzip(x["a"], np.uint64) for x in answers])
                number[order] = np.concatenate([_unzip(x["b"], np.uint32) for x in answers])
                kept = batch.select(["block", "ids", "train", "lengths", "tokens"]).slice(k, 1)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([_zip(number)], pa.binary()), pa.array([_zip(totals)], pa.binary())], names=[*kept.schema.names, "number", "totals"])

    return run


def _hash(columns: np.ndarray) -> np.ndarray:
    out = np.full(columns.shape[1], 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        out = mix64(out ^ c.astype(np.uint64)) + np.uint64(0x632BE59BD9B4E019)
    return out


@dataclass
class _Model:
    """What all blocks and shards know: sizes, and the hot contexts of each level, with 65,536 entries at most."""

    shards: int
    words: int  # all numbers are below; this number is the begin mark's
    total: int
    types: int
    discount: float
    hot: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # of each level from the first: hashes in order, contexts (a row for each word), how often each was followed
    left: list[np.ndarray] = field(default_factory=list)  # the hot contexts' back-off weights

    def add_hot(self, grams: list[tuple[list[int], int]], size: int) -> None:
        context = np.array([g for g, _ in grams], np.int64).reshape(-1, size).T
        h = _hash(context)
        order = np.argsort(h, kind="stable")
        self.hot.append((h[order], context[:, order], np.array([n for _, n in grams], np.int64)[order]))

    def find_hot(self, level: int, context: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Place of each context (a column) among the hot ones, or -1."""
        kept, grams, _ = self.hot[level - 1]
        if not len(kept):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(kept, h), len(kept) - 1)
        return np.where((grams[:, at] == context).all(axis=0), at, -1)

    def shard_of(self, level: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of n-grams (columns): their shards, and the places of their contexts among the hot ones."""
        h = _hash(grams[:-1])
        hot = self.find_hot(level, grams[:-1], h)
        dealt = np.where(hot >= 0, mix64(h ^ mix64(grams[-1].astype(np.uint64))), h)
        return (dealt % np.uint64(self.shards)).astype(np.int64), hot


@dataclass
class _Walk:
    """A block's tokens with a begin mark before each text, and the distinct n-grams of each level."""

    place: np.ndarray  # where tokens are, not begin marks
    unigram: np.ndarray  # probability of each token
    learns: np.ndarray  # whether the text trains
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # n-grams (columns, in order), their contexts' ranks, where tokens have one, and which it is


def _walk(model: _Model, row: dict, first: int, last: int) -> _Walk:
    """The n-grams of the levels ``first`` to ``last``."""
    lengths, flat, totals = np.array(row["lengths"], np.int64), _unzip(row["tokens"], np.uint32), _unzip(row["totals"], np.uint64).astype(np.int64)
    size = len(flat) + len(lengths)
    starts = np.cumsum(lengths) - lengths + np.arange(len(lengths))
    place = np.ones(size, bool)
    place[starts] = False
    words, p = np.full(size, model.words, np.int64), np.ones(size)
    words[place] = _unzip(row["number"], np.uint32)[flat]
    p[place] = unigrams(totals, model.total, model.types, model.discount)[flat]
    depth = np.arange(size) - np.repeat(starts, lengths + 1)
    rank, levels = words, []
    for level in range(1, last + 1):
        ok = np.flatnonzero(depth >= level)
        keys, at, back = np.unique(rank[ok - 1] * (model.words + 1) + words[ok], return_index=True, return_inverse=True)
        if level >= first:
            levels.append((np.stack([words[ok[at] - level + j] for j in range(level + 1)]), rank[ok[at] - 1], ok, back))
        rank = np.full(size, -1)
        rank[ok] = back
    return _Walk(place, p, np.repeat(np.array(row["train"], bool), lengths + 1), levels)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _ask_grams(model: _Model, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            walk = _walk(model, row, level, level)
            grams, _, ok, back = walk.levels[0]
            if not grams.size:
                continue
            counts = np.bincount(back[walk.learns[ok]], minlength=grams.shape[1])
            entries = np.vstack([grams, counts]).astype(np.uint32)
            shard, _ = model.shard_of(level, grams)
            parts, packed = _by_shard(shard, model.shards)[1], []
            for part in parts:
                some = entries[:, part]
                some[0] = np.diff(some[0], prepend=np.uint32(0))  # in order, so differences are small
                packed.append(_zip(some))
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[p[0]]) for p in parts], pa.int32()), pa.array([row["block"]] * len(parts), pa.int64()), pa.array(packed, pa.binary())], names=["shard", "block", "grams"])

    return run


def _learn(model: _Model, level: int, hot_share: int):
    """A shard's trie, and its answers: one for each block, and one row with what the shard holds."""

    def run(table: pa.Table) -> pa.Table:
        v, shard, blocks = model.words, table.column("shard")[0].as_py(), table.column("block").to_pylist()
        asked = [_unzip(g, np.uint32).reshape(level + 2, -1) for g in table.column("grams").to_pylist()]
        sizes = np.array([a.shape[1] for a in asked])
        grams = np.concatenate(asked, axis=1).astype(np.int64)
        grams[0] = np.concatenate([np.cumsum(a[0], dtype=np.int64) for a in asked])
        context = np.unique(grams[0], return_inverse=True)[1]
        for j in range(1, level):
            context = np.unique(context * (v + 1) + grams[j], return_inverse=True)[1]
        keys, back = np.unique(context * (v + 1) + grams[level], return_inverse=True)
        n = np.bincount(back, weights=grams[level + 1]).astype(np.int64)
        parent, word = keys // (v + 1), keys % (v + 1)
        parents, one = int(parent[-1]) + 1, np.empty(len(keys), np.int64)
        one[back] = np.arange(len(back))  # a place in ``grams`` where each is
        of_parent = np.empty(parents, np.int64)
        of_parent[parent] = one
        hot = model.find_hot(level, grams[:level, of_parent], _hash(grams[:level, of_parent]))
        followed = np.bincount(parent, n, parents)
        followed[hot >= 0] = model.hot[level - 1][2][hot[hot >= 0]]
        seen = n > 0
        alpha = grid_code((n[seen] - model.discount) / followed[parent[seen]])
        taken = np.bincount(parent[seen], grid_value(alpha), parents)
        bow = np.where((followed > 0) & (hot < 0), grid_code(np.clip(1 - taken, 1e-12, 1)), 0).astype(np.uint16)
        trie = Trie.build([{"parent": parent[seen], "successor": word[seen], "alpha": alpha, "bow": bow, "parents": parents, "universe": v + 1}])
        node = trie.find(0, parent, word)
        found = np.where(node >= 0, trie.alpha(0, node), 0).astype(np.uint16)
        ends = np.cumsum(sizes)
        run_start = np.r_[True, np.diff(context) != 0]
        run_start[ends[:-1]] = True
        weights, runs = trie.bow(0, context[run_start]), np.cumsum(run_start)[ends - 1]
        often, m = np.flatnonzero(n * hot_share > model.total), len(blocks)
        return pa.table({
            "shard": pa.array([shard] * (m + 1), pa.int32()), "block": pa.array([*blocks, None], pa.int64()), "a": pa.array([*(_zip(x) for x in np.split(found[back], ends[:-1])), None], pa.binary()),
            "b": pa.array([*(_zip(x) for x in np.split(weights, runs[:-1])), None], pa.binary()), "size": pa.array([None] * m + [int(seen.sum())], pa.int64()),
            "often": pa.array([None] * m + [[{"gram": grams[: level + 1, one[i]].tolist(), "n": int(n[i])} for i in often]], _OFTEN),
            "parts": pa.array([None] * m + [[{"place": int(hot[i]), "taken": float(taken[i])} for i in np.flatnonzero(hot >= 0)]], _PARTS),
        })

    return run


def _score(model: _Model, order: int):
    def scores(row: dict) -> tuple[np.ndarray, ...]:
        walk, lengths, flat = _walk(model, row, 1, order - 1), np.array(row["lengths"], np.int64), _unzip(row["tokens"], np.uint32)
        p, totals = walk.unigram, _unzip(row["totals"], np.uint64).astype(np.int64)
        answers: list[list[dict]] = [[] for _ in range(order)]
        for answer in sorted(row["answers"] or [], key=lambda x: x["shard"]):
            answers[answer["level"]].append(answer)
        for level, (grams, context, ok, back) in enumerate(walk.levels, 1):
            if not grams.size:
                break
            shard, hot = model.shard_of(level, grams)
            by, _ = _by_shard(shard, model.shards)
            alpha, weight = np.empty(len(by)), np.empty(len(by))
            alpha[by] = grid_value(np.concatenate([_unzip(x["a"], np.uint16) for x in answers[level]]))
            start = np.r_[True, (np.diff(context[by]) != 0) | (np.diff(shard[by]) != 0)]
            codes = np.concatenate([_unzip(x["b"], np.uint16) for x in answers[level]])[np.cumsum(start) - 1]
            weight[by] = np.where(codes > 0, grid_value(codes), 1.0)  # a context that no training text has changes nothing
            weight[hot >= 0] = model.left[level - 1][hot[hot >= 0]]
            p[ok] = alpha[back] + weight[back] * p[ok]
        base = np.log10((totals + 1) / (model.total + model.types + 1))
        at = np.cumsum(lengths) - lengths
        return lengths, np.add.reduceat((totals > 0)[flat].astype(np.int64), at), np.add.reduceat(base[flat], at), np.add.reduceat(np.log10(np.maximum(p[walk.place], 1e-300)), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, row = batch.column("ids").slice(k, 1).flatten(), batch.select(["train", "lengths", "tokens", "number", "totals", "answers"]).slice(k, 1).to_pylist()[0]
                lengths, known, base, score = scores(row)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([not t for t in row["train"]], pa.bool_()), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), model.total, np.int64)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def unigrams(counts: np.ndarray, total: int, types: int, discount: float) -> np.ndarray:
    """Absolute discounting; the discounted mass is that of the one event "unseen"."""
    if not total:
        return np.ones(len(counts))
    return np.where(counts > 0, np.maximum(counts - discount, 1e-9), discount * types) / total


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, order: int = 3, block_tokens: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    rows = rows.withColumn("train", fold("doc_id", modulus) != held_out)
    plain = T.StructType.fromDDL("block long, train array<boolean>, lengths array<int>, tokens binary, words binary, counts binary, number binary, totals binary")
    ids = T.StructField("ids", T.ArrayType(id_type))
    columns = [plain["block"], ids, plain["train"], plain["lengths"], plain["tokens"]]
    blocks = scratch.table("blocks", rows.mapInArrow(_blocks(block_tokens), T.StructType([*columns, plain["words"], plain["counts"]])), "uncompressed")

    n_blocks = blocks.count()
    shards = max(1, n_blocks // 8)  # a block's dictionary is a fraction of its tokens
    asked = blocks.select("block", "words", "counts").mapInArrow(_ask(shards), "shard int, block long, words binary, counts binary")
    totals = scratch.table("words", asked.groupBy("shard").applyInArrow(_answer(shards), _ANSWER + ", stats array<long>"), "uncompressed")
    held = totals.where("block IS NULL")
    types, total, once, twice = held.agg(*(F.coalesce(F.sum(F.element_at("stats", i)), F.lit(0)) for i in range(1, 5))).first()
    words = shards * (held.agg(F.max("size")).first()[0] or 0)
    if words >= (1 << 32) - 1:
        raise ValueError("too many words for numbers of 32 bits")
    begins = blocks.select(F.explode("train").alias("t")).where("t").count()
    model = _Model(max(1, n_blocks), words, total, types, min(0.9, max(0.05, once / max(1, once + 2 * twice))))
    share = min(max(model.shards, _HOT[0]), _HOT[1])
    often = [*_often(held, share, total), ([words], begins)]
    numbered = _with_answers(blocks, totals.where("block IS NOT NULL").select("block", F.lit(0).alias("level"), "shard", "a", "b"))
    numbered = numbered.mapInArrow(_number(shards), T.StructType([*columns, plain["number"], plain["totals"]]))
    numbered = scratch.table("numbered", numbered, "uncompressed")
    scratch.drop("blocks", "words")

    answers = spark.createDataFrame([], "block long, level int, shard int, a binary, b binary")
    for level in range(1, order):
        model.add_hot([x for x in often if x[1] * share > total], level)
        asked = numbered.select("block", "train", "lengths", "tokens", "number", "totals").mapInArrow(_ask_grams(model, level), "shard int, block long, grams binary")
        learned = asked.groupBy("shard").applyInArrow(_learn(model, level, share), _ANSWER + ", parts array<struct<place:int,taken:double>>")
        learned = scratch.table(f"grams-{level}", learned, "uncompressed")
        held = learned.where("block IS NULL")
        often, left = _often(held, share, total), np.ones(len(model.hot[-1][0]))
        for r in held.select(F.inline("parts")).groupBy("place").agg(F.sum("taken").alias("taken")).collect():  # the hot contexts
            left[r["place"]] = min(1.0, max(1e-12, 1 - r["taken"]))
        model.left.append(left)
        answers = answers.union(learned.where("block IS NOT NULL").select("block", F.lit(level).alias("level"), "shard", "a", "b"))

    out = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return _with_answers(numbered, answers).mapInArrow(_score(model, order), out)


def _with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    return blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("level", "shard", "a", "b")).alias("answers")), "block", "left")  # a row for each shard and level


def _often(held: DataFrame, share: int, total: int) -> list[tuple[list[int], int]]:
    """(n-gram, count) of what over one in ``share`` of all tokens is: fewer than ``share``."""
    rows = held.select(F.inline("often")).where(F.col("n") * F.lit(share) > F.lit(total)).collect()
    return [(r["gram"], r["n"]) for r in rows]
