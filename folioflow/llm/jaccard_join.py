"""N-gram Jaccard join by parity sketches.

A text's set holds the 64-bit hashes of its distinct five-word shingles. Sets with Jaccard similarity of ``percent`` / 100
differ in a bounded number of elements: |A xor B| <= D = (a + b) / 9 at 80 percent, and their sizes are within 4 : 5.

*Sketches.* XOR-hashing every element into a sketch flips one bit of one part; equal elements cancel, so the number of
differing parts, and the Hamming distance of the sketches, never exceed |A xor B|. Sizes fall into bands [2^k, 2^(k+1));
a band has its own number of parts, and a set also joins the band below if partners can lie there.

*Pigeonhole.* Of a set's non-empty parts at most D differ from a partner's. Order the parts' patterns by any rule that
all sets share, and two partners hold m common patterns among their first D + m: the prefix that is joined on. Fewer than m
(``EXTRA`` + 1, or all that a small set has beyond D) common patterns rule a pair out. The order puts
patterns that a sample shows to be frequent last, so widely shared passages hardly ever reach a prefix; it changes the
work only, never the result. A set with too few non-empty parts for its prefix makes the join start over with more parts.
Pairs whose smaller set has at most ``SMALL`` elements have a band for each pair of sizes, in which every element is a part and
the prefix as short as those sizes allow; sizes that only equal sets can link have none. So short texts that share frequent
shingles do not meet.

*Links.* Equal sets are one class and copies are never paired. Within a pattern's group every class is paired with the
group's first and last class only; a folded sketch drops hopeless pairs, the rest are verified on the exact sets.
Connected classes then need no further pairs to be connected: a second join of the groups emits pairs of different components
only. Components come from iterated minimum labels with pointer jumping over tables in the shared folder.

*Counts.* Every link joins two classes of one component, so all links of a class are counted there: a component's classes are
dealt into blocks, and each two blocks that share a pattern are compared on the exact sets by matrix products, which yield
counts and no rows for pairs. The work still grows with the square of a component, spread over its pairs of blocks.

Classes are told apart by 128-bit hashes of their sets, texts by two 64-bit hashes, shingles by 64-bit hashes, of which a
pair would need several equal by chance to link. Null ids take part in links but never name a component unless all of its
ids are null. Null, empty and wordless texts have an empty set, link with nothing, and have their own id as component.
Repeated rows and ids are rows of their own. A tie for the smallest id is one id. A very long text is one set like any
other. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.words import HASHES, byte_list, keep_only, mix64
from folioflow.session import Scratch, ship

SHINGLE = 5
FOLDED = 8  # longs of the folded sketch
EXTRA = 7  # patterns beyond the first D + 1
TOKEN_BANDS = 6  # below 2^6 elements each element is a part
SMALL = 16  # up to so many elements in the smaller set, pairs are joined by their sizes
BLOCK = 256  # classes of a component that are compared at once
BLOCK_ELEMENTS = 1 << 20  # and about so many elements of theirs
_HOT = 1024
_SEED = np.uint64(0x9FB21C651E98DF25)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = HASHES.of((text or b"").lower().split())
    n = len(h) - size + 1
    if not len(h):
        return h
    if n <= 0:
        total = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            total = total + h[k : k + 1] * _STEPS[k]
        return mix64(mix64(total))
    total = h[:n] * _STEPS[0]
    for k in range(1, size):
        total = total + h[k : k + n] * _STEPS[k % len(_STEPS)]
    return np.unique(mix64(total))


def differ_at_most(a: int, b: int, percent: int) -> int:
    """The largest |A xor B| of linked sets with sizes a and b."""
    return (100 - percent) * (a + b) // (100 + percent)


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, D) of each band in which a set of this size is joined with sets of more than ``SMALL`` elements."""
    if size <= SMALL:
        return []
    band, largest = size.bit_length() - 1, 100 * size // percent
    out = [(band, differ_at_most(size, largest, percent))]
    if 1 << band > max(SMALL + 1, (percent * size + 99) // 100):
        out.append((band - 1, differ_at_most(size, (1 << band) - 1, percent)))
    return out


def size_pairs(size: int, percent: int) -> list[tuple[int, int]]:
    """(partner's size, prefix) of each size, with which a pair is small, that a different linked set can have."""
    out = []
    for other in range(-(-percent * size // 100), 100 * size // percent + 1):
        common = -(-percent * (size + other) // (100 + percent))
        if other and min(size, other) <= SMALL and (common < size or common < other) and common <= min(size, other):
            out.append((other, size - common + 1))
    return out


def elements(s: np.ndarray) -> np.ndarray:
    """A code of each element, for small sets and those that small sets are joined with."""
    return mix64(s ^ _SEED)


def rare_first(codes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return codes
    late = hot[np.minimum(np.searchsorted(hot, codes), len(hot) - 1)] == codes
    return np.concatenate([codes[~late], codes[late]])


def patterns(s: np.ndarray, band: int, spread: int) -> np.ndarray:
    """A 64-bit code of each non-empty part of the sketch of ``s`` in a band."""
    seed = np.uint64(0x632BE59BD9B4E019 * (band + 1) & 0xFFFFFFFFFFFFFFFF)
    bits = mix64(s ^ seed)
    if band < TOKEN_BANDS:
        return bits
    parts = spread << band
    at = (s >> np.uint64(20)) % np.uint64(parts)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return mix64(np.bitwise_xor.reduceat(bits[order], first) ^ (at[first] * np.uint64(0x9FB21C651E98DF25)))


def prefix(s: np.ndarray, percent: int, spread: int, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """The patterns a set is joined on, and how many of them a partner shares at least; below 1 there are too few."""
    out, need = [np.empty(0, np.uint64)], EXTRA + 1 if len(s) > SMALL else 1
    for band, most in bands(len(s), percent):
        keys = np.unique(patterns(s, band, spread))
        need = min(need, len(keys) - most)
        if len(keys) > most + 1 + EXTRA:
            keys = rare_first(keys, hot)[: most + 1 + EXTRA]
        out.append(keys)
    if pairs := size_pairs(len(s), percent):
        codes = rare_first(np.sort(elements(s)), hot)
        out += [mix64(codes[:n] ^ mix64(np.array([min(len(s), m) << 20 | max(len(s), m)], np.uint64))) for m, n in pairs]
    return np.concatenate(out), need


def parities(s: np.ndarray, bits: int) -> np.ndarray:
    """The sketch of a set folded to so many bits, a power of two, as longs."""
    flips = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def wide_sketch(s: np.ndarray) -> bytes | None:
    """For sets that the folded sketch can't tell apart: eight to sixteen bits for each element."""
    return parities(s, 8 << len(s).bit_length()).tobytes() if len(s) > 48 * FOLDED else None


def wide_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two wide sketches, the wider one folded to the other's width."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``, by products of ``width`` elements at a time."""
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, codes, held = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    codes = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[codes]
    codes, rows = codes[codes >= 0], rows[codes >= 0]
    order = np.argsort(codes, kind="stable")
    codes, rows = codes[order], rows[order]
    same = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        a, b = np.searchsorted(codes, (at, at + width))
        held = np.zeros((len(left) + len(right), width), np.float32)
        held[rows[a:b], codes[a:b] - at] = 1
        same += (held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return same


def _sets_udf(spark, percent: int, spread: int, hot: np.ndarray, size: int, everything: bool):
    shared = spark.sparkContext.broadcast(hot)  # at most `hot_keys` longs
    longs = ",".join(f"k{i}:bigint" for i in range(FOLDED))

    @F.arrow_udf(f"struct<n:int,f1:bigint,f2:bigint,{longs},wide:binary,keys:array<bigint>,need:int>")
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        late, none, seen = shared.value, np.empty(0, np.uint64), set()
        keep_only(HASHES)
        for texts in batches:
            n, f, need, keys, absent, folds, wide, offsets = [], [], [], [], [], [], [], [0]
            for text in byte_list(texts):
                s = shingles(text, size)
                n.append(len(s))
                f.append(xxhash.xxh3_128_intdigest(s.tobytes()))
                if not len(s) or f[-1] in seen:  # one copy of a class in each task is joined on, the others have no keys
                    key, least = None, None
                elif everything:
                    key, least = np.concatenate([elements(s) if size_pairs(len(s), percent) else none, *(patterns(s, b, spread) for b, _ in bands(len(s), percent))]), 1
                else:
                    key, least = prefix(s, percent, spread, late)
                seen.add(f[-1])
                absent.append(key is None)
                keys.append(none if key is None else key)
                offsets.append(offsets[-1] + len(keys[-1]))
                need.append(least)
                folds.append(parities(s, 64 * FOLDED))
                wide.append(wide_sketch(s))
            fold = np.array(folds, np.int64).reshape(-1, FOLDED)
            values = pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64))
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int32()), *(pa.array([(x >> k & (1 << 64) - 1) - (1 << 63) for x in f], pa.int64()) for k in (0, 64)), *(pa.array(np.ascontiguousarray(fold[:, i])) for i in range(FOLDED)), pa.array(wide, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(absent, pa.bool_())), pa.array(need, pa.int32())],
                names=["n", "f1", "f2", *(f"k{i}" for i in range(FOLDED)), "wide", "keys", "need"],
            )

    return sketched.asNondeterministic()


def _hot_patterns(spark, texts: DataFrame, percent: int, spread: int, size: int, hot_keys: int, one_in: int = 64, least: int = 6) -> np.ndarray:
    """Patterns that a sample of one in ``one_in`` texts holds at least ``least`` times: ``hot_keys`` at most."""
    some = texts.where(F.pmod(F.xxhash64(F.lit(29), "_text"), F.lit(one_in)) == 0).select(_sets_udf(spark, percent, spread, np.empty(0, np.uint64), size, True)(F.col("_text")).alias("s"))
    found = _frequent(some.select("s.f1", "s.f2", F.explode("s.keys").alias("key")).distinct(), least, hot_keys).toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _frequent(keys: DataFrame, least: int, most: int) -> DataFrame:
    return keys.groupBy("key").count().where(F.col("count") >= least).orderBy(F.desc("count"), "key").limit(most).select("key")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(f, c): the smallest node reachable from each node of ``edges`` (a, b). Each round is written out."""
    both = scratch.table(f"{name}-edges", edges.select(F.col("a").alias("f"), F.col("b").alias("g")).union(edges.select("b", "a")).distinct())
    labels = scratch.table(f"{name}-0", both.groupBy("f").agg(F.least(F.min("g"), F.col("f")).alias("c")))
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("f").alias("g"), F.col("c").alias("via")), "g").groupBy("f").agg(F.min("via").alias("via"))
        jump = labels.select(F.col("f").alias("c"), F.col("c").alias("root"))
        moved = labels.join(near, "f").join(jump, "c", "left").select("f", F.least("c", "via", F.coalesce("root", "c")).alias("new"), "c")
        moved = scratch.table(f"{name}-{step}", moved.select("f", F.col("new").alias("c"), (F.col("new") != F.col("c")).alias("changed")))
        done = moved.where("changed").limit(1).count() == 0
        scratch.drop(f"{name}-{step - 1}")
        labels = moved.select("f", "c")
        if done:
            return labels


def _text_keys() -> list:
    return [F.xxhash64("_text").alias("t1"), F.xxhash64(F.lit(5), "_text").alias("t2")]


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, size: int, hot_keys: int, broadcast_rows: int, links: bool):
        self.spark, self.percent, self.size, self.broadcast_rows = docs.sparkSession, percent, size, broadcast_rows
        ship(self.spark)
        self.scratch = Scratch(self.spark)
        self.texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        self.hot_keys, self.links = hot_keys, links
        self.exact: list[DataFrame] = []  # (f, s) of classes in verified pairs

    def sets(self) -> DataFrame:
        """One row for each document: id, text key, n, set key, folded sketch, prefix."""
        spread = 1
        while True:
            hot = _hot_patterns(self.spark, self.texts, self.percent, spread, self.size, self.hot_keys)
            rows = self.texts.select(F.col("_id").alias("id"), *_text_keys(), _sets_udf(self.spark, self.percent, spread, hot, self.size, False)(F.col("_text")).alias("s"))
            self.full = f"sets-{spread}"
            rows = self.scratch.table(self.full, rows.select("id", "t1", "t2", "s.*"))
            if rows.where("need < 1").limit(1).count() == 0:
                return rows
            self.scratch.drop(self.full)
            spread *= 4

    def classes(self, sets: DataFrame) -> DataFrame:
        """One row for each distinct set: a number f, its smallest id, how many documents have it, and one text's key."""
        one = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "need", *(f"k{i}" for i in range(FOLDED)), "wide", "keys")]
        rows = sets.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("t1", "t2")).alias("t"), *one)
        return self.scratch.table("classes", rows.select("*", "t.*").drop("t").withColumn("f", F.monotonically_increasing_id()))

    def hashes(self, classes: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
        """(f, s): the sorted set of each class in ``wanted`` (f), from one of its texts."""
        first = self.scratch.table(f"{name}-wanted", classes.join(wanted, "f", "left_semi").select("f", "t1", "t2"))
        rows = self.texts.select(*_text_keys(), "_text")
        # a class is broadcast as three longs; beyond the bound both sides are shuffled, copies of a text once a task
        if first.count() <= self.broadcast_rows:
            rows = rows.join(F.broadcast(first), ["t1", "t2"]).dropDuplicates(["f"])
        else:
            rows = rows.groupBy("t1", "t2").agg(F.first("_text").alias("_text")).join(first, ["t1", "t2"])
        size = self.size

        @F.arrow_udf("array<bigint>")
        def shingle_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array([shingles(t, size).view(np.int64) for t in byte_list(texts)], pa.list_(pa.int64()))

        return self.scratch.table(f"{name}-hashes", rows.select("f", shingle_set(F.col("_text")).alias("s")), "snappy")

    def alike(self, a: str, b: str):
        """Whether sizes and folded sketches of two sides allow a link."""
        n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
        apart = sum((F.bit_count(F.col(f"{a}.k{i}").bitwiseXOR(F.col(f"{b}.k{i}"))) for i in range(1, FOLDED)), F.bit_count(F.col(f"{a}.k0").bitwiseXOR(F.col(f"{b}.k0"))))
        return (100 * F.least(n, m) >= self.percent * F.greatest(n, m)) & (apart * (100 + self.percent) <= (100 - self.percent) * (n + m))

    def narrowed(self, pairs: DataFrame, wides: DataFrame) -> DataFrame:
        """Pairs (a, b, size) without those whose wide sketches differ too much."""
        percent = self.percent

        @F.arrow_udf("boolean")
        def near(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for left, right, sizes in batches:
                rows = zip(left.to_pylist(), right.to_pylist(), sizes.to_pylist())
                yield pa.array([x is None or y is None or wide_distance(x, y) * (100 + percent) <= (100 - percent) * n for x, y, n in rows], pa.bool_())

        rows = pairs.join(wides.select(F.col("f").alias("b"), F.col("wide").alias("wb")), "b", "left").join(wides.select(F.col("f").alias("a"), F.col("wide").alias("wa")), "a", "left")
        return rows.where(near("wa", "wb", "size")).select("a", "b")

    def verified(self, classes: DataFrame, pairs: DataFrame, wides: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose exact sets are similar enough."""
        pairs = self.scratch.table(f"{name}-near", self.narrowed(pairs, wides))
        wanted = pairs.select(F.col("a").alias("f")).union(pairs.select("b")).distinct()
        s = self.hashes(classes, wanted, name)
        rows = pairs.join(s.select(F.col("f").alias("b"), F.col("s").alias("sb")), "b").join(s.select(F.col("f").alias("a"), F.col("s").alias("sa")), "a")
        same = F.size(F.array_intersect("sa", "sb")).cast("long")
        rows = rows.where(100 * same >= self.percent * (F.size("sa") + F.size("sb") - same)).select("a", "b")
        out = self.scratch.table(f"{name}-links", rows)
        self.scratch.drop(*(f"{name}-{x}" for x in ("near", "wanted") + (() if self.links else ("hashes",))))
        self.exact.append(s)
        return out

    def counted(self, classes: DataFrame, comps: DataFrame, keys: DataFrame) -> DataFrame:
        """(f, n_links, n_linked): the linked classes of each class in ``comps``, and their documents."""
        percent, scratch = self.percent, self.scratch
        members = scratch.table("members", comps.join(classes.select("f", "n", "copies"), "f"))
        # a component that fits in a block is one; others are cut by size, then by a hash of the class
        whole = members.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("long")).alias("total")).select("c", ((F.col("k") <= BLOCK) & (F.col("total") <= BLOCK_ELEMENTS)).alias("whole"))
        rows = members.join(whole, "c").withColumn("band", F.when(F.col("whole"), 0).otherwise(1 + F.floor(4 * F.log2("n"))))
        most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_ELEMENTS) / F.max("n"))))
        cuts = rows.where("NOT whole").groupBy("c", "band").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"), F.min("n").alias("least"), F.max("n").alias("largest"))
        rows = rows.join(cuts, ["c", "band"], "left").withColumn("u", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.shiftleft(F.col("band").cast("long"), 48) + F.pmod(F.xxhash64(F.lit(41), "f"), "parts")))
        blocks = scratch.table("blocks", rows.select("f", "c", "copies", "u", "whole", "least", "largest"))
        # linked classes share a pattern, so do their blocks
        on = scratch.table("shared", keys.select("key", "f").join(blocks.where("NOT whole"), "f").select("key", "c", "u", "least", "largest").distinct())
        near = (F.col("x.u") < F.col("y.u")) & (100 * F.col("x.largest").cast("long") >= percent * F.col("y.least").cast("long")) & (100 * F.col("y.largest").cast("long") >= percent * F.col("x.least").cast("long"))
        tiles = on.alias("x").join(on.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.c") == F.col("y.c")) & near).select("x.c", "x.u", F.col("y.u").alias("v")).distinct()
        tiles = scratch.table("tiles", tiles)
        row = blocks.select("f", "c", "copies", "u")
        dealt = row.select("f", "copies", "c", "u", F.col("u").alias("v"), F.lit(0).alias("side"))
        dealt = dealt.union(row.join(tiles, ["c", "u"]).select("f", "copies", "c", "u", "v", F.lit(0))).union(row.withColumnRenamed("u", "v").join(tiles, ["c", "v"]).select("f", "copies", "c", "u", "v", F.lit(1)))
        first, *more = self.exact
        sets = first
        for s in more:
            sets = sets.union(s.join(first.select("f"), "f", "left_anti"))

        def compare(tile: pa.Table) -> pa.Table:
            side, f, copies = (tile[c].to_numpy() for c in ("side", "f", "copies"))
            s = [x.values.to_numpy().view(np.uint64) for x in tile["s"]]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            alone = not len(right)
            right = left if alone else right
            n = np.array([len(x) for x in s])
            same = overlaps([s[i] for i in left], [s[i] for i in right])
            linked = 100 * same >= percent * (n[left][:, None] + n[right][None, :] - same)
            if alone:
                np.fill_diagonal(linked, False)
            sums = [(f[left], linked.sum(1), linked @ copies[right])] + ([] if alone else [(f[right], linked.sum(0), copies[left] @ linked)])
            return pa.table({name: np.concatenate(c).astype(np.int64) for name, c in zip(("f", "n_links", "n_linked"), zip(*sums))})

        found = dealt.join(sets, "f").groupBy("c", "u", "v").applyInArrow(compare, "f long, n_links long, n_linked long")
        out = scratch.table("counts", found.groupBy("f").agg(F.sum("n_links").alias("n_links"), F.sum("n_linked").alias("n_linked")))
        scratch.drop("members", "blocks", "shared", "tiles", "stars-hashes", "pairs-hashes")
        return out

    def run(self) -> DataFrame:
        scratch = self.scratch
        sets = self.sets()
        documents = scratch.table("documents", sets.select("id", "n", "f1", "f2"))
        classes = self.classes(sets)
        scratch.drop(self.full)
        sketches = classes.select("f", "n", "need", *(f"k{i}" for i in range(FOLDED)))
        wides = classes.where("wide IS NOT NULL").select("f", "wide")
        keys = classes.select("f", F.explode("keys").alias("key"))
        # patterns that a sample of the classes shows to be frequent in prefixes, `hot_keys` at most
        warm = scratch.table("warm", _frequent(classes.where(F.pmod(F.xxhash64(F.lit(31), "f1", "f2"), F.lit(64)) == 0).select(F.explode("keys").alias("key")), 6, self.hot_keys))
        group = Window.partitionBy("key")
        cold = keys.join(F.broadcast(warm), "key", "left_anti").repartition("key")
        cold = cold.select("f", "key", F.min("f").over(group).alias("lo"), F.max("f").over(group).alias("hi"))
        # they are not dealt by key: their ends are aggregated where they lie
        warm = keys.join(F.broadcast(warm), "key", "left_semi")
        ends = warm.groupBy("key").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
        warm = warm.join(F.broadcast(ends), "key").select("f", "key", "lo", "hi")
        keys = scratch.table("groups", cold.where("lo < hi").union(warm.where("lo < hi").distinct()))
        stars = keys.where("f > lo").select(F.col("lo").alias("a"), F.col("f").alias("b")).union(keys.where("f < hi").select("f", "hi")).distinct()
        stars = stars.join(sketches.alias("x"), F.col("a") == F.col("x.f")).join(sketches.alias("y"), F.col("b") == F.col("y.f")).where(self.alike("x", "y")).select("a", "b", (F.col("x.n") + F.col("y.n")).alias("size"))
        stars = scratch.table("stars", stars)
        links = self.verified(classes, stars, wides, "stars")
        comps = components(links, scratch, "first")
        # what is left: members of one group in different components
        open_ = keys.select("key", "f").join(comps, "f", "left").withColumn("c", F.coalesce("c", "f"))
        open_ = scratch.table("open", open_)
        mixed = open_.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
        left = scratch.table("left", open_.join(mixed, "key", "left_semi").join(sketches, "f"))
        pairs = left.alias("x").join(left.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.f") < F.col("y.f")) & (F.col("x.c") != F.col("y.c")) & self.alike("x", "y"))
        pairs = pairs.groupBy(F.col("x.f").alias("a"), F.col("y.f").alias("b")).agg(F.first(F.col("x.n") + F.col("y.n")).alias("size"), F.count(F.lit(1)).alias("shared"), F.first(F.least("x.need", "y.need")).alias("need"))
        pairs = pairs.where("shared >= need").select("a", "b", "size")
        pairs = scratch.table("pairs", pairs.join(stars.select("a", "b"), ["a", "b"], "left_anti"))
        if pairs.limit(1).count():
            links = scratch.table("links", links.union(self.verified(classes, pairs, wides, "pairs")))
            comps = components(links, scratch, "second")
        counts = self.counted(classes, comps, keys) if self.links else comps.select("f", *(F.lit(None).cast("long").alias(c) for c in ("n_links", "n_linked")))
        scratch.drop("groups", "open", "left", "stars", "pairs", "warm")
        # the smallest id of each class, then of each component
        named = scratch.table("named", classes.select("f", "f1", "f2", "id", "copies").join(comps, "f", "left").withColumn("c", F.coalesce("c", "f")))
        smallest = named.groupBy("c").agg(F.min("id").alias("component_id"))
        named = scratch.table("components", named.join(smallest, "c").join(counts, "f", "left").select("f1", "f2", "copies", "component_id", F.col("f").alias("set_class"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.coalesce("n_linked", F.lit(0)) + F.col("copies") - 1).alias("n_linked")))
        scratch.drop("classes", "named")
        # classes with over a 1024th of all documents, fewer than 1024, are sent to all executors
        hot = F.col("copies") * _HOT > documents.count()
        full = documents.where("n > 0")
        here = full.join(F.broadcast(named.where(hot)), ["f1", "f2"])
        rest = full.join(F.broadcast(named.where(hot).select("f1", "f2")), ["f1", "f2"], "left_anti").join(named.where(~hot), ["f1", "f2"])
        out = here.unionByName(rest).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id", "set_class", "n_links", "n_linked")
        alone = documents.where("n = 0").select("id", F.lit(0).cast("long"), "id", F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))
        out = out.union(alone)
        return out if self.links else out.drop("n_links", "n_linked")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = SHINGLE, hot_keys: int = 65_536, broadcast_rows: int = 1_000_000, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, set_class, n_links and n_linked of each row: all other classes that link with its class,
    and all other rows that link with it, those of its own class included. Without ``links`` the last two are left out.

    ``hot_keys`` bounds the list of frequent patterns; ``broadcast_rows`` the classes sent to all executors when their
    texts are read again, beyond which that join is shuffled.
    """
    if not 1 <= size <= len(_STEPS):
        raise ValueError(f"shingles of 1 to {len(_STEPS)} words")
    return _Join(docs, id_col, text_col, percent, size, hot_keys, broadcast_rows, links).run()
