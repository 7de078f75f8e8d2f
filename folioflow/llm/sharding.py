"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of a ring; a row belongs to the next point clockwise of its key's hash. No shard takes
more rows than its bound. Rows that find their shard full continue clockwise to the next point of a shard with room, in
rounds; every round with an overflow fills a shard, so there are at most as many rounds as shards. With ``slack`` 0 the
bounds add up to the number of rows, hence row counts differ by at most one (law ``rows``).

The ring is cut into a fixed number of bins. Only the bins' row counts reach the driver, which plans for each bin which
ranks go to which shard. A row's rank within its bin comes from a window over (bin, part), where ``part`` spreads a bin
over up to ``PARTS`` tasks by the row's place in the input: a key that holds a third of all rows is ranked in parallel.

Rows are sharded one by one, repeated rows too; equal texts are not kept together. A null text has size 1 and the crc of
the empty text; a null id is an ordinary key. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import Scratch

PARTS = 32


def ring(shards: int, vnodes: int, bins: int) -> list[int]:
    """The shards met clockwise from each bin's start, as positions of a sorted list of points."""
    return sorted((xxhash.xxh3_64_intdigest(f"shard {s} node {v}".encode()) % bins, s, v) for s in range(shards) for v in range(vnodes))


def plan(counts: dict[int, int], shards: int, vnodes: int, bins: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(bin, from rank, to rank, shard, first slot) for all rows. ``counts``: rows of each bin."""
    total, points = sum(counts.values()), ring(shards, vnodes, bins)
    extra = int(slack * total / shards)
    room = [total // shards + (s < total % shards) + extra for s in range(shards)]
    slot, out = [0] * shards, []
    starts = [p[0] for p in points]
    waiting = [(b, 0, n, bisect_left(starts, b) % len(points)) for b, n in sorted(counts.items())]
    while waiting:
        turned_away = []
        for b, lo, hi, at in waiting:
            for _ in range(len(points)):
                if room[points[at][1]]:
                    break
                at = (at + 1) % len(points)
            s = points[at][1]
            taken = min(room[s], hi - lo)
            if taken:
                out.append((b, lo, lo + taken, s, slot[s]))
                slot[s] += taken
                room[s] -= taken
            if lo + taken < hi:
                turned_away.append((b, lo + taken, hi, (at + 1) % len(points)))
        waiting = turned_away
    return out


def shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 64, bins: int = 4096, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row. The plan sent to the driver has at most ``bins`` counts."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = scratch.table(
        "rows",
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(F.lit(41), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
            F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"),
        ).withColumn("bin", F.pmod("key", F.lit(bins)).cast("int")),
    )
    counts = scratch.table("counts", rows.groupBy("bin", "part").agg(F.count(F.lit(1)).alias("n")))
    segments = plan({r.bin: r.n for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}, shards, vnodes, bins, slack)
    starts = counts.select("bin", "part", (F.sum("n").over(Window.partitionBy("bin").orderBy("part")) - F.col("n")).alias("start"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "part").orderBy("key", "doc_id", "text_crc32", "size")) - 1)
    ranked = ranked.join(starts, ["bin", "part"]).withColumn("rank", F.col("rank") + F.col("start"))
    # at most one segment more for each shard and round than there are bins
    to = spark.createDataFrame(segments, "bin int, lo long, hi long, shard int, first long")
    return (
        ranked.join(F.broadcast(to), "bin")
        .where("rank >= lo AND rank < hi")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"))
    )
