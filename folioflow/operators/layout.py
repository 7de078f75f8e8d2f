"""Spatial joins, reading order and grouping on positioned text.

All joins are equi-joins on the page with range conditions, so a page's rows meet and nothing else does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.geometry import overlap_ratio, rect, x_overlap_ratio
from folioflow.session import ship

PAGE = ("paper_id", "page_no")


def reading_order(elements: DataFrame, page=PAGE) -> DataFrame:
    """``read_no`` by row buckets of 8 units, then from left to right, then by ``insert_no``."""
    order = Window.partitionBy(*page).orderBy(F.floor(F.col("y0") / 8), F.bround("x0", 1), "insert_no")
    return elements.withColumn("read_no", F.row_number().over(order))


def bounding_boxes(elements: DataFrame, by: list[str]) -> DataFrame:
    return elements.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def upper_median(values: Column) -> Column:
    """Of a collected array: the element at n // 2 of the sorted values."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def captions_with_body(captions: DataFrame, blocks: DataFrame, above: float = 170, below: float = 120, least: float = 0.18, page=PAGE) -> DataFrame:
    """Pairs of caption and block that lie within reach of each other and over each other."""
    c, b = captions.alias("c"), blocks.alias("b")
    over = (F.col("b.y1") <= F.col("c.y0")) & (F.col("c.y0") - F.col("b.y0") <= above)
    under = (F.col("b.y0") >= F.col("c.y1")) & (F.col("b.y0") - F.col("c.y1") <= below)
    same = [F.col(f"c.{p}") == F.col(f"b.{p}") for p in page]
    near = (over | under) & (x_overlap_ratio(rect("b."), rect("c.")) > least)
    return c.join(b, [*same, near])


def nearest(left: DataFrame, right: DataFrame, page=PAGE, limit: float = 32.0) -> DataFrame:
    """For each left row the right row with the closest middle height, the first of equals, if it is near enough."""
    middle = lambda p: (F.col(f"{p}.y0") + F.col(f"{p}.y1")) / 2
    pairs = left.alias("l").join(right.alias("r"), [F.col(f"l.{p}") == F.col(f"r.{p}") for p in page])
    pairs = pairs.withColumn("distance", F.abs(middle("l") - middle("r"))).where(F.col("distance") <= limit)
    first = Window.partitionBy(*(f"l.{p}" for p in page), "l.insert_no").orderBy("distance", "r.insert_no")
    return pairs.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def outside(blocks: DataFrame, crops: DataFrame, share: float = 0.35, page=PAGE) -> DataFrame:
    """Blocks that no crop covers by more than ``share``."""
    same = [F.col(f"b.{p}") == F.col(f"c.{p}") for p in page]
    return blocks.alias("b").join(crops.alias("c"), [*same, overlap_ratio(rect("b."), rect("c.")) > share], "left_anti")


def inside(blocks: DataFrame, crops: DataFrame, share: float = 0.35, page=PAGE) -> DataFrame:
    same = [F.col(f"b.{p}") == F.col(f"c.{p}") for p in page]
    return blocks.alias("b").join(crops.alias("c"), [*same, overlap_ratio(rect("b."), rect("c.")) > share], "left_semi")


def islands(rows: DataFrame, number: str, by: list[str], order: list[str], top: str, bottom: str, gap: float = 26.0) -> DataFrame:
    """``group_no``: a new group starts unless the number follows the previous one and the gap is small."""
    w = Window.partitionBy(*by).orderBy(*order)
    follows = (F.col(number) == F.lag(number).over(w) + 1) & (F.col(top) - F.lag(bottom).over(w) <= gap)
    starts = F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("_starts", starts).withColumn("group_no", F.sum("_starts").over(w)).drop("_starts")


def caption_groups(captions: DataFrame, reach: float = 18.0, page=PAGE) -> DataFrame:
    """``group_no``: table captions level with the first of a group join it; every other caption is a group. Order is that of
    ``insert_no``, of equal ones that of their kind and height."""

    @F.arrow_udf("array<long>")
    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def fold(rows):
            anchors = []
            for row in rows:
                found = next((i for i, (kind, y) in enumerate(anchors) if kind == row["kind"] == "table" and abs(y - row["y0"]) <= reach), None)
                if found is None:
                    found = len(anchors)
                    anchors.append((row["kind"], row["y0"]))
                yield found

        for pages in batches:
            yield pa.array([list(fold(rows)) for rows in pages.to_pylist()], pa.list_(pa.int64()))

    row = F.struct("insert_no", "kind", "y0", F.struct(*captions.columns).alias("row"))
    whole = captions.groupBy(*page).agg(F.array_sort(F.collect_list(row)).alias("rows"))  # a page's captions
    keys = F.transform("rows", lambda r: F.struct(r["kind"].alias("kind"), r["y0"].alias("y0")))
    pairs = whole.select("rows", numbers(keys).alias("numbers")).select(F.inline(F.arrays_zip("rows", "numbers")))
    return pairs.select("rows.row.*", F.col("numbers").alias("group_no"))


def _meet(a, b):
    """The common rectangle, or None if it has no area."""
    r = (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
    return r if r[0] < r[2] and r[1] < r[3] else None


def _join(a, b):
    """The rectangle around both; one without area adds nothing."""
    if b[0] >= b[2] or b[1] >= b[3]:
        return a
    if a[0] >= a[2] or a[1] >= a[3]:
        return b
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def _share(a, b) -> float:
    """Of the first rectangle's area."""
    m = _meet(a, b)
    return (m[2] - m[0]) * (m[3] - m[1]) / ((a[2] - a[0]) * (a[3] - a[1])) if m else 0.0


def _around(r, page, margin: float):
    return (max(r[0] - margin, page[0]), max(r[1] - margin, page[1]), min(r[2] + margin, page[2]), min(r[3] + margin, page[3]))


def _is_label(text, cluster, page, figure: bool) -> bool:
    """Whether a text near a cluster belongs to it: body text beside a figure does not."""
    if not figure:
        return _meet(text, _around(cluster, page, 26)) is not None
    tight = _around(cluster, page, 10)
    x, y = (text[0] + text[2]) / 2, (text[1] + text[3]) / 2
    overlaps = _share(text, tight) > 0.35
    if text[2] - text[0] > (page[2] - page[0]) * 0.38 and text[3] - text[1] > 26 and not overlaps:
        return False
    return overlaps or (tight[0] <= x <= tight[2] and tight[1] <= y <= tight[3])


def _cluster(rows, above: bool, page, figure: bool, grouped: bool):
    """The box that grows over (kind, box) candidates, and how many it took; None without candidates."""
    drawn = [i for i, (kind, _) in enumerate(rows) if kind != "text"]
    pool = drawn or range(len(rows))
    if not pool:
        return None, 0
    first = max(pool, key=lambda i: (rows[i][1][3], -i)) if above else min(pool, key=lambda i: (rows[i][1][1], i))
    box, used = rows[first][1], {first}
    if drawn and grouped:
        edge = box[3] if above else box[1]
        for i in drawn:
            r = rows[i][1]
            if (r[3] >= edge - 120 and r[1] <= edge + 12) if above else (r[1] <= edge + 120 and r[3] >= edge - 12):
                box = _join(box, r)
                used.add(i)
    else:
        reach, grown = 28 if drawn else 42, True
        while grown:
            grown = False
            for i in pool:
                r = rows[i][1]
                if _share(r, box) > 0.05 or -8 <= (box[1] - r[3] if above else r[1] - box[3]) <= reach:
                    used.add(i)
                    new = _join(box, r)
                    grown, box = grown or new != box, new
    if drawn:
        window = _around(box, page, 26)
        for i, (kind, r) in enumerate(rows):
            if kind == "text" and _meet(r, window) and _is_label(r, box, page, figure):
                box = _join(box, r)
                used.add(i)
    return (max(box[0], page[0]), max(box[1], page[1]), min(box[2], page[2]), min(box[3], page[3])), len(used)


def _nearest_cluster(captions, kind: str, page, rows):
    """Box, direction and size of the cluster above a group of captions, or below it if none is near above."""
    g = captions[0]
    for c in captions[1:]:
        g = _join(g, c)
    if len(captions) > 1:
        left, right = g[0] - 35, g[2] + 35
    elif g[2] - g[0] > (page[2] - page[0]) * 0.55:
        left, right = page[0], page[2]
    else:
        margin = 25 if kind == "figure" else 45
        left, right = g[0] - margin, g[2] + margin
    left, right = max(left, page[0]), min(right, page[2])
    near = [(k, r) for k, r in rows if max(0.0, min(r[2], right) - max(r[0], left)) / max(r[2] - r[0], 1.0) > 0.15]
    for above in (True, False):
        side = [(k, r) for k, r in near if (r[3] <= g[1] - 2 if above else r[1] >= g[3] + 2)]
        box, n = _cluster(side, above, page, kind == "figure", len(captions) > 1)
        if box is not None and (g[1] - box[3] if above else box[1] - g[3]) <= 80:
            return box, "above" if above else "below", n
    return None, "above", 0


def visual_clusters(captions: DataFrame, primitives: DataFrame, page=PAGE) -> DataFrame:
    """For each group of captions (``group_no``; ``insert_no`` is its first) the box of its table or figure.

    Captions have ``kind`` and the page's ``width`` and ``height``, primitives have ``kind``. Candidates lie over or
    under the caption, in a window that depends on the group, its width and kind. The box starts at the one nearest
    to the caption and grows over those that it overlaps or that follow within 28 units (42 where all are texts), a
    group's over a band of 120; labels are added, body text beside a figure is not. It counts if it is within 80 units
    above, else if it is within 80 below; without one it is null and ``direction`` "above". Order matters and is that of ``insert_no``.
    """

    ship(captions.sparkSession)
    sides = ("x0", "y0", "x1", "y1")

    @F.arrow_udf("array<struct<insert_no:long,x0:double,y0:double,x1:double,y1:double,direction:string,n:long>>")
    def grow(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        box = lambda r: tuple(r[s] for s in sides)

        def found(captions, things):
            rows, groups = [(t["kind"], box(t)) for t in things or ()], {}
            for c in captions:
                groups.setdefault(c["group_no"], []).append(c)
            for group in groups.values():
                first = group[0]
                crop, direction, n = _nearest_cluster([box(c) for c in group], first["kind"], (0.0, 0.0, first["width"], first["height"]), rows)
                yield dict(zip(("insert_no", *sides, "direction", "n"), (first["insert_no"], *(map(float, crop) if crop is not None else (None,) * 4), direction, n)))

        kind = pa.list_(pa.struct([("insert_no", pa.int64()), *((s, pa.float64()) for s in sides), ("direction", pa.string()), ("n", pa.int64())]))
        for captions, things in batches:
            yield pa.array([list(found(c, t)) for c, t in zip(captions.to_pylist(), things.to_pylist())], kind)

    wide = [F.col(s).cast("double").alias(s) for s in (*sides, "width", "height")]
    left = captions.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col("insert_no").cast("long").alias("insert_no"), "group_no", "kind", *wide))).alias("captions"))  # a page's captions
    right = primitives.groupBy(*(F.col(p).alias(f"_{p}") for p in page)).agg(F.array_sort(F.collect_list(F.struct("insert_no", "kind", *wide[:4]))).alias("things"))  # what a page shows
    pairs = left.join(right, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in page], "left")
    return pairs.select(*page, F.inline(grow("captions", "things")))
