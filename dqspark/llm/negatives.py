"""Hard negatives by segment summaries.

Every vector is stored with the mean and the deviation of its segments, at 1, 4 and 16
segments.  Over a segment of L entries two vectors have an inner product of L times the
product of their means, give or take L times the product of their deviations; the sum over
segments bounds a score from above and below.  Pairs that the bounds rule out go, the rest
meet finer segments, and what is left after the finest is scored exactly.

Anchors are a stated query set.  They are taken in blocks of bounded size, and each block
meets all rows where these lie: a task keeps the best rows of each anchor only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import field, pin, with_batches
from .vectors import common_length, matrix

#: Segments at each level; a level's segments divide those of the one before.
LEVELS = (1, 4, 16)
#: Anchors of a block, about; anchors and rows that are compared at once.
BLOCK, TILE = 2048, 1024
#: Entries beyond this size count as this size, so that scores are longs.
MOST = 1 << 26
LOW, HIGH = -(1 << 62), 1 << 62


def bounds_of(d: int, segments: int) -> np.ndarray:
    return np.array([i * d // segments for i in range(segments + 1)])


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all segments of all levels, a row per vector."""
    x, means, devs = x.astype(np.float64), [], []
    for segments in LEVELS:
        ends = bounds_of(x.shape[1], segments)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            part = x[:, a:b] if b > a else np.zeros((len(x), 1))
            middle = part.mean(axis=1)
            means.append(middle)
            devs.append(np.sqrt(((part - middle[:, None]) ** 2).mean(axis=1)))
    return np.stack(means, axis=1), np.stack(devs, axis=1)


class Tile:
    """Vectors with what their bounds need: at each level means and deviations times the root of the segment length."""

    def __init__(self, ids, labels, x, means, devs):
        self.ids, self.labels, self.x, self.top = ids, labels, x, int(np.abs(x).max(initial=0))
        self.levels, at = [], 0
        for segments in LEVELS:
            root = np.sqrt(np.diff(bounds_of(x.shape[1], segments)))
            self.levels.append((means[:, at : at + segments] * root, devs[:, at : at + segments] * root))
            at += segments

    def scores(self, other: Tile, columns: np.ndarray) -> np.ndarray:
        """Exact inner products with the other's chosen rows."""
        if self.top * other.top * self.x.shape[1] < 1 << 53:
            return (self.x.astype(np.float64) @ other.x[columns].astype(np.float64).T).astype(np.int64)
        return self.x @ other.x[columns].T


def survivors(anchors: Tile, rows: Tile, mask: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, mask over them) of the pairs whose bounds reach into [low, high] of their anchor at every level."""
    columns = np.nonzero(mask.any(axis=0))[0]
    for (am, ad), (rm, rd) in zip(anchors.levels, rows.levels, strict=True):
        mask = mask if len(columns) == mask.shape[1] else mask[:, columns]
        if not len(columns):
            break
        middle, spread = am @ rm[columns].T, ad @ rd[columns].T
        spread = spread * (1 + 1e-9) + np.abs(middle) * 1e-9 + 1e-3
        mask = mask & (middle + spread >= low[:, None]) & (middle - spread <= high[:, None])
        left = mask.any(axis=0)
        columns, mask = columns[left], mask[:, left]
    return columns, mask


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def index(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, x, means, devs) of the rows that take part, pinned; one row for each id."""
    given = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("x"))
    given = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("x", lambda e: e.isNotNull()), F.lit(False)))
    d = common_length(given, "x")
    held = given.where(F.size("x") == (d or 0)).withColumn("x", F.transform("x", lambda e: F.least(F.greatest(e, F.lit(-MOST)), F.lit(MOST))))
    one = held.groupBy("id").agg(F.min(F.struct("label", "x")).alias("row")).select("id", "row.label", "row.x")

    def start():
        def work(lists):
            means, devs = summaries(np.array(lists, dtype=np.int64).reshape(len(lists), d or 0))
            return means.tolist(), devs.tolist()

        return work

    return pin(with_batches(one, ["x"], ["id", "label", "x"], [field("means", "array<double>"), field("devs", "array<double>")], start, rows=TILE))


def tiles(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[Tile]:
    parts, width = (b.slice(at, TILE) for b in batches for at in range(0, b.num_rows, TILE)), sum(LEVELS)
    for part in parts:
        ids, labels, x, means, devs = part.columns
        flat = [c.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width) for c in (means, devs)]
        yield Tile(ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False), matrix(x, d), *flat)


def positives_of(rows: DataFrame, anchors: list[Tile], d: int, k: int) -> dict[int, list[tuple[int, int]]]:
    """The k best other rows of the same label for each anchor: id -> [(id, score)], best first."""

    def run(batches):
        kept = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tile.ids] for tile in anchors]
        least = [np.full(len(tile.ids), LOW, dtype=np.int64) for tile in anchors]
        for rows in tiles(batches, d):
            for tile, own, floor in zip(anchors, kept, least, strict=True):
                mask = (tile.labels[:, None] == rows.labels) & (tile.ids[:, None] != rows.ids)
                columns, mask = survivors(tile, rows, mask, floor, np.full(len(floor), HIGH))
                if not len(columns):
                    continue
                scores = tile.scores(rows, columns)
                mask &= scores >= floor[:, None]
                for i in np.nonzero(mask.any(axis=1))[0]:
                    at = np.nonzero(mask[i])[0]
                    own[i] = best(np.concatenate([own[i][0], scores[i, at]]), np.concatenate([own[i][1], rows.ids[columns[at]]]), k)
                    if len(own[i][0]) == k:
                        floor[i] = own[i][0][-1]
        made = [(a, int(p), int(s)) for tile, own in zip(anchors, kept, strict=True) for a, (ss, ps) in zip(tile.ids.tolist(), own, strict=True) for s, p in zip(ss, ps, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in range(3)], names=["anchor_id", "positive_id", "positive_score"])

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    out: dict[int, list[tuple[int, int]]] = {}
    for r in found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).orderBy("anchor_id", "n").collect():  # at most k for each anchor of a block
        out.setdefault(r.anchor_id, []).append((r.positive_id, r.positive_score))
    return out


def negatives_of(rows: DataFrame, anchors: list[Tile], positives: dict[int, list[tuple[int, int]]], d: int, k: int, band: tuple[int, int]) -> DataFrame:
    """The k best rows of another label within the band of each (anchor, positive)."""
    plans = []
    for tile in anchors:
        given = [positives.get(int(a), []) for a in tile.ids]
        width = max(map(len, given), default=0)
        low, high = np.full((len(given), width), HIGH, dtype=np.int64), np.full((len(given), width), LOW, dtype=np.int64)
        for i, listed in enumerate(given):
            for j, (_, score) in enumerate(listed):
                low[i, j], high[i, j] = -(-band[0] * score // 100), band[1] * score // 100
        plans.append((tile, given, low, high))

    def run(batches):
        kept = [[[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in listed] for listed in given] for _, given, _, _ in plans]
        floors = [low.copy() for _, _, low, _ in plans]
        for rows in tiles(batches, d):
            for (tile, _, _, high), own, floor in zip(plans, kept, floors, strict=True):
                if not floor.shape[1]:
                    continue
                low, top = floor.min(axis=1), np.where(floor <= high, high, LOW).max(axis=1)
                columns, mask = survivors(tile, rows, tile.labels[:, None] != rows.labels, low, top)
                if not len(columns):
                    continue
                scores = tile.scores(rows, columns)
                mask &= (scores >= low[:, None]) & (scores <= top[:, None])
                for i in np.nonzero(mask.any(axis=1))[0]:
                    at = np.nonzero(mask[i])[0]
                    seen, ids = scores[i, at], rows.ids[columns[at]]
                    for j in range(len(own[i])):
                        fits = (seen >= floor[i, j]) & (seen <= high[i, j])
                        if fits.any():
                            own[i][j] = best(np.concatenate([own[i][j][0], seen[fits]]), np.concatenate([own[i][j][1], ids[fits]]), k)
                            if len(own[i][j][0]) == k:
                                floor[i, j] = own[i][j][0][-1]
        made = [
            (int(a), p, int(n), score, int(s))
            for (tile, given, _, _), own in zip(plans, kept, strict=True) for a, listed, lists in zip(tile.ids, given, own, strict=True)
            for (p, score), (ss, ns) in zip(listed, lists, strict=True) for s, n in zip(ss, ns, strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in range(5)], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(
    df: DataFrame, anchor: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores being inner products of whole-number vectors.

    ``anchor`` makes a condition of the key.  An anchor's positives are its best other rows of
    the same label; for each, the best rows of another label whose score lies within
    ``band`` percent of the positive's score are its negatives.  Higher scores come first,
    ties by the smaller key.  Rows with a null key, label, vector or entry take no part, nor
    do vectors of another length than most have; of rows that share a key the one with the
    smallest (label, vector) does.  Keys and labels are whole numbers.  Entries beyond
    ±2**26 count as that.  No rows, no anchors or no negatives give no rows.  Other columns
    are not read.
    """
    rows = index(df.select(*dict.fromkeys([key, vector, label])), key, vector, label)
    asked = rows.where(F.coalesce(anchor(F.col("id")), F.lit(False)))
    first, total = rows.select(F.size("x")).first(), asked.count()
    d, parts, made = (first[0] if first else 0), max(1, -(-total // block)), []
    for part in range(parts):
        # keys are different, so their hashes fill the parts evenly
        chosen = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id").collect()
        anchors = []
        for at in range(0, len(chosen), TILE):
            some = chosen[at : at + TILE]
            x = np.array([r.x for r in some], dtype=np.int64).reshape(len(some), d)
            anchors.append(Tile(np.array([r.id for r in some]), np.array([r.label for r in some]), x, np.array([r.means for r in some]), np.array([r.devs for r in some])))
        best_rows = positives_of(rows, anchors, d, positives) if anchors else {}
        found = negatives_of(rows, anchors, best_rows, d, negatives, band)
        made.append(pin(found) if parts > 1 else found)
    return reduce(DataFrame.unionByName, made)

