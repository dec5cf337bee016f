"""Near-duplicate detection: SimHash fingerprints, a vantage-point tree, connected components.

Texts with equal fingerprints are one point.  A vantage-point tree, fitted on a bounded
sample of points, gives every point its home leaf.  A branch is skipped when the triangle
inequality shows that it holds nothing within the radius; a point whose ball reaches over
a boundary is also sent, as a query, to the leaves on the outer side.  Each leaf compares
its own points and the queries sent to it, and returns a spanning forest of the links it
finds, never all pairs.  Components of all leaves are joined by distributed star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, pin, row_ids, with_batches

#: Words of a shingle, seed of its hash, and the differing bits up to which fingerprints link.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Points of the sample that the tree is fitted on, at most, and points a leaf should get.
SAMPLE, LEAF = 65_536, 4096
#: Comparisons made at once within a leaf.
BLOCK = 4_000_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint_of(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text as a signed 64-bit integer; 0 for a text without a word."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = [0, *ends[:-words].tolist()]
        stops = (ends[words - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)]
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 4096):
        counts += np.unpackbits(values[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keeps: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` (a long) of every whole text; null and blank texts get 0."""
    return with_batches(docs, [text], docs.columns if keeps is None else keeps, [field("fingerprint", "long")], lambda: lambda texts: ([fingerprint_of(t) for t in texts],))


class Tree:
    """A vantage-point tree over 64-bit points: arrays of vantage points, inner radii and children.

    A child is a node number, or minus a leaf number minus one.
    """

    def __init__(self, sample: np.ndarray, leaves: int, radius: int = RADIUS):
        self.radius, self.points, self.inner, self.children = radius, [], [], []
        self.leaves = 0
        self.root = self.grow(np.unique(sample), max(1.0, len(sample) / max(1, leaves)), np.random.default_rng(SEED))

    def grow(self, sample: np.ndarray, enough: float, rng) -> int:
        split = self.split(sample, rng) if len(sample) > max(2, enough) else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        point, inner, near = split
        node = len(self.points)
        self.points.append(point)
        self.inner.append(inner)
        self.children.append(None)
        self.children[node] = (self.grow(sample[near], enough, rng), self.grow(sample[~near], enough, rng))
        return node

    def split(self, sample: np.ndarray, rng):
        """The vantage point and inner radius with the fewest points near the boundary."""
        best = None
        for point in rng.choice(sample, min(8, len(sample)), replace=False):
            distance = np.bitwise_count(sample ^ point)
            for inner in {int(np.quantile(distance, q, method="lower")) for q in (0.4, 0.5, 0.6)}:
                near = distance <= inner
                if near.any() and not near.all():
                    lost = ((distance > inner - self.radius) & (distance <= inner + self.radius)).mean() + abs(near.mean() - 0.5)
                    if best is None or lost < best[0]:
                        best = lost, (point, inner, near)
        return best and best[1]

    def route(self, points: np.ndarray, home: np.ndarray | None = None):
        """(leaf, index of the point, at home) for each leaf that a point must be compared in, a leaf at a time."""
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool) if home is None else home)]
        while todo:
            node, index, home = todo.pop()
            if not len(index):
                continue
            if node < 0:
                yield -node - 1, index, home
                continue
            distance = np.bitwise_count(points[index] ^ self.points[node]).astype(np.int16)
            inner, reach = self.inner[node], self.radius
            near = distance <= inner
            # a point at home crosses outwards only: of any linked pair, the one inside visits the other
            into = np.where(home, near, distance <= inner + reach)
            out = np.where(home, ~near | (distance > inner - reach), distance > inner - reach)
            todo.append((self.children[node][0], index[into], home[into]))
            todo.append((self.children[node][1], index[out], home[out] & ~near[out]))


def forest(homes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(point, root) edges that connect what links among homes and between queries and homes."""
    points = np.concatenate([homes, queries])
    root = np.arange(len(points))
    step = max(1, BLOCK // max(1, len(homes)))
    for at in range(0, len(points), step):
        a, b = np.nonzero(np.bitwise_count(points[at : at + step, None] ^ homes[None, :]) <= radius)
        a += at
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, up := root[root]):
                root = up
    moved = np.nonzero(root != np.arange(len(points)))[0]
    return points[moved], points[root[moved]]


def deep_forest(homes: np.ndarray, queries: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The same edges for a leaf that holds many more points than it should: a tree of its own divides it further."""
    if len(homes) <= 4 * leaf:
        return forest(homes, queries, radius)
    drawn = np.random.default_rng(SEED).choice(homes, min(SAMPLE, len(homes)), replace=False)
    tree, points = Tree(drawn, -(-len(homes) // leaf), radius), np.concatenate([homes, queries])
    found = []
    for _, index, home in tree.route(points, np.arange(len(points)) < len(homes)):
        part = points[index]
        if tree.leaves == 1 or home.sum() > len(homes) // 2:
            found.append(forest(part[home], part[~home], radius))
        else:
            found.append(deep_forest(part[home], part[~home], radius, leaf))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def links(points: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) that connect all distinct ``fingerprint`` values within ``radius`` bits.

    Their components are those of the graph of all linked pairs; at most one edge per point
    and leaf comes out.  ``points`` must be pinned: it is counted, sampled and read.  The
    tree is fitted on about ``sample`` points; where these are too few for leaves of ``leaf``
    points, a leaf is divided further by the task that compares it.
    """
    total = points.count()
    share = min(1.0, sample / max(1, total))
    drawn = points.where(F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 30)) < int(share * (1 << 30)))
    fitted = np.array([r[0] for r in drawn.select("fingerprint").limit(2 * sample).collect()], dtype=np.int64).view(np.uint64)
    tree = Tree(fitted, -(-total // leaf), radius)
    schema = pa.schema([("leaf", pa.int32()), ("fingerprint", pa.int64()), ("home", pa.bool_())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, index, home in tree.route(points):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), number, np.int32)), pa.array(points[index].view(np.int64)), pa.array(home)], schema=schema)

    def compare(group: pa.Table) -> pa.Table:
        values, home = group.column("fingerprint").to_numpy().view(np.uint64), group.column("home").to_numpy(zero_copy_only=False).astype(bool)
        a, b = deep_forest(np.sort(values[home]), values[~home], radius, leaf)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = points.select("fingerprint").mapInArrow(spread, "leaf int, fingerprint long, home boolean")
    return routed.groupBy("leaf").applyInArrow(compare, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root being the smallest node of its component.

    Large-star and small-star steps in turn; each hangs neighbours on the smallest one they
    see, so hubs are only ever aggregated by a partial minimum.  Every round is pinned, and
    the rounds grow with the logarithm of the longest chain.
    """
    now, seen = pin(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        count, print_ = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, print_) == seen or not count:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = count, print_
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = pin(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) of every row; a component is named by its smallest key.

    Null and blank texts have fingerprint 0 and link like any other.  Repeated rows and
    repeated keys come out as often as they came in.  A null key never names a component
    unless all its keys are null.  Other columns are not read.  An empty table gives no rows.
    """
    marked = pin(fingerprints(docs.select(F.col(key), F.col(text)), text, [key]))
    points = pin(marked.groupBy("fingerprint").agg(F.min(key).alias("first")))
    roots = components(links(points, radius))
    groups = points.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(groups.join(named, "root").select("fingerprint", "component_id"), "fingerprint").select(key, "fingerprint", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest key (a null key comes last); columns as they were.

    Rows are told apart by key and text, so different texts without a key, or with the same
    one, are judged each by itself; of rows equal in both one stays.  Null and blank texts
    are copies of each other.
    """
    given = row_ids(docs, key, text)
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_id").alias("id"))
    found = near_duplicates(given.select(order.alias("_order"), F.col("row").getField(text).alias("_text")), "_order", "_text")
    chosen = found.where(F.col("_order.id") == F.col("component_id.id")).select(F.col("_order.id").alias("_id")).distinct()
    # the semi join and the removal of repeated rows share one exchange and one sort
    return given.select("row", "_id").join(chosen, "_id", "left_semi").dropDuplicates(["_id"]).select("row.*")
