"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

Vectors of whole numbers get one more coordinate, ``sqrt(M^2 - |v|^2)`` with ``M`` the greatest norm, and
anchors a zero: the squared distance is then ``|a|^2 + M^2 - 2 * score``, so a window of scores is an annulus.

The tree is fitted on a bounded sample (``SAMPLE`` rows of least id hash): a node takes up to ``ARITY`` split points that lie far
from each other, and a row belongs to the subtree of its nearest one (multiway hyperplanes). All rows are then sent
down the tree, and each split point stores the range of its distances to the rows of every sibling subtree, its own
included. An anchor at distance ``d`` from a split point looks for rows at distances ``[low, high]``: by the
triangle inequality these lie within ``[max(d - high, low - d), d + high]`` of the split point, so
siblings whose stored range doesn't meet that are eliminated. What is left are leaves, whose rows are all scored, in
whole numbers; so results are exact whatever the sample was.

A search has two rounds. Home: each anchor scores a segment of its own leaf, which gives a least score that matters (the
``k``-th best so far). Rest: the tree is searched with the annulus from that score up. Positives have a
window without an upper end, and only rows of the anchor's label count; negatives have a window for each positive, from
``PERCENT`` hundredths of its score up to it, and only rows of other labels count.

Leaves are cut into segments of about ``SEGMENT`` rows, block by block, so a leaf, or one vector, that a third of the rows share
is many units; anchors are cut into slices. A unit (segment, slice) holds one segment in memory
and streams its anchors past it, so the index is shuffled once per slice of ``SLICE`` anchors and
anchors once per segment that the bounds leave them. A unit gives at most ``k`` rows per window.

Defined results: null ids, null labels, null or empty vectors, and vectors with a null or non-finite component take no
part; of rows with one id the one of least (label, vector) counts; vectors whose length isn't the most frequent one
(the greater of equally frequent ones) take no part; an anchor without positives, and a positive without negatives, give no
rows; scores beyond a long are clamped; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, stage

ARITY = 8
SAMPLE = 8192
#: A node that stands for fewer rows is a leaf, as is one at this depth or with so few rows in the sample.
LEAF_ROWS = 8192
NODE_SAMPLE = 32
DEPTH = 3
SEGMENT = 16_384
SLICE = 65_536
#: Negatives score at least so many hundredths of the positive's score.
PERCENT = 80
_EXACT = 2**52
_TOP = 2**63 - 1


@dataclass
class _Node:
    """Split points, and for each child either a node's or, as ``-1 - leaf``, a leaf's number."""

    points: np.ndarray
    children: list[int] = field(default_factory=list)


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None] - 2 * rows @ points.T
    return np.sqrt(np.maximum(square, 0))


def _spread_points(sample: np.ndarray, arity: int) -> np.ndarray:
    """Rows that lie far from each other: each next one has the greatest distance to those taken."""
    chosen = [0]
    least = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < arity and least.max() > 1e-6:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def build(sample: np.ndarray, node_sample: int) -> tuple[list[_Node], int]:
    """The nodes, the root first, and the number of leaves; no node means one leaf."""
    nodes: list[_Node] = []
    leaves = 0

    def grow(rows: np.ndarray, level: int) -> int:
        nonlocal leaves
        points = _spread_points(rows, ARITY) if level < DEPTH and len(rows) > node_sample else rows[:0]
        if len(points) < 2:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(_Node(points))
        nearest = _distances(rows, points).argmin(axis=1)
        for j in range(len(points)):
            nodes[at].children.append(grow(rows[nearest == j], level + 1))
        return at

    grow(sample, 0)
    return nodes, leaves


class _Tree:
    def __init__(self, nodes: list[_Node], leaves: int, norm2: float) -> None:
        self.nodes, self.leaves, self.norm2 = nodes, leaves, norm2
        #: ranges[node][i, j]: least and greatest distance of split point i to the rows of subtree j.
        self.low = [np.full((len(n.points),) * 2, np.inf) for n in nodes]
        self.high = [np.full((len(n.points),) * 2, -np.inf) for n in nodes]

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([vectors, np.sqrt(np.maximum(0, self.norm2 - (vectors**2).sum(axis=1)))[:, None]])

    def descend(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        leaf = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))] if self.nodes else []
        while todo:
            at, which = todo.pop()
            nearest = _distances(rows[which], self.nodes[at].points).argmin(axis=1)
            for j, child in enumerate(self.nodes[at].children):
                mine = which[nearest == j]
                if child < 0:
                    leaf[mine] = -1 - child
                elif len(mine):
                    todo.append((child, mine))
        return leaf

    def paths(self) -> list[list[tuple[int, int]]]:
        """For each leaf its ancestors, as (node, which child)."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(max(1, self.leaves))]
        todo: list[tuple[int, list]] = [(0, [])] if self.nodes else []
        while todo:
            at, path = todo.pop()
            for j, child in enumerate(self.nodes[at].children):
                if child < 0:
                    out[-1 - child] = [*path, (at, j)]
                else:
                    todo.append((child, [*path, (at, j)]))
        return out

    def widen(self, path: list[tuple[int, int]], rows: np.ndarray) -> None:
        """The stored ranges take in rows of the leaf at the end of ``path``."""
        for at, j in path:
            d = _distances(rows, self.nodes[at].points)
            self.low[at][:, j] = np.minimum(self.low[at][:, j], d.min(axis=0))
            self.high[at][:, j] = np.maximum(self.high[at][:, j], d.max(axis=0))

    def reached(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each anchor must visit each leaf; ``low``, ``high``: its annuli, one column a window."""
        found = np.zeros((len(anchors), max(1, self.leaves)), bool)
        if not self.nodes:
            found[:] = (low <= high).any(axis=1)[:, None]
            return found
        todo = [(0, np.flatnonzero((low <= high).any(axis=1)))]
        while todo:
            at, which = todo.pop()
            if not len(which):
                continue
            node = self.nodes[at]
            d = _distances(anchors[which], node.points)[:, None, :]  # anchor, window, split point
            inner, outer = low[which][:, :, None], high[which][:, :, None]
            nearest, farthest = np.maximum(d - outer, inner - d), d + outer
            for j, child in enumerate(node.children):
                meets = (nearest <= self.high[at][:, j]) & (farthest >= self.low[at][:, j])
                alive = (meets.all(axis=2) & (inner <= outer)[:, :, 0]).any(axis=1)
                if child >= 0:
                    todo.append((child, which[alive]))
                else:
                    found[which[alive], -1 - child] = True
        return found

    def annuli(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of scores from ``least`` to ``most``; rounding is allowed for."""
        square = (anchors**2).sum(axis=1)[:, None] + self.norm2
        near = np.sqrt(np.maximum(0, square - 2 * most.astype(np.float64)))
        far = np.sqrt(np.maximum(0, square - 2 * least.astype(np.float64)))
        slack = 1e-6 * np.sqrt(square) + 1e-3
        empty = least > most
        return np.where(empty, 1.0, near - slack), np.where(empty, 0.0, far + slack)


def scores(anchors: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs; in float64 where all sums are exact there, else in whole numbers, clamped."""
    if exact:
        return (anchors @ vectors.T).astype(np.int64)
    a, b = ([[int(x) for x in row] for row in side] for side in (anchors, vectors))
    return np.array([[max(-_TOP, min(_TOP, sum(x * y for x, y in zip(p, q, strict=True)))) for q in b] for p in a], np.int64)


def least_negative(positive: str, percent: int) -> Column:
    """The least score of which a hundred are at least ``percent`` of the positive's, without overflow."""
    rest = 100 - percent
    return F.expr(f"{positive} - (({positive} - pmod({positive}, 100L)) div 100 * {rest} + pmod({positive}, 100L) * {rest} div 100)").cast("long")


def valid_rows(embeddings: DataFrame, vector: Column) -> DataFrame:
    """vec_id, label, vector of the rows that take part, one a vec_id."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), vector.alias("vector"))
    rows = rows.where("vec_id is not null and label is not null and vector is not null and size(vector) > 0")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


_BLOCK = pa.schema([("leaf", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])


def _blocks(shared):
    """Rows of a batch that come into one leaf, as one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, kind = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            leaf = tree.descend(tree.lifted(v))
            order = np.argsort(leaf, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1)
            columns = [
                [int(leaf[p[0]]) for p in parts], [len(p) for p in parts], [ids[p].astype(np.int64).tobytes() for p in parts],
                [labels[p].astype(np.int32).tobytes() for p in parts], [v[p].astype(kind).tobytes() for p in parts],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK.types, strict=True)], schema=_BLOCK)

    return run


_RANGES = pa.schema([("node", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def _ranges(shared):
    """Per task, for each node the ranges of its split points' distances to the rows of its subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, kind = shared.value
        paths = tree.paths()
        for batch in batches:
            for leaf, n, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree.widen(paths[leaf], tree.lifted(np.frombuffer(block, kind).reshape(n, -1).astype(np.float64)))
        nodes = list(range(len(tree.nodes)))
        yield pa.RecordBatch.from_pydict({"node": nodes, "low": [x.ravel() for x in tree.low], "high": [x.ravel() for x in tree.high]}, schema=_RANGES)

    return run


_WINDOW = "array<struct<id:long,least:long,most:long>>"
_VISIT = f"segment long, anchor_id long, label int, vector binary, window {_WINDOW}"


def _visits(shared, home: bool):
    """(anchor_id, label, vector, window) to a row per segment that the anchor must visit.

    ``home``: one segment of the anchor's own leaf; else all segments of the leaves that its windows reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first, kind, exact = shared.value
        counts = np.diff(first)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v = _matrix(part.column(2))
                if home:
                    ids, leaf = part.column(0).to_numpy(), tree.descend(tree.lifted(v))
                    anchor = np.arange(len(v))
                    segment = first[leaf] + (mix64(ids.astype(np.uint64)) % counts[leaf].astype(np.uint64)).astype(np.int64)
                else:
                    anchor, leaf = np.nonzero(_reach(tree, v, part.column(3).to_pylist(), exact))
                    n = counts[leaf]
                    anchor, segment = np.repeat(anchor, n), np.repeat(first[leaf] - (np.cumsum(n) - n), n)
                    segment = segment + np.arange(len(anchor))
                packed = [x.tobytes() for x in v.astype(kind)]
                for i in range(0, len(segment), 4096):
                    which = anchor[i : i + 4096]
                    taken = part.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(segment[i : i + 4096]), taken.column(0), taken.column(1), pa.array([packed[j] for j in which.tolist()], pa.binary()), taken.column(3)],
                        names=["segment", "anchor_id", "label", "vector", "window"],
                    )

    return run


def _reach(tree: _Tree, v: np.ndarray, windows: list, exact: bool) -> np.ndarray:
    if not exact:
        return np.ones((len(v), max(1, tree.leaves)), bool)
    width = max(map(len, windows))
    least, most = np.ones((len(v), width), np.int64), np.zeros((len(v), width), np.int64)
    for i, w in enumerate(windows):
        for j, x in enumerate(w):
            least[i, j], most[i, j] = x["least"], x["most"]
    anchors = np.hstack([v, np.zeros((len(v), 1))])
    return tree.reached(anchors, *tree.annuli(anchors, least, most))


_FOUND = "anchor_id long, window_id long, most long, vec_id long, score long"


def _score_units(shared, same_label: bool, k: int):
    """Streams rows (segment, slice, is_anchor, ids, labels, vectors, anchor_id, label, vector, window): a unit's blocks come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, kind, exact = shared.value
        unit, blocks, held = None, [], None

        def scored(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, labels, vectors = held
            anchors, own = part.column(6).to_numpy(), part.column(7).to_numpy()
            queries = np.frombuffer(b"".join(part.column(8).to_pylist()), kind).astype(np.float64).reshape(part.num_rows, -1)
            s = scores(queries, vectors, exact)
            fits = ((labels[None] == own[:, None]) == same_label) & (ids[None] != anchors[:, None])
            out: list[list] = [[], [], [], [], []]
            for i, windows in enumerate(part.column(9).to_pylist()):
                mine = np.flatnonzero(fits[i])
                value, name = s[i][mine], ids[mine]
                for w in windows:
                    inside = np.flatnonzero((value >= w["least"]) & (value <= w["most"]))
                    if len(inside) > 4 * k:  # the k best and their ties
                        edge = np.partition(value[inside], len(inside) - k)[len(inside) - k]
                        inside = inside[value[inside] >= edge]
                    best = inside[np.lexsort((name[inside], -value[inside]))[:k]]
                    for column, x in zip(out, ([anchors[i]] * len(best), [w["id"]] * len(best), [w["most"]] * len(best), name[best], value[best]), strict=True):
                        column.extend(x)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "window_id", "most", "vec_id", "score"])

        for batch in batches:
            segments, slices_, is_anchor = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            change = (np.diff(segments) != 0) | (np.diff(slices_) != 0) | (np.diff(is_anchor.astype(int)) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if (segments[a], slices_[a]) != unit:
                    unit, blocks, held = (segments[a], slices_[a]), [], None
                if not is_anchor[a]:
                    blocks += zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in (3, 4, 5)), strict=True)
                    continue
                if held is None:
                    ids = np.frombuffer(b"".join(x[0] for x in blocks), np.int64)
                    labels = np.frombuffer(b"".join(x[1] for x in blocks), np.int32)
                    vectors = np.frombuffer(b"".join(x[2] for x in blocks), kind).astype(np.float64)
                    held, blocks = (ids, labels, vectors.reshape(len(ids), -1) if len(ids) else vectors), []
                if len(held[0]):
                    for i in range(a, b, 64):
                        yield scored(batch.slice(i, min(64, b - i)))

    return run


@dataclass
class Index:
    """All rows in blocks of the tree's leaves, staged, and what a search needs to know of them."""

    rows: DataFrame
    blocks: DataFrame
    segments: DataFrame
    shared: object
    n_slices: int

    def _round(self, anchors: DataFrame, home: bool, same_label: bool, k: int) -> DataFrame:
        columns = ["segment", "slice", "is_anchor", "ids", "labels", "vectors", "anchor_id", "label", "vector", "window"]
        slice_ = F.pmod(F.xxhash64("anchor_id"), F.lit(self.n_slices)).cast("int")
        none = F.lit(None).cast("binary")
        queries = (
            anchors.select("anchor_id", "label", "vector", "window").mapInArrow(_visits(self.shared, home), _VISIT)
            .withColumns({"slice": slice_, "is_anchor": F.lit(True), "ids": none, "labels": none, "vectors": none})
        )
        segment = F.col("first") + F.pmod(F.xxhash64("ids"), F.col("n_segments"))
        data = self.blocks.join(F.broadcast(self.segments), "leaf").withColumns(
            {
                "segment": segment, "slice": F.explode(F.sequence(F.lit(0), F.lit(self.n_slices - 1))), "is_anchor": F.lit(False),
                "anchor_id": F.lit(None).cast("long"), "label": F.lit(None).cast("int"), "vector": none, "window": F.lit(None).cast(_WINDOW),
            }
        )
        units = data.select(columns).unionByName(queries.select(columns)).repartition("segment", "slice")
        return units.sortWithinPartitions("segment", "slice", "is_anchor").mapInArrow(_score_units(self.shared, same_label, k), _FOUND)

    def search(self, anchors: DataFrame, same_label: bool, k: int) -> DataFrame:
        """anchor_id, window_id, most, rank, vec_id, score: the k best rows of each window (id, least, most) of each anchor."""
        first = self._round(anchors, True, same_label, k)
        at = Window.partitionBy("anchor_id", "window_id").orderBy(F.desc("score"), "vec_id")
        known = (
            first.withColumn("n", F.row_number().over(at)).where(F.col("n") == k)
            .groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window_id", "score"))).alias("known"))
        )
        narrowed = F.transform(
            "window",
            lambda w: F.struct(
                w["id"].alias("id"), F.greatest(w["least"], F.coalesce(F.element_at("known", w["id"]), w["least"])).alias("least"), w["most"].alias("most")
            ),
        )
        again = stage(anchors.join(known, "anchor_id", "left").withColumn("window", narrowed).select("anchor_id", "label", "vector", "window"), "gnat-anchors")
        found = self._round(again, False, same_label, k)
        return found.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)


def index(rows: DataFrame, is_anchor: Column) -> Index | None:
    """The tree over ``rows`` (vec_id, label, vector of whole numbers); None if there are none."""
    spark = rows.sparkSession
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return None
    kept = stage(rows.where(F.size("vector") == lengths["n"]).withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))), "gnat-rows")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    norm2, most, n_rows, n_anchors = kept.agg(F.max(square), F.max(largest), F.count("*"), F.count_if("is_anchor")).first()
    kind = np.int16 if most < 2**15 else np.float32 if most < 2**24 else np.float64
    # A bounded sample, the rows of least id hash, decides where the tree splits and nothing else.
    sample = kept.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    lifted = _Tree([], 1, norm2).lifted(_matrix(sample.column(0).combine_chunks()))
    nodes, leaves = build(lifted, max(NODE_SAMPLE, LEAF_ROWS * len(lifted) // n_rows))
    tree = _Tree(nodes, leaves, norm2)
    fitted = spark.sparkContext.broadcast((tree, kind))
    blocks = stage(
        kept.select("vec_id", "label", "vector").mapInArrow(_blocks(fitted), "leaf int, n int, ids binary, labels binary, vectors binary"), "gnat-blocks"
    )
    # What comes to the driver has one number per pair of siblings, and per leaf: at most ARITY ** (DEPTH + 1) each.
    ranges = blocks.select("leaf", "n", "vectors").mapInArrow(_ranges(fitted), "node int, low array<double>, high array<double>")
    cells = ranges.select("node", F.posexplode(F.arrays_zip("low", "high")).alias("cell", "r")).select("node", "cell", "r.*")
    for r in cells.groupBy("node", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.low[r["node"]].flat[r["cell"]], tree.high[r["node"]].flat[r["cell"]] = r["low"], r["high"]
    counts = np.zeros(max(1, leaves), np.int64)
    for r in blocks.groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        counts[r["leaf"]] = r["n"]
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-counts // SEGMENT)))])
    segments = spark.createDataFrame(
        [(leaf, int(first[leaf]), int(first[leaf + 1] - first[leaf])) for leaf in range(len(counts))], "leaf int, first long, n_segments long"
    )
    shared = spark.sparkContext.broadcast((tree, first, kind, norm2 < _EXACT))
    return Index(kept, blocks, segments, shared, max(1, -(-n_anchors // SLICE)))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, vector (``valid_rows``). For each anchor its best rows of the same label, and for each of
    those the best rows of another label that score between ``percent`` hundredths of its score and its score.
    """
    found = index(rows, is_anchor)
    if found is None:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], schema)
    whole = F.struct(F.lit(0).cast("long").alias("id"), F.lit(-_TOP).alias("least"), F.lit(_TOP).alias("most"))
    anchors = found.rows.where("is_anchor").select(
        F.col("vec_id").alias("anchor_id"), "label", "vector", F.array(whole).cast(_WINDOW).alias("window")
    )
    near = found.search(anchors, True, positives)
    least = least_negative("score", percent)
    windows = near.groupBy("anchor_id").agg(
        F.collect_list(F.struct(F.col("vec_id").alias("id"), least.alias("least"), F.col("score").alias("most"))).alias("window")
    )
    with_windows = stage(anchors.drop("window").join(windows, "anchor_id"), "gnat-positives")
    return found.search(with_windows, False, negatives).select(
        "anchor_id", F.col("window_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("most").alias("positive_score"), F.col("score").alias("negative_score"),
    )
