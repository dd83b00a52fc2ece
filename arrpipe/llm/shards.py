"""Sharding by a k-d tree over document metadata, natively in DataFrame operations.

A point of the tree is a group of equal texts, with the group's least metadata and all its
bytes, so that copies come into one shard. Only a group that alone weighs more than a shard's target is dealt, by a hash
of the document ids, into points of its own. The dimensions are the logarithm of the size, the
dense ranks of source and language among their sorted distinct values, and the document id; a hash between 0 and 1 is added
to each whole number, so one number orders the points of a dimension and equal values by hash.

A node that stands for ``k`` shards is cut at the ``floor(k/2)/k`` weighted quantile of its widest dimension (its range
against the range of all points). All nodes of a level share one aggregation of the points into at most ``BINS * k``
bins a node, and the cut is an edge of a bin; a bin around the cut that weighs over a thousandth of a shard is aggregated
again in finer bins. The bins also hold the ranges of all dimensions, so they say everything about the node's
two children, and a level costs one pass over narrow rows, mostly, and no shuffle of them. What reaches the driver is
the bins, at most ``BINS`` rows a shard. The tree is one expression over small literal arrays: it takes no join.

Single points that weigh more than a hundredth of a shard would leave the sides uneven by up
to their half; such a point stays on the side of the plain cut, and the cut for the
lighter points is moved to even out the sides.

Only narrow rows (hash of the text, size, metadata) are grouped, ranked and numbered, in cells of a group and a bucket
of ids, so a group that a third of the rows share spreads over ``BUCKETS`` cells. The rows themselves are
shuffled once, to meet their cell.

Defined results: a null text has the size 8 and no copies but other nulls; null metadata stand
above all others; repeated rows are rows of their own; texts of any length are handled whole; an empty table gives an empty
result; columns of the input whose names clash with the ones added are replaced.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.state import dense_ids
from .common import id_key, pieces, stage

SHARDS = 24
BINS = 2048
BUCKETS = 1024
_ROUNDS = 8
_HEAVY, _LIGHT = 100, 1000  # parts of a shard
_DIMENSIONS = ["y0", "y1", "y2", "y3"]


@dataclass
class Node:
    """``dimension`` counts from 1: its points below ``cut`` go left, heavy ones below ``heavy_cut``. ``left`` is 0 for a leaf."""

    shards: int
    first: int
    total: float
    low: np.ndarray
    high: np.ndarray
    dimension: int = 0
    cut: float = 0.0
    heavy_cut: float = 0.0
    left: int = 0
    right: int = 0


@dataclass
class _Bins:
    """Bins of a node in order: heavy or not, weight, and each dimension's least and greatest values."""

    heavy: np.ndarray
    w: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def sorted(self, d: int) -> _Bins:
        return self.where(np.argsort(self.low[:, d], kind="stable"))

    def where(self, which: np.ndarray) -> _Bins:
        return _Bins(self.heavy[which], self.w[which], self.low[which], self.high[which])

    def joined(self, other: _Bins) -> _Bins:
        pairs = ((self.heavy, other.heavy), (self.w, other.w), (self.low, other.low), (self.high, other.high))
        return _Bins(*(np.concatenate(p) for p in pairs))


def size_bytes(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")


def _literal(values: list, kind: str = "double") -> Column:
    """A list as one literal array."""
    return F.from_json(F.lit(json.dumps([float(v) if kind == "double" else int(v) for v in values])), f"array<{kind}>")


def node_of(nodes: list[Node], heavy: float) -> Column:
    """The place in ``nodes`` of the leaf of a point with columns y0 to y3 and w."""
    cells = {name: _literal([getattr(n, name) for n in nodes]) for name in ("cut", "heavy_cut")}
    cells |= {name: _literal([getattr(n, name) for n in nodes], "int") for name in ("left", "right")}
    cells["dimension"] = _literal([n.dimension if n.left else 0 for n in nodes], "int")
    depth = max(1, math.ceil(math.log2(max(2, max(n.shards for n in nodes)))) + 1)

    def step(at: Column, _: Column) -> Column:
        here = at + 1
        d = F.element_at(cells["dimension"], here)
        y = F.element_at(F.array(*_DIMENSIONS), F.greatest(d, F.lit(1)))
        cut = F.when(F.col("w") > heavy, F.element_at(cells["heavy_cut"], here)).otherwise(F.element_at(cells["cut"], here))
        return F.when(d == 0, at).when(y < cut, F.element_at(cells["left"], here)).otherwise(F.element_at(cells["right"], here))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def _edge(bins: _Bins, d: int, need: float) -> tuple[float, int]:
    """The edge whose weight below is nearest to ``need``, and the bin around the need."""
    if not len(bins.w):
        return -math.inf, -1
    below = np.concatenate([[0.0], np.cumsum(bins.w)])
    at = int(np.abs(below - need).argmin())
    around = min(len(bins.w) - 1, int(np.searchsorted(below[1:], need)))
    return (bins.low[at, d] if at < len(bins.w) else math.inf), around


def _histograms(points: DataFrame, nodes: list[Node], ask: dict[int, tuple[float, float, int]], heavy: float) -> dict[int, _Bins]:
    """For each node of ``ask`` (low, high, number) its points in that range of its dimension, in equal bins."""
    asked = [ask.get(i, (1.0, 0.0, 1)) for i in range(len(nodes))]
    here = F.col("node") + 1
    y = F.element_at(F.array(*_DIMENSIONS), F.element_at(_literal([max(1, n.dimension) for n in nodes], "int"), here))
    low, high = (F.element_at(_literal([a[i] for a in asked]), here) for i in (0, 1))
    width = F.element_at(_literal([(a[1] - a[0]) / a[2] or 1.0 for a in asked]), here)
    last = F.element_at(_literal([a[2] - 1 for a in asked], "int"), here)
    rows = (
        points.withColumn("node", node_of(nodes, heavy)).withColumn("y", y)
        .where((F.col("y") >= low) & (F.col("y") <= high))
        .groupBy("node", F.least(F.floor((F.col("y") - low) / width), last).alias("bin"), (F.col("w") > heavy).alias("heavy"))
        .agg(F.sum("w").cast("double").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in _DIMENSIONS for f in (F.min, F.max)])
        .toArrow()
    )
    columns = {name: rows[name].to_numpy() for name in rows.column_names}
    found = {}
    for n in ask:
        mine = columns["node"] == n
        sides = [np.stack([columns[f"{f}_{d}"][mine] for d in _DIMENSIONS], axis=1) for f in ("min", "max")]
        found[n] = _Bins(columns["heavy"][mine].astype(bool), columns["w"][mine], *sides)
    return found


def _ranges(n: Node) -> np.ndarray:
    """Of each dimension, without the added hash."""
    def plain(y: np.ndarray) -> np.ndarray:
        size = np.floor(np.exp2(y[0]) * (1 + 1e-12))
        return np.array([np.log2(max(1.0, size)), *np.floor(y[1:])])

    return plain(n.high) - plain(n.low)


def _child(shards: int, first: int, bins: _Bins) -> Node:
    if not len(bins.w):
        return Node(shards, first, 0.0, np.zeros(4), np.zeros(4))
    return Node(shards, first, float(bins.w.sum()), bins.low.min(axis=0), bins.high.max(axis=0))


def tree(points: DataFrame, shards: int) -> tuple[list[Node], float]:
    """The nodes, the root first, and the weight above which a point is heavy."""
    whole = points.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("double"), *[F.coalesce(f(d), F.lit(0.0)) for f in (F.min, F.max) for d in _DIMENSIONS]).first()
    nodes = [Node(shards, 0, whole[0], np.array(whole[1:5]), np.array(whole[5:9]))]
    target = max(1.0, whole[0] / shards)
    heavy, light = target / _HEAVY, target / _LIGHT

    scale = np.maximum(_ranges(nodes[0]), 1e-9)
    level = [0] if shards > 1 else []
    while level:
        for i in level:
            nodes[i].dimension = 1 + int((_ranges(nodes[i]) / scale).argmax())
        ask = {i: (nodes[i].low[nodes[i].dimension - 1], nodes[i].high[nodes[i].dimension - 1], BINS * nodes[i].shards) for i in level}
        bins: dict[int, _Bins] = {}
        for _ in range(_ROUNDS):
            for i, new in _histograms(points, nodes, ask, heavy).items():
                bins[i] = (bins[i].joined(new) if i in bins else new).sorted(nodes[i].dimension - 1)
            ask = {}
            for i in level:
                n, b = nodes[i], bins[i]
                d, need = n.dimension - 1, n.total * (n.shards // 2) / n.shards
                n.heavy_cut, around = _edge(b, d, need)
                left = b.w[b.heavy & (b.low[:, d] < n.heavy_cut)].sum()
                small = np.flatnonzero(~b.heavy)
                n.cut, next_ = _edge(b.where(small), d, max(0.0, need - left))
                for at in (around, int(small[next_]) if next_ >= 0 else -1):
                    if at >= 0 and b.w[at] > light and b.low[at, d] < b.high[at, d]:
                        # Bins of heavy and light points may overlap: take all that meet the range.
                        low, high = b.low[at, d], b.high[at, d]
                        meets = (b.low[:, d] <= high) & (b.high[:, d] >= low)
                        low, high = b.low[meets, d].min(), b.high[meets, d].max()
                        bins[i], ask[i] = b.where(~((b.low[:, d] >= low) & (b.high[:, d] <= high))), (low, high, BINS)
                        break
            if not ask:
                break
        if ask:  # rounds are used up: what was to be refined comes back as it is
            for i, new in _histograms(points, nodes, {i: (*a[:2], 1) for i, a in ask.items()}, heavy).items():
                bins[i] = bins[i].joined(new).sorted(nodes[i].dimension - 1)
        following = []
        for i in level:
            n, b = nodes[i], bins[i]
            left = b.low[:, n.dimension - 1] < np.where(b.heavy, n.heavy_cut, n.cut)
            k = n.shards // 2
            n.left, n.right = len(nodes), len(nodes) + 1
            nodes += [_child(k, n.first, b.where(left)), _child(n.shards - k, n.first + k, b.where(~left))]
            following += [c for c in (n.left, n.right) if nodes[c].shards > 1]
        level = following
    return nodes, heavy


def _group() -> Column:
    return F.coalesce(F.when(F.col("text").isNotNull(), F.md5(F.encode("text", "UTF-8"))), F.lit("null"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64(id_key(), F.col("source"), F.col("lang")), F.lit(BUCKETS)).cast("int")


def points_of(cells: DataFrame, shards: int) -> DataFrame:
    """g, part, w and y0 to y3 of the tree's points; ``part`` is -1 where the group is whole, else a bucket."""
    total = cells.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    groups = cells.groupBy("g").agg(F.sum("w").alias("gw"))
    # Groups above a shard's target: fewer than there are shards.
    large = F.broadcast(groups.where(F.col("gw") > total / shards).select(F.col("g").alias("lg")))
    part = F.when(F.col("lg").isNotNull(), F.col("b")).otherwise(-1)
    merged = stage(
        cells.join(large, F.col("g") == F.col("lg"), "left")
        .groupBy("g", part.alias("part"))
        .agg(F.sum("w").alias("w"), F.min("size").alias("size"), *[F.min(c).alias(c) for c in ("source", "lang", "id")]),
        "shard-merged",
    )
    values = merged.select(F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("lang", "source")]))).distinct()
    ranks = dense_ids(values, ["kind", "value"], "rank", F.lit(0))
    for c in ("source", "lang"):
        own = ranks.where(F.col("kind") == c).select(F.col("value").alias(f"{c}_value"), F.col("rank").cast("double").alias(f"{c}_rank"))
        merged = merged.join(own, F.col(c).eqNullSafe(F.col(f"{c}_value")))
    tie = F.xxhash64("g", "part").bitwiseAND(F.lit(2**40 - 1)) / F.lit(float(2**40))
    ys = (F.log2(F.col("size") + tie), F.col("source_rank") + tie, F.col("lang_rank") + tie, F.col("id") + tie)
    return merged.select("g", "part", "w", *[y.alias(d) for d, y in zip(_DIMENSIONS, ys, strict=True)])


def assign(docs: DataFrame, shards: int = SHARDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot; without the text unless ``keep_text``."""
    added = ["size", "text_crc32", "shard", "slot"]
    kept = [c for c in docs.columns if c not in added and (keep_text or c != "text")]
    cells = stage(
        docs.select(_group().alias("g"), _bucket().alias("b"), size_bytes().alias("s"), "source", "lang", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("id"))
        .groupBy("g", "b")
        .agg(F.count("*").alias("n"), F.sum("s").alias("w"), F.min("s").alias("size"), *[F.min(c).alias(c) for c in ("source", "lang", "id")]),
        "shard-cells",
    )
    points = stage(points_of(cells, shards), "shard-points")
    nodes, heavy = tree(points, shards)
    shard = F.element_at(_literal([n.first for n in nodes], "int"), node_of(nodes, heavy) + 1)
    owner = points.select(F.col("g").alias("pg"), "part", shard.alias("shard"))
    mine = (F.col("g") == F.col("pg")) & ((F.col("part") == -1) | (F.col("part") == F.col("b")))
    numbered = _first_slots(cells.join(owner, mine).select("g", "b", "n", "shard"), shards)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), size_bytes().alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        _group().alias("rg"), _bucket().alias("rb"), id_key().alias("key"), F.xxhash64("source", "lang").alias("else"),
    )
    at = F.row_number().over(Window.partitionBy("rg", "rb").orderBy("key", "else"))
    return (
        rows.join(numbered, (F.col("rg") == F.col("g")) & (F.col("rb") == F.col("b")))
        .withColumn("slot", (F.col("start") + at - 1).cast("long"))
        .select("row.*", "size", "text_crc32", "shard", "slot")
    )


def _first_slots(placed: DataFrame, shards: int) -> DataFrame:
    """g, b, shard, and start: the rows of a shard before a cell. Buckets of cells are numbered by windows and set off
    against each other by a running sum of their sizes, so that no shard meets in one task."""
    fixed = stage(placed, "shard-placed")
    buckets = pieces(fixed.count(), 50_000 * shards)
    fixed = fixed.withColumn("bucket", F.pmod(F.xxhash64("g", "b"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
        .select(F.col("shard").alias("os"), F.col("bucket").alias("ob"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("g", "b").rowsBetween(Window.unboundedPreceding, -1)
    return (
        fixed.withColumn("_n", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(offsets, (F.col("shard") == F.col("os")) & (F.col("bucket") == F.col("ob")))
        .select("g", "b", "shard", (F.col("offset") + F.col("_n")).alias("start"))
    )
