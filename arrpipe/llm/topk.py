"""Exact top-k inner-product search with a pivot-distance index.

Vectors of integers get one more coordinate, ``sqrt(M^2 - |v|^2)`` with ``M`` the greatest norm, and
queries a zero: distance then falls as the inner product rises. Each vector is keyed by
its nearest pivot and its distance to it, and the table is range-partitioned and sorted on
that key, so a pivot's vectors are sorted annuli, stored as blocks that also hold the range of their distances to
every pivot. A hot pivot, or one vector that a third of the rows share, spreads over many blocks.

Queries are sorted by the same key into tiles. A tile first visits the blocks of its own annulus; the
k-th score found there bounds how far away a better vector can be. Then the annuli around it
are expanded: a block takes part only if, by the triangle inequality over all pivots, it can hold a
vector within that radius; a tile visits its blocks from the nearest bound outwards, and stops when the
bound exceeds the radius, which shrinks on the way. Blocks of a tile are dealt over segments of bounded size, and
the segments' lists are merged.

Rows with equal vectors score alike and rank by id, so beyond the ``k + 1`` least ids of a
vector none can be among the k best of any query; those rows are left out of the index.

Defined results: null ids, null or empty vectors, vectors with a null or non-finite component, and
vectors whose length isn't the most frequent one (the greater of equally frequent ones) take no part; a row repeated as a whole
counts once; scores beyond a long are clamped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

PIVOTS = 32
BLOCK = 256
TILE = 256
SEGMENT_BLOCKS = 512
HOME_BLOCKS = 4
_EXACT = 2**52

_KEYED = "vec_id long, query boolean, pivot int, distance double, vector array<double>"
_BLOCKS = "pivot int, low array<double>, high array<double>, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score long"


def quantised(embedding: str, factor: int = 64) -> Column:
    """floor(factor * x) of each component as double; null unless all are finite."""
    x = F.transform(F.col(embedding), lambda v: F.floor(v.cast("double") * factor).cast("double"))
    bad = F.exists(F.col(embedding), lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(False)), x)


def _distances(vectors: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """To each pivot, with the added coordinate."""
    whole = np.hstack([vectors, extra[:, None]])
    square = (whole**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * whole @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _key(shared):
    """Adds the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, norm2, _ = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(2))
            is_query = batch.column(1).to_numpy(zero_copy_only=False)
            extra = np.where(is_query, 0.0, np.sqrt(np.maximum(0, norm2 - (v**2).sum(axis=1))))
            d = _distances(v, extra, pivots)
            nearest = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(d)), nearest]), batch.column(2)],
                names=["vec_id", "query", "pivot", "distance", "vector"],
            )

    return run


_ARROW_BLOCKS = pa.schema(
    [
        ("pivot", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
        ("ids", pa.binary()), ("vectors", pa.binary()),
    ]
)


def _pack(shared, size: int, query: bool):
    """Blocks of at most ``size`` vectors that follow each other in key order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, norm2, kind = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, pivot, v = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(4))
            extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, norm2 - (v**2).sum(axis=1)))
            d = _distances(v, extra, pivots)
            cuts = (np.flatnonzero(np.diff(pivot)) + 1).tolist()
            out: dict[str, list] = {name: [] for name in _ARROW_BLOCKS.names}
            for a, b in zip([0, *cuts], [*cuts, len(v)], strict=True):
                for i in range(a, b, size):
                    part = slice(i, min(i + size, b))
                    out["pivot"].append(pivot[i])
                    out["low"].append(d[part].min(axis=0))
                    out["high"].append(d[part].max(axis=0))
                    out["ids"].append(ids[part].tobytes())
                    out["vectors"].append(v[part].astype(kind).tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=_ARROW_BLOCKS)

    return run


def _scores(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs; in float64 where all sums are exact there, else in whole numbers."""
    if exact:
        return (queries @ vectors.T).astype(np.int64)
    top = 2**63 - 1
    whole = [[[int(x) for x in row] for row in side] for side in (queries, vectors)]
    return np.array(
        [[max(-top, min(top, sum(x * y for x, y in zip(q, v, strict=True)))) for v in whole[1]] for q in whole[0]], dtype=np.int64
    )


class _Best:
    """The running k best (score, id) of each query of a tile."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, norm2: float) -> None:
        self.ids, self.vectors, self.k, self.norm2 = ids, vectors, k, norm2
        self.exact = norm2 < _EXACT
        self.score = np.full((len(ids), k), -(2**63), dtype=np.int64)
        self.id = np.full((len(ids), k), 2**63 - 1, dtype=np.int64)
        self.count = np.zeros(len(ids), dtype=np.int64)
        self.square = (vectors**2).sum(axis=1)

    def radius(self) -> float:
        """No vector farther from its query than this can enter any list; rounding is allowed for."""
        if (self.count < self.k).any() or not self.exact:
            return float("inf")
        square = self.square + self.norm2 - 2 * self.score[:, -1].astype(np.float64)
        return float(np.sqrt(max(0.0, square.max()))) * (1 + 1e-9) + 1e-3

    def visit(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = _scores(self.vectors, vectors, self.exact)
        other = ids[None] != self.ids[:, None]
        hopeful = other & ((scores >= self.score[:, -1:]) | (self.count < self.k)[:, None])
        for i in np.flatnonzero(hopeful.any(axis=1)):
            new = np.flatnonzero(hopeful[i])
            score = np.concatenate([self.score[i, : self.count[i]], scores[i][new]])
            name = np.concatenate([self.id[i, : self.count[i]], ids[new]])
            order = np.lexsort((name, ~score))[: self.k]  # ~x falls as x rises, without overflow
            self.count[i] = len(order)
            self.score[i, : len(order)], self.id[i, : len(order)] = score[order], name[order]

    def rows(self) -> pa.RecordBatch:
        held = np.arange(self.k)[None] < self.count[:, None]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, self.count)), pa.array(self.id[held]), pa.array(self.score[held])],
            names=["query_id", "vec_id", "score"],
        )


def _visit(shared, k: int, radii: bool):
    """Streams rows (tile, segment, bound, ids, vectors, radius); a tile's queries come first, at bound -1.

    Gives each tile's radius, or its lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, norm2, kind = shared.value
        width = pivots.shape[1] - 1
        best, tile, known = None, None, float("inf")

        def finished() -> pa.RecordBatch:
            if not radii:
                return best.rows()
            return pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), pa.array([best.radius()])], names=["tile", "radius"])

        for batch in batches:
            for i in range(batch.num_rows):
                at, _, bound, ids, vectors, limit = (batch.column(c)[i].as_py() for c in range(6))
                ids = np.frombuffer(ids, np.int64)
                vectors = np.frombuffer(vectors, kind).reshape(-1, width).astype(np.float64)
                if bound < 0:
                    if best is not None:
                        yield finished()
                    best, tile, known = _Best(ids, vectors, k, norm2), at, limit
                elif bound <= min(known, best.radius()):
                    best.visit(ids, vectors)
        if best is not None:
            yield finished()

    return run


def _visited(tiles: DataFrame, pairs: DataFrame, blocks: DataFrame, shared, k: int, radii: bool) -> DataFrame:
    """``pairs``: tile, segment, bound, block, radius. Each (tile, segment) is one sorted run of rows."""
    heads = pairs.groupBy("tile", "segment", "radius").agg(F.lit(-1.0).alias("bound")).join(
        tiles.select("tile", "ids", "vectors"), "tile"
    )
    bodies = pairs.join(blocks.select("block", "ids", "vectors"), "block")
    columns = ["tile", "segment", "bound", "ids", "vectors", "radius"]
    runs = (
        heads.select(columns).unionByName(bodies.select(columns))
        .repartition("tile", "segment")
        .sortWithinPartitions("tile", "segment", "bound")
    )
    return runs.mapInArrow(_visit(shared, k, radii), "tile long, radius double" if radii else _FOUND)


def _bound() -> Column:
    """The least distance between a tile's query and a block's vector that the pivots allow."""
    gaps = F.zip_with(
        F.arrays_zip(F.col("low").alias("l"), F.col("high").alias("h")), F.arrays_zip(F.col("tlow").alias("l"), F.col("thigh").alias("h")),
        lambda b, t: F.greatest(b["l"] - t["h"], t["l"] - b["h"]),
    )
    return F.greatest(F.lit(0.0), F.array_max(gaps))


def search(vectors: DataFrame, query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows but its own for each row where ``query`` holds.

    ``vectors``: vec_id, and vector as an array<double> of whole numbers (see ``quantised``).
    """
    spark = vectors.sparkSession
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    lengths = valid.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = stage(
        valid.where(F.size("vector") == lengths["n"])
        .select(F.col("vec_id").cast("long"), F.coalesce(query, F.lit(False)).alias("query"), "vector")
        .dropDuplicates(["vec_id", "vector"]),
        "topk-vectors",
    )
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    norm2, most = rows.agg(F.max(square), F.max(largest)).first()
    kind = np.float32 if most < 2**24 else np.float64
    # Pivots: a bounded sample, the rows with the least hash of their id.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(PIVOTS).collect()
    centres = np.array([r["vector"] for r in sample], dtype=np.float64)
    pivots = np.hstack([centres, np.sqrt(np.maximum(0, norm2 - (centres**2).sum(axis=1)))[:, None]])
    shared = spark.sparkContext.broadcast((pivots, norm2, kind))

    least = Window.partitionBy("vector").orderBy("vec_id")
    candidates = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).select("vec_id", F.lit(False).alias("query"), "vector")

    def packed(part: DataFrame, size: int, is_query: bool, name: str) -> DataFrame:
        keyed = part.select("vec_id", "query", "vector").mapInArrow(_key(shared), _KEYED)
        ordered = keyed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
        blocks = ordered.mapInArrow(_pack(shared, size, is_query), _BLOCKS)
        return stage(blocks.withColumn("block", F.monotonically_increasing_id()), name)

    blocks = packed(candidates, BLOCK, False, "topk-index")
    tiles = packed(rows.where("query"), TILE, True, "topk-tiles").select(
        F.col("block").alias("tile"), F.col("pivot").alias("home"), F.col("low").alias("tlow"), F.col("high").alias("thigh"), "ids", "vectors"
    )
    # The tile's own annulus: blocks of its pivot, those whose range lies nearest.
    home = tiles.select("tile", "home", "tlow", "thigh").join(
        blocks.select("block", F.col("pivot").alias("home"), "low", "high"), "home"
    )
    here = F.col("home") + 1
    middle = (F.element_at("tlow", here) + F.element_at("thigh", here) - F.element_at("low", here) - F.element_at("high", here))
    nearest = Window.partitionBy("tile").orderBy(F.abs(middle), "block")
    first = (
        home.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= HOME_BLOCKS)
        .select("tile", F.lit(0).alias("segment"), F.lit(0.0).alias("bound"), "block", F.lit(float("inf")).alias("radius"))
    )
    radii = stage(_visited(tiles, first, blocks, shared, k, True), "topk-radii")
    # Expanded annuli, pivot by pivot: an equi-join on the pivot with a range of distances.
    n_blocks = blocks.count()
    segments = max(1, -(-n_blocks // SEGMENT_BLOCKS))
    around = (
        tiles.select("tile", "tlow", "thigh")
        .join(radii, "tile", "left")
        .withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
        .select("tile", "tlow", "thigh", "radius", F.posexplode("tlow").alias("pivot", "near"))
        .withColumn("far", F.element_at("thigh", F.col("pivot") + 1))
    )
    own = F.col("pivot") + 1
    pairs = (
        around.join(blocks.select("block", "pivot", "low", "high"), "pivot")
        .where((F.element_at("low", own) <= F.col("far") + F.col("radius")) & (F.element_at("high", own) >= F.col("near") - F.col("radius")))
        .withColumn("bound", _bound())
        .where("bound <= radius")
        .select("tile", F.pmod(F.xxhash64("block"), F.lit(segments)).cast("int").alias("segment"), "bound", "block", "radius")
    )
    found = _visited(tiles, stage(pairs, "topk-pairs"), blocks, shared, k, False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
