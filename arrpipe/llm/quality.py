"""Quality classifier: naive Bayes features in a linear support vector machine.

Features are indicators of hashed n-grams: words (case kept), pairs of words, and the punctuation around a word. Each is
scaled by its log-count ratio between the classes, with add-one smoothing; rows are scaled to length
1. On these, a hinge-loss linear model is fitted by dual coordinate descent, and its
weights are pulled towards their mean magnitude (interpolation), as the method proposes.

The model is fitted on at most ``fit_rows`` labelled rows, those with the least hash of
their id; the bound is what keeps the sample's ids small enough to broadcast, so texts aren't shuffled. The
sample is split into groups of ``group_rows`` expected rows; each group is a task that fits its own model, and
the weights are averaged. Rows of a group are visited in an order that follows their ids and features, and groups are
added up by number, so neither the input's partitions nor a task that runs again change the model. Scoring reads every whole text once and needs the 1 MB weight vector only.

Defined results: null and empty texts have no features and get the score of the intercept alone; labels other
than 0 and 1 are ignored; of several labels for an id the mean counts, 0.5 being ignored; without labels
of both classes every score is the share of the class that is there (0.5 without any); rows repeat as in
the input; columns of the input whose names clash with the ones added are replaced.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, stage

FIT_ROWS = 40_000
GROUP_ROWS = 4_000
BITS = 18
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_CACHE = 500_000
_BETA = 0.25  # the interpolation of the published method
_COST = 1.0
_EPOCHS = 15


class Features:
    """Distinct hashed n-grams of a text. The hashes of recently seen units are remembered."""

    def __init__(self, bits: int = BITS) -> None:
        self.shift = np.uint64(64 - bits)
        self.units: dict[bytes, int] = {}

    def _unit(self, unit: bytes) -> int:
        """crc32 of the word, and above it of the punctuation around it (0: none)."""
        if len(self.units) >= _CACHE:
            self.units.clear()
        word = unit.strip(_PUNCTUATION)
        at = unit.find(word) if word else len(unit)
        around = unit[:at] + unit[at + len(word) :]
        found = self.units[unit] = zlib.crc32(word) | (zlib.crc32(b"+" + around) << 32 if around else 0)
        return found

    def of(self, text: str | None) -> np.ndarray:
        units = text.encode().split() if text else []
        if not units:
            return np.zeros(0, dtype=np.int32)
        known, make = self.units.get, self._unit
        codes = np.fromiter((known(u) or make(u) for u in units), dtype=np.uint64, count=len(units))
        word, around = codes & np.uint64(2**32 - 1), codes >> np.uint64(32)
        pair = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:] + np.uint64(1)
        names = np.concatenate([word, around[around > 0] + np.uint64(2**32), pair])
        ids = np.sort((names * np.uint64(0xC2B2AE3D27D4EB4F)) >> self.shift)
        return ids[np.concatenate([[True], ids[1:] != ids[:-1]])].astype(np.int32)


def descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L2-regularised hinge-loss model, by dual coordinate descent.

    Per row one dual variable in [0, cost]; a step minimises the dual in it exactly. Rows have length 1, and
    the intercept is a feature of value 1, so the curvature is 2. Classes weigh the same in sum.
    """
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    share = max(1e-9, float((labels > 0).mean()))
    upper = np.where(labels > 0, _COST * 0.5 / share, _COST * 0.5 / max(1e-9, 1 - share))
    random = np.random.default_rng(0)
    for _ in range(_EPOCHS):
        moved = 0.0
        for i in random.permutation(len(rows)):
            ids, x, y = rows[i], values[i], labels[i]
            gradient = y * (float(w[ids] @ x) + b) - 1.0
            new = min(max(alpha[i] - gradient / (1.0 + float(x @ x)), 0.0), upper[i])
            step = (new - alpha[i]) * y
            if step:
                w[ids] += step * x
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def _vector(ids: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    x = ratio[ids]
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


def sample(labels: DataFrame, label: str, where: Column, fit_rows: int) -> DataFrame:
    """At most ``fit_rows`` (doc_id, y), y in -1, 1."""
    return (
        labels.where(F.col(label).isin(0, 1) & where & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.avg(F.col(label).cast("double")).alias("mean"))
        .where("mean <> 0.5")
        .select("_id", F.when(F.col("mean") > 0.5, 1).otherwise(-1).alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(fit_rows)
    )


def train_rows() -> Column:
    """The rows that labels are learned from: two thirds, by id."""
    return F.coalesce(crc_of_id() % 3 != 1, F.lit(False))


class Model:
    def __init__(self, weights: np.ndarray, ratio: np.ndarray, intercept: float) -> None:
        self.weights, self.ratio, self.intercept = weights, ratio, intercept


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None,
        fit_rows: int = FIT_ROWS, group_rows: int = GROUP_ROWS, bits: int = BITS) -> Model:
    where = train_rows() if where is None else where
    size = 1 << bits
    chosen = stage(sample(labels, label, where, fit_rows), "quality-sample")
    n = chosen.count()
    groups = max(1, -(-n // group_rows))

    def extract(batches):
        features = Features(bits)
        for pdf in batches:
            ids = [features.of(t) for t in pdf["text"]]
            yield pd.DataFrame({"g": pdf["g"], "id": pdf["_id"], "y": pdf["y"], "ids": ids})

    # At most fit_rows pairs of numbers: under 1 MB to broadcast.
    rows = stage(
        docs.select(F.col("doc_id").cast("long").alias("_doc"), "text")
        .join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
        .select("text", "_id", "y", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(groups)).cast("int").alias("g"))
        .mapInPandas(extract, "g int, id long, y int, ids array<int>"),
        "quality-rows",
    )
    shares = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        level = 30.0 if 1 in shares else -30.0 if shares else 0.0
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), level)

    def count(batches):
        positive, negative = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for pdf in batches:
            for y, ids in zip(pdf["y"], pdf["ids"], strict=True):
                (positive if y > 0 else negative)[ids] += 1
        yield pd.DataFrame({"positive": [positive.tobytes()], "negative": [negative.tobytes()]})

    # Per task of the bounded sample two vectors of 2 MB, added up on the driver one by one.
    positive, negative = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in rows.mapInPandas(count, "positive binary, negative binary").toLocalIterator():
        positive += np.frombuffer(r["positive"], np.int64)
        negative += np.frombuffer(r["negative"], np.int64)
    p, q = positive + 1.0, negative + 1.0
    ratio = np.log((p / p.sum()) / (q / q.sum()))

    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = shared.value
        order = sorted(range(len(pdf)), key=lambda i: (pdf["id"][i], pdf["ids"][i].tobytes()))
        ids = [pdf["ids"][i].astype(np.int64) for i in order]
        w, b = descend(ids, [_vector(x, r) for x in ids], pdf["y"].to_numpy(dtype=float)[order], size)
        mean = float(np.abs(w).mean())
        pulled = w + (1 - _BETA) / _BETA * mean  # (1 - beta) * mean + beta * w, in the scale of w
        return pd.DataFrame({"g": [pdf["g"][0]], "n": [len(pdf)], "w": [pulled.astype(np.float32).tobytes()], "b": [b]})

    weights, intercept = np.zeros(size), 0.0
    total = sum(shares.values())
    # One vector of 1 MB a group, fit_rows / group_rows of them.
    solved = rows.groupBy("g").applyInPandas(solve, "g int, n long, w binary, b double").collect()
    for r in sorted(solved, key=lambda r: r["g"]):
        weights += np.frombuffer(r["w"], np.float32) * (r["n"] / total)
        intercept += r["b"] * r["n"] / total
    return Model(weights.astype(np.float32), ratio.astype(np.float32), intercept)


def score(model: Model, spark, text: str = "text") -> Column:
    """The model's score of a text column, in 0 to 1."""
    shared = spark.sparkContext.broadcast((model.weights, model.ratio, model.intercept))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        weights, ratio, intercept = shared.value
        features = Features(int(len(weights)).bit_length() - 1)
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            ids = features.of(t)
            x = _vector(ids, ratio)
            margin = float(weights[ids] @ x) + intercept if len(ids) else intercept
            out[i] = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, 2.0 * margin))))
        return pd.Series(out)

    return scored(F.col(text))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*own, score(model, docs.sparkSession).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
