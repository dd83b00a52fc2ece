"""Mixing sources to target weights by Pareto order sampling.

A document that should appear ``e`` times on average gets ``floor(e)`` whole copies for
certain, and one more with the remaining inclusion probability ``p``. Which documents get it
is decided by order sampling: with a hashed uniform number ``u`` a document ranks at
``(u / (1 - u)) / (p / (1 - p))``, and each source takes its documents in that order as long as
their words fit into what its target leaves after the whole copies. Where more than a hundredth
of that stays open, the order steps over the document that didn't fit and goes on in rounds with those of
at most half of what is open, so each round halves it or uses all such documents up. A last document per
source, the one whose size comes nearest to what is still open, closes the gap.

The decisions depend on a document's id and on a few numbers per source, so applying
them to wide rows joins the small table of sources and moves no text.

Defined results: a null text has no words; texts of any length are counted whole; a null source is a source of its own, last in
order; rows with one id rank together and are taken together, in the rounds those of them that are short enough;
a source without words gets nothing; an empty table gives an empty result; columns of the input whose names
clash with the ones added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKEN, id_key, stage

WEIGHTS = (5, 2, 1)
_BINS = 4096  # first-level resolution of a source's ranks
_OPEN = 0.01  # share of a source's room above which the rounds go on
_POSITION = "struct<q: double, id: bigint>"


def size_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def uniform(seed: str) -> Column:
    """A number in (0, 1) from 52 bits of md5 of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(16**13))


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: float, share: float) -> DataFrame:
    """Per source the words it should give: shares by weight, none over ``cap`` times its size.

    What the capped sources can't use goes to the others by weight. Sources sorted by
    ``cap * size / weight`` reach their cap one after the other, so one running sum finds the level.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()  # one row per source
    ranked = (
        sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("_w", cycle)
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    capped = ranked.withColumn("_capped", F.col("_cap") / F.col("_w") <= level)
    free = (F.col("_total") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everything), F.lit(0.0))) / F.sum(
        F.when(~F.col("_capped"), F.col("_w"))
    ).over(everything)
    return capped.select(
        "source", "source_size",
        F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * free).alias("target"),
    )


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, null being a value."""
    other = b.withColumnRenamed("source", "_source")
    return a.join(other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _reach(ranked: DataFrame) -> DataFrame:
    """Per source whose documents (size, q) don't all fit into ``room``: the bin and the last position that fit, the first that doesn't."""
    binned = ranked.withColumn("bin", _bin())
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        binned.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
        .withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        # The first bin that doesn't fit: all below is taken.
        .where("before + words > room")
    )
    # Read twice, and a row per source.
    edge = stage(bins.groupBy("source").agg(F.min(F.struct("bin", "before")).alias("e")).select("source", "e.bin", "e.before"), "mix-edges")
    # Only one bin of 4096 per source meets in a window.
    other = edge.select(F.col("source").alias("_source"), F.col("bin").alias("_bin"), "before")
    position = F.struct(F.col("q"), F.col("id"))
    inside = (
        binned.join(other, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin")))
        .withColumn("id", id_key())
        .withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("q", "id")) + F.col("before"))
        .groupBy("source")
        .agg(
            F.max(F.when(F.col("upto") <= F.col("room"), position)).alias("cut"),
            F.min(F.when(F.col("upto") > F.col("room"), position)).alias("stop"),
        )
    )
    return _same(edge.select("source", "bin"), inside, "left")


def _gaps(judged: DataFrame) -> DataFrame:
    taken = F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))
    return judged.groupBy("source").agg((F.first("room") - taken).alias("gap"), F.first("room").alias("all_room"))


def _filled(sizes: DataFrame, cuts: DataFrame) -> DataFrame:
    """``cuts`` with the rounds of the sources that stay open; ends when none has a document to go on with.

    Every round starts behind the position that stopped the one before, so it ends.
    """
    while True:
        judged = _decide(_same(sizes, cuts.where("p > 0 and stop is not null")), F.col("size"))
        open_ = _gaps(judged).where(F.col("gap") > F.col("all_room") * _OPEN).select("source", "gap")
        behind = F.struct(F.col("q"), id_key().alias("id")) > F.col("stop")
        # Read by all that follows, which would judge all documents each time.
        left = stage(
            _same(judged.where(~F.col("extra") & behind & (F.col("size") > 0)).select("source", "doc_id", "size", "q"), open_)
            .where("size <= gap / 2")
            .withColumn("room", F.col("gap")),
            "mix-left",
        )
        if left.isEmpty():
            return cuts
        usable = left.groupBy("source").agg(F.first("gap").alias("gap"))
        reached = _reach(left).select("source", F.col("stop").alias("next"))
        rounds = _same(usable, reached, "left")
        more = F.array(F.struct((F.col("gap") / 2).alias("most"), F.col("stop").alias("after"), F.col("next").alias("before")))
        cuts = stage(
            _same(cuts, rounds, "left")
            .withColumn("fills", F.when(F.col("gap").isNull(), F.col("fills")).otherwise(F.concat("fills", more)))
            # Without a round, or after one that took all it could, nothing is left to go on with.
            .withColumn("stop", F.col("next"))
            .drop("gap", "next"),
            "mix-cuts",
        )


def plan(sizes: DataFrame, weights=WEIGHTS, cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """One row per source: target, whole copies, the rank up to which it takes, its rounds, its last document.

    ``sizes``: doc_id, source, size, u; it is read several times, so give a staged table.
    """
    source_sizes = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = stage(
        targets(source_sizes, weights, cap, share)
        .withColumn("whole", F.floor(ratio).cast("long"))
        .withColumn("p", ratio - F.col("whole"))
        .withColumn("room", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-sources",
    )
    ranked = _same(sizes, sources.where("p > 0").select("source", "p", "room")).withColumn("q", rank())
    cuts = stage(
        _same(sources, _reach(ranked), "left")
        .withColumn("edge_bin", F.when(F.col("p") > 0, F.coalesce("bin", F.lit(_BINS + 1))).otherwise(-1))
        .withColumn("fills", F.array().cast(f"array<struct<most: double, after: {_POSITION}, before: {_POSITION}>>"))
        .drop("bin"),
        "mix-cuts",
    )
    cuts = _filled(sizes, cuts)
    judged = _decide(_same(sizes, cuts.where("p > 0")), F.col("size"))
    closing = (
        _same(judged.where("not extra"), _gaps(judged))
        .where("abs(gap - size) < gap")
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")), "q", id_key())).getField("col3").alias("closing"))
    )
    return stage(_same(cuts.drop("stop"), closing, "left"), "mix-plan")


def rank() -> Column:
    return (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))


def _bin() -> Column:
    return F.floor(F.col("q") / (1 + F.col("q")) * _BINS).cast("int")


def _decide(rows: DataFrame, size: Column) -> DataFrame:
    """``size`` is looked at for sources with rounds only."""
    ranked = rows.withColumn("q", F.when(F.col("p") > 0, rank()))
    position = F.struct(F.col("q"), id_key().alias("id"))
    inside = (_bin() == F.col("edge_bin")) & (position <= F.col("cut"))
    filled = F.when(
        F.size("fills") > 0,
        F.exists("fills", lambda f: (position > f["after"]) & (f["before"].isNull() | (position < f["before"])) & (size <= f["most"])),
    )
    return ranked.withColumn("extra", F.coalesce((_bin() < F.col("edge_bin")) | inside, F.lit(False)) | F.coalesce(filled, F.lit(False)))


def apply(rows: DataFrame, mix_plan: DataFrame, seed: str = "mix") -> DataFrame:
    """``rows`` (with doc_id, source, and text or else size) and the number of ``copies`` of each in the mix."""
    added = ["copies", "source_size", "target"]
    # The input's columns travel in one struct, so that no name of theirs clashes.
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in added]).alias("row")
    packed = rows.select(row, "doc_id", "source", uniform(seed).alias("u"))
    size = size_words("row.text") if "text" in rows.columns else F.col("row.size")
    judged = _decide(_same(packed, mix_plan, "left"), size)
    last = F.coalesce((F.col("closing") == id_key()) & ~F.col("extra"), F.lit(False))
    copies = F.col("whole") + F.col("extra").cast("long") + last.cast("long")
    return judged.select("row.*", copies.alias("copies"), "source_size", "target")


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Staged: doc_id, source, words and the uniform number of every document."""
    return stage(docs.select("doc_id", "source", size_words().alias("size"), uniform(seed).alias("u")), "mix-sizes")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix; a document taken twice comes twice."""
    chosen = apply(docs, plan(sizes(docs)))
    return (
        chosen.where("copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
