"""Line dedup by site-relative frequency, natively in DataFrame operations.

For each host and line: pages of the host that contain the line, divided by the host's pages. A line
above ``ratio`` on at least ``least_pages`` pages is boilerplate of its host and is dropped from
all of the host's pages. Counts combine before the shuffle, so a line on every page of a hot host
costs one row per task. Only 128-bit line fingerprints are shuffled, and each page gets back the
fingerprints to drop.

Defined results: a null or unreadable URL has the host ''; a null page, and a null array, has no lines; pages and lines of any length are handled whole; a line
counts once per page; every row is a page, also one that repeats another row; an empty
table gives an empty result; columns of the input whose names clash with the ones added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

RATIO = 0.2
LEAST_PAGES = 2  # on fewer a line can't repeat

# What separates the lines of an HTML page, and its usual entities.
BLOCKS = r"(?i)<(?:br|/?(?:p|div|li|ul|ol|h[1-6]|tr|td|th|table|title|article|section|header|footer|nav|head|body|html|pre|blockquote))\b[^>]*>"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAGS = r"(?s)<[^>]*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SPACE = r"[ \t\r]+"


def host(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), HOST, 1), F.lit("")))


def html_text(html: str = "html") -> Column:
    """The page's text, a line per block element."""
    text = F.regexp_replace(F.col(html), HIDDEN, "")
    text = F.regexp_replace(text, BLOCKS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def lines_of(text: Column) -> Column:
    """Lines with runs of blanks made one, trimmed, empty ones left out; null has none."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), "\n")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` (host, lines array<string>) with n_lines, n_dropped and kept_text."""
    added = ["n_lines", "n_dropped", "kept_text"]
    own = [c for c in pages.columns if c not in added and c != "lines"]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    packed = stage(
        pages.select(row, F.col("host").alias("h"), "lines").withColumns(
            {"lines": F.coalesce("lines", F.array().cast("array<string>"))}
        ).withColumns(
            {"p1": F.xxhash64("h", "lines"), "p2": F.xxhash64(F.lit(1), "h", "lines"), "n": F.size("lines")}
        ),
        "page-lines",
    )
    seen = packed.select("h", "p1", "p2", F.explode(F.array_distinct("lines")).alias("line")).select(
        "h", "p1", "p2", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")
    )
    totals = packed.groupBy("h").agg(F.count("*").alias("pages")).withColumnRenamed("h", "th")
    common = (
        seen.groupBy("h", "a", "b").agg(F.count("*").alias("on_pages")).where(F.col("on_pages") >= least_pages)
        .join(totals, F.col("h") == F.col("th"))
        .where(F.col("on_pages") / F.col("pages") > ratio)
        .select(F.col("h").alias("ch"), F.col("a").alias("ca"), F.col("b").alias("cb"))
    )
    flagged = (
        seen.join(common, (F.col("h") == F.col("ch")) & (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")))
        .groupBy(F.col("p1").alias("f1"), F.col("p2").alias("f2"))
        .agg(F.collect_set(F.struct("a", "b")).alias("drop"))
    )
    kept = F.when(
        F.col("drop").isNull(), F.col("lines")
    ).otherwise(F.filter("lines", lambda x: ~F.array_contains("drop", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))))
    return (
        packed.join(flagged, (F.col("p1") == F.col("f1")) & (F.col("p2") == F.col("f2")), "left")
        .withColumn("kept", kept)
        .select(
            "row.*",
            F.col("n").cast("long").alias("n_lines"),
            (F.col("n") - F.size("kept")).cast("long").alias("n_dropped"),
            F.array_join("kept", "\n").alias("kept_text"),
        )
    )
