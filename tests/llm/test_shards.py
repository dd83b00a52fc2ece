"""K-d shards: even bytes, gapless slots, copies together, edges."""

import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arrpipe.llm import shards
from arrpipe.llm.queries import QUERIES


def check(rows, n_shards, slack):
    total, per, slots = sum(r["size"] for r in rows), defaultdict(int), defaultdict(list)
    for r in rows:
        per[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < n_shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    largest = max(r["size"] for r in rows)
    for s in range(n_shards):
        assert abs(per[s] - total / n_shards) <= slack * total / n_shards + largest, (s, per[s], total / n_shards)
    return per


def docs_of(n, seed=1):
    r = random.Random(seed)
    return [(i, "x" * int(r.paretovariate(1.2) * 30 % 5000) + str(i), r.choice(["en", "de", None]), r.choice(["s1", "s1", "s2", None])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("n_shards", [24, 5])
def test_even_bytes(spark, n_shards):
    rows = docs_of(3000)
    out = shards.assign(frame(spark, rows).repartition(4), n_shards).collect()
    assert len(out) == len(rows)
    check(out, n_shards, 0.03)
    texts = dict((i, t) for i, t, *_ in rows)
    assert all(r["size"] == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out)


def test_copies_stay_together_and_hot_groups_split(spark):
    rows = docs_of(2000) + [(5000 + i, "hot copy " * 10, "en", f"s{i}") for i in range(3000)] + [(9000 + i, "few copies", "de", f"s{i}") for i in range(6)]
    out = shards.assign(frame(spark, rows), 24).collect()
    check(out, 24, 0.05)
    assert len({r.shard for r in out if r.text == "few copies"}) == 1
    assert len({r.shard for r in out if r.text == "hot copy " * 10}) > 3


def test_only_groups_above_a_target_are_parted(spark):
    rows = docs_of(400) + [(1000 + 50 * k + i, f"group {k} " * (k + 1), "en", f"s{i % 5}") for k in range(20) for i in range(40)]
    out = shards.assign(frame(spark, rows), 6).collect()
    target = sum(r["size"] for r in out) / 6
    groups = defaultdict(list)
    for r in out:
        groups[r.text].append(r)
    assert any(len(g) == 40 for g in groups.values())
    for g in groups.values():
        assert sum(r["size"] for r in g) > target or len({r.shard for r in g}) == 1


def cut_by_hand(points, n_shards, heavy, first=0, scale=None):
    """Shards of points (key, w, y) by a k-d tree in plain Python, cut at the edges nearest to the quantiles."""
    def ranges(own):
        spans = []
        for d in range(4):
            values = [math.log2(math.floor(2 ** p[2][d] * (1 + 1e-12))) if d == 0 else math.floor(p[2][d]) for p in own]
            spans.append(max(values) - min(values))
        return spans

    if n_shards == 1 or not points:
        return {p[0]: first for p in points}
    scale = scale or [max(x, 1e-9) for x in ranges(points)]
    widths = [x / s for x, s in zip(ranges(points), scale, strict=True)]
    d = widths.index(max(widths))
    k, total = n_shards // 2, sum(p[1] for p in points)

    def edge(own, need):
        own = sorted(own, key=lambda p: p[2][d])
        below, at = 0, (abs(need), own[0][2][d] if own else -math.inf)
        for i, p in enumerate(own):
            below += p[1]
            at = min(at, (abs(below - need), own[i + 1][2][d] if i + 1 < len(own) else math.inf))
        return at[1]

    need = total * k / n_shards
    heavy_cut = edge(points, need)
    taken = sum(p[1] for p in points if p[1] > heavy and p[2][d] < heavy_cut)
    cut = edge([p for p in points if p[1] <= heavy], max(0, need - taken))
    left = [p for p in points if p[2][d] < (heavy_cut if p[1] > heavy else cut)]
    right = [p for p in points if not p[2][d] < (heavy_cut if p[1] > heavy else cut)]
    return cut_by_hand(left, k, heavy, first, scale) | cut_by_hand(right, n_shards - k, heavy, first + k, scale)


@pytest.mark.parametrize("n_shards,n_bins", [(24, 4), (7, 64)])
def test_equals_plain_tree(spark, monkeypatch, n_shards, n_bins):
    for name, value in (("BINS", n_bins), ("_LIGHT", 10**9), ("_ROUNDS", 60)):
        monkeypatch.setattr(shards, name, value)
    docs = frame(spark, docs_of(700, 3) + [(5000 + i, "copy " * 9, "en", f"s{i}") for i in range(60)])
    cells = docs.select(
        shards._group().alias("g"), shards._bucket().alias("b"), shards.size_bytes().alias("s"), "source", "lang", F.col("doc_id").cast("double").alias("id"),
    ).groupBy("g", "b").agg(F.sum("s").alias("w"), F.min("s").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("id").alias("id"))
    points = shards.points_of(cells, n_shards).persist()
    nodes, heavy = shards.tree(points, n_shards)
    first = {i: n.first for i, n in enumerate(nodes)}
    found = {(r.g, r.part): first[r.node] for r in points.select("g", "part", shards.node_of(nodes, heavy).alias("node")).collect()}
    plain = [((r.g, r.part), r.w, (r.y0, r.y1, r.y2, r.y3)) for r in points.collect()]
    assert found == cut_by_hand(plain, n_shards, heavy)
    used = {n.dimension for n in nodes if n.left}
    assert len(used) > 2  # cuts go along several dimensions
    points.unpersist()


def test_sources_that_begin_alike_differ(spark):
    rows = [(1, f"text {i:03}", "en", "source_" + "ab"[i % 2]) for i in range(200)]
    out = shards.assign(frame(spark, rows), 2).collect()
    by_source = defaultdict(set)
    for r in out:
        by_source[r.source].add(r.shard)
    assert by_source["source_a"] != by_source["source_b"] and all(len(x) == 1 for x in by_source.values())


def test_long_text(spark):
    rows = [(1, "long " * 1_000_000, "en", "s"), *[(i, f"short {i}", "en", "s") for i in range(2, 50)]]
    out = shards.assign(frame(spark, rows), 4).collect()
    assert {r["size"] for r in out if r.doc_id == 1} == {5_000_008} and len(out) == 49


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "en", "é"), (2, "a", "en", "s"), (2, "b", "en", "s")]
    df = frame(spark, rows).selectExpr("*", "'clash' as shard", "1 as slot", "2 as node", "3 as g")
    out = shards.assign(df, 3).collect()
    assert len(out) == 5 and {r.node for r in out} == {2}
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert shards.assign(df.limit(0), 3).collect() == []
    one = shards.assign(df.limit(1), 24).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_query(spark):
    rows = QUERIES["op8_kd_shards"](spark, "/root/testdata/sf0.001").collect()
    check(rows, 24, 0.1)
    assert {r.law for r in rows} == {"bytes"}
