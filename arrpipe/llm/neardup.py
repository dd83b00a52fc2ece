"""Near-duplicate classes with DartMinHash signatures and banded joining.

A document is a weighted set of shingles of five words (a shorter text is one shingle). Darts are thrown at
the plane of each element: in every unit cell of its weight axis, they arrive along the rank axis as a
Poisson process whose gaps are hashed from the element and the cell, so equal elements of different documents
see the same darts. A dart counts if it falls below the element's weight. Each dart belongs to
one of ``COORDINATES`` coordinates by hash, and a coordinate keeps its earliest dart: two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Only darts up to a rank of
about ``k (ln k + 2) / total weight`` are generated, so large sets cost one hash per element; where a coordinate stays
empty the rank is doubled.

By default an element weighs 1, which gives the Jaccard similarity of sets; ``weights="count"`` takes occurrences.

Signatures are cut into bands of rows; documents sharing a band are candidates (at similarity 0.8, 32 bands of 4 rows miss
5 pairs in 10^8). Documents with the same weighted set are first collapsed into one representative, so thousands of copies cost
nothing further. Within a band's bucket no pairs are listed: in each round, the bucket's leader (the least by a hash of
the round and band) is compared with the members that aren't in its class yet, exactly, on the shingles. Buckets whose
members are all of one class retire, and so do members that have too many shingles of their own to be similar to any other.
After ``STAR_ROUNDS`` rounds, what is left in open buckets goes through a prefix-filtered join on the
elements in which members differ from a common hub, which finds every pair that can still reach the threshold (see
``_rest``). So every candidate pair is either verified, in one class already, or provably below the threshold.

Classes are connected components, found by hooking each class to its least neighbour and jumping.

Defined results: null texts and texts without words are in a class of their own each; a repeated row is a copy; a null id is
a document, ordered last; a very long text is worked on by itself, at some 40 bytes a word; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, mix64, stage, text_tag, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
STAR_ROUNDS = 3
CHUNK_ROWS, CHUNK_BYTES = 256, 2_000_000

_SIGNED = pa.schema(
    [("id", pa.int64()), ("tag", pa.int64()), ("same", pa.binary()), ("n", pa.float64()), ("bands", pa.list_(pa.int64()))]
)
_SIGNED_DDL = "id long, tag long, same binary, n double, bands array<long>"


def elements(text: str | None, shingle: int = SHINGLE, counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit shingle hashes and their weights."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    if len(_HASHES) > _CACHE:
        _HASHES.clear()
    known = _HASHES.get
    one = np.fromiter((known(w) or _hash(w) for w in words), dtype=np.uint64, count=len(words))
    size = min(shingle, len(one))
    code = np.full(len(one) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + one[j : len(one) - size + 1 + j])
    code.sort()
    first = np.concatenate([[True], code[1:] != code[:-1]])
    found = code[first]
    if not counts:
        return found, np.ones(len(found))
    return found, np.diff(np.append(np.flatnonzero(first), len(code))).astype(float)


_HASHES: dict[bytes, int] = {}  # of recently seen words
_CACHE = 500_000


def _hash(word: bytes) -> int:
    found = _HASHES[word] = xxhash.xxh3_64_intdigest(word)
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate, for every (nonempty) weighted set, as 64-bit names."""
    n = len(sets)
    names, best = np.zeros(n * k, dtype=np.uint64), np.full(n * k, np.inf)
    limit = np.array([k * (math.log(k) + 2) / w.sum() for _, w in sets])
    pending = np.arange(n)
    while len(pending):
        # The unit cells of all elements of the pending sets.
        owner = np.repeat(pending, [len(sets[i][0]) for i in pending])
        element = np.concatenate([sets[i][0] for i in pending])
        height = np.concatenate([sets[i][1] for i in pending])  # the part of a cell below the element's weight
        cell = np.zeros(len(element), np.uint64)
        if (height > 1).any():
            cells = np.ceil(height).astype(np.int64)
            inner = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
            owner, element, height = (np.repeat(x, cells) for x in (owner, element, height))
            height, cell = height - inner, inner.astype(np.uint64)
        state = mix64(element + (cell + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        whole = bool((height >= 1).all())
        end = limit[owner]
        rank = np.zeros(len(element))
        slots, ranks, darts = [], [], []
        while len(state):
            state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
            rank = rank - np.log(_unit(state))
            alive = np.flatnonzero(rank <= end)
            state, rank, owner, end = state[alive], rank[alive], owner[alive], end[alive]
            name = (state ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)
            name ^= name >> np.uint64(32)
            slot = owner * k + (name % np.uint64(k)).astype(np.int64)
            if whole:
                slots.append(slot), ranks.append(rank), darts.append(name)
                continue
            height = height[alive]
            inside = np.flatnonzero(_unit(mix64(name)) < height)
            slots.append(slot[inside]), ranks.append(rank[inside]), darts.append(name[inside])
        best.reshape(n, k)[pending] = np.inf
        slot, rank, name = (np.concatenate(x) for x in (slots, ranks, darts))
        np.minimum.at(best, slot, rank)
        earliest = rank == best[slot]
        names[slot[earliest]] = name[earliest]
        pending = pending[np.isinf(best.reshape(n, k)[pending]).any(axis=1)]
        limit[pending] *= 2
    return names.reshape(n, k)


def band_keys(names: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = names.reshape(len(names), bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    key = np.broadcast_to(key, rows.shape[:2])
    for j in range(rows.shape[2]):
        key = mix64(key ^ rows[:, :, j]) + np.uint64(j)
    return key.astype(np.int64)


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Rows that are worked on at once: few enough texts, and of bounded length together unless one alone is longer."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        if i > start and (i - start == CHUNK_ROWS or held + (n or 0) > CHUNK_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def _sign(shingle: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 2):
                sets = [elements(t, shingle, counts) for t in part.column(2).to_pylist()]
                full = [i for i, (e, _) in enumerate(sets) if len(e)]
                keys: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, band_keys(signatures([sets[i] for i in full])), strict=True):
                        keys[i] = row
                same = [
                    xxhash.xxh3_128_digest(e.tobytes() + (w.tobytes() if counts else b"")) if len(e) else None for e, w in sets
                ]
                sizes = [float(w.sum()) for _, w in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(same, pa.binary()), pa.array(sizes), pa.array(keys, pa.list_(pa.int64()))],
                    schema=_SIGNED,
                )

    return run


def _sets(shingle: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 1):
                sets = [elements(t, shingle, counts) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([e.tobytes() for e, _ in sets], pa.binary()), pa.array([w.astype(np.float32).tobytes() if counts else b"" for _, w in sets], pa.binary())],
                    names=["rep", "items", "weights"],
                )

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


def _decoded(items: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(items, np.uint64)
    return e, np.frombuffer(weights, np.float32).astype(float) if weights else np.ones(len(e))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            x = [batch.column(c)[i].as_py() for c in range(2, 6)]
            out.append(similarity(_decoded(x[0], x[1]), _decoded(x[2], x[3])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Staged: a, b, similarity of the pairs (a, b)."""
    one = sets.select(F.col("rep").alias("a"), F.col("items").alias("ai"), F.col("weights").alias("aw"))
    two = sets.select(F.col("rep").alias("b"), F.col("items").alias("bi"), F.col("weights").alias("bw"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ai", "aw", "bi", "bw")
    return stage(joined.mapInArrow(_verify, "a long, b long, similarity double"), "similar")


def components(classes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """``classes`` (rep, class) with the classes that ``edges`` (a, b) connect made one, the least.

    Each class hooks to its least neighbour, and pointers are followed four steps; repeated until
    no edge connects two classes, or ``most`` times.
    """
    labels, done = classes, 0
    while most is None or done < most:
        ends = (
            edges.join(labels.select(F.col("rep").alias("a"), F.col("class").alias("ca")), "a")
            .join(labels.select(F.col("rep").alias("b"), F.col("class").alias("cb")), "b")
            .where("ca <> cb")
            .select(F.greatest("ca", "cb").alias("c"), F.least("ca", "cb").alias("p"))
        )
        parent = stage(ends.groupBy("c").agg(F.min("p").alias("p")), "class-parents")
        if parent.isEmpty():
            break
        two = _jumped(parent)
        labels = stage(
            labels.join(_jumped(two), F.col("class") == F.col("c"), "left").select("rep", F.coalesce("p", "class").alias("class")), "classes"
        )
        done += 1
    return labels


def _jumped(parent: DataFrame) -> DataFrame:
    """Every pointer replaced by where it leads in two steps."""
    up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    return parent.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"))


def document_key() -> Column:
    return F.struct(id_key().alias("id"), text_tag().alias("tag"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, weights: str = "set") -> DataFrame:
    """A row per document: id (null ids as the greatest long), tag, class, keep.

    ``class`` is the least id of the group that similarities of ``threshold`` connect, and ``keep`` holds for one row per group.
    """
    counts = weights == "count"
    signed = stage(
        docs.select(id_key().alias("id"), text_tag().alias("tag"), "text").mapInArrow(_sign(shingle, counts), _SIGNED_DDL), "signatures"
    )
    full = signed.where("same is not null")
    # One representative per weighted set; partial sums keep hot copies cheap.
    reps = stage(
        full.groupBy("same").agg(F.min(F.struct("id", "tag", "n", "bands")).alias("r"))
        .select("same", F.monotonically_increasing_id().alias("rep"), F.col("r.id").alias("id"), F.col("r.tag").alias("tag"), F.col("r.n").alias("n"), F.col("r.bands").alias("bands")),
        "representatives",
    )
    spread = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    rows = stage(spread.join(shared, "key"), "buckets")
    wanted = rows.select("rep").distinct().join(reps.select("rep", "id", "tag"), "rep").select("rep", F.col("id").alias("wi"), F.col("tag").alias("wt"))
    texts = docs.select(id_key().alias("id"), text_tag().alias("tag"), "text")
    sets = stage(
        texts.join(wanted, (F.col("id") == F.col("wi")) & (F.col("tag") == F.col("wt")))
        .select("rep", "text").mapInArrow(_sets(shingle, counts), "rep long, items binary, weights binary").dropDuplicates(["rep"]),
        "shingle-sets",
    )
    classes = _link(rows, sets, threshold)
    # A class is named by its least document id.
    placed = reps.join(classes, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    heads = placed.groupBy("class").agg(F.min(F.struct("id", "tag")).alias("head"))
    member = stage(
        placed.join(heads, "class").select("same", F.col("head.id").alias("class"), F.col("head.tag").alias("class_tag")),
        "members",
    )
    inside = full.select("id", "tag", "same").join(member, "same").select("id", "tag", "class", "class_tag")
    alone = signed.where("same is null").select("id", "tag", F.col("id").alias("class"), F.col("tag").alias("class_tag"))
    return inside.unionByName(alone).withColumn(
        "keep", (F.col("id") == F.col("class")) & (F.col("tag") == F.col("class_tag"))
    ).drop("class_tag")


def _link(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Classes (rep, class) of bucket rows (key, rep, n)."""
    classes = stage(rows.select("rep").distinct().withColumn("class", F.col("rep")), "classes")
    known = None
    active = rows.select("key", "rep", "n")
    for round_ in range(STAR_ROUNDS + 1):
        labelled = active.join(classes, "rep")
        # Buckets of several classes go on.
        open_keys = labelled.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
        active = stage(labelled.join(open_keys.select("key"), "key").select("key", "rep", "n", "class"), "open-buckets")
        if round_ == 1:
            active = stage(_possible(active, sets, threshold), "open-buckets")
        if active.isEmpty():
            break
        last = round_ == STAR_ROUNDS
        if last:
            pairs = _rest(active, sets, threshold)
        else:
            order = F.struct(F.xxhash64("rep", "key", F.lit(round_)).alias("h"), "rep", "class", "n")
            leaders = active.groupBy("key").agg(F.min(order).alias("l")).select("key", F.col("l.rep").alias("leader"), F.col("l.class").alias("lc"), F.col("l.n").alias("ln"))
            pairs = (
                active.join(leaders, "key").where("class <> lc")
                .where(F.least("n", "ln") >= F.lit(threshold) * F.greatest("n", "ln"))
                .select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
            )
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        new = compared(pairs, sets)
        known = new if known is None else known.unionByName(new)
        if last:
            break
        # Some steps are enough here: classes that are still apart are only compared in vain.
        classes = components(classes, new.where(F.col("similarity") >= threshold).select("a", "b"), 2)
        active = active.select("key", "rep", "n")
    if known is None:
        known = rows.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0.0).alias("similarity")).limit(0)
    return components(classes, known.where(F.col("similarity") >= threshold).select("a", "b"))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, items, weights, hub, size) to one row per element."""
    for batch in batches:
        for _, items, weights, hub, size in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            e, w = _decoded(items, weights)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(e), hub)), pa.array(np.full(len(e), size)), pa.array(e.view(np.int64)), pa.array(w)],
                names=["hub", "size", "item", "w"],
            )


def _lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rep, items, weights in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            e, w = _decoded(items, weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), rep)), pa.array(e.view(np.int64)), pa.array(w)], names=["rep", "item", "w"])


def _possible(active: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The bucket rows that can still have a partner in their bucket.

    Elements that no other open document holds can't be in an intersection. With the weight ``s`` of the others, and
    no partner smaller than the least size that the bucket and the threshold allow, the similarity is at most
    ``s / (n + least - s)``. Counting elements combines before the shuffle, so common ones cost nothing.
    """
    reps = active.select("rep").distinct()
    items = sets.join(reps, "rep", "left_semi").select("rep", "items", "weights").mapInArrow(_lone, "rep long, item long, w double")
    lone = (
        items.groupBy("item").agg(F.count("*").alias("m"), F.min("rep").alias("rep"), F.min("w").alias("w")).where("m = 1")
        .groupBy("rep").agg(F.sum("w").alias("lone"))
    )
    least = active.groupBy("key").agg(F.min("n").alias("least"))
    common = F.col("n") - F.coalesce("lone", F.lit(0.0))
    bound = common / (F.col("n") + F.greatest(F.col("least"), F.col("n") * threshold) - common)
    return (
        active.join(least, "key").join(lone, "rep", "left").where(bound >= F.lit(threshold - 1e-9))
        .select("key", "rep", "n", "class")
    )


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, rep, common elements and weights, rep's set) to the elements in which they differ, and by how much."""
    for batch in batches:
        hubs, reps = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            common = np.array(batch.column(2)[i].as_py() or [], np.int64).view(np.uint64), np.array(batch.column(3)[i].as_py() or [])
            own = _decoded(batch.column(4)[i].as_py(), batch.column(5)[i].as_py())
            item, at = np.unique(np.concatenate([common[0], own[0]]), return_inverse=True)
            weight = np.abs(np.bincount(at, weights=np.concatenate([-common[1], own[1]]), minlength=len(item)))
            item, weight = item[weight > 0], weight[weight > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hubs[i]]), pa.array([reps[i]]), pa.array([float(weight.sum())]), pa.array([item.view(np.int64)]), pa.array([weight])],
                names=["hub", "rep", "gap", "items", "weights"],
            )


def _rest(active: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs of different classes in open buckets that may be similar, without listing all pairs of a bucket.

    Each bucket has a hub, the member in most open buckets, and buckets of one hub share a reference set: the elements that
    most of their members hold. With ``D(x)`` the elements in which x and the reference differ, x and y differ by at least ``|D(x)| + |D(y)| - 2 |D(x) and D(y)|``, and similar ones by at most ``r (n(x) + n(y))``, ``r = (1 - t) /
    (1 + t)``, so by at most ``limit(x)``, y being no larger than ``n(x) / t`` and the hub's
    largest member. So similar y share of D(x) at least ``|D(x)| - limit(x)``: every such y
    has one of the first elements of D(x), in any order, that leave less than that. The order is by
    rarity, and what a document has edited is rare. If D(x) is within the limit, y shares an element of D(x) or is itself
    within the limit's rest of the reference. Members of the hub's own class don't look for partners.
    """
    degree = active.groupBy("rep").agg(F.count("*").alias("d"))
    hubs = active.join(degree, "rep").groupBy("key").agg(F.max(F.struct("d", "rep", "class")).alias("h")).select("key", F.col("h.rep").alias("hub"), F.col("h.class").alias("hc"))
    members = active.join(hubs, "key").select("hub", "hc", "rep", "class", "n").distinct()
    largest = members.groupBy("hub").agg(F.max("n").alias("most"), F.count("*").alias("size"))
    members = stage(members.join(largest, "hub"), "hub-members")
    items = (
        members.select("hub", "rep", "size").join(sets, "rep").select("rep", "items", "weights", "hub", "size")
        .mapInArrow(_elements, "hub long, size long, item long, w double")
    )
    common = (
        items.groupBy("hub", "item").agg(F.count("*").alias("m"), F.first("size").alias("size"), F.max("w").alias("w"))
        .where("2 * m > size")
        .groupBy("hub").agg(F.collect_list(F.struct("item", "w")).alias("c"))
        .select("hub", F.col("c.item").alias("ci"), F.col("c.w").alias("cw"))
    )
    apart = (
        members.select("hub", "rep").join(common, "hub", "left").join(sets, "rep").select("hub", "rep", "ci", "cw", "items", "weights")
        .mapInArrow(_apart, "hub long, rep long, gap double, items array<long>, weights array<double>")
    )
    known = stage(members.join(apart, ["hub", "rep"]), "hub-gaps")
    reach = (1 - threshold) / (1 + threshold)
    limit = (F.col("n") + F.least(F.col("n") / threshold, F.col("most"))) * reach + 1e-9
    listed = known.select("hub", "hc", "rep", "class", "n", "most", "gap", F.explode(F.arrays_zip("items", "weights")).alias("x")).select(
        "hub", "hc", "rep", "class", "n", "most", "gap", F.col("x.items").alias("item"), F.col("x.weights").alias("w")
    )
    often = listed.groupBy("hub", "item").agg(F.count("*").alias("m"))
    # All later elements together must weigh less than what a partner shares.
    onwards = Window.partitionBy("hub", "rep").orderBy("m", "item").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ordered = stage(
        listed.join(often, ["hub", "item"]).withColumn("left", F.sum("w").over(onwards)).where("m > 1"), "hub-elements"
    )
    seekers = ordered.where("class <> hc").where(F.col("left") >= F.col("gap") - limit - 1e-6).select(
        "hub", "item", F.col("rep").alias("x"), F.col("class").alias("cx"), F.col("n").alias("nx"), F.col("gap").alias("gx"), F.col("left").alias("lx")
    )
    partners = ordered.select(
        "hub", "item", F.col("rep").alias("y"), F.col("class").alias("cy"), F.col("n").alias("ny"), F.col("gap").alias("gy"), F.col("left").alias("ly")
    )
    most = (F.col("nx") + F.col("ny")) * reach
    fits = (
        (F.col("x") != F.col("y")) & (F.col("cx") != F.col("cy"))
        & (F.least("nx", "ny") >= F.lit(threshold) * F.greatest("nx", "ny"))
        & (F.abs(F.col("gx") - F.col("gy")) <= most + 1e-9)
    )
    # At the first element that two share, what is left of either covers all that they share.
    enough = 2 * F.least("lx", "ly") >= F.col("gx") + F.col("gy") - most - 1e-6
    sharing = seekers.join(partners, ["hub", "item"]).where(fits & enough).select("x", "y")
    within = known.where(F.col("gap") <= limit).select("hub", "hc", "rep", "class", "n", "gap")
    close = (
        within.where("class <> hc").select("hub", F.col("rep").alias("x"), F.col("class").alias("cx"), F.col("n").alias("nx"), F.col("gap").alias("gx"))
        .join(within.select("hub", F.col("rep").alias("y"), F.col("class").alias("cy"), F.col("n").alias("ny"), F.col("gap").alias("gy")), "hub")
        .where(fits & (F.col("gx") + F.col("gy") <= most + 1e-9))
        .select("x", "y")
    )
    pairs = sharing.unionByName(close)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def unique(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class; of rows repeated as a whole, one."""
    kept = near_duplicates(docs, threshold).where("keep").select(F.col("id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, id_key().alias("_id"), text_tag().alias("_tag"))
    return keyed.join(kept, ["_id", "_tag"], "left_semi").dropDuplicates(["_id", "_tag"]).select("_row.*")
