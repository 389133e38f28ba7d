"""Near-duplicate documents by DartMinHash sketches, banded joining and exact verification.

A document is a weighted set: its five-word shingles, weighted by how often they occur. Each unit
of weight of a shingle throws darts: a Poisson number of them, drawn by hash, into each cell of the
rank axis, and every dart has a coordinate and a rank of its own. The dart of least rank at each of
``COORDINATES`` coordinates is the sketch. Two sets agree at a coordinate with the probability of
their weighted Jaccard similarity, and only about ``t log t`` darts are made for a set, however
many shingles it has: the rank axis is cut off where that many have been thrown, and extended in
the rare case that a coordinate is empty.

Sketches are cut into ``BANDS`` bands; texts that agree in a band share a bucket. In each bucket
the members are compared with a hub, its least text, and then with texts linked to it as long as
that links more of them, for two rounds. All that are left, in small buckets and large ones alike, are compared with
every text of another class that can reach the threshold with them by the sizes and the rarest
shingles of both, which is exact. A pair is a link if the weighted Jaccard similarity of its texts is ``THRESHOLD`` or more, computed from all
their shingles. Classes are the connected components of the links.

At similarity 0.8 two texts miss all 25 bands with a probability of 5 in 100,000.

Defined results: equal texts (null counts as empty) are collapsed first and are one class. Texts of
one to four words have one shingle, the whole text; texts without a word are in a class with equal
texts only. The class id is the least id in the class, null ids left aside. Every row gives one row;
one row of each class is kept, the one with the least id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.llm.common import documents, free, whole
from wayloom.llm.words import GOLDEN, WordIds, mix, windows
from wayloom.session import stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
COORDINATES = BANDS * ROWS
#: Hubs that a bucket gets at once after the first, out of what is linked to it.
MORE_HUBS = 4
#: Rounds of hubs. They only save time, as all pairs that they leave are compared afterwards.
HUB_ROUNDS = 2
#: What bounds on sizes are widened by, against rounding.
EPSILON = 1e-6
#: Edges of the rank cells below 1; above, cells have width 1.
LOW_EDGES = (0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1)
UNIT = 2.0**-53


@cache
def cells(count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower edge, width and key of the first rank cells."""
    edges = np.array([*LOW_EDGES, *range(2, max(3, count + 2))], float)
    keys = mix(np.arange(1, len(edges), dtype=np.uint64) * GOLDEN)
    return edges[:-1], np.diff(edges), keys


@cache
def poisson(mean: float) -> np.ndarray:
    """Probabilities of at most 0, 1, 2 … darts, up to where more are beyond a 53-bit draw."""
    found, term, k = [], math.exp(-mean), 0
    while not found or 1 - found[-1] > UNIT and k < 60:
        found.append((found[-1] if found else 0) + term)
        k += 1
        term *= mean / k
    return np.minimum(np.array(found), 1 - UNIT)


def elements(words: np.ndarray) -> np.ndarray:
    """The units of weight of a text's shingles: a hash for each shingle and copy of it."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    shingles = windows(words, min(SHINGLE, len(words)))
    shingles = np.sort(shingles)
    starts = np.flatnonzero(np.concatenate(([True], shingles[1:] != shingles[:-1])))
    copies = np.arange(len(shingles)) - np.repeat(starts, np.diff(np.append(starts, len(shingles))))
    return mix(shingles + mix(copies.astype(np.uint64)))


def sketch(units: np.ndarray) -> np.ndarray:
    """The dart of least rank at each coordinate; the units must not be empty."""
    limit = COORDINATES * (math.log(COORDINATES) + 4) / len(units)
    while True:
        lower, width, keys = cells(1 << max(0, math.ceil(math.log2(limit + 1))))
        used = int(np.searchsorted(lower, limit))
        lower, width, keys = lower[:used], width[:used], keys[:used]
        thrown = mix(units[:, None] ^ keys[None, :])
        draws = (thrown >> np.uint64(11)) * UNIT
        some, cell = np.nonzero(draws > np.exp(-width)[None, :])
        draws, thrown = draws[some, cell], thrown[some, cell]
        counts = np.zeros(len(cell), np.int64)
        for size in set(width[np.unique(cell)].tolist()):
            at = width[cell] == size
            counts[at] = np.searchsorted(poisson(size), draws[at], side="left")
        ends = np.cumsum(counts)
        number = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
        darts = mix(np.repeat(thrown, counts) + (number + 1).astype(np.uint64) * GOLDEN)
        cell = np.repeat(cell, counts)
        ranks = lower[cell] + width[cell] * ((mix(darts) >> np.uint64(11)) * UNIT)
        near = ranks < limit
        darts, ranks = darts[near], ranks[near]
        at = (darts % np.uint64(COORDINATES)).astype(np.int64)
        order = np.lexsort((darts, ranks, at))
        at, first = np.unique(at[order], return_index=True)
        if len(at) == COORDINATES:
            return darts[order][first]
        limit *= 2


def bands(signature: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band; equal bands of different number have different keys."""
    parts = signature.reshape(BANDS, ROWS)
    keys = mix(np.arange(BANDS, dtype=np.uint64))
    for k in range(ROWS):
        keys = mix(keys * GOLDEN + parts[:, k])
    return keys.view(np.int64)


def sketched(rows: DataFrame) -> DataFrame:
    """``(id, digest, bands)`` of rows ``(id, digest, text)``; texts without words have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            found = []
            for text in batch.column(2):
                units = elements(ids.of((text.as_py() or b"").split()))
                found.append(bands(sketch(units)) if len(units) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))],
                names=["id", "digest", "bands"],
            )

    return rows.mapInArrow(run, "id long, digest binary, bands array<long>")


def with_elements(rows: DataFrame) -> DataFrame:
    """``(node, units)`` of rows ``(node, text)``: the distinct units, by 32 bits of their hashes.

    Two different units of a pair share those bits with a probability below 1 in a million for
    texts of up to 4,000 words, which moves a similarity by less than its fifth digit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            found = []
            for text in batch.column(1):
                units = elements(ids.of((text.as_py() or b"").split()))
                found.append(np.unique((units >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["node", "units"]
            )

    return rows.mapInArrow(run, "node long, units array<int>")


def _digest(text_col: str):
    return F.unhex(F.md5(whole(text_col)))


def verified(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose similarity reaches the threshold, with it."""
    left = units.select(F.col("node").alias("a"), F.col("units").alias("units_a"))
    right = units.select(F.col("node").alias("b"), F.col("units").alias("units_b"))
    shared = F.size(F.array_intersect("units_a", "units_b"))
    joined = pairs.join(left, "a").join(right, "b")
    alike = shared / (F.size("units_a") + F.size("units_b") - shared)
    return joined.select("a", "b", alike.alias("similarity")).where(F.col("similarity") >= threshold)


def shared_buckets(members: DataFrame) -> DataFrame:
    """The members of buckets that have two or more."""
    large = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return members.join(stage(large), "bucket", "left_semi")


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``(bucket, band, node, label)`` of the members of buckets with more than one label."""
    members = members.select("bucket", "band", "node")
    if labels is None:
        members = members.withColumn("label", F.col("node"))
    else:
        members = members.join(labels, "node", "left").select(
            "bucket", "band", "node", F.coalesce("label", "node").alias("label")
        )
    members = stage(members)
    mixed = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return members.join(stage(mixed.where("lo <> hi").select("bucket")), "bucket", "left_semi")


def hubs_of(members: DataFrame, parts: int) -> DataFrame:
    """``(bucket, hub, hub_label)``: the least member of each part that a bucket's members fall
    into by hash. Only aggregates, so a large bucket never meets in one task."""
    part = F.pmod(F.xxhash64("node", "bucket"), F.lit(parts)).alias("part")
    least = members.groupBy("bucket", part).agg(F.min("node").alias("hub"))
    own = members.select("bucket", F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    return stage(least.select("bucket", "hub").join(own, ["bucket", "hub"]))


def candidates(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of members with hubs of their bucket that have another label."""
    pairs = members.join(hubs, "bucket").where(F.col("label") != F.col("hub_label"))
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def rare_first(nodes: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """``(unit, node, label, size, place)``: the rarest units of each node, as many as a set of the
    threshold's similarity, equal in size or smaller, cannot all lack.

    ``place`` counts from the rarest unit. Units of one node only come first and are left out.
    """
    held = units.join(nodes, "node").select("node", "label", F.size("units").alias("size"), F.explode("units").alias("unit"))
    held = stage(held)
    common = held.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1")
    found = held.join(common, "unit").groupBy("node", "label", "size")
    found = found.agg(F.sort_array(F.collect_list(F.struct("n", "unit"))).alias("units"))
    placed = found.select("node", "label", "size", F.size("units").alias("of"), F.posexplode("units").alias("at", "unit"))
    placed = placed.select(
        F.col("unit.unit").alias("unit"), "node", "label", "size", (F.col("size") - F.col("of") + F.col("at")).alias("place")
    )
    return placed.where(F.col("place") <= F.col("size") * (1 - threshold) + EPSILON)


def alike_by_rare_units(nodes: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` of rows ``(node, label)`` that differ in label and may reach the threshold.

    Two sets of that similarity share at least ``threshold / (1 + threshold)`` of their sizes' sum.
    If both are in one order, the first unit that they share has so many from there on in either
    set; so it is among the rarest of both, and one equality join on those finds every such pair.
    Units of one label only are left out, and the largest label of a unit is not joined to itself.
    """
    held = stage(rare_first(nodes, units, threshold))
    counts = held.groupBy("unit", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("unit").agg(F.count("*").alias("labels"), F.max_by("label", "n").alias("most"))
    held = held.join(most.where("labels > 1").drop("labels"), "unit")
    held = stage(held.withColumn("other", F.col("label") != F.col("most")).drop("most"))
    share = threshold / (1 + threshold)
    low = held.where(F.col("place") <= F.col("size") * (1 - 2 * share) + EPSILON)
    low = low.select("unit", *[F.col(c).alias(f"{c}_low") for c in ("node", "label", "size", "place", "other")])
    fits = (
        (F.col("label") != F.col("label_low"))
        & (F.struct("size_low", "node_low") < F.struct("size", "node"))
        & (F.col("size_low") >= F.col("size") * threshold - EPSILON)
        & (
            F.least(F.col("size") - F.col("place"), F.col("size_low") - F.col("place_low"))
            >= (F.col("size") + F.col("size_low")) * share - EPSILON
        )
    )
    found = [
        low.where(mine).join(held.where(theirs), "unit").where(fits)
        for mine, theirs in ((F.col("other_low"), F.lit(True)), (~F.col("other_low"), F.col("other")))
    ]
    pairs = found[0].unionByName(found[1])
    return pairs.select(F.least("node", "node_low").alias("a"), F.greatest("node", "node_low").alias("b")).distinct()


class Links:
    """Links found so far, the pairs already compared, and the components they make."""

    def __init__(self, units: DataFrame, threshold: float):
        self.units, self.threshold = units, threshold
        none = units.where(F.lit(False)).select(F.col("node").alias("a"), F.col("node").alias("b"))
        self.tested, self.kept, self.labels = none, verified(none, units, threshold), None

    def compare(self, pairs: DataFrame) -> None:
        new = stage(pairs.join(self.tested, ["a", "b"], "left_anti"))
        self.tested = self.tested.unionByName(new)
        more = stage(verified(new, self.units, self.threshold).distinct())
        if not more.isEmpty():
            self.kept = self.kept.unionByName(more)
            self.labels = stage(components(self.kept))

    def grow(self, members: DataFrame) -> DataFrame:
        """Compare each bucket with its least member, and then with members that were linked to it,
        a few at a time, as long as that links more of the bucket and for ``HUB_ROUNDS`` at most;
        returns the members of buckets that still have several labels.

        A text between others that are not alike themselves, such as the source of many edited
        copies, is so found as soon as one of them is a hub.
        """
        open_ = stage(labelled(members, self.labels))
        rest, used, first = open_.limit(0), None, None
        for _ in range(HUB_ROUNDS):
            if open_.isEmpty():
                break
            if used is None:
                hubs = first = hubs_of(open_, 1)
                used = hubs.select("bucket", F.col("hub").alias("node"))
            else:
                core = open_.join(first.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_semi")
                core = core.select("bucket", "label")
                linked = open_.join(core, ["bucket", "label"], "left_semi")
                hubs = hubs_of(linked.join(used, ["bucket", "node"], "left_anti"), MORE_HUBS)
                used = stage(used.unionByName(hubs.select("bucket", F.col("hub").alias("node"))))
            self.compare(candidates(open_, hubs))
            before = open_.select("bucket", "node", F.col("label").alias("former"))
            now = stage(labelled(open_, self.labels))
            moved = now.join(before, ["bucket", "node"]).where(F.col("label") != F.col("former"))
            going = stage(moved.select("bucket").distinct())
            rest = rest.unionByName(now.join(going, "bucket", "left_anti"))
            open_ = stage(now.join(going, "bucket", "left_semi"))
        return stage(labelled(rest.unionByName(open_), self.labels))

    def finish(self, members: DataFrame) -> None:
        """Compare all members that may still be linked to one of another class."""
        left = stage(labelled(members, self.labels))
        if not left.isEmpty():
            self.compare(alike_by_rare_units(left.select("node", "label").distinct(), self.units, self.threshold))


def links(docs: DataFrame, texts: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Verified links ``(a, b, similarity)`` between texts that share a bucket.

    ``texts`` has ``(node, digest, rep_id)``; ``docs`` has ``(id, digest, text)``; ``sketches`` has
    ``(node, bands)``.
    """
    members = stage(sketches.select(F.posexplode("bands").alias("band", "bucket"), "node"))
    members = stage(shared_buckets(members))
    needed = texts.join(members.select("node").distinct(), "node", "left_semi")
    held = needed.select("node", F.col("digest").alias("of"), "rep_id")
    found = docs.join(held, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("rep_id")))
    units = stage(with_elements(found.select("node", F.col("text").cast("binary").alias("text"))))
    state = Links(units, threshold)
    state.finish(state.grow(members))
    return state.kept


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of all nodes with a link: the least node of their component.

    Each round a node takes the least label of itself and its neighbours, then the label of that
    label, so chains halve; rounds end when no label changes.
    """
    both = stage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        taken = stage(labels.join(least, "node").select("node", "label", F.least("label", "near").alias("new")))
        jump = taken.select(F.col("node").alias("new"), F.col("new").alias("next"))
        moved = stage(
            taken.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("next", "new")).alias("new"))
        )
        changed = not moved.where("label <> new").isEmpty()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """The class of every row, and the links behind the classes.

    First ``(id, digest, row, class_id, class_size, kept)``, staged; then ``(a, b, similarity)``
    between the ids of texts, one of each set of equal texts.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("id"), _digest(text_col).alias("digest"), whole(text_col).alias("text")
    )
    rows = stage(
        sketched(source.withColumn("text", F.col("text").cast("binary"))).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    texts = stage(rows.groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("rep_id")))
    sketches = rows.select(F.col("row").alias("node"), "bands").join(texts.select("node"), "node", "left_semi")
    found = stage(links(source, texts, stage(sketches), threshold))
    labels = stage(components(found))
    of_texts = stage(
        texts.join(labels, "node", "left").select("digest", "node", "rep_id", F.coalesce("label", "node").alias("label"))
    )
    placed = stage(rows.select("id", "row", "digest").join(of_texts.select("digest", "label"), "digest"))
    sums = placed.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    firsts = placed.join(stage(sums), "label")
    # One row stays, also where ids repeat or all are null: the first of those with the least id.
    least = (
        firsts.where(F.col("id").eqNullSafe(F.col("class_id")))
        .groupBy("label")
        .agg(F.min("row").alias("kept_row"), F.first("class_id").alias("class_id"), F.first("class_size").alias("class_size"))
    )
    result = placed.join(stage(least), "label").select(
        "id", "digest", "row", "class_id", "class_size", (F.col("row") == F.col("kept_row")).alias("kept")
    )
    names = of_texts.select("node", "rep_id")
    named = found.join(names.withColumnsRenamed({"node": "a", "rep_id": "id_a"}), "a").join(
        names.withColumnsRenamed({"node": "b", "rep_id": "id_b"}), "b"
    )
    return stage(result), named.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "similarity")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One document of each class, with all columns."""
    digest, copy, key, keep = free(docs, "digest", "copy", "key", "keep")
    kept = classes(docs, id_col, text_col, threshold)[0].where("kept")
    kept = kept.select(F.col("digest").alias(key), F.col("id").alias(keep))
    found = docs.withColumn(digest, _digest(text_col)).join(
        kept, (F.col(digest) == F.col(key)) & F.col(id_col).cast("long").eqNullSafe(F.col(keep))
    )
    same = Window.partitionBy(key, keep).orderBy(F.lit(0))
    return found.withColumn(copy, F.row_number().over(same)).where(F.col(copy) == 1).select(*docs.columns)


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = classes(documents(spark, folder))[0]
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
