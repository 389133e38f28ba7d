"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest capacity. A piece goes, longest pieces
first, into the open bin that it fills best. If none has room, a bin is opened whose size costs
least for each token it holds (``cost``); when all pieces are placed, every bin is downsized to the
smallest capacity that holds its contents, so that a size chosen too large costs nothing.

Pieces are dealt by hash into shards of about ``SHARD_PIECES``, which are packed independently:
the number of shards grows with the input, the memory and time of one shard do not, and neither a
long document nor a hot source meets in one shard. The loss against one global packing is at most
the few bins that each shard leaves partly filled.

Defined results: every row gives its pieces in order; together they cover it exactly. A null or
empty text, of length 0, gives one row without a bin. Repeated rows and null ids are packed like
any other. Ties are broken by id and position, so a rerun gives the same bins.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import documents, whole
from wayloom.session import stage

CAPACITIES = (512, 1024, 2048)
SHARD_PIECES = 8192
WORD = r"[^\x20\x09-\x0D]+"
_BINS = 1_000_000


def n_words(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def cost(capacity: int) -> float:
    """Work on one sequence: a fixed part, one for each token, and attention between them."""
    return 64 + capacity + capacity * capacity / 8192


def fit(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Bin of each length, its start in the bin, and the downsized capacity of each bin.

    ``lengths`` come in the order in which they are to be placed; none exceeds the largest capacity.
    """
    sizes = sorted(capacities)
    # The size to open for a length: least cost for each token among those that hold it.
    best = {c: min((s for s in sizes if s >= c), key=lambda s: (cost(s) / s, -s)) for c in sizes}
    open_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if an open bin has room for exactly r
    bins, starts, used = [], [], []
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room = best[sizes[bisect_left(sizes, length)]]
            at = len(used)
            used.append(0)
        bins.append(at)
        starts.append(used[at])
        used[at] += length
        if room > length:
            open_bins.setdefault(room - length, []).append(at)
            rooms |= 1 << (room - length)
    return bins, starts, [sizes[bisect_left(sizes, u)] for u in used]


def _pack_shard(table: pa.Table, capacities: tuple[int, ...]) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
    bins, starts, sizes = fit(table.column("length").to_pylist(), capacities)
    shard = table.column("shard").to_pylist()
    return pa.table(
        {
            "id": table.column("id"),
            "piece": table.column("piece"),
            "start": table.column("start"),
            "length": table.column("length"),
            "bin_id": pa.array([s * _BINS + b for s, b in zip(shard, bins)], pa.int64()),
            "bin_start": pa.array(starts, pa.int64()),
            "capacity": pa.array([sizes[b] for b in bins], pa.int64()),
        }
    )


def pack(
    docs: DataFrame,
    length: Column,
    id_col: str = "doc_id",
    capacities: tuple[int, ...] = CAPACITIES,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """``(id, piece, start, length, bin_id, bin_start, capacity)`` for every piece.

    ``length`` gives a row's tokens; ``start`` counts from the row's first, ``bin_start`` from the
    bin's.
    """
    top = max(capacities)
    measured = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("row"),
        length.cast("long").alias("total"),
    )
    last = F.greatest(F.ceil(F.col("total") / top) - 1, F.lit(0))
    cut = measured.select("id", "row", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = stage(
        cut.select(
            "id",
            "row",
            "piece",
            (F.col("piece") * top).alias("start"),
            F.least(F.col("total") - F.col("piece") * top, F.lit(top)).alias("length"),
        )
    )
    filled = F.col("length") > 0
    shards = max(1, -(-pieces.where(filled).count() // shard_pieces))
    dealt = pieces.where(filled).withColumn(
        "shard", F.pmod(F.xxhash64("id", "row", "piece"), F.lit(shards)).cast("long")
    )

    def shard(table: pa.Table) -> pa.Table:
        return _pack_shard(table, tuple(capacities))

    packed = dealt.groupBy("shard").applyInArrow(
        shard,
        "id long, piece long, start long, length long, bin_id long, bin_start long, capacity long",
    )
    none = F.lit(None).cast("long")
    empty = pieces.where(~filled).select(
        "id", "piece", "start", "length", none.alias("bin_id"), none.alias("bin_start"), none.alias("capacity")
    )
    return packed.unionByName(empty).withColumnRenamed("id", id_col)


def bins(packed: DataFrame) -> DataFrame:
    """``(bin_id, capacity, used, pieces)`` for every bin."""
    return packed.where(F.col("bin_id").isNotNull()).groupBy("bin_id").agg(
        F.first("capacity").alias("capacity"), F.sum("length").alias("used"), F.count("*").alias("pieces")
    )


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder), n_words("text"))
