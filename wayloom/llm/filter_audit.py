"""How filters interact, by incremental retraction streaming.

All files run through one stream in available-now micro-batches. Four filters look at a text alone;
the fifth fails every text that a smaller id has too, wherever it lies, and so can change its mind
with every file that arrives. The stream's state is keyed by text and holds the smallest id so far
with its rows. A row that is not the smallest fails the fifth filter at once. When a smaller id
arrives, the rows held before are retracted from the part counters with the mask they had, counted
again with the fifth filter failed, and the new ones are held. Every micro-batch adds its changes of
the counters (parts x masks, not documents) under its own number, so that a batch that is run again
after a failure replaces itself. The report for all orders of the filters comes from the counters.

Before the shuffle by text, each task settles what its rows decide between them: a hot text reaches
its state as a few rows from each task. The state is kept in RocksDB and not in the heap.

Defined results: a null text counts as empty, a null part as the empty string. Null ids fail the
fifth filter never and make no other fail; rows of one id and text do not fail each other. Repeated
rows count each time. Labels of an id count as one if it has several rows of them; without labels a
document is neither good nor toxic, and a null id has none. An empty table gives no rows. Texts are told apart by SHA-256
and may be as long as a value can be. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from wayloom.llm.common import partitions
from wayloom.session import discard, listing, matches, scratch_path, stage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PCT = 50
MAX_CAPITALS_PCT = 3
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes that continue a code point in UTF-8.
FURTHER = bytes(range(0x80, 0xC0))
COPY = 1 << FILTERS.index("E")
#: Bytes of input that a micro-batch brings to each core.
BYTES_PER_CORE = 32 << 20
#: Buckets of texts whose state is brought up to date together, for each shuffle partition.
BUCKETS_PER_PARTITION = 16
#: Texts that a task settles together before it hands them over.
MAX_TEXTS = 100_000

PROFILE = "id long, part string, digest binary, mask int"
HELD = "digest binary, mask int, id long, copy boolean, part string, good boolean, toxic boolean, n long"
HELD_NAMES = [c.split()[0] for c in HELD.split(", ")]
CHANGE = "part string, mask int, good boolean, toxic boolean, n long"


def text_mask(text: bytes) -> int:
    """Bits of the filters that look at the text alone and that it fails."""
    words = text.split()
    points = len(text) - count_of(text, FURTHER)
    failed = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PCT * len(words),
        100 * count_of(text, CAPITALS) > MAX_CAPITALS_PCT * points,
        any(sign in text for sign in SIGNS),
    )
    return sum(1 << k for k, fails in enumerate(failed) if fails)


def count_of(text: bytes, wanted: bytes) -> int:
    return len(text) - len(text.translate(None, wanted))


def profiles(docs: DataFrame, id_col: str, part_col: str, text_col: str) -> DataFrame:
    """Id, part, digest and mask of every row; the texts go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, masks = [], []
            for text in batch.column(2):
                text = text.as_py() or b""
                digests.append(hashlib.sha256(text).digest())
                masks.append(text_mask(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                names=["id", "part", "digest", "mask"],
            )

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("id"), part.alias("part"), F.col(text_col).cast("binary").alias("text")
    )
    return narrow.mapInArrow(run, PROFILE)


class Texts(dict):
    """What a task knows of each text: its mask, the smallest id, the rows of that id by kind, and
    the other rows, which are copies. A kind is (part, good, toxic)."""

    def add(self, digest: bytes, mask: int, key: int, kind: tuple) -> None:
        found = self.get(digest)
        if found is None:
            found = self[digest] = [mask, key, {}, {}]
        if key < found[1]:
            for old, n in found[2].items():
                found[3][old] = found[3].get(old, 0) + n
            found[1], found[2] = key, {}
        rows = found[2] if key == found[1] else found[3]
        rows[kind] = rows.get(kind, 0) + 1

    def batch(self) -> pa.RecordBatch:
        rows = [
            (digest, mask, key, copy, *kind, n)
            for digest, (mask, key, *both) in self.items()
            for copy, kinds in zip((False, True), both)
            for kind, n in kinds.items()
        ]
        types = [pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(columns, names=HELD_NAMES)


def settled(rows: DataFrame) -> DataFrame:
    """What the rows of each task decide between them: a text's smallest id, all others copies.

    Rows without id go by a key of their own, their mask, under which all are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts()
        for batch in batches:
            for digest, mask, key, *kind in zip(*(c.to_pylist() for c in batch.columns)):
                texts.add(bytes([mask]) if key is None else digest, mask, key or 0, tuple(kind))
            if len(texts) > MAX_TEXTS:
                yield texts.batch()
                texts.clear()
        if texts:
            yield texts.batch()

    return rows.select("digest", "mask", "id", "part", "good", "toxic").mapInArrow(run, HELD)


class Retraction(StatefulProcessor):
    """Changes of the counters by the rows that arrive; keeps each text's smallest id and its rows.

    Texts are grouped in buckets by their digest, so that a call of Python serves many of them; the
    state is looked up and written text by text.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getMapState("texts", "digest binary", "smallest long, held string")

    def handleInputRows(
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        counts: dict[tuple, int] = {}
        for frame in rows:
            arrived: dict[bytes, list[tuple]] = {}
            for digest, *row in zip(*(frame[name].tolist() for name in HELD_NAMES)):
                arrived.setdefault(bytes(digest), []).append(row)
            for digest, found in arrived.items():
                kept = self.texts.getValue((digest,))
                smallest, held = kept if kept else (None, "[]")
                at, now = changed(counts, smallest, {tuple(kind): n for kind, n in json.loads(held)}, found)
                now = json.dumps(list(now.items()))
                if (at, now) != (smallest, held):
                    self.texts.updateValue((digest,), (at, now))
        changes = [(kind[0], mask, *kind[1:], n) for (kind, mask), n in counts.items() if n]
        yield pd.DataFrame(changes, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def changed(counts: dict, smallest: int | None, held: dict, rows: list[tuple]) -> tuple[int, dict]:
    """Add a text's rows to the changes; returns its smallest id and the rows of that id by kind.

    Copies come with the smallest id of their task, so there is a smallest one afterwards.
    """

    def count(kind: tuple, mask: int, n: int) -> None:
        counts[kind, mask] = counts.get((kind, mask), 0) + n

    for mask, at, copy, part, good, toxic, n in rows:
        kind = (part, good, toxic)
        if not copy and (smallest is None or at < smallest):
            # The rows held so far turn out to be copies.
            for old, number in held.items():
                count(old, mask, -number)
                count(old, mask | COPY, number)
            smallest, held = at, {}
        if copy or at > smallest:
            count(kind, mask | COPY, n)
        else:
            count(kind, mask, n)
            held[kind] = held.get(kind, 0) + n
    return smallest, held


def counters(
    spark: SparkSession,
    path: str,
    labels: DataFrame,
    state: str | None = None,
    id_col: str = "doc_id",
    part_col: str = "lang",
    text_col: str = "text",
    batch_bytes: int | None = None,
) -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows of each part by the filters they fail, bit k being filter k.

    ``path`` is a Parquet table whose files are streamed, ``batch_bytes`` of them at a time; ``labels``
    has (id_col, quality, toxic). With ``state``, a folder, a later run takes new files only and
    carries on from there; else the state is dropped at the end.
    """
    folder = state or scratch_path(spark, "filter-audit")
    marked = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    labelled = scratch_path(spark, "filter-labels")
    stage(marked.where("(good OR toxic) AND id IS NOT NULL"), path=labelled)
    # A session of its own, so that the settings for the stream are no one else's.
    own = spark.newSession()
    for name, value in {
        "spark.sql.shuffle.partitions": partitions(spark),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        # Else each partition's state reserves some megabytes of disk from the start.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }.items():
        own.conf.set(name, value)
    size = batch_bytes or BYTES_PER_CORE * spark.sparkContext.defaultParallelism
    # A stream reads folders and patterns; a single file is given as a pattern that only it matches.
    is_file = not any(is_folder for _, is_folder in listing(spark, path))
    source = f"{path[:-1]}[{path[-1]}]" if is_file else path
    files = own.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", size).parquet(source)
    rows = profiles(files, id_col, part_col, text_col).join(own.read.parquet(labelled), "id", "left")
    bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS_PER_PARTITION * partitions(spark)))
    changes = (
        settled(rows.na.fill(False, ["good", "toxic"]))
        .withColumn("bucket", bucket)
        .groupBy("bucket")
        .transformWithStateInPandas(Retraction(), CHANGE, "update", "none")
    )

    def add(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        summed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    query = (
        changes.writeStream.foreachBatch(add)
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    discard(spark, labelled)
    if not state:
        discard(spark, f"{folder}/checkpoint")
    if not matches(spark, f"{folder}/counters/batch=*"):
        return spark.createDataFrame([], "part string, mask int, n long, good long, toxic long")
    found = spark.read.schema(CHANGE).parquet(f"{folder}/counters")
    return (
        found.groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"),
            F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"),
        )
        .where("n > 0")
    )


def report(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the counters."""
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    rows = counted.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.array(*[F.lit(k + 1) for k in range(len(FILTERS))]))
    )

    def bits(letters: Column) -> Column:
        return reduce(
            Column.__add__, [F.when(letters.contains(x), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)]
        )

    rows = rows.withColumns(
        {
            "own": bits(F.substring("filter_order", F.col("step"), F.lit(1))),
            "earlier": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)),
        }
    )
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0
    share = F.lit(factorial(len(FILTERS))) / F.bit_count("mask")

    def total(condition: Column, amount: Column | str = "n") -> Column:
        return F.sum(F.when(condition, amount if isinstance(amount, Column) else F.col(amount)).otherwise(0))

    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
        # Each failing filter comes first in an equal share of the orders.
        total(fails, F.col("n") * share.cast("long")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return report(counters(spark, f"{folder}/documents.parquet", labels))


SQL_OP11 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
masks AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS toxic
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, CAST(power(2, instr('ABCDE', substr(filter_order, step, 1)) - 1) AS INTEGER) AS own,
    coalesce(list_sum([CAST(power(2, instr('ABCDE', y) - 1) AS INTEGER)
      FOR y IN string_split(filter_order, '')[1 : step - 1]]), 0)::INTEGER AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0) AS BIGINT) AS shapley
FROM counted, steps GROUP BY part, filter_order, step"""
