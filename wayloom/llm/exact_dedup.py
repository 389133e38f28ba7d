"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest. A batch is reduced to its
distinct digests, a sort-merge anti-join against the index finds the new ones (the index side is
read in place, without a shuffle or a sort), and they are appended. DataFrame operations only.

Defined results: a null text counts as empty. Of equal texts the row with the largest id stays, a
null id being the smallest; of fully repeated rows exactly one stays. A digest that the index holds
already keeps the id of its first batch, and every row of the new batch with it goes. An empty
batch adds nothing. Only the id and text columns are looked at, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wayloom.llm.common import documents, free, partitions, whole
from wayloom.session import matches, scratch_path, stage


def text_digest(text: str) -> Column:
    return F.sha2(whole(text), 256)


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """Name of the index table that lies at ``path``; made there, empty, if there is none.

    The number of buckets is chosen once (the shuffle partitions by default) and kept beside the
    digests. Another number for an existing index is refused: it would look in wrong buckets.
    """
    kept = f"{path}/layout"
    if matches(spark, kept):
        found = spark.read.parquet(kept).first()["buckets"]
        if buckets not in (None, found):
            raise ValueError(f"the index at {path} has {found} buckets, not {buckets}")
        buckets = found
    else:
        buckets = buckets or partitions(spark)
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(kept)
    name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/digests'"
    )
    spark.catalog.refreshTable(name)
    return name


def add_batch(
    docs: DataFrame, index: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Put a batch against the index at the path ``index`` and append what is new.

    Returns the batch's rows ``(id, row, digest)`` and its groups ``(digest, keep_id, keep_row,
    group_size)``; ``keep_row`` is null where an earlier batch holds the text. Both are staged.
    Running a batch again adds nothing.
    """
    spark = docs.sparkSession
    name = open_index(spark, index, buckets)
    held = spark.table(name)
    # Staged, so that row numbers cannot change between their uses.
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.monotonically_increasing_id().alias("row"),
            text_digest(text_col).alias("digest"),
        )
    )
    # Partial aggregates shrink the copies of a hot text before the shuffle.
    groups = stage(
        rows.groupBy("digest").agg(
            F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size")
        )
    )
    added = groups.join(held.hint("merge"), "digest", "left_anti")
    batch = stage(added.select("digest", F.col("last.id").alias("keep_id"), F.col("last.row").alias("keep_row")))
    known = held.join(groups.select("digest").hint("merge"), "digest", "left_semi")
    resolved = stage(
        groups.select("digest", "group_size").join(
            batch.unionByName(known.withColumn("keep_row", F.lit(None).cast(T.LongType()))), "digest"
        )
    )
    layout = spark.read.parquet(f"{index}/layout").first()["buckets"]
    (
        batch.select("digest", "keep_id")
        .repartition(layout, "digest")
        .write.mode("append")
        .format("parquet")
        .bucketBy(layout, "digest")
        .sortBy("digest")
        .option("path", f"{index}/digests")
        .saveAsTable(name)
    )
    return rows, resolved


def verdicts(
    docs: DataFrame,
    index: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)`` for every row of the batch.

    Rows find their group by a join of two staged tables on the digest, which adaptive execution
    splits where one text holds a large share of the rows.
    """
    index = index or scratch_path(docs.sparkSession, "digest-index")
    rows, groups = add_batch(docs, index, id_col, text_col, buckets)
    return rows.join(groups, "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame, index: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows that stay, with all their columns.

    Joined on digest and id together, so that the many copies of one text spread over all tasks.
    """
    index = index or scratch_path(docs.sparkSession, "digest-index")
    _, groups = add_batch(docs, index, id_col, text_col)
    digest, copy, key, keep = free(docs, "digest", "copy", "key", "keep")
    winners = groups.where(F.col("keep_row").isNotNull()).select(
        F.col("digest").alias(key), F.col("keep_id").alias(keep)
    )
    found = docs.withColumn(digest, text_digest(text_col))
    found = found.join(
        winners, (F.col(digest) == F.col(key)) & F.col(id_col).cast("long").eqNullSafe(F.col(keep))
    )
    same = Window.partitionBy(key, keep).orderBy(F.lit(0))
    return (
        found.withColumn(copy, F.row_number().over(same))
        .where(F.col(copy) == 1)
        .select(*docs.columns)
    )


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(documents(spark, folder))


SQL_OP1 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)"""
