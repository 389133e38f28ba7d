"""Exact substring deduplication by recompression.

A text's words are renamed round by round: a round of runs gives every maximal run of one symbol a
new symbol, a round of pairs splits the alphabet in two by a hash of the symbol and joins every
left symbol with a right one that follows it. New names are hashes of what they stand for, so they
are the same in every text and every task without a dictionary. Equal passages thereby get equal
symbols except at their borders, where a neighbour outside may be drawn in. What cannot be touched
from outside, the interior of a passage, is known from the passage alone.

Every window of ``LENGTH`` words is represented by the first ``SYMBOLS`` symbols of its interior
in the last round that leaves it so many; equal windows have equal representatives, neighbouring
windows mostly share theirs, and some 15 words stand behind one, more than unrelated texts share.
So it goes:

1. Representatives of all texts are counted by name, between texts and within them. Names found
   once prove all their windows unique.
2. Only texts with a shared name are looked at again, and only those of their windows that a shared
   name represents are hashed and counted.
3. Windows found twice or more cover words; these are removed, and the kept words joined.

Equal texts are collapsed before: from two on, all their words are covered if they fill a window.
Counting combines partial aggregates before the shuffle, and the joins back to texts split hot
names, so neither a passage of thousands of texts nor a hot text meets in one task.

Names and windows are told apart by 64-bit hashes; among n windows a false match is expected n^2 /
2^65 times.

Defined results: a null text has no words. Texts shorter than a window keep all words. Windows are
judged on the input. Every row gives one row, repeated rows and null ids too, and the copies of a
text all lose their words. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import documents, whole
from wayloom.llm.words import GOLDEN, WordIds, mix, windows
from wayloom.session import stage

LENGTH = 35
#: Rounds of runs (r) and of pairs (p). Runs cost a window more of its border than pairs.
ROUNDS = "rpppppp"
#: More symbols tell texts apart better, fewer are shared by more neighbouring windows.
SYMBOLS = 3
#: Words that are recompressed together.
CHUNK = 200_000


def representatives(ids: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its first word, the name that represents it, and where that stands.

    ``ids`` are the words of several texts, text k being ``ids[bounds[k]:bounds[k + 1]]``.
    """
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.flatnonzero(np.arange(len(ids)) + length <= bounds[1:][owner]) if len(ids) else np.empty(0, np.int64)
    symbols, begin, end = ids, first.copy(), first + length
    names, places = np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64)
    alive = np.arange(len(first))

    def settle(number: int, which: np.ndarray) -> None:
        """Represent windows by their interior as it is before this round."""
        at, size = begin[which], np.minimum(end[which] - begin[which], SYMBOLS)
        found = symbols[at]
        for k in range(1, SYMBOLS):
            more = size > k
            found[more] = mix(found[more] * GOLDEN + symbols[at[more] + k])
        names[alive[which]] = mix(found + mix(np.array([number + 1], np.uint64)))
        places[alive[which]] = (number << 40) + at

    for number, kind in enumerate(ROUNDS):
        salt = mix(np.array([number + 1], np.uint64))[0]
        same = owner[1:] == owner[:-1]
        if kind == "r":
            opens = np.ones(len(symbols), bool)
            opens[1:] = ~(same & (symbols[1:] == symbols[:-1]))
            at = np.cumsum(opens) - 1
            starts = np.flatnonzero(opens)
            lengths = np.diff(np.append(starts, len(symbols))).astype(np.uint64)
            renamed = symbols[starts]
            long = lengths > 1
            renamed[long] = mix(renamed[long] * GOLDEN + lengths[long] + salt)
            new_begin, new_end = at[begin] + 1, at[end - 1]
        else:
            right = (mix(symbols ^ salt) & np.uint64(1)).astype(bool)
            pairs = np.zeros(len(symbols), bool)
            pairs[:-1] = ~right[:-1] & right[1:] & same
            opens = np.ones(len(symbols), bool)
            opens[1:] = ~pairs[:-1]
            at = np.cumsum(opens) - 1
            starts = np.flatnonzero(opens)
            renamed = symbols[starts]
            joined = pairs[starts]
            renamed[joined] = mix(renamed[joined] * GOLDEN + symbols[starts[joined] + 1] + salt)
            # A right symbol in front may belong to what is before, a left one at the end to what follows.
            inner = begin + right[begin]
            last = end - 1 - ~right[end - 1]
            new_begin = at[np.minimum(inner, len(symbols) - 1)]
            new_end = np.where(last >= inner, at[last] + 1, new_begin)
        gone = new_end - new_begin < SYMBOLS
        if gone.any():
            settle(number, gone)
            left = ~gone
            alive, new_begin, new_end = alive[left], new_begin[left], new_end[left]
        symbols, owner, begin, end = renamed, owner[starts], new_begin, new_end
        if not len(alive):
            break
    if len(alive):
        settle(len(ROUNDS), np.ones(len(alive), bool))
    return first, names, places


def chunks(column, ids: WordIds) -> Iterator[tuple[list[int], list[list[bytes]], np.ndarray, np.ndarray]]:
    """Texts of a column in chunks of about ``CHUNK`` words: rows, words, ids and bounds."""
    rows, words, size = [], [], 0
    for row, text in enumerate(column):
        found = (text.as_py() or b"").split()
        rows.append(row)
        words.append(found)
        size += len(found)
        if size >= CHUNK:
            yield rows, words, *_numbered(words, ids)
            rows, words, size = [], [], 0
    if rows:
        yield rows, words, *_numbered(words, ids)


def _numbered(words: list[list[bytes]], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.cumsum([0, *map(len, words)])
    return np.concatenate([ids.of(w) for w in words]), bounds


_OUTLINE = "id long, digest binary, n_words long, kept binary, names array<long>, again array<long>"


def outlines(rows: DataFrame, length: int) -> DataFrame:
    """Of rows ``(id, digest, text)``: word count, SHA-256 of the joined words, the distinct names
    of the text's representatives, and those of them that it has in more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            counts, digests, names, again = [], [], [], []
            for _, words, numbers, bounds in chunks(batch.column(2), ids):
                first, named, places = representatives(numbers, bounds, length)
                cuts = np.searchsorted(first, bounds)
                for k, found in enumerate(words):
                    counts.append(len(found))
                    digests.append(hashlib.sha256(b" ".join(found)).digest())
                    own = slice(cuts[k], cuts[k + 1])
                    _, at = np.unique(places[own], return_index=True)
                    distinct, often = np.unique(named[own][at], return_counts=True)
                    distinct = distinct.view(np.int64)
                    names.append(distinct)
                    again.append(distinct[often > 1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(names, pa.list_(pa.int64())),
                    pa.array(again, pa.list_(pa.int64())),
                ],
                names=["id", "digest", "n_words", "kept", "names", "again"],
            )

    return rows.mapInArrow(run, _OUTLINE)


def suspects(texts: DataFrame, length: int) -> DataFrame:
    """``(node, pos, window)`` of the windows that a shared name represents.

    ``texts`` has ``(node, text, names)``, the names being the text's shared ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            for rows, words, numbers, bounds in chunks(batch.column(1), ids):
                first, named, _ = representatives(numbers, bounds, length)
                cuts = np.searchsorted(first, bounds)
                for k, row in enumerate(rows):
                    shared = batch.column(2)[row].values.to_numpy().view(np.uint64)
                    own = slice(cuts[k], cuts[k + 1])
                    places = np.flatnonzero(np.isin(named[own], shared))
                    hashes = windows(numbers[bounds[k] : bounds[k + 1]], length)[places]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(places), batch.column(0)[row].as_py()), pa.int64()),
                            pa.array(places, pa.int32()),
                            pa.array(hashes.view(np.int64), pa.int64()),
                        ],
                        names=["node", "pos", "window"],
                    )

    return texts.mapInArrow(run, "node long, pos int, window long")


def covered(n_words: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which words the windows at these places cover."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def without(texts: DataFrame, length: int) -> DataFrame:
    """``(node, n_removed, kept, text)`` of rows ``(node, text, places)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, texts = [], [], []
            for text, places in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or b"").split()
                gone = covered(len(words), places.values.to_numpy(), length)
                kept = b" ".join([w for w, out in zip(words, gone.tolist()) if not out])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).digest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(texts, pa.binary()),
                ],
                names=["node", "n_removed", "kept", "text"],
            )

    return texts.mapInArrow(run, "node long, n_removed long, kept binary, text binary")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.unhex(F.md5(whole(text_col))).alias("digest"),
        whole(text_col).cast("binary").alias("text"),
    )


def analysed(
    docs: DataFrame, id_col: str, text_col: str, length: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (id, row, digest, n_words, kept), ``texts`` (digest, node, rep_id, copies), and the
    texts with removed words, ``(node, text, places)``; the first two are staged."""
    source = _source(docs, id_col, text_col)
    outlined = stage(outlines(source, length).withColumn("row", F.monotonically_increasing_id()))
    texts = stage(
        outlined.groupBy("digest").agg(
            F.min("row").alias("node"), F.min("id").alias("rep_id"), F.count("*").alias("copies")
        )
    )
    # Copies of one text do not make a name shared, so it is counted by texts.
    text = F.xxhash64("digest").alias("of")
    named = outlined.select(F.explode("names").alias("name"), text, F.lit(False).alias("twice")).unionByName(
        outlined.select(F.explode("again").alias("name"), text, F.lit(True).alias("twice"))
    )
    shared = stage(
        named.groupBy("name")
        .agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.max("twice").alias("twice"))
        .where("lo <> hi OR twice")
        .select("name")
    )
    of_rows = outlined.select("row", F.explode("names").alias("name")).join(shared, "name", "left_semi")
    # From here on one row stands for all copies of its text.
    of_texts = of_rows.join(texts.select(F.col("node").alias("row"), "digest", "rep_id"), "row")
    wanted = stage(
        of_texts.groupBy(F.col("row").alias("node"), F.col("digest").alias("of"), "rep_id").agg(
            F.collect_list("name").alias("names")
        )
    )
    found = source.join(wanted, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("rep_id")))
    candidates = stage(found.select("node", "text", "names"))
    hashed = suspects(candidates, length)
    often = stage(hashed.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"))
    hits = hashed.join(often, "window", "left_semi").groupBy("node").agg(F.collect_set("pos").alias("places"))
    rows = outlined.select("id", "row", "digest", "n_words", "kept")
    return rows, texts, candidates.select("node", "text").join(stage(hits), "node")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """``(id_col, n_words, n_removed, kept_sha256, kept_text)`` for every row.

    ``kept_text`` has the kept words where some were removed; it is null where the text stays as
    it is, so that unchanged texts need not travel.
    """
    rows, texts, touched = analysed(docs, id_col, text_col, length)
    # Rows that repeat in id and text are one text.
    results = stage(without(touched, length)).dropDuplicates(["node"]).withColumnsRenamed(
        {"kept": "kept_left", "text": "text_left"}
    )
    of_texts = stage(texts.join(results, "node", "left"))
    joined = rows.join(of_texts, "digest")
    all_gone = (F.col("copies") > 1) & (F.col("n_words") >= length)
    empty = F.unhex(F.sha2(F.lit(""), 256))
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(F.when(all_gone, empty).otherwise(F.coalesce("kept_left", "kept")))).alias("kept_sha256"),
        F.when(all_gone, "").otherwise(F.col("text_left").cast("string")).alias("kept_text"),
    )


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder)).drop("kept_text")
