import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from wayloom.llm import filter_audit
from wayloom.llm.filter_audit import FILTERS, counters, report, text_mask
from wayloom.session import discard, listing, scratch_path

SCHEMA = "doc_id long, text string, lang string, id int, mask string"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def brute(rows, labels):
    """Every order applied to every document."""
    good = {k for k, quality, _ in labels if quality == 1} - {None}
    toxic = {k for k, _, mark in labels if mark == 1} - {None}
    found, shapley = {}, Counter()
    for key, text, lang in rows:
        failed = {x for x, bad in fails(text or "").items() if bad}
        if key is not None and any(k is not None and k < key and (t or "") == (text or "") for k, t, _ in rows):
            failed.add("E")
        part = lang or ""
        for order in map("".join, permutations(FILTERS)):
            here = True
            for step, x in enumerate(order, 1):
                row = found.setdefault((part, order, step), [0] * 6)
                removed = here and x in failed
                row[0] += here and not removed
                row[1] += removed
                row[2] += x in failed and not here
                row[3] += failed == {x}
                row[4] += removed and key in good
                row[5] += removed and key in toxic
                shapley[part, x] += removed
                here = here and not removed
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def reported(counted):
    rows = report(counted).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def table(spark, files):
    """A Parquet table with a file for each list of rows, in that order of time."""
    path = scratch_path(spark, "audit-docs")
    for rows in files:
        frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(path)
    return path


LONG = " ".join(f"w{k}" for k in range(250))
SAME = "the same " * 120
FILES = [
    [(50, LONG, "en"), (40, SAME, "de"), (None, LONG, "en"), (7, None, None), (41, "ABC " + LONG, "en")],
    [(30, LONG, "fr"), (60, LONG, "en"), (40, SAME, "de"), (40, SAME, "en"), (8, "", "")],
    [],
    [(20, LONG, "en"), (20, LONG, "en"), (6, None, "en"), (39, SAME + "#", "de"), (5, "UP", "en")],
    [(10, LONG + "é", "en"), (20, LONG, "de"), (None, SAME, "und"), (41, "UP", "en"), (1, SAME, "de")],
]
MARKS = [(50, 1, 0), (50, 1, 1), (20, 1, 0), (40, 0, 1), (41, None, 1), (999, 1, 1), (None, 1, 1), (5, 1, None)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(MARKS, LABELS)


def test_masks():
    for text in ("", " \t\n", LONG, SAME, "A" + "b" * 32, "A" + "b" * 33, "É" * 9, "a|b", "é" * 33 + "Z", LONG + " *"):
        assert text_mask(text.encode()) == sum(1 << k for k, bad in enumerate(fails(text).values()) if bad), text


@pytest.mark.parametrize("batch_bytes", [1, 1 << 30])
def test_retractions_against_every_order(spark, labels, batch_bytes):
    """Smaller ids that arrive in later micro-batches, or all files at once; nulls, ties, repeats."""
    found = reported(counters(spark, table(spark, FILES), labels, batch_bytes=batch_bytes))
    assert found == brute([r for rows in FILES for r in rows], MARKS)


def test_a_later_run_takes_new_files_only(spark, labels):
    state, path = scratch_path(spark, "audit-state"), table(spark, FILES[:2])
    assert reported(counters(spark, path, labels, state)) == brute([*FILES[0], *FILES[1]], MARKS)
    for rows in FILES[3:]:
        spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).write.mode("append").parquet(path)
    for _ in range(2):
        found = reported(counters(spark, path, labels, state))
        assert found == brute([r for rows in FILES for r in rows], MARKS)


def test_a_batch_that_runs_again_replaces_itself(spark, labels):
    state, path = scratch_path(spark, "audit-state"), table(spark, FILES)
    before = reported(counters(spark, path, labels, state, batch_bytes=1))
    numbers = sorted(int(path.rpartition("=")[2]) for path, _ in listing(spark, f"{state}/counters/batch=*"))
    assert len(numbers) >= 4
    discard(spark, f"{state}/checkpoint/commits/{numbers[-1]}")
    assert reported(counters(spark, path, labels, state, batch_bytes=1)) == before


def test_a_hot_text_reaches_its_state_settled(spark):
    rows = spark.range(3000).select(
        F.lit(b"d").alias("digest"), F.lit(1).alias("mask"), "id", F.lit("en").alias("part"),
        F.lit(False).alias("good"), (F.col("id") % 2 == 0).alias("toxic"),
    ).repartition(3)
    found = filter_audit.settled(rows).collect()
    assert len(found) <= 9 and sum(r["n"] for r in found) == 3000
    assert min(r["id"] for r in found if not r["copy"]) == 0


def test_empty_table_and_single_file(spark, labels):
    empty = scratch_path(spark, "audit-empty")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(empty)
    assert reported(counters(spark, empty, labels)) == {}


def test_query_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    marks = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    found = filter_audit.op11_filter_audit(spark, folder).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found} == brute(rows, marks)
