import os
import re

import duckdb
import pytest
from test_minhash import brute
from test_packing import checked

import __spark_entry__ as contract
import corpus_pipeline
from wayloom.llm import exact_dedup, mixing, packing, quality_rules, registry
from wayloom.session import stage


def pairs(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    columns, texts = docs.columns, pairs(docs)

    docs = stage(steps["quality_rules"](spark, docs, folder))
    judged = {k: quality_rules.judge(t.encode()) for k, t in texts.items()}
    want = {k: text for k, (m, text) in judged.items() if m[quality_rules.METRIC_NAMES.index("kept")]}
    assert docs.columns == columns and pairs(docs) == want
    assert docs.where("n_chars <> length(text)").count() == 0

    docs = stage(steps["exact_dedup"](spark, docs, folder))
    last = {t: k for k, t in sorted(want.items())}
    want = {k: t for t, k in last.items()}
    assert docs.columns == columns and pairs(docs) == want

    docs = stage(steps["minhash"](spark, docs, folder))
    least = {c for _, c, _ in brute(sorted(want.items()))}
    want = {k: t for k, t in want.items() if k in least}
    assert docs.columns == columns and pairs(docs) == want

    con = duckdb.connect()
    (path,) = {os.path.dirname(f) for f in docs.inputFiles()}
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path.removeprefix('file://')}/*.parquet'")
    picked = {k for (k,) in con.execute(f"SELECT doc_id FROM ({mixing.SQL_OP5}) WHERE selected").fetchall()}
    docs = stage(steps["mixing"](spark, docs, folder))
    want = {k: t for k, t in want.items() if k in picked}
    assert docs.columns == columns and pairs(docs) == want

    rows = steps["packing"](spark, docs, folder).collect()
    totals = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in want.items()}
    checked(rows, totals, packing.CAPACITIES)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, rows))


def test_registered_with_the_entry():
    assert set(registry.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(registry.ORACLES) <= set(contract.oracle_sql()) & set(registry.QUERIES)
    numbers = sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14))


def test_empty_and_odd_documents(spark, docs):
    for rows in ([], [(1, None), (2, ""), (None, "w " * 30), (3, "x " * 4)]):
        table = docs(rows)
        for _, step in corpus_pipeline.STAGES:
            table = stage(step(spark, table, ""))
        assert table.count() == 0


DOCS = ["same text", "same text", None, "", "other", "Same text"]


def exact_expected(rows):
    ids = {}
    for key, text in rows:
        ids.setdefault(text or "", []).append(key)
    return sorted((k, max(ids[t or ""]), len(ids[t or ""]), k == max(ids[t or ""])) for k, t in rows)


def test_exact_dedup_over_batches(spark, docs, tmp_path):
    rows = list(enumerate(DOCS))
    path = f"{tmp_path}/index"
    found = exact_dedup.verdicts(docs(rows), path, buckets=4)
    fields = ("doc_id", "keep_id", "group_size", "kept")
    assert sorted(tuple(r[f] for f in fields) for r in found.collect()) == exact_expected(rows)
    later = exact_dedup.verdicts(docs([(10, "same text"), (11, "new"), (12, "new")]), path).collect()
    assert sorted(tuple(r[f] for f in fields) for r in later) == [
        (10, 1, 1, False), (11, 12, 2, False), (12, 12, 2, True)
    ]
    # The batch again: its texts are known now.
    again = exact_dedup.verdicts(docs([(11, "new"), (12, "new")]), path).collect()
    assert not any(r["kept"] for r in again)
    index = spark.table(exact_dedup.open_index(spark, path))
    assert index.count() == index.select("digest").distinct().count() == 5
    with pytest.raises(ValueError):
        exact_dedup.open_index(spark, path, buckets=8)
    plan = index.join(index.select("digest").hint("merge"), "digest", "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    schema = "doc_id long, text string, digest int, KEY string"
    rows = [(1, "a", 1, "x"), (1, "a", 1, "x"), (None, "a", 2, "y"), (None, "b", 3, "z"), (None, "b", 3, "z")]
    frame = spark.createDataFrame(rows, schema)
    kept = exact_dedup.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3]], key=str)
    assert sum(r["kept"] for r in exact_dedup.verdicts(frame).collect()) == 2
    assert exact_dedup.deduplicate(frame.where("false")).count() == 0
