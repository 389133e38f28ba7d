import duckdb
import pytest
from pyspark.sql import functions as F

from wayloom.llm import mixing


def cells(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokens long")


def test_marginals_fit(spark):
    rows = [(s, l, 10 + 7 * i * j) for i, s in enumerate("abcd") for j, l in enumerate(["x", "y", None])]
    targets = {"source": 0.5, "lang": {"x": 0.7, "y": 0.2}}
    fitted = mixing.rake(cells(spark, rows), targets, rounds=20).collect()
    total = sum(r["tokens"] for r in fitted)
    assert total == pytest.approx(sum(r["weight"] for r in fitted))
    for lang, share in (("x", 0.7), ("y", 0.2), (None, 0.1)):
        assert sum(r["weight"] for r in fitted if r["lang"] == lang) == pytest.approx(share * total, rel=1e-3)
    roots = {s: sum(n for a, _, n in rows if a == s) ** 0.5 for s in "abcd"}
    for s in "abcd":
        held = sum(r["weight"] for r in fitted if r["source"] == s)
        assert held == pytest.approx(total * roots[s] / sum(roots.values()), rel=1e-3)
    # Raking keeps the odds ratios of the counts.
    w = {(r["source"], r["lang"]): r["weight"] / r["tokens"] for r in fitted}
    assert w["a", "x"] * w["b", "y"] == pytest.approx(w["a", "y"] * w["b", "x"])


def test_probabilities_meet_the_budget(spark):
    rows = [("a", 1000, 100.0), ("b", 100, 900.0), ("c", 500, 600.0), ("d", 0, 0.0)]
    frame = spark.createDataFrame(rows, "source string, tokens long, weight double")
    for budget in (0.1, 0.4, 0.8, 1.0, 2.0):
        got = {r["source"]: r for r in mixing.probabilities(frame, budget).collect()}
        assert all(0 <= r["probability"] <= 1 for r in got.values())
        expected = sum(r["tokens"] * r["probability"] for r in got.values())
        assert expected == pytest.approx(min(budget, 1) * 1600)
        assert got["d"]["probability"] == 0
        free = [r for r in got.values() if 0 < r["probability"] < 1]
        assert len({round(r["probability"] / r["rate"], 9) for r in free}) <= 1


def test_odd_rows(spark, docs):
    frame = docs([(1, "some words here"), (1, "some words here"), (None, "more words"), (4, None), (5, "")])
    frame = frame.withColumn("source", F.when(F.col("doc_id") == 5, None).otherwise(F.col("source")))
    found = mixing.sample(frame, mixing.document_labels(), budget=1.0).collect()
    assert len(found) == 5
    assert {r["row"]["doc_id"]: r["selected"] for r in found} == {1: True, None: True, 4: False, 5: False}
    assert mixing.sample(frame.where("false"), mixing.document_labels()).count() == 0


def test_sql_twin(spark, folder):
    got = mixing.op5_mixing(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({mixing.SQL_OP5})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
