import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayloom.llm import packing


def best_fit_by_search(lengths, capacities):
    """The same rule with a plain search over all open bins."""
    bins = []  # [capacity, used]
    where = []
    for n in lengths:
        rooms = [(c - u, i) for i, (c, u) in enumerate(bins) if c - u >= n]
        if rooms:
            room = min(r for r, _ in rooms)
            where.append(room)
            at = [i for r, i in rooms if r == room][-1]
        else:
            size = min((c for c in capacities if c >= n), key=lambda c: (packing.cost(c) / c, -c))
            bins.append([size, 0])
            at = len(bins) - 1
            where.append(None)
        bins[at][1] += n
    return sorted(u for _, u in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_fit_is_best_fit(lengths):
    sizes = (10, 20, 40)
    lengths = sorted(lengths, reverse=True)
    at, starts, capacities = packing.fit(lengths, sizes)
    used = {}
    for b, s, n in zip(at, starts, lengths):
        assert s == used.get(b, 0)
        used[b] = s + n
    for b, u in used.items():
        assert capacities[b] == min(c for c in sizes if c >= u)
    # Equal rooms are interchangeable, so only what the bins hold is compared.
    assert sorted(used.values()) == best_fit_by_search(lengths, sizes)


def checked(rows, totals, capacities):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        if r["length"]:
            bins.setdefault(r["bin_id"], []).append((r["bin_start"], r["length"], r["capacity"]))
        else:
            assert r["bin_id"] is None and r["capacity"] is None
    assert {k: sum(n for *_, n in v) for k, v in pieces.items()} == totals
    for found in pieces.values():
        at = 0
        for _, start, n in sorted(found):
            assert start == at
            at += n
    for found in bins.values():
        at = 0
        for start, n, _ in sorted(found):
            assert start == at
            at += n
        (size,) = {c for *_, c in found}
        assert size == min(c for c in capacities if c >= at)
    return bins


def test_every_piece_once_and_no_bin_too_full(spark, docs):
    texts = ["w " * n for n in (0, 1, 5, 9, 10, 11, 25, 40, 41, 100, 3, 3, 7)] + [None]
    totals = {i: len((t or "").split()) for i, t in enumerate(texts)}
    found = packing.pack(docs(texts), packing.n_words("text"), capacities=(10, 20, 40), shard_pieces=4)
    checked(found.collect(), totals, (10, 20, 40))
    assert found.count() == packing.pack(docs(texts), packing.n_words("text"), capacities=(10, 20, 40)).count()


def test_repeated_rows_null_ids_and_an_empty_table(spark, docs):
    frame = docs([(1, "a b c"), (1, "a b c"), (None, "a b")])
    rows = packing.pack(frame, packing.n_words("text"), capacities=(4, 8)).collect()
    assert sorted(r["length"] for r in rows) == [2, 3, 3]
    assert packing.pack(frame.where("false"), packing.n_words("text")).count() == 0


def test_query_fills_its_sequences(spark, folder):
    found = packing.op6_packing(spark, folder)
    texts = spark.read.parquet(f"{folder}/documents.parquet")
    totals = {r[0]: r[1] for r in texts.select("doc_id", packing.n_words("text")).collect()}
    checked(found.collect(), totals, packing.CAPACITIES)
    sums = packing.bins(found).agg(F.sum("used"), F.sum("capacity")).first()
    assert sums[0] / sums[1] > 0.95
    assert math.fsum(totals.values()) == sums[0]
