import random
from collections import Counter

import numpy as np
import pytest

from wayloom.llm import minhash
from wayloom.llm.words import WordIds


def shingles(text):
    words = (text or "").encode().split()
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(rows):
    """Least id of each row's class, by all pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1] or "", rows[j][1] or ""
            if a == b or similarity(a, b) >= minhash.THRESHOLD:
                parent[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    least = {r: min((k for k in g if k is not None), default=None) for r, g in groups.items()}
    return sorted(((k, least[root(i)], len(groups[root(i)])) for i, (k, _) in enumerate(rows)), key=str)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, text, share):
    text = list(text)
    for _ in range(max(1, int(len(text) * share))):
        text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
    return text


def got(found):
    return sorted(((r["id"], r["class_id"], r["class_size"]) for r in found.collect()), key=str)


def test_agreement_is_the_weighted_similarity():
    rng, ids = random.Random(5), WordIds()
    for n in (7, 60, 900, 12_000):
        found, true = [], []
        for _ in range(25 if n < 10_000 else 4):
            a = words(rng, n // 2) * 2
            b = edited(rng, a, 0.02)
            found.append(np.mean(minhash.sketch(minhash.elements(ids.of([w.encode() for w in a]))) ==
                                 minhash.sketch(minhash.elements(ids.of([w.encode() for w in b])))))
            true.append(similarity(" ".join(a), " ".join(b)))
        assert np.mean(found) == pytest.approx(np.mean(true), abs=0.04)


def test_classes_against_all_pairs(spark, docs):
    rng = random.Random(11)
    texts = []
    for g in range(12):
        base = words(rng, rng.choice([30, 120, 400]))
        texts.append(base)
        texts += [edited(rng, base, 0.004) for _ in range(g % 5)]
    texts += [words(rng, n) for n in (1, 3, 5, 6, 2000)]
    rows = [" ".join(t) for t in texts]
    rows += [None, "", " \n", "one two three", "one two three", "one two four", "a b c d e f", "a b c d e f g"]
    rows += [rows[0], rows[0]]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert got(minhash.classes(docs(rows))[0]) == brute(rows)


def test_a_large_group_and_a_common_passage(spark, docs):
    """Hundreds of near copies of one text, and as many texts that share half their words."""
    rng = random.Random(2)
    base, passage = words(rng, 300), words(rng, 150)
    rows = [" ".join(edited(rng, base, 0.003)) for _ in range(150)]
    rows += [" ".join(passage + words(rng, 100)) for _ in range(100)]
    rows = list(enumerate(rows))
    found = minhash.classes(docs(rows))[0].collect()
    assert {r["class_id"] for r in found if r["id"] < 150} == {0}
    assert len({r["class_id"] for r in found if r["id"] >= 150}) == 100
    assert sum(r["kept"] for r in found) == 101


def test_copies_that_are_alike_only_through_their_source(spark, docs):
    rng = random.Random(8)
    base = words(rng, 300)
    rows = [" ".join(edited(rng, base, 0.02)) for _ in range(60)]
    rows.insert(40, " ".join(base))
    apart = np.mean([similarity(rows[i], rows[i + 1]) < 0.8 for i in range(0, 30, 2)])
    assert apart > 0.8 and min(similarity(rows[40], r) for r in rows) >= 0.8
    rows = list(enumerate(rows))
    assert got(minhash.classes(docs(rows))[0]) == brute(rows)


def test_sets_that_link_to_one_member_of_a_large_class_only(spark):
    """Copies of copies in one bucket: alike to one member, not to its hubs nor to other copies."""
    sets = [[*range(100), 1000 + i] for i in range(150)]
    for k in range(10):
        member = [*range(92), *range(2000 + 16 * k, 2008 + 16 * k)]
        sets += [member, [*member[8:], *range(2008 + 16 * k, 2016 + 16 * k)]]
    units = spark.createDataFrame(list(enumerate(sets)), "node long, units array<int>")
    members = spark.createDataFrame([(7, 0, i) for i in range(len(sets))], "bucket long, band int, node long")
    state = minhash.Links(units, 0.8)
    state.finish(members)
    assert dict(map(tuple, state.labels.collect())) == {i: 0 for i in range(len(sets))}


def test_pairs_in_large_buckets_need_no_further_band(spark):
    """Two texts alike in one large bucket, which no hub links and which agree in that band only."""
    sets = [[*range(50), *range(1000 + 60 * i, 1060 + 60 * i)] for i in range(60)]
    sets += [[*sets[k][:104], *range(9000 + 6 * k, 9006 + 6 * k)] for k in (35, 45, 55)]
    schema = "doc_id long, text string"
    texts = [" ".join(f"w{u}" for u in s) for s in sets]
    frame = spark.createDataFrame(list(enumerate(texts)), schema)
    keys = [[1, *range(100 * i + 10, 100 * i + 34)] for i in range(len(sets))]
    docs = frame.selectExpr("doc_id id", "unhex(md5(text)) digest", "text")
    nodes = docs.selectExpr("id node", "digest", "id rep_id")
    sketches = spark.createDataFrame(list(enumerate(keys)), "node long, bands array<long>")
    found = {(r["a"], r["b"]) for r in minhash.links(docs, nodes, sketches, 0.8).collect()}
    assert found == {(35, 60), (45, 61), (55, 62)}


def test_pairs_by_rare_units_miss_none(spark):
    rng = random.Random(4)
    sets = {}
    for k in range(240):
        if k % 3:
            source = list(sets[k - k % 3])
            cut = source[: max(1, round(len(source) * rng.choice([1, 0.95, 0.9, 0.8])))]
            own = cut[: max(1, round(len(cut) * rng.choice([1, 0.97, 0.9, 0.8])))]
            sets[k] = {*own, *rng.sample(range(9000), rng.choice([0, 1, len(cut) // 10]))}
        else:
            sets[k] = {*range(rng.choice([0, 0, 5, 20])), *rng.sample(range(9000), rng.choice([1, 2, 5, 10, 40]))}
    units = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "node long, units array<int>")
    labels = {k: k if k % 4 else 0 for k in sets}
    nodes = spark.createDataFrame(list(labels.items()), "node long, label long")
    found = {tuple(r) for r in minhash.alike_by_rare_units(nodes, units, 0.8).collect()}
    true = {
        (a, b)
        for a in sets
        for b in sets
        if a < b and labels[a] != labels[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    }
    assert len(true) > 50 and true <= found
    assert all(labels[a] != labels[b] for a, b in found)


def test_chains_are_one_class(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = dict(map(tuple, minhash.components(edges).collect()))
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    schema = "doc_id long, text string, digest int, row string, keep int"
    rows = [(1, "a b c d e f", 1, "x", 0)] * 2 + [(None, "a b c d e f", 2, "y", 0), (None, "lone text here", 3, "z", 0)]
    frame = spark.createDataFrame(rows, schema)
    found = minhash.classes(frame)[0].collect()
    assert len(found) == 4 and sum(r["kept"] for r in found) == 2
    kept = minhash.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3]], key=str)


def test_empty_table(spark, docs):
    assert minhash.classes(docs(["x"]).where("false"))[0].count() == 0
    assert minhash.deduplicate(docs(["x"]).where("false")).count() == 0


def test_query_on_whole_texts(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = minhash.op10_minhash(spark, folder).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in found), key=str) == brute(rows)
