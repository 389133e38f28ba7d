import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wayloom.llm import substring_dedup


def brute(texts, length):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def got(found):
    rows = found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["doc_id"])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=5), st.integers(1, 9))
def test_equal_windows_have_equal_names(texts, length):
    ids = np.array([x + 1 for t in texts for x in t], np.uint64)
    bounds = np.cumsum([0, *map(len, texts)])
    first, names, _ = substring_dedup.representatives(ids, bounds, length)
    spans = [(b, e) for b, e in zip(bounds, bounds[1:])]
    assert first.tolist() == [i for b, e in spans for i in range(b, e - length + 1)]
    known = {}
    for i, name in zip(first.tolist(), names.tolist()):
        assert known.setdefault(tuple(ids[i : i + length].tolist()), name) == name


def test_representatives_are_few():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 2**63, 20_000).astype(np.uint64)
    _, names, places = substring_dedup.representatives(ids, np.array([0, len(ids)]), 35)
    assert len(np.unique(places)) < len(ids) / 3
    assert len(np.unique(names)) == len(np.unique(places))


def planted(rng):
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(40):
        base = [word() for _ in range(rng.randrange(0, 150))]
        if i % 3 == 0:
            cut = rng.randrange(0, 30)
            base[len(base) // 2 : len(base) // 2] = passage[cut : cut + rng.choice([34, 35, 36, 50])]
        if i % 7 == 0 and base:
            base += base[: rng.choice([34, 35, 80])]
        texts.append(" ".join(base))
    texts += [texts[3], texts[3], texts[5] + "\n", texts[5].replace(" ", "  ")]
    texts += ["a " * 34, "a " * 35, "a " * 36, "a b " * 40, "x y z " * 300, None, "", " \n\t"]
    return texts


def test_against_all_windows(spark, docs):
    texts = planted(random.Random(4))
    assert got(substring_dedup.remove_repeats(docs(texts))) == brute(texts, 35)
    short = [" ".join((t or "").split()[:40]) for t in texts]
    assert got(substring_dedup.remove_repeats(docs(short), length=4)) == brute(short, 4)


def test_kept_texts(spark, docs):
    passage = " ".join(f"p{i}" for i in range(40))
    found = substring_dedup.remove_repeats(docs([f"one {passage} two", f"three {passage}", "alone"]))
    assert {r["doc_id"]: r["kept_text"] for r in found.collect()} == {0: "one two", 1: "three", 2: None}


def test_repeated_rows_null_ids_and_an_empty_table(spark, docs):
    text = " ".join(f"p{i}" for i in range(40))
    frame = docs([(1, text), (1, text), (None, f"own {text}"), (None, "few words")])
    rows = substring_dedup.remove_repeats(frame).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 40, 40, 40]
    assert substring_dedup.remove_repeats(frame.where("false")).count() == 0


def test_query_on_whole_texts(spark, folder):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert got(substring_dedup.op2_substring_dedup(spark, folder)) == brute([t for _, t in rows], 35)
