import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayloom.llm import collocations
from wayloom.llm.collocations import Filter, mine

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, limit, min_count):
    """All phrases counted, all candidates scored, then dropped, then ranked."""
    counts, totals, found = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * longer[p] < 80 * a:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:limit], 1):
            found.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(found)


def mined(frame, **options):
    return sorted(map(tuple, mine(frame, **options).collect()))


@pytest.mark.parametrize(
    "options", [dict(limit=20, min_count=6, reach=1), dict(limit=300, min_count=4, reach=2), dict(limit=5, min_count=2, reach=1)]
)
def test_given_texts_against_brute_force(spark, folder, options):
    """Limits that are met in the first round, in later ones, and by expanding everything."""
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    if options["min_count"] == 2:
        frame = frame.where("lang <> 'en'")
    rows = [tuple(r) for r in frame.select("lang", "text").collect()]
    assert mined(frame, **options) == brute(rows, options["limit"], options["min_count"])


ODD = [
    ("en", "New York City. new york CITY! New York, new york;New York\tCity"),
    ("en", "New York City. new york CITY! New York, new york;New York\tCity"),
    ("en", None),
    ("en", ""),
    ("en", " .,;:!?\n\r\x0b\x0c "),
    (None, "a a a a a a. a a a"),
    ("", "É é É é É é É é, é é"),
    ("und", "a a a b. b a a"),
    ("de", "x"),
    ("fr", "un mot " * 4000),
    ("es", "w w w w \x00 \x00 \x00 w w"),
]


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, ties, other columns of any name."""
    frame = spark.createDataFrame([(*row, 1, "x") for row in ODD], "lang string, text string, phrase int, _l1 string")
    for limit in (1, 2, 100):
        assert mined(frame, limit=limit, min_count=2) == brute(ODD, limit, 2)


def test_empty_table(spark, docs):
    assert mined(docs([])) == mined(docs(["", None])) == []


def test_sums_handed_over_early(spark, monkeypatch, folder):
    """Tasks that hold little, and pieces longer than what is read at a time."""
    rows = [("en", "one two three four five six " * 40 + "." + "six five " * 9)] * 3
    frame = spark.createDataFrame(rows, "lang string, text string")
    tally = collocations.Tally("en", 2, collocations.Rule())
    monkeypatch.setattr(collocations, "CHUNK", 50)
    for _, text in rows:
        tally.add(text.encode().translate(collocations.ENDS))
        tally.add(b"")
    got = {r["phrase"]: r["f"] for batch in tally.rows() for r in batch.to_pylist()}
    assert got["six five"] == 27 and got["six one"] == 39 * 3 and tally.total == 3 * 258
    assert mined(frame, min_count=5) == brute(rows, 2000, 5)


def test_a_full_filter_changes_nothing(spark, monkeypatch, folder):
    frame = spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'fr'")
    wanted = mined(frame, limit=30, min_count=5)
    monkeypatch.setattr(collocations, "filter_of", lambda members: Filter(np.full(64, 255, np.uint8)))
    assert mined(frame, limit=30, min_count=5) == wanted


def test_scores_beyond_64_bits(spark):
    a = 4 * 10**17
    phrases = spark.createDataFrame([("en", "x y", a), ("en", "y y", a - 1)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("en", "x", a + 3), ("en", "y", a + 5)], "lang string, phrase string, f long")
    found = {r["phrase"]: r["score"] for r in collocations.scored(phrases, 2, {1: words}).collect()}
    assert found == {"x y": 2000000 * a // (2 * a + 8), "y y": 2000000 * (a - 1) // (2 * a + 10)}
