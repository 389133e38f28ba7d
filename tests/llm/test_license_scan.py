import random
import re

import pytest

from wayloom.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def base_of(text):
    words = WORD.findall((text or "").translate(UPPER))
    found = []
    for phrase, label in license_scan.PHRASES:
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    starts = [i for i, _ in found]
    labels = ",".join(sorted({x for _, x in found}))
    return len(words), len(found), min(starts, default=None), max(starts, default=None), labels


CASES = [
    ("Released under the MIT License.", "mit", 1.0),
    ("x y. Released under the MIT-License!", "mit", 1.0),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 1.0),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl", 1.0),
    ("Licensed under the very Apache License, Version 2.0.", "apache", None),
    ("the mit license mit license", "mit", None),
    ("under the terms of an agreement", "", None),
    ("İMİT LİCENSE and Kelvin K MIT LICENSe", "mit", None),
    ("mit", "", 0.0),
    ("apache license", "apache", None),
    (None, "", 0.0),
    ("", "", 0.0),
    ("... !!", "", 0.0),
    ("word " * 20000 + "general public license", "gpl", None),
    ("Released under the MIT License. " * 3000, "mit", 1.0),
]


def test_cases(spark, docs):
    found, spans = license_scan.scan(docs([t for t, *_ in CASES]))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == len(CASES)
    for i, (text, labels, score) in enumerate(CASES):
        row = rows[i]
        got = tuple(row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))
        assert got == base_of(text), text
        assert row["labels"] == labels, text
        assert 0 <= row["score"] <= 1 and (score is None or row["score"] == score), text
    best = spans.where("doc_id = 1 AND verified").first()
    assert (best["first"], best["last"]) == (2, 6)
    assert spans.where("doc_id = 14 AND verified AND template = 0").count() == 3000


def test_an_inserted_word_moves_votes_to_a_neighbour(spark, docs):
    text = license_scan.TEMPLATES[2][1].split()
    text.insert(30, "clearly")
    del text[50]
    found, spans = license_scan.scan(docs([" ".join(text), " ".join(text[:20])]))
    row = spans.where("doc_id = 0 AND template = 2 AND coverage > 0.1").collect()
    assert len(row) == 1 and row[0]["verified"] and row[0]["coverage"] > 0.85
    assert {r["doc_id"]: r["labels"] for r in found.collect()} == {0: "mit", 1: ""}


def spans_of(words, templates=license_scan.TEMPLATES):
    """Best verified-or-not span by plain loops: ``(labels, score)`` of one text."""
    labels, score = set(), 0.0
    for label, text in templates:
        known = text.split()
        reach = max(license_scan.MAX_SHIFT, len(known) // license_scan.WORDS_PER_SHIFT)
        starts = {}
        for t in range(len(known) - 2):
            starts.setdefault(tuple(known[t : t + 3]), []).append(t)
        votes = [(i, t) for i in range(len(words) - 2) for t in starts.get(tuple(words[i : i + 3]), [])]
        for own in {i - t for i, t in votes}:
            tried = []
            for distance in range(reach + 1):
                near = [(i, t) for i, t in votes if abs(i - t - own) <= distance]
                coverage = len({t + k for _, t in near for k in range(3)}) / len(known)
                length = max(i for i, _ in near) + 2 - min(i for i, _ in near)
                good = coverage >= license_scan.MIN_COVERAGE and length < license_scan.MAX_STRETCH * len(known)
                tried.append((good, coverage))
            best = max(tried)
            if best[0]:
                labels.add(label)
            score = max(score, best[1]) if best[0] else score
    return labels, score


def edited(rng, words):
    """Words left out, put in, said again: what moves votes between diagonals."""
    words = list(words)
    for _ in range(rng.randint(0, 8)):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0 and len(words) > 4:
            del words[at]
        elif kind == 1:
            words.insert(at, rng.choice(["clearly", "the", "software", "x1"]))
        else:
            piece = words[at : at + rng.randint(2, 6)]
            words[at:at] = piece * rng.randint(1, 5)
    return words


def test_labels_as_by_plain_loops_on_edited_notices(spark, docs):
    rng = random.Random(8)
    texts = []
    for _ in range(150):
        parts = [edited(rng, rng.choice(license_scan.TEMPLATES)[1].split()) for _ in range(rng.randint(1, 3))]
        texts.append(" ".join(" ".join(p) + " end of it" for p in parts))
    found, spans = license_scan.scan(docs(texts))
    best = {r["doc_id"]: r["best"] for r in spans.where("verified").groupBy("doc_id").agg({"coverage": "max"}).toDF("doc_id", "best").collect()}
    verified = 0
    for row in found.collect():
        words = texts[row["doc_id"]].split()
        labels, score = spans_of(words)
        base = set(filter(None, row["base_labels"].split(",")))
        assert set(filter(None, row["labels"].split(","))) == labels | base, texts[row["doc_id"]]
        assert best.get(row["doc_id"], 0.0) == score
        assert score <= row["score"] <= 1
        verified += bool(labels - base)
    assert verified > 20


def test_repeats_beside_a_notice_do_not_hide_it(spark, docs):
    notice = license_scan.TEMPLATES[4][1]
    texts = ["you may not " * 40 + notice, notice + " of the license" * 60, f"{notice} x {notice}", "you may not " * 40]
    found, spans = license_scan.scan(docs(texts))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [rows[i]["labels"] for i in range(4)] == ["apache", "apache", "apache", ""]
    assert rows[0]["score"] == 1.0 and rows[3]["score"] < 0.75
    assert spans.where("doc_id = 2 AND template = 4 AND verified").count() == 2


def test_repeated_rows_null_ids_and_an_empty_table(spark, docs):
    frame = docs([(1, "mit license"), (1, "mit license"), (None, "mit license")])
    assert license_scan.scan(frame)[0].count() == 3
    assert license_scan.scan(frame.where("false"))[0].count() == 0


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(5, "mit license", 1, "a")], "id long, body string, row int, words string")
    assert license_scan.scan(frame, "id", "body")[0].first()["labels"] == "mit"


@pytest.mark.parametrize("name", ["op8_license_scan"])
def test_query_on_whole_texts(spark, folder, name):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = license_scan.op8_license_scan(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        got = tuple(row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))
        assert got == base_of(texts[row["doc_id"]])
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
