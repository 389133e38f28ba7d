import re
from collections import Counter

import pytest

from wayloom.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if seen[tuple(words[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
        failed,
    )


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
PROSE = "This line is plain prose, with a full stop and enough words."
CASES = [
    (PROSE, True, 0),
    (f"{PROSE}\nHome | About | Contact | Login", True, 1),
    (f"{PROSE}\nWe accept cookies to improve things.", True, 1),
    (f"{PROSE}\n{PROSE} {PROSE}\n{PROSE}", False, 1),
    (f"{PROSE}\n###$$$ word*** more%%% and&&& so|| on<<", True, 1),
    (f"{PROSE}\nBUY!! NOW!! CHEAP!! ONLY!! HERE!! GO!! ON!! AND!! ON!! MORE!! ALL!! DAY!!", False, 1),
    (f"{PROSE}\nThe The of of and and it it", True, 1),
    ("Only four words here.", False, 0),
    (None, False, 0),
    ("", False, 0),
    (" \n\t\n", False, 0),
    ("é中 \x1cx\x85y\xa0z " * 20, False, 0),
    (f"The court said in a long line of prose that its privacy policy, like every other one of the kind, is long. {PROSE}", True, 0),
    ("w" * 300_000, False, 0),
]


def test_cases(spark, docs):
    rows = {r["doc_id"]: r for r in quality_rules.metrics(docs([t for t, *_ in CASES])).collect()}
    for i, (text, kept, removed) in enumerate(CASES):
        row = rows[i]
        assert tuple(row[f] for f in FIELDS) == base(text), text and text[:80]
        assert (row["kept"], row["n_removed_lines"]) == (kept, removed), text and text[:80]


def test_clean_takes_lines_out(spark):
    schema = "kept string, doc_id long, TEXT string, n_words int"
    rows = [("a", 1, CASES[1][0], 5), ("b", 1, CASES[1][0], 5), ("c", None, "short", 1), ("d", 2, None, 0)]
    found = quality_rules.clean(spark.createDataFrame(rows, schema), "TEXT")
    assert found.columns == ["kept", "doc_id", "TEXT", "n_words"]
    assert sorted(map(tuple, found.collect())) == [("a", 1, PROSE, 5), ("b", 1, PROSE, 5)]
    assert quality_rules.clean(spark.createDataFrame([], schema), "TEXT").count() == 0
    assert quality_rules.metrics(spark.createDataFrame([], schema), "doc_id", "TEXT").count() == 0


def test_verdicts_on_labelled_documents(spark, folder):
    """Nothing here is fitted, so all labelled documents are held out."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = quality_rules.op3_quality_rules(spark, "/root/testdata/sf0.1").join(labels, "doc_id")
    rows = found.select("quality", "kept", "base_failed").collect()
    junk = [r for r in rows if r["quality"] == 0]
    clean = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in junk) < 0.02 * len(junk)
    assert sum(r["kept"] for r in clean) > 0.99 * len(clean)


@pytest.mark.parametrize("size", [0, 1, 4, 5, 9])
def test_repeated_words_of_short_texts(size):
    assert quality_rules.repeated_words([b"w"] * size) == (size if size >= 6 else 0)


def test_query_on_whole_texts(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = quality_rules.op3_quality_rules(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert tuple(row[f] for f in FIELDS) == base(texts[row["doc_id"]])
        assert not (row["base_failed"] and row["kept"])
