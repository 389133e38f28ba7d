import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayloom.llm import bpe_automaton

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


ODD = [
    "Plain words, and more.",
    None,
    "",
    " ",
    "   three blanks   and\n\n  lines \n x\t\ty ",
    "it's we'll I'D they've 'tis 123 4.5 !!! ... 中文 \U0001f600\U0001f600 é café naïve",
    "<|endoftext|> in a<|endoftext|>b text <|endoftext|",
    "\x00\x1c\x1f\x85\xa0　  ​ ֌ ՘x ꟎1 \U00010d40",
    "a" * 3000,
    "aaab" * 2000 + " " * 2000 + "x",
    "long " * 5000,
    "Plain words, and more.",
]


@pytest.fixture(scope="module")
def code():
    return bpe_automaton.coder(PATH)


def test_agrees_with_the_library_on_odd_texts(spark, docs):
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "same id"), (3, "same id")]
    coded = bpe_automaton.encode(docs(rows), PATH, decoded="again")
    found = bpe_automaton.decode(coded, PATH).collect()
    assert all(r["again"] == r["text"] for r in found)
    assert sorted((str(r["doc_id"]), r["n_tokens"], ids(r["ids"]), r["text"]) for r in found) == sorted(
        (str(k), len(expected(x)), expected(x), LIBRARY.decode(expected(x), skip_special_tokens=False))
        for k, x in rows
    )


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("etaoin shr'.,\n\tÉé0 "), st.characters(codec="utf-8"))))
def test_agrees_with_the_library_on_any_text(code, text):
    found = code.encode(text)
    assert ids(found) == expected(text)
    assert code.decode(found) == LIBRARY.decode(expected(text), skip_special_tokens=False) == text


def merged(word, merges):
    """The merges applied one after another, from the left."""
    parts = [bytes([b]) for b in word]
    for pair in merges:
        done, k = [], 0
        while k < len(parts):
            both = k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair
            done.append(parts[k] + parts[k + 1] if both else parts[k])
            k += 1 + both
        parts = done
    return parts


@pytest.mark.parametrize("seed", range(8))
def test_gadgets_give_what_successive_merges_give(seed):
    """Merges of any order of parts, also such that no text ever uses."""
    draw = random.Random(seed)
    tokens, merges = [b"a", b"b", b"c"], []
    while len(merges) < 25:
        pair = draw.choice(tokens), draw.choice(tokens)
        if pair[0] + pair[1] not in tokens:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    vocabulary = {bytes([b]): b for b in range(256)}
    vocabulary |= {x + y: 256 + k for k, (x, y) in enumerate(merges)}
    automaton = bpe_automaton.Automaton(vocabulary, merges, limit=40)
    for _ in range(400):
        word = bytes(draw.choices(b"abc", k=draw.randint(0, 30)))
        assert [automaton.label[t] for t in automaton.encode(word)] == merged(word, merges)


def test_results_do_not_depend_on_what_is_remembered(code):
    small = bpe_automaton.Coder(PATH)
    small.automaton.limit = 60
    small.of_piece.limit = small.of_chunk.limit = 5
    text = "The quick brown fox's jumps, über den lazy dog\n" * 3 + "and 12 others"
    assert small.encode(text) == code.encode(text)


def test_unknown_ids_and_cut_characters_are_decoded_as_the_library_does(code):
    given = [64, 70_000, 50_256, 158, 65]
    assert code.decode(np.array(given, "<u4").tobytes()) == LIBRARY.decode(given, skip_special_tokens=False)


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe_automaton.Coder(public_tokenizers.path("word_bpe_49k.json"))
    kept = json.load(open(PATH, encoding="utf-8"))
    kept["model"]["merges"] = kept["model"]["merges"][5:]
    path = tmp_path / "cut.json"
    path.write_text(json.dumps(kept))
    with pytest.raises(ValueError, match="not made yet"):
        bpe_automaton.Coder(str(path)).automaton  # noqa: B018


def test_clashing_names_and_empty_tables(spark, docs):
    frame = docs([(1, "some text")]).selectExpr("doc_id AS ids", "text", "1 AS n_tokens", "lang AS TEXT_")
    coded = bpe_automaton.encode(frame, PATH, id_col="ids")
    assert coded.columns == ["ids", "n_tokens", "ids_"]
    (row,) = bpe_automaton.decode(coded, PATH, ids_col="ids_").collect()
    assert row["text"] == "some text"
    assert bpe_automaton.decode(bpe_automaton.encode(docs([]), PATH), PATH).count() == 0


def test_query_against_the_library(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = bpe_automaton.op13_bpe_automaton(spark, folder).collect()
    assert len(found) == len(texts)
    for row in found:
        wanted = expected(texts[row["doc_id"]])
        text = LIBRARY.decode(wanted, skip_special_tokens=False)
        assert row["n_tokens"] == len(wanted)
        assert row["ids_sha256"] == hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
