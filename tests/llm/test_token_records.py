import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayloom.llm import crc32c, token_records
from wayloom.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    encode = Tokenizer.from_file(PATH).encode
    start, found = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*encode(text or "", add_special_tokens=False).ids, token_records.END_ID]
        found.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def written(spark, frame, **options):
    manifest = token_records.write(frame, scratch_path(spark, "records"), PATH, **options)
    return manifest, token_records.read(manifest)


def test_checksums():
    known = {b"123456789": 0xE3069283, b"": 0, b"\0" * 32: 0x8A9136AA, bytes(range(32)): 0x46DD794E}
    assert crc32c.crc32c_many(list(known)).tolist() == list(known.values())
    assert crc32c.masked(np.array([0xE3069283], np.uint32)).tolist() == [
        ((0xE3069283 >> 15 | 0xE3069283 << 17 & 0xFFFFFFFF) + 0xA282EAD8) % 2**32
    ]


ODD = [
    "Plain words, and more.",
    None,
    "",
    "é café naïve İstanbul ΣΣς",
    "tab\tline\nfeed\x0bvt\x0cff\rcr\x1cfs\x85nel\xa0nbsp em　wide",
    "<|endoftext|> inside a<|endoftext|>b text",
    " ́mark after blank ̸",
    "it's we'll I'D 123 4.5 !!! ... 中文 \U0001f600\U0001f600",
    "İ İSTANBUL ﬁ ½ K Å Ω H̱ ẖ ŉ ß ẞ 가 각 가나 ａＢ ١٢ a1b a.b ..a",
    "End. END, end! End!! end### End*** (end) 'end' end's END'S <|x|> x|> <|x",
    "long " * 5000,
    "Plain words, and more.",
]


def test_agrees_with_the_tokenizer_on_odd_texts(spark, docs):
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "same id"), (3, "same id")]
    _, found = written(spark, docs(rows), files=3)
    got = sorted(map(tuple, found.drop("file", "record").collect()), key=lambda r: r[1])
    assert got == expected(rows)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAéÉİıΣςß中 \t\n.,!?|<>'#1½क़\u0301\u0331\u1100\u1161\u00a0\u212a"), max_size=30))
def test_words_agree_with_whole_texts(text):
    known = token_records.tokens(PATH)
    direct = known.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(known.encode(text.encode()), known.kind).tolist() == direct


def test_random_reads_by_the_index(spark, docs):
    manifest, found = written(spark, docs(ODD), files=2)
    for row in found.collect():
        data = token_records.record_at(row["file"], row["record"])
        key, ids = token_records.document_of(data)
        assert (key, zlib.crc32(ids)) == (row["doc_id"], row["ids_crc32"])
    assert manifest.count() == 2


def test_a_changed_byte_is_found(spark, docs, tmp_path):
    manifest, _ = written(spark, docs(ODD[:3]), files=1)
    row = manifest.first()
    path = row["file"]
    name = path.removeprefix("file://")
    raw = bytearray(open(name, "rb").read())
    raw[14] ^= 1
    open(name, "wb").write(raw)
    with pytest.raises(ValueError):
        token_records.record_at(path, 0)


def test_empty_table(spark, docs):
    manifest, found = written(spark, docs(["x"]).where("false"))
    assert manifest.count() == found.count() == 0


def test_query_on_whole_texts(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = token_records.op7_token_records(spark, folder).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)
