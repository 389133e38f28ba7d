"""Token ids in length-delimited binary records.

A file is a row of records, each framed as

    length of the data (8 bytes) | masked CRC-32C of those 8 bytes | data | masked CRC-32C of the data

all little-endian, which is the framing of TFRecord files. The data of a record is one document:
whether there is an id (1 byte), the bytes of a token id (1 byte; 2 for vocabularies of up to 65,536
tokens, else 4), the document's id (8 bytes), then the token ids. Beside
each file lies ``.index`` with the 8-byte offset of every record, for shuffled reads. Files are cut
from the documents in ascending id order; ``manifest`` has a row for each file.

Defined results: a null text counts as empty and holds the end id only. Rows with a null id come
first. Repeated rows are all written; rows of equal id stand in the order of their texts.
An empty table gives no files.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.llm.common import documents, partitions
from wayloom.llm.crc32c import crc32c_many, masked
from wayloom.llm.storage import committed, opened
from wayloom.session import scratch_path, stage

END_ID = 2
HEAD = "<?Bq"
HEAD_SIZE = struct.calcsize(HEAD)
#: Records are framed and read in pieces of about this many bytes.
PIECE = 4 << 20


#: What may follow the letters of a word without changing how they are encoded.
TAIL = b".,!?;:#*$%&|"


def all_letters(word: bytes) -> bool:
    """Whether a word is letters only, also when it is normalised and lower-cased."""
    if word.isascii():
        return word.isalpha()
    text = word.decode("utf-8", "replace")
    return text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


class WordTokens(dict):
    """White-space-delimited word to its token ids, as little-endian numbers of ``width`` bytes.

    Holds for tokenizers that lower-case, whose normaliser and splitter never look across white
    space, whose splitter parts letters from ``TAIL``, and whose pieces end with a token of their
    own kind (``</w>``), as the tests check. Words that are letters with a tail share the encoding
    of their letters, and new ones are encoded together as one text, cut at its end-of-word tokens;
    all other words go through the tokenizer one by one. The result does not depend on what is
    remembered.
    """

    def __init__(self, tokenizer, limit: int = 900_000):
        super().__init__()
        self.tokenizer, self.limit = tokenizer, limit
        vocabulary = tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: bytes) -> bytes:
        words = text.split()
        if len(self) > self.limit:
            self.clear()
        if unknown := {w for w in words if w not in self}:
            self.learn(unknown)
        return b"".join(map(self.__getitem__, words))

    def learn(self, words: set[bytes]) -> None:
        parts, odd, letters = [], set(), set()
        for word in words:
            core = word.lower().rstrip(TAIL)
            if all_letters(core):
                tail = word[len(core) :]
                parts.append((word, core, tail))
                letters.add(core)
                odd.add(tail)
            else:
                odd.add(word)
        self.one_by_one([w for w in odd if w not in self])
        self.together([w for w in letters if w not in self])
        for word, core, tail in parts:
            self[word] = self[core] + self[tail] if tail else self[core]

    def one_by_one(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast(
            [w.decode("utf-8", "replace") for w in words], add_special_tokens=False
        )
        self.update((w, self.packed(e.ids)) for w, e in zip(words, found))

    def together(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            (found,) = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
            ids = np.array(found.ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            # As many ends as words: each has one, for each has at least one.
            if len(cuts) == len(some):
                raw, before = ids.tobytes(), 0
                for word, cut in zip(some, (cuts * self.width).tolist()):
                    self[word] = raw[before:cut]
                    before = cut
            else:
                self.one_by_one(some)


_loaded: dict[str, WordTokens] = {}


def tokens(path: str) -> WordTokens:
    """The tokenizer of a file, loaded once in each worker process."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = WordTokens(Tokenizer.from_file(path))
    return _loaded[path]


def frame(data: list[bytes]) -> list[bytes]:
    """The records with their lengths and checksums."""
    lengths = [struct.pack("<Q", len(d)) for d in data]
    heads = masked(crc32c_many(lengths)).astype("<u4").tobytes()
    sums = masked(crc32c_many(data)).astype("<u4").tobytes()
    return [
        b"".join((n, heads[4 * i : 4 * i + 4], d, sums[4 * i : 4 * i + 4]))
        for i, (n, d) in enumerate(zip(lengths, data))
    ]


def unframed(source) -> Iterator[list[bytes]]:
    """The data of all records of a stream, in pieces, checksums tested."""
    done = False
    while not done:
        lengths, heads, data, sums, size = [], b"", [], b"", 0
        while size < PIECE:
            head = source.read(12)
            if len(head) < 12:
                if head:
                    raise ValueError("a record is cut off")
                done = True
                break
            (n,) = struct.unpack("<Q", head[:8])
            body = source.read(n + 4)
            if len(body) < n + 4:
                raise ValueError("a record is cut off")
            lengths.append(head[:8])
            heads += head[8:]
            data.append(body[:n])
            sums += body[n:]
            size += n + 16
        for got, kept in ((lengths, heads), (data, sums)):
            if masked(crc32c_many(got)).astype("<u4").tobytes() != kept:
                raise ValueError("a checksum does not fit")
        if data:
            yield data


def document_of(data: bytes) -> tuple[int | None, np.ndarray]:
    """The id and the token ids, as unsigned 32-bit numbers, of a record's data."""
    has, width, key = struct.unpack_from(HEAD, data)
    ids = np.frombuffer(data, f"<u{width}", offset=HEAD_SIZE).astype("<u4")
    return (key if has else None), ids


def record_at(path: str, k: int) -> bytes:
    """The data of record ``k`` of a file, found by its index."""
    files, name = opened(path)
    with files.open_input_file(f"{name}.index") as index:
        index.seek(8 * k)
        (offset,) = struct.unpack("<Q", index.read(8))
    with files.open_input_file(name) as source:
        source.seek(offset)
        (n,) = struct.unpack("<Q", source.read(8))
        source.seek(offset + 12)
        body = source.read(n + 4)
    if masked(crc32c_many([body[:n]])).astype("<u4").tobytes() != body[n:]:
        raise ValueError("a checksum does not fit")
    return body[:n]


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: int | None = None,
) -> DataFrame:
    """Write the documents as record files below ``path``; returns the manifest.

    ``(file, records, tokens, first_token)`` for each file, ``first_token`` being the number of
    tokens in all files before it. The texts are range-partitioned by id once, as text, which is
    smaller than its token ids.
    """
    count = files or partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(tokenizer)
        encode, width = known.encode, known.width
        number = TaskContext.get().partitionId()
        name = f"{path}/part-{number:06d}.records"
        n_tokens, offset, offsets, waiting, size = 0, 0, [], [], 0
        end = known.packed([END_ID])
        first = next(batches, None)
        if first is None:
            return

        def flush(out) -> None:
            nonlocal offset, size
            for record in frame(waiting):
                offsets.append(offset)
                offset += len(record)
                out.write(record)
            waiting.clear()
            size = 0

        def all_batches():
            yield first
            yield from batches

        with committed(name) as out:
            for batch in all_batches():
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py() or b"") + end
                    n_tokens += len(ids) // width
                    waiting.append(struct.pack(HEAD, key is not None, width, key or 0) + ids)
                    size += len(ids)
                    if size >= PIECE:
                        flush(out)
            flush(out)
        with committed(f"{name}.index") as out:
            out.write(np.array(offsets, "<u8").tobytes())
        if offsets:
            yield pa.RecordBatch.from_pylist([{"file": name, "records": len(offsets), "tokens": n_tokens}])

    written = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
        .repartitionByRange(count, F.col("id").asc_nulls_first())
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
        .mapInArrow(run, "file string, records long, tokens long")
    )
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each file; only this listing passes through one task.
    listing = stage(written).withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return stage(listing, path=f"{path}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, file, record)`` of every record, from the files.

    ``start`` counts the tokens before it in id order. Each file is read by one task, in pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, name = opened(row["file"])
                start, record = row["first_token"], 0
                with files.open_input_stream(name, buffer_size=1 << 20) as source:
                    for piece in unframed(source):
                        out = []
                        for data in piece:
                            key, ids = document_of(data)
                            n = len(ids)
                            out.append((key, start, n, zlib.crc32(ids), row["file"], record))
                            start += n
                            record += 1
                        columns = zip(*out)
                        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(columns, kinds)], names=_READ_NAMES
                        )

    listing = manifest.select("file", "first_token")
    # One file to a task: the listing itself is tiny and would be one task else.
    listing = listing.repartition(partitions(manifest.sparkSession), "file")
    return listing.mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, record long"
    )


_READ_NAMES = ["doc_id", "start", "n_tokens", "ids_crc32", "file", "record"]


def op7_token_records(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-records")
    manifest = write(documents(spark, folder), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(manifest).drop("file", "record")
