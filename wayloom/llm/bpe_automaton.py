"""Byte-pair encoding by a tokenization automaton.

The merges of a byte-level tokenizer are compiled into a deterministic automaton whose arcs are
tokens. At first one state has an arc for each byte. Then each merge ``(u, v)`` in turn puts in its
gadget: where ``u`` leads to a state with an arc ``v``, ``u`` is led to a copy of that state without
``v``, and an arc ``uv`` goes where ``v`` went. What is left are exactly the right tokenizations.
All arcs of one token lead to one state, so a state is what may follow a token, and it is kept as
its parent and what the gadget took away: arcs numbered so that ``v`` and all tokens made later that
begin with it are two intervals.

Words are read byte by byte: a state of the reader is the set of arcs that are begun, each with the
place in its label that is reached, and the token that ends here. Its transitions are a table,
filled when first needed. The path back along the tokens that end is the encoding, in time linear
in the word. Decoding puts the labels of the arcs together.

Defined results: a null text counts as empty and has no tokens. Rows are coded by themselves, so
repeated rows, null ids and empty tables need nothing special; only the id and text columns are read,
and if the id column is named as a result is, the result's name is lengthened. A text is one value
of a row, so it can have as many bytes as Spark allows there. Bytes that are not UTF-8 become
U+FFFD. Ids without a token are left out by decoding, as the library does.
"""

from __future__ import annotations

import json
import re
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import documents, free

# Fixed value: how byte-level tokenizers part a text before merging.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Letters, digits and white space up to here are the same in all versions of Unicode.
FAR = re.compile("[^\x00-ɏ]")
#: A blank that follows white space does not surely begin a piece.
LOOSE = regex.compile(r"\s ")

START = 0
NEVER = 1 << 60


def byte_signs() -> list[str]:
    """The character that stands for each byte in the files of byte-level tokenizers.

    Printable characters of Latin-1 stand for themselves, the others follow from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Automaton:
    """The token automaton of a list of merges, and the byte reader that is derived from it.

    ``vocabulary`` names the id of each label, ``merges`` the pairs of labels in their order.
    ``limit`` bounds the reader's table and the remembered arcs; results do not depend on it.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], limit: int = 250_000):
        self.limit = limit
        self.label = {i: x for x, i in vocabulary.items()}
        self.size = {i: len(x) for i, x in self.label.items()}
        self._gadgets(vocabulary, merges)
        self._number_arcs()
        self._spell_labels()
        # Needed to compile only.
        del self.parts, self.made, self.rank, self.begun, self.taken, self.end, self.number
        self._forget()

    def _gadgets(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        tokens = [vocabulary[bytes([b])] for b in range(256)]
        self.parts: dict[int, tuple[int, int]] = {}
        self.made = dict.fromkeys(tokens, -1)
        self.rank: dict[tuple[int, int], int] = {}
        self.begun: dict[int, list[int]] = {t: [] for t in tokens}
        #: State after each token; the parent of each state and the (token, time) taken away.
        self.after = dict.fromkeys(tokens, START)
        self.parent, self.taken = [START], [None]
        unused: set[int] = set()
        for time, (left, right) in enumerate(merges):
            u, v, w = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if any(t not in self.made and t not in unused for t in (u, v)) or w in self.made or w in unused:
                raise ValueError(f"merge {time} uses what is not made yet or makes a token again")
            if {u, v} & unused or self.parted(u, v):
                unused.add(w)
                continue
            state = len(self.parent)
            self.parent.append(self.after[u])
            self.taken.append((v, time))
            self.after[w] = self.after[v]
            self.after[u] = state
            self.parts[w], self.made[w], self.rank[u, v] = (u, v), time, time
            self.begun[w] = []
            self.begun[u].append(w)

    def parted(self, u: int, v: int) -> bool:
        """Whether ``v`` has no arc after ``u``: parts of the two would have been merged earlier."""
        x, before_x = u, NEVER
        while True:
            y, before_y = v, NEVER
            while True:
                time = self.rank.get((x, y), NEVER)
                if time < before_x and time <= before_y and time != NEVER:
                    return True
                if y not in self.parts:
                    break
                y, before_y = self.parts[y][0], self.made[y]
            if x not in self.parts:
                return False
            x, before_x = self.parts[x][1], self.made[x]

    def _number_arcs(self) -> None:
        """Number arcs so that a token is followed by those that begin with it, in order of time."""
        self.number: dict[int, int] = {}
        self.end: dict[int, int] = {}
        waiting = [(t, False) for t, time in self.made.items() if time < 0]
        while waiting:
            token, left = waiting.pop()
            if left:
                self.end[token] = len(self.number)
            else:
                self.number[token] = len(self.number)
                waiting.append((token, True))
                waiting += [(t, False) for t in reversed(self.begun[token])]
        #: Two intervals of arcs that each state lacks and its parent may have.
        self.cuts = np.zeros((len(self.parent), 2, 2), np.int32)
        for state, (v, time) in enumerate(self.taken[1:], 1):
            later = self.begun[v]
            at = bisect_left(later, time, key=self.made.__getitem__)
            low = self.number[later[at]] if at < len(later) else self.end[v]
            self.cuts[state] = (self.number[v], self.number[v] + 1), (low, self.end[v])

    def _spell_labels(self) -> None:
        """The labels as a trie whose nodes span ranges of the tokens sorted by label."""
        tokens = sorted(self.number, key=self.label.__getitem__)
        self.sorted_numbers = np.array([self.number[t] for t in tokens])
        self.next, self.low, self.high, self.ends = [{}], [0], [len(tokens)], [None]
        path, spelt = [0], b""
        for k, token in enumerate(tokens):
            label = self.label[token]
            same = 0
            while same < len(spelt) and spelt[same] == label[same]:
                same += 1
            del path[same + 1 :]
            for byte in label[same:]:
                node = len(self.next)
                self.next[path[-1]][byte] = node
                self.next.append({})
                self.low.append(k)
                self.high.append(k)
                self.ends.append(None)
                path.append(node)
            self.ends[path[-1]] = token
            for node in path:
                self.high[node] = k + 1
            spelt = label
        self.high[0] = len(tokens)

    def _forget(self) -> None:
        self.open: dict[int, int] = {}
        #: The reader's states, by what they are made of: the token that ends, and begun arcs.
        self.place: dict[tuple[int, ...], int] = {(-1, START): 0}
        self.made_of = [(-1, START)]
        #: Transitions by state and byte, and the token that ends in each state.
        self.table: dict[int, int] = {}
        self.last = [-1]

    def arcs(self, state: int) -> int:
        """The arcs of a state: bit k is set if the k-th token by label has one."""
        found = self.open.get(state)
        if found is None:
            edges = np.zeros(len(self.sorted_numbers) + 1, np.int32)
            chain, at = [START], state
            while at != START:
                chain.append(at)
                at = self.parent[at]
            for low, high in self.cuts[chain].transpose(1, 2, 0):
                np.add.at(edges, low, 1)
                np.add.at(edges, high, -1)
            kept = (np.cumsum(edges)[:-1] == 0)[self.sorted_numbers]
            found = int.from_bytes(np.packbits(kept, bitorder="little").tobytes(), "little")
            if len(self.open) > self.limit // 50:
                self.open.clear()
            self.open[state] = found
        return found

    def _fill(self, at: int, byte: int) -> int:
        """The transition of the reader's state ``at``, put into the table."""
        begun, token, n_nodes = [], -1, len(self.next)
        for arc in self.made_of[at][1:]:
            state, node = divmod(arc, n_nodes)
            node = self.next[node].get(byte)
            if node is None:
                continue
            arcs, width = self.arcs(state) >> self.low[node], self.high[node] - self.low[node]
            if self.ends[node] is not None:
                if arcs & 1:
                    token = self.ends[node]
                arcs, width = arcs >> 1, width - 1
            if arcs & ((1 << width) - 1):
                begun.append(state * n_nodes + node)
        key = (token, *begun, self.after[token] * n_nodes)
        if key not in self.place:
            self.place[key] = len(self.last)
            self.made_of.append(key)
            self.last.append(token)
        self.table[at << 8 | byte] = found = self.place[key]
        return found

    def encode(self, word: bytes) -> list[int]:
        if len(self.last) > self.limit:
            self._forget()
        at, path, step, last, size = 0, [0], self.table.get, self.last, self.size
        for byte in word:
            # No transition leads back to state 0.
            at = step(at << 8 | byte) or self._fill(at, byte)
            path.append(at)
        left, found = len(word), []
        while left:
            token = last[path[left]]
            found.append(token)
            left -= size[token]
        found.reverse()
        return found


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memory(dict):
    """Short texts to what ``make`` gives for them; remembers up to ``limit``."""

    def __init__(self, make: Callable[[str], bytes], limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, text: str) -> bytes:
        found = self.make(text)
        if len(text) < 200:
            if len(self) >= self.limit:
                self.clear()
            self[text] = found
        return found


class Coder:
    """What a tokenizer file says, compiled.

    Only plain byte-level files are accepted: no normaliser, the usual splitter, merges alone.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            kept = json.load(file)
        model, added = kept["model"], kept["added_tokens"]
        steps = [kept["pre_tokenizer"] or {}, kept["decoder"] or {}]
        unusual = [model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")]
        unusual += [model.get(x) for x in ("byte_fallback", "ignore_merges")] + [kept["normalizer"]]
        unusual += [a[x] for a in added for x in ("single_word", "lstrip", "rstrip")]
        unusual += [steps[0].get("add_prefix_space"), not steps[0].get("use_regex", True)]
        if any(unusual) or any(s.get("type") != "ByteLevel" for s in steps) or model["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.path, self._library = path, None
        self.signs = {sign: byte for byte, sign in enumerate(byte_signs())}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.vocabulary = {self.spelt(x): i for x, i in model["vocab"].items()}
        self.merges = [(self.spelt(x), self.spelt(y)) for x, y in pairs]
        self.special = {a["content"]: a["id"] for a in added}
        contents = sorted(self.special, key=len, reverse=True)
        self.between = re.compile("(" + "|".join(map(re.escape, contents)) + ")") if contents else None
        label = {i: x for x, i in self.vocabulary.items()}
        label |= {i: self.spelt(x) for x, i in self.special.items()}
        self.labels = [label.get(i, b"") for i in range(max(label) + 1)]
        self.known: dict[str, bool] = {}
        #: Packed ids of pieces, and of chunks that follow a blank.
        self.of_piece = Memory(lambda x: pack(self.automaton.encode(x.encode())))
        self.of_chunk = Memory(lambda x: self.packed(" " + x))

    @cached_property
    def automaton(self) -> Automaton:
        return Automaton(self.vocabulary, self.merges)

    def spelt(self, token: str) -> bytes:
        """The bytes a token stands for."""
        found = [self.signs.get(sign) for sign in token]
        return token.encode() if None in found else bytes(found)

    def _split_by_library(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def usual(self, text: str) -> bool:
        """Whether the splitter here sees all characters of a text as the library does.

        The two may know different versions of Unicode.
        """
        if text.isascii():
            return True
        for sign in set(FAR.findall(text)):
            if sign not in self.known:
                probe = f"a{sign}0{sign}!{sign} {sign}\n"
                self.known[sign] = SPLIT.findall(probe) == self._split_by_library(probe)
            if not self.known[sign]:
                return False
        return True

    def packed(self, text: str) -> bytes:
        pieces = SPLIT.findall(text) if self.usual(text) else self._split_by_library(text)
        return b"".join(map(self.of_piece.__getitem__, pieces))

    def _encode_plain(self, text: str) -> bytes:
        # A blank after other than white space begins a piece, so chunks can be coded apart.
        if LOOSE.search(text) or not self.usual(text):
            return self.packed(text)
        first, *chunks = text.split(" ")
        return self.packed(first) + b"".join(map(self.of_chunk.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """The token ids of a text as little-endian unsigned 32-bit numbers."""
        if not self.between:
            return self._encode_plain(text)
        found = []
        for k, part in enumerate(self.between.split(text)):
            found.append(pack([self.special[part]]) if k % 2 else self._encode_plain(part))
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        labels, numbers = self.labels, np.frombuffer(ids, "<u4")
        numbers = numbers[numbers < len(labels)]
        return b"".join(map(labels.__getitem__, numbers.tolist())).decode("utf-8", "replace")


_compiled: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The compiled tokenizer of a file, made once in each worker process."""
    if path not in _compiled:
        _compiled[path] = Coder(path)
    return _compiled[path]


def groups(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose second column has some ``size`` bytes."""
    ends = list(accumulate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, bisect_left(ends, done + size))
        yield batch.slice(start, stop - start)
        start = stop


def encode(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: str | None = None,
) -> DataFrame:
    """``(id_col, n_tokens, ids)`` of every row, the ids packed as 4 little-endian bytes each.

    ``tokenizer`` is the path of a tokenizer file that every worker has. ``decoded`` names a further
    column for what the ids are decoded to, by the same workers.
    """
    names = [id_col, *free(docs.select(id_col), "n_tokens", "ids", *([decoded] if decoded else []))]
    kinds = [docs.schema[id_col].dataType.simpleString(), "long", "binary", "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(tokenizer)
        for batch in batches:
            for part in groups(batch):
                ids = [known.encode((x or b"").decode("utf-8", "replace")) for x in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(known.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{name}` {kind}" for name, kind in zip(names, kinds))
    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, schema)


def decode(coded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with their packed ids decoded to ``text_col``, which is put behind the others."""
    columns = [c for c in coded.columns if c != ids_col]
    (name,) = free(coded, text_col)
    kinds = [f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in (*columns, ids_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = coder(tokenizer).decode
        for batch in batches:
            texts = pa.array([decoded(x or b"") for x in batch.column(len(columns)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*columns, ids_col, name])

    return coded.select(*columns, ids_col).mapInArrow(run, ", ".join([*kinds, f"`{name}` string"]))


def op13_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return encode(documents(spark, folder), path, decoded="text").select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
