"""Line-first cleaning.

Every line of a text that holds a word is judged on its own. It fails if

* punctuation: symbols stand at a fifth of its words or more, or most of its words are exclaimed;
* stutter: a third of its words or more, of at least six, repeat the word before them;
* navigation: it is cut by bars or arrows into three or more short entries, or most of its words
  are menu words;
* boilerplate: it holds a notice of the fixed list, or it repeats an earlier line of the text.

Failing lines are removed. A document is then rejected if less than ``MIN_LEFT`` of its words are
left, or if it fails the base rules (too few words, or too many in repeated five-word windows).

Defined results: null and empty texts have no words and fail the base rules. Every input row gives
one row, repeated rows too. Lines without a word are neither judged nor removed. The work is row
by row in Arrow batches, so nothing is shuffled and a long text costs its own length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import documents
from wayloom.llm.words import windows

MIN_WORDS = 10
MAX_REPEATED_PCT = 20
WINDOW = 5
MIN_LEFT = 0.6

SYMBOLS = "#*$%&|<>"
_EXCLAIMED = re.compile(r"![\"')\]]*(?=[ \t\r\v\f]|$)")
_MARK = frozenset("|»›•·→>:")
_ENTRY = re.compile(r"\s*(?:[|»›•·→]|>>?|::)\s+")
MAX_SYMBOL_SHARE = 0.2
MAX_EXCLAIMED_SHARE = 0.5
MAX_STUTTER_SHARE = 1 / 3
MIN_ENTRIES = 3
MAX_ENTRY_WORDS = 4

MENU_WORDS = frozenset(
    "home about contact login logout register menu search sitemap faq help cart checkout account "
    "profile settings next previous back top share tweet print subscribe archive archives tags "
    "categories".split()
)
NOTICES = re.compile(
    r"all rights reserved|cookie (?:policy|settings|preferences)|accept (?:all )?cookies|"
    r"privacy policy|terms (?:of (?:use|service)|and conditions)|subscribe to (?:our|the) newsletter|"
    r"sign up for (?:our|the) newsletter|follow us on|share (?:this|on) |click here|read more\b|"
    r"javascript (?:is|must be) (?:disabled|enabled)|skip to (?:main )?content|powered by ",
    re.IGNORECASE,
)
#: A notice counts in lines of no more words than this; longer lines are prose that mentions one.
MAX_NOTICE_WORDS = 20

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_removed_lines long, n_left_words long"
)


def line_fails(line: str, words: list[bytes]) -> bool:
    """Whether a line with these words fails one of the rules that look at it alone."""
    n_words = len(words)
    if sum(map(line.count, SYMBOLS)) >= MAX_SYMBOL_SHARE * n_words:
        return True
    if n_words >= 6 and sum(map(eq, words, words[1:])) >= MAX_STUTTER_SHARE * n_words:
        return True
    if n_words > 2 and "!" in line and len(_EXCLAIMED.findall(line)) > MAX_EXCLAIMED_SHARE * n_words:
        return True
    entries = _ENTRY.split(line) if not _MARK.isdisjoint(line) else []
    if len(entries) >= MIN_ENTRIES and n_words <= MAX_ENTRY_WORDS * len(entries):
        return True
    if n_words <= MAX_NOTICE_WORDS:
        parts = re.findall(r"\w+", line.lower())
        if n_words > 1 and sum(map(MENU_WORDS.__contains__, parts)) * 2 > len(parts):
            return True
        return NOTICES.search(line) is not None
    return False


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows that are found twice or more in the text."""
    # Compared within one text only, so this process's own 64-bit hashes will do.
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    found = windows(ids, WINDOW)
    if len(found) < 2:
        return 0
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[starts + k] = True
    return int(covered.sum())


def judge(raw: bytes) -> tuple[list, str]:
    """The metrics of one text, in the order of ``METRICS``, and the text without failing lines."""
    text = raw.decode("utf-8", "replace")
    pieces = [line.split() for line in raw.split(b"\n")]
    words = list(chain.from_iterable(pieces))
    n_words = len(words)
    blanks = sum(text.count(c) for c in " \t\n\v\f\r")
    repeated = repeated_words(words)
    earlier, left, lines, duplicates, removed, n_left = set(), [], 0, 0, 0, 0
    for line, piece in zip(text.split("\n"), pieces):
        if size := len(piece):
            lines += 1
            again = line in earlier
            earlier.add(line)
            duplicates += again
            if again or line_fails(line, piece):
                removed += 1
                continue
            n_left += size
        left.append(line)
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED_PCT * n_words
    kept = not failed and n_left >= MIN_LEFT * n_words
    metrics = [
        n_words,
        len(text) - blanks,
        sum(text.count(c) for c in SYMBOLS),
        duplicates,
        repeated,
        failed,
        kept,
        lines,
        removed,
        n_left,
    ]
    return metrics, "\n".join(left)


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``METRICS`` of every row."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {METRICS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(x or b"")[0] for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) or [[]] * METRICS_COUNT
            kinds = [pa.bool_() if k in (5, 6) else pa.int64() for k in range(METRICS_COUNT)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns, kinds)], names=[id_col, *METRIC_NAMES]
            )

    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, schema)


METRIC_NAMES = [x.split()[0] for x in METRICS.split(", ")]
METRICS_COUNT = len(METRIC_NAMES)


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, all their columns, with failing lines taken out of the text."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [judge((x or "").encode()) for x in batch.column(at).to_pylist()]
            texts = pa.array([text for _, text in judged], batch.column(at).type)
            batch = batch.set_column(at, batch.schema.field(at), texts)
            yield batch.filter(pa.array([row[METRIC_NAMES.index("kept")] for row, _ in judged], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return metrics(documents(spark, folder))
