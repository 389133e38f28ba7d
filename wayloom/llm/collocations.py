"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow to the right, from words to two, three and four of them. What a prefix is known to
count bounds what can become of it: with ``f`` occurrences of the prefix and ``f1`` of its first
word, no phrase that it grows into can score above ``2000000 f / (f1 + f)``, as the cut after the
first word already gives no more. So the prefixes with the best bounds are expanded first, down to
a score that is set for each language, and then

* every phrase at or above that score is known, with all that its own score needs, and
* so is every longer phrase that could drop one of them, since phrases at or above the score are
  also looked for as the end of longer ones.

A language is settled if that leaves as many survivors as are asked for, ties included; otherwise
its score is lowered and the next prefixes are expanded. Without prefixes left everything is known.

Each expansion is one pass over the texts. Tasks count by exact word numbers of their own and hand
over partial sums, so that a phrase however common is a few rows for each task. A pass is told by
Bloom filters what to count; a filter has at most ``MAX_BITS`` bits whatever the data, and beyond
that lets more phrases through. These are counted like the others: what a filter lets through
changes the time and not the result.

Defined results: a null text counts as empty, a null language as ``und``. Repeated rows and texts
count each time, ids are not looked at, other columns may have any name. Languages without a
candidate and empty tables give no rows. A text may be of any length; a task holds one piece of it
(a stretch without ``.,;:!?`` or line ends) and ``CHUNK`` bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.llm.common import documents
from wayloom.llm.words import GOLDEN, mix
from wayloom.session import stage

MIN_COUNT = 30
LONGEST = 4
LIMIT = 2000
SCALE = 2_000_000
#: A longer phrase with this share (in percent) of a phrase's occurrences drops it.
DROP_PCT = 80
#: Candidates of two words above the first score, as a multiple of the limit, and how that grows.
REACH, GROWTH = 2, 4
#: Bits of a filter for each member, and at most.
BITS, MAX_BITS = 16, 1 << 27
CHUNK = 2 << 20
#: Words and phrases that a task holds before it hands its sums over.
MAX_WORDS, MAX_PHRASES = 500_000, 2_000_000

END = b"\xff"
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", END * 10)


def tongue(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def grown(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are a word longer."""
    return mix(hashes * GOLDEN + words)


@dataclass(frozen=True)
class Filter:
    """Bloom filter with two bits for a member; may find others too."""

    bits: np.ndarray

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        last = np.uint64(8 * len(self.bits) - 1)
        return [hashes & last, (hashes >> np.uint64(32)) & last]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        first, second = (
            self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) for p in self.places(hashes)
        )
        return (first & second & 1).astype(bool)


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Hashes of phrases that have one number of words."""
    seeds = {lang: tongue(lang) for lang in set(langs)}
    found = np.array([seeds[lang] for lang in langs], np.uint64)
    for words in zip(*(p.encode().split(b" ") for p in phrases)):
        found = grown(found, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return found


def filter_of(members: DataFrame) -> Filter:
    """Filter of the (lang, phrase) rows, put together in tasks; the driver gets its words of bits."""
    wanted, size = BITS * members.count(), 1 << 12
    while size < min(wanted, MAX_BITS):
        size *= 2
    empty = np.zeros(size // 8, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            places = np.concatenate(Filter(empty).places(hashes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places >> 6), pa.array((np.uint64(1) << (places & 63).astype(np.uint64)).view(np.int64))],
                names=["place", "bits"],
            )

    parts = members.select("lang", "phrase").mapInArrow(run, "place long, bits long")
    table = parts.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[table["place"].to_numpy()] = table["bits"].to_numpy()
    return Filter(words.view(np.uint8))


@dataclass(frozen=True)
class Rule:
    """What a pass counts: phrases all of whose parts of two words (words, if the phrase has two)
    are in ``parts``, and whose beginning is in ``first``, or whose end in ``last``, or which are in
    ``whole``. All that is not given holds no phrase."""

    parts: Filter | None = None
    first: Filter | None = None
    last: Filter | None = None
    whole: Filter | None = None

    def chosen(self, length: int, lang: np.uint64, words: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Starts of the phrases to count, among those that lie inside a piece."""
        start = np.flatnonzero(inside)
        if not self.parts:
            return start
        size = 1 if length == 2 else 2
        hashes = {1: grown(np.full(len(words), lang), words)}
        for n in range(2, length + 1):
            hashes[n] = grown(hashes[n - 1][:-1], words[n - 1 :])
        good = self.parts.has(hashes[size])
        for k in range(length - size + 1):
            start = start[good[start + k]]
        if length == 2:
            return start
        found = np.zeros(len(start), bool)
        for members, n, shift in ((self.first, length - 1, 0), (self.last, length - 1, 1), (self.whole, length, 0)):
            if members:
                found |= members.has(hashes[n][start + shift])
        return start[found]


class Words(dict):
    """Word to its number in this task, from 1; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({END: 0})
        self.hashes = np.zeros(1024, np.uint64)
        self.new: list[int] = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        self.new.append(xxhash.xxh3_64_intdigest(word))
        return found

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            if len(self) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(len(self), np.uint64)])
            self.hashes[len(self) - len(self.new) : len(self)] = self.new
            self.new.clear()
        return found


def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], wide: bool) -> tuple[np.ndarray, ...]:
    """Counts of equal keys together; a key is two numbers, the first of which is 0 if not ``wide``."""
    high, low, count = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((low, high)) if wide else np.argsort(low)
    high, low = high[order], low[order]
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    at = np.flatnonzero(first)
    return high[at], low[at], np.add.reduceat(count[order], at) if len(at) else count


class Tally:
    """Phrases of one language that a task has counted and not handed over yet."""

    def __init__(self, lang: str, length: int, rule: Rule):
        self.lang, self.length, self.rule = lang, length, rule
        self.seed, self.words, self.total = tongue(lang), Words(), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = self.held = 0

    def add(self, data: bytes) -> None:
        at = 0
        while at < len(data):
            cut = data.find(END, at + CHUNK)
            cut = len(data) if cut < 0 else cut
            self._add(data[at:cut])
            at = cut + 1

    def _add(self, data: bytes) -> None:
        ids = self.words.numbers(data.replace(END, b" \xff ").split())
        n = self.length
        if len(ids) < n:
            return
        inside = ids != 0
        self.total += int(inside.sum())
        whole = inside[: len(ids) - n + 1].copy()
        for k in range(1, n):
            whole &= inside[k : len(ids) - n + 1 + k]
        start = self.rule.chosen(n, self.seed, self.words.hashes[ids], whole)
        columns = [ids[start + k] for k in range(n)]
        if n <= 2:
            low = columns[0] if n == 1 else columns[0] << 32 | columns[1]
            low, count = np.unique(low, return_counts=True)
            part = np.zeros(len(low), np.int64), low, count
        else:
            low = columns[2] if n == 3 else columns[2] << 32 | columns[3]
            part = summed([(columns[0] << 32 | columns[1], low, np.ones(len(low), np.int64))], True)
        self.parts.append(part)
        self.waiting += len(part[1])
        if self.waiting > self.held + MAX_PHRASES // 4:
            self.parts = [summed(self.parts, n > 2)]
            self.waiting = self.held = len(self.parts[0][1])

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What was counted, and a row without phrase for all words."""
        high, low, count = summed(self.parts, self.length > 2) if self.parts else [np.zeros(0, np.int64)] * 3
        last = (1 << 32) - 1
        columns = {1: [low], 2: [low >> 32, low & last], 3: [high >> 32, high & last, low]}.get(
            self.length, [high >> 32, high & last, low >> 32, low & last]
        )
        words = pa.array(list(self.words), pa.binary())
        for at in range(0, len(low), 50_000):
            parts = [words.take(pa.array(c[at : at + 50_000])) for c in columns]
            phrases = pc.binary_join_element_wise(*parts, b" ") if len(parts) > 1 else parts[0]
            yield self._batch(phrases.cast(pa.string()), count[at : at + 50_000])
        if self.length == 1:
            yield self._batch(pa.nulls(1, pa.string()), np.array([self.total]))

    def _batch(self, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        langs = pa.array([self.lang]).take(pa.array(np.zeros(len(phrases), np.int64)))
        return pa.RecordBatch.from_arrays([langs, phrases, pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])


def counted(texts: DataFrame, length: int, rule: Rule) -> DataFrame:
    """``(lang, phrase, f)`` of all phrases of ``length`` words that the rule chooses.

    ``texts`` is (lang, text as bytes). For single words there is a row of each language without a
    phrase, which counts all of them.
    """
    shared = texts.sparkSession.sparkContext.broadcast(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}
        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                if lang not in tallies:
                    tallies[lang] = Tally(lang, length, shared.value)
                own = batch.column(1).filter(pc.equal(langs, lang))
                waiting, size = [], 0
                for text in own:
                    waiting.append((text.as_py() or b"").lower().translate(ENDS))
                    size += len(waiting[-1])
                    if size >= CHUNK:
                        tallies[lang].add(END.join(waiting))
                        waiting, size = [], 0
                tallies[lang].add(END.join(waiting))
            words = sum(len(t.words) for t in tallies.values())
            if words > MAX_WORDS or sum(t.waiting for t in tallies.values()) > MAX_PHRASES:
                for tally in tallies.values():
                    yield from tally.rows()
                tallies.clear()
        for tally in tallies.values():
            yield from tally.rows()

    found = texts.mapInArrow(run, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def exact_ratio(a: str, others: str) -> Column:
    """``floor(SCALE a / others)``, also where the product passes 64 bits."""
    return F.expr(f"CAST(CAST({SCALE} AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(19,0)) div ({others}) AS BIGINT)")


def head(k: int) -> Column:
    return F.substring_index("phrase", " ", k)


def tail(length: int, k: int) -> Column:
    """What follows the first ``k`` words of a phrase of ``length``."""
    return F.substring_index("phrase", " ", k - length)


def with_count(table: DataFrame, counts: DataFrame, part: Column, name: str, how: str = "left") -> DataFrame:
    known = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))
    found = table.withColumn("_wanted", part)
    found = found.join(known, (F.col("lang") == F.col("_lang")) & (F.col("_wanted") == F.col("_part")), how)
    return found.drop("_lang", "_part", "_wanted")


def scored(phrases: DataFrame, length: int, counts: dict[int, DataFrame]) -> DataFrame:
    """The phrases with the counts of their parts, their worst cut, and the bound for what grows.

    Null where a part was not counted.
    """
    table = phrases
    for k in range(1, length):
        table = with_count(table, counts[k], head(k), f"_l{k}")
        table = with_count(table, counts[length - k], tail(length, k), f"_r{k}")
    cuts = [
        F.struct(
            exact_ratio("f", f"_l{k} + _r{k}").alias("score"),
            F.lit(k).alias("k"),
            F.col(f"_l{k}").alias("l"),
            F.col(f"_r{k}").alias("r"),
        )
        for k in range(1, length)
    ]
    unknown = reduce(Column.__or__, [F.col(f"_{x}{k}").isNull() for k in range(1, length) for x in "lr"])
    worst = F.when(~unknown, F.least(*cuts) if len(cuts) > 1 else cuts[0])
    known = [F.col("_l1").alias("first"), worst.alias("worst")]
    table = table.select("lang", "phrase", "f", *known)
    return table.withColumns(
        {
            "score": F.col("worst.score"),
            "l": F.col("worst.l"),
            "r": F.col("worst.r"),
            "bound": exact_ratio("f", "first + f"),
        }
    ).drop("worst", "first")


def mine(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    limit: int = LIMIT,
    min_count: int = MIN_COUNT,
    reach: int = REACH,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of every language.

    ``reach`` sets how many prefixes are expanded at first; the result does not depend on it.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.col(text_col).cast("binary").alias("text"))
    often = F.col("phrase").isNull() | (F.col("f") >= min_count)
    first = stage(counted(texts, 1, Rule()).where(often))
    totals = first.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    words = first.where("phrase IS NOT NULL")
    pairs = stage(counted(texts, 2, Rule(parts=filter_of(words))).where(often))
    counts = {1: words, 2: pairs}
    two = stage(scored(pairs, 2, counts))
    in_parts = filter_of(pairs)
    done = two.select("lang", F.lit(0).cast("long").alias("reached"), F.lit(True).alias("settled")).where("false")
    while True:
        # The score down to which each language that is not settled is looked at now.
        best = Window.partitionBy("lang").orderBy(F.desc("score"))
        at = two.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= reach * limit)
        down_to = at.groupBy("lang").agg(
            F.when(F.count("*") < reach * limit, F.lit(-1)).otherwise(F.min("score")).alias("reached")
        )
        settled = done.where("settled")
        reached = stage(
            down_to.join(settled.select("lang"), "lang", "left_anti").unionByName(settled.select("lang", "reached"))
        )
        scores = {2: two}
        for length in (3, 4):
            below = scores[length - 1].join(reached, "lang")
            rule = Rule(
                parts=in_parts,
                first=filter_of(below.where("bound >= reached")),
                last=filter_of(below.where("score >= reached")),
            )
            found = counted(texts, length, rule).where(often)
            counts[length] = stage(found)
            if length == LONGEST:
                counts[3] = stage(counts[3].unionByName(missing_parts(texts, scores, counts, reached, in_parts, often)))
            scores[length] = stage(scored(counts[length], length, counts))
        every = reduce(
            DataFrame.unionByName,
            [t.select("lang", "phrase", F.col("f").alias("a"), "l", "r", "score") for t in scores.values()],
        )
        kept = stage(surviving(every.join(reached, "lang").where("score >= reached"), counts).drop("reached"))
        enough = kept.groupBy("lang").agg(F.count("*").alias("kept"))
        done = stage(
            reached.join(enough, "lang", "left").select(
                "lang", "reached", ((F.col("reached") < 0) | (F.col("kept") >= limit)).alias("settled")
            )
        )
        if done.where("NOT coalesce(settled, false)").isEmpty():
            break
        reach *= GROWTH
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def missing_parts(
    texts: DataFrame,
    scores: dict[int, DataFrame],
    counts: dict[int, DataFrame],
    reached: DataFrame,
    in_parts: Filter,
    often: Column,
) -> DataFrame:
    """Ends of three words that the score of a phrase of four needs and that were not counted."""
    fours = counts[4].join(reached, "lang")
    begun = scores[3].where("bound IS NOT NULL").select("lang", F.col("phrase").alias("_head"), "bound")
    fours = fours.withColumn("_head", head(3)).join(begun, ["lang", "_head"]).where("bound >= reached")
    ends = fours.select("lang", tail(4, 1).alias("phrase")).distinct()
    ends = stage(ends.join(counts[3], ["lang", "phrase"], "left_anti"))
    if ends.isEmpty():
        return counts[3].where("false")
    found = counted(texts, 3, Rule(parts=in_parts, whole=filter_of(ends))).where(often)
    return found.join(counts[3], ["lang", "phrase"], "left_anti")


def surviving(candidates: DataFrame, counts: dict[int, DataFrame]) -> DataFrame:
    """Candidates without a longer phrase around them that occurs nearly as often.

    A phrase of one word more tells: whatever is around that occurs no more often.
    """
    around = [
        counts[length].select(
            "lang",
            F.explode(F.array(head(length - 1), tail(length, 1))).alias("phrase"),
            F.col("f").alias("longer"),
        )
        for length in (3, 4)
    ]
    most = around[0].unionByName(around[1]).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    dropped = F.expr(
        f"CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(19,0)) >= "
        f"CAST({DROP_PCT} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(19,0))"
    )
    found = candidates.join(most, ["lang", "phrase"], "left")
    return found.where(~F.coalesce(dropped, F.lit(False))).drop("longer")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return mine(documents(spark, folder))


SQL_OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counts AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
  GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT lang, k, phrase, a, w, unnest(generate_series(1, k - 1)) AS c FROM candidates),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, c, x.f AS l, y.f AS r,
    CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.k = c AND x.phrase = array_to_string(w[1 : c], ' ')
    JOIN counts y ON y.lang = cuts.lang AND y.k = cuts.k - c AND y.phrase = array_to_string(w[c + 1 : cuts.k], ' ')),
worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, c) = 1),
inner_phrases AS (
  SELECT lang, j AS k, array_to_string(w[i : i + j - 1], ' ') AS phrase, a
  FROM (SELECT lang, w, a, j, unnest(generate_series(1, k - j + 1)) AS i
        FROM candidates, (SELECT unnest([2, 3]) AS j) WHERE j < k)),
around AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
ranked AS (
  SELECT lang, phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank
  FROM worst LEFT JOIN around USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
