"""Language-model scoring with a log-frequency Bloom filter.

Every training document is counted: words (with one end per document) exactly, and, by 64-bit hash, words and pairs of neighbouring
words for the filter. A count is quantised to a level: the number of thresholds 1, 2, 3, 4, 6, 8, 12, ... that it reaches. A key
enters the filter once for each level up to its own; a lookup probes level after level until one is missing. The level gives
the threshold reached, at most the count and more than two thirds of it.

Size. Every pair of the training texts is stored, whatever its count: `BITS_EACH` bits an entry, so the filter grows with the
corpus. It is made of slices by hash range, each sized by its own entries and built in one group from at most about `SLICE` tokens'
counts. Slices are broadcast together up to `PASS` bytes. A larger filter takes several passes over the texts: each
broadcasts the next slices, adds the levels found there to a column of one byte a key, writes the table and frees its broadcast,
so the memory of driver and workers stays the same at every size.

base = sum over tokens of log10((c + 1) / (N + V + 1)), from exact counts: the `WORDS` most frequent words are broadcast with theirs,
the others meet the table of counts in a join. score = log10 probability of the text under the model

    P(w | h) = MIX * q(h, w) / u(h) + (1 - MIX) * (q(w) + 1) / (N + V + 1),

where q is the threshold a count reaches and u(h) the largest count of h's level; contexts that were not trained give the last factor
alone. Since q never exceeds the count and u never falls below it, the probabilities after any h sum to one at most. False
positives of the filter are the only exception: an unseen pair is taken for one seen once, at a rate of a few in a hundred; a
pair's level is cut to those of its two words.

Edge cases: a null or empty text is one end. A null id counts as an empty one for the split. Repeated rows are documents of
their own, each with its own result row. Without training documents all counts are 0. An empty table gives no rows. Other
columns are not read. Very long texts are counted and scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.session import materialise, release

WORDS = 100_000  # words that are broadcast with their exact counts
SLICE = 1 << 19  # training tokens to a slice of the filter
PASS = 96 << 20  # bytes of the filter that are broadcast at a time
BITS_EACH = 10
PROBES = 4  # bits per entry, all in one word of 64
MIX = 0.7  # weight of the pair's frequency
FLUSH = 300_000  # distinct words or pairs held before they are handed on
TOKENS = 100_000  # tokens scored at a time
THRESHOLDS = np.array([1.0] + [x for k in range(1, 60) for x in (2.0**k, 1.5 * 2.0**k)])
END = "\x20"  # no word holds a space
ORACLE_SQL = None  # the filter is not SQL; base, counts and score are tested against a plain model


def held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: only A-Z change, and only ASCII white space separates


def _count_words(batches):
    counts, ends = Counter(), 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            counts.update(tokens(text.as_py()))
            ends += 1
            if len(counts) > FLUSH:
                yield flush()
                counts.clear()
    if ends:
        counts[END.encode()] += ends
    yield flush()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(before) + words)


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def _places(keys: np.ndarray, level: int, first, words):
    """(word, bits in it) of the keys' entries at a level; `first` and `words` say which words the keys' slice has."""
    inner = _mixed(keys ^ _mixed(_mixed(np.array([level], np.uint64))))
    at = first + (((inner >> np.uint64(32)) * words) >> np.uint64(32))
    mask, one, low = np.zeros(len(keys), np.uint64), np.uint64(1), np.uint64(63)
    for i in range(PROBES):
        mask |= one << ((inner >> np.uint64(6 * i)) & low)
    return at.astype(np.int64), mask


@dataclass
class Filter:
    """Neighbouring slices of the filter; at most PASS bytes, or one slice."""

    slices: int  # of the whole filter
    start: int
    firsts: np.ndarray  # first word of each slice held, and the end
    bits: bytearray  # read back without a copy

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key; 0 for keys of other slices."""
        words, out = np.frombuffer(self.bits, np.uint64), np.zeros(len(keys), np.uint8)
        part = _slice_of(keys, self.slices).astype(np.int64) - self.start
        left, level = np.flatnonzero((part >= 0) & (part < len(self.firsts) - 1)), 1
        keys, part = keys[left], part[left]
        first = self.firsts[part]
        size = self.firsts[part + 1] - first
        while len(left) and level < len(THRESHOLDS):
            at, mask = _places(keys, level, first, size)
            found = np.flatnonzero(words[at] & mask == mask)
            left, keys, first, size = left[found], keys[found], first[found], size[found]
            out[left] = level
            level += 1
        return out


@dataclass
class Model:
    """What scoring needs on a worker besides the filter; bounded by WORDS."""

    words: dict[bytes, int]  # numbered words; the end is one of them unless nothing was trained
    counts: np.ndarray  # by number; the last is that of all others
    total: int  # N
    distinct: int  # V
    filters: DataFrame  # (part, bits)
    sizes: list[int]  # bytes of each slice

    @cached_property
    def hashes(self) -> np.ndarray:
        """Of the numbered words, by number; 0 for all others."""
        return np.fromiter((*map(xxhash.xxh64_intdigest, self.words), 0), np.uint64, len(self.counts))

    @property
    def floor(self) -> int:
        return self.total + self.distinct + 1

    def numbered(self, words: list[bytes]) -> np.ndarray:
        get, other = self.words.get, len(self.counts) - 1
        return np.fromiter((get(w, other) for w in words), np.int64, len(words))

    def base(self, numbers: np.ndarray) -> np.ndarray:
        return np.log10((self.counts[numbers] + 1) / self.floor)

    def passes(self, limit: int = PASS):
        """The filter's slices in order, as many at a time as the limit holds."""
        start = 0
        while start < len(self.sizes):
            end = start + 1
            while end < len(self.sizes) and sum(self.sizes[start : end + 1]) <= limit:
                end += 1
            firsts = np.cumsum([0] + self.sizes[start:end]) // 8
            bits = bytearray(int(firsts[-1]) * 8)
            for row in self.filters.where(F.col("part").between(start, end - 1)).toLocalIterator():
                at = int(firsts[row.part - start]) * 8
                bits[at : at + len(row.bits)] = row.bits
            yield Filter(len(self.sizes), start, firsts.astype(np.uint64), bits), end == len(self.sizes)
            start = end


def probability(pair: np.ndarray, context: np.ndarray, word: np.ndarray, floor: int) -> np.ndarray:
    """P(w | h) from the levels of the pair, h and w."""
    reached = np.concatenate(([0.0], THRESHOLDS))
    alone = (reached[word] + 1) / floor
    share = reached[np.minimum(pair, np.minimum(context, word))] / np.maximum(1, reached[context + 1] - 1)
    return np.where(context > 0, MIX * share + (1 - MIX) * alone, alone)


def _count_pairs(slices: int):
    def run(batches):
        hashes, held, size = Hashes(), [], 0
        end = np.uint64(hashes[END.encode()])

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            part = _slice_of(keys, slices).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array(keys.view(np.int64)), pa.array(counts)], names=["part", "key", "c"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                words = np.append(hashes.of(tokens(text.as_py())), end)
                held.append(pair_keys(np.concatenate(([end], words[:-1])), words))
                size += len(words)
                if size > 10 * FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _word_keys(slices: int):
    """(word, c) in; its key and slice out."""

    def run(batches):
        for batch in batches:
            keys = np.fromiter((xxhash.xxh64_intdigest(w.as_py()) for w in batch.column(0)), np.uint64, batch.num_rows)
            part = _slice_of(keys, slices).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(keys.view(np.int64)), batch.column(1)], names=["part", "key", "c"])

    return run


def _slice(key, table):
    """The counts of a slice's keys in; its bytes out."""
    keys, where = np.unique(table["key"].to_numpy().view(np.uint64), return_inverse=True)
    levels = np.searchsorted(THRESHOLDS, np.bincount(where, table["c"].to_numpy()), side="right")
    flags = np.zeros(max(1, -(-int(levels.sum()) * BITS_EACH // 64)), np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, mask = _places(keys[levels >= level], level, np.uint64(0), np.uint64(len(flags)))
        np.bitwise_or.at(flags, at, mask)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([flags.tobytes()], pa.binary())})


def build_filter(texts: DataFrame, counted: DataFrame, total: int, slice_tokens: int = SLICE) -> tuple[DataFrame, list[int]]:
    """(table of the slices, their sizes in bytes) from a one-column table of texts with so many tokens, and its words' counts."""
    slices, fields = max(1, -(-total // slice_tokens)), "part int, key long, c long"
    keys = texts.mapInArrow(_count_pairs(slices), fields).union(counted.mapInArrow(_word_keys(slices), fields))
    table = materialise(keys.groupBy("part").applyInArrow(_slice, "part int, bits binary"), "filter")
    found = {r.part: r.n for r in table.select("part", F.length("bits").alias("n")).collect()}  # one short row a slice
    return table, [found.get(i, 8) for i in range(slices)]


def train(texts: DataFrame, words: int = WORDS, slice_tokens: int = SLICE) -> tuple[Model, DataFrame]:
    """The model of a one-column table of texts, and the exact counts (word binary, c) of all words."""
    counted = materialise(texts.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counted.orderBy(F.desc("c"), "word").limit(words).collect()
    if total and all(bytes(r.word) != END.encode() for r in frequent):
        frequent += counted.where(F.col("word") == F.lit(END).cast("binary")).collect()  # the end is numbered whatever its rank
    counts = np.array([r.c for r in frequent] + [total - sum(r.c for r in frequent)], np.int64)
    return Model({bytes(r.word): i for i, r in enumerate(frequent)}, counts, total, distinct, *build_filter(texts, counted, total, slice_tokens)), counted


def _chunks(batch):
    """(rows, ids, texts, levels found so far, words of each text) for so many texts at a time as hold TOKENS tokens."""
    texts, at = batch.column(2).cast(pa.binary()), 0
    while at < len(texts):
        start, words, sizes = at, [], []
        while at < len(texts) and len(words) < TOKENS:
            found = tokens(texts[at].as_py())
            words += found
            words.append(END.encode())
            sizes.append(len(found) + 1)
            at += 1
        seen = batch.column(3).slice(start, at - start)
        yield batch.slice(start, at - start), words, np.array(sizes), None if seen.null_count else [np.frombuffer(x.as_py(), np.uint8) for x in seen]


def _look(part: Filter, model, words: list[bytes], sizes: np.ndarray, seen) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the pairs (first row) and the words (second) of all texts, by these slices and those before; the words' numbers.

    Numbered words need no lookup: their levels follow from their counts, and their hashes are kept by number. Words are looked up once each.
    """
    numbers = model.numbered(words)
    own = model.hashes[numbers]
    other = np.flatnonzero(numbers == len(model.counts) - 1)
    own[other] = np.fromiter((xxhash.xxh64_intdigest(words[i]) for i in other), np.uint64, len(other))
    before = np.concatenate((own[:1], own[:-1]))
    before[np.cumsum(sizes) - sizes] = np.uint64(xxhash.xxh64_intdigest(END.encode()))
    levels = np.zeros((2, len(own)), np.uint8)
    levels[0] = part.levels(pair_keys(before, own))
    keys, where = np.unique(own[other], return_inverse=True)
    levels[1, other] = part.levels(keys)[where]
    if seen is not None:
        levels += np.concatenate([x.reshape(2, -1) for x in seen], axis=1)
    known = numbers < len(model.counts) - 1
    levels[1, known] = np.searchsorted(THRESHOLDS, model.counts, side="right")[numbers[known]]
    return levels, numbers


def _model(shared) -> Model:
    return Model(*shared.value, None, [])


def _probe(shared, part):
    """(row, doc_id, text, levels) in and out, with the levels of this pass's slices added."""

    def run(batches):
        model = _model(shared)
        for batch in batches:
            for rows, words, sizes, seen in _chunks(batch):
                levels, _ = _look(part.value, model, words, sizes, seen)
                each = [x.tobytes() for x in np.split(levels, np.cumsum(sizes)[:-1], axis=1)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(each, pa.binary())], names=["row", "doc_id", "text", "levels"])

    return run


ROWS = "row long, doc_id {}, word binary, times long, n_tokens long, n_known long, base double, score double"


def _score(shared, last):
    """(row, doc_id, text, levels) in; per text one row with its score and what the numbered words give, and one per distinct other word with its frequency."""

    def run(batches):
        model = _model(shared)
        other, end_known = len(model.counts) - 1, model.total > 0
        for batch in batches:
            for rows, words, sizes, seen in _chunks(batch):
                starts = np.cumsum(sizes) - sizes
                levels, numbers = _look(last.value, model, words, sizes, seen)
                levels = levels.astype(np.int64)
                context = np.concatenate((levels[1][:1], levels[1][:-1]))
                context[starts] = levels[1][starts + sizes - 1]  # the end's own level
                score = np.log10(probability(levels[0], context, levels[1], model.floor))
                rare = numbers == other
                if not end_known:
                    rare[np.cumsum(sizes) - 1] = False  # nothing was trained: the end has count 0
                base = np.where(rare, 0.0, model.base(numbers) if end_known else math.log10(1 / model.floor))
                known = (~rare) & end_known
                sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, score)]
                numbered = rows.column(0).to_pylist()
                main = [(r, d, b"\x20%d" % r, 1, int(n), int(k), float(b), float(s)) for r, d, n, k, b, s in zip(numbered, rows.column(1).to_pylist(), sizes, *sums, strict=True)]
                place = np.searchsorted(starts, np.flatnonzero(rare), side="right") - 1
                repeats = Counter((numbered[p], words[i]) for p, i in zip(place.tolist(), np.flatnonzero(rare).tolist(), strict=True))
                main += [(r, None, w, n, 0, 0, 0.0, 0.0) for (r, w), n in repeats.items()]
                kinds = (pa.int64(), batch.column(1).type, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                columns = [pa.array(c, k) for c, k in zip(zip(*main, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])

    return run


def score(docs: DataFrame, model: Model, counted: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = PASS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model.words, model.counts, model.total, model.distinct))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast("binary").alias("levels")
    )
    kind, written = docs.select(id_col).schema[0].dataType.simpleString(), None
    for part, last in model.passes(limit):
        sent = context.broadcast(part)
        if last:
            break
        before, written = written, materialise(rows.mapInArrow(_probe(shared, sent), rows.schema), "levels")
        sent.unpersist()
        if before is not None:
            release(before)
        rows = written
    parts = rows.mapInArrow(_score(shared, sent), ROWS.format(kind))
    met = parts.join(counted, "word", "left")
    rare = F.substring("word", 1, 1) != F.lit(END).cast("binary")
    log = F.when(rare, F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(model.floor))).otherwise(0.0)
    summed = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(rare & (F.coalesce("c", F.lit(0)) > 0), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + log).alias("base_score"),
        F.sum("score").alias("score"),
    )
    return summed.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, counted = train(docs.where(~held_out(F.col("doc_id"))).select(F.coalesce("text", F.lit("")).alias("text")))
    return score(docs, model, counted)
