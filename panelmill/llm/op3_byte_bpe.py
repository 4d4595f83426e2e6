"""Byte-level BPE by monoid tree reduction.

A piece (one match of the splitting pattern) is encoded by halves: both halves are encoded on their own, down to leaves of a
few bytes, and neighbours are joined by re-encoding a window around the boundary that doubles until nothing outside can
change. The proof used: a token sequence is the encoding of its bytes exactly when every pair of neighbours is the encoding
of the pair's bytes. Until the first merge across a boundary each side changes as it would alone, so a merge that crosses
in the whole would cross in the pair. The window is stable when the pairs at its two ends pass that test.
Decoding looks tokens up in leaves and concatenates the leaves pairwise up the tree.

Edge cases: a null or empty text has no tokens and decodes to no bytes; null ids decode like an empty list. Rows are
independent, so repeated rows, ties and empty tables need no rule. Very long texts are cut before white space, where the
pattern never matches across. An id outside the vocabulary raises KeyError.
"""

from __future__ import annotations

import base64
from array import array
from itertools import chain, islice, repeat
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = np.iinfo(np.int32).max  # rank of a pair that does not merge; also the id of a place without a token
LEAF = 16  # bytes encoded without halving
BLOCK = 1 << 14  # leaves encoded side by side
SEGMENT = 1 << 19  # characters after which a long text is cut at the next white space, and of a group of texts
PIECES = 60_000  # entries of a generation of what a worker remembers; only saves time
KNOWN = 48  # longest piece remembered
ORACLE_SQL = None  # merges are iterative; tested against tiktoken and by round trip


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file; on the driver, which broadcasts them (one entry per token of a fixed vocabulary)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairRanks:
    """Rank of the token that two neighbouring tokens make, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        made = [
            (ranks[token[:at]] << 32 | ranks[token[at:]], rank)
            for token, rank in ranks.items()
            for at in range(1, len(token))
            if token[:at] in ranks and token[at:] in ranks
        ]
        keys, values = np.array(sorted(made), np.int64).reshape(-1, 2).T
        self.keys, self.values = np.append(keys, np.iinfo(np.int64).max), np.append(values, NONE).astype(np.int32)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], NONE)


class TreeEncoder:
    """Encodes pieces of bytes; `table` maps ids to bytes. The leaves of many pieces are encoded side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.rank = PairRanks(ranks)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = self.rank(self.bytes[:, None], self.bytes)

    def leaves(self, data: list[bytes]) -> list[bytes]:
        """Ids of strings of at most LEAF bytes: in each round every string merges its lowest rank, leftmost on ties."""
        sizes = np.fromiter(map(len, data), np.int64, len(data))[:, None]
        chars = np.frombuffer(b"".join(d.ljust(LEAF, b"\0") for d in data), np.uint8).reshape(-1, LEAF)
        place = np.arange(LEAF)
        coded = np.where(place < sizes, self.bytes[chars], NONE)
        scores = np.where(place[1:] < sizes, self.byte_pairs[chars[:, :-1], chars[:, 1:]], NONE)
        rows, ids = np.arange(len(data)), coded.copy()
        while True:
            at = scores.argmin(1)
            best = scores[np.arange(len(rows)), at]
            if not (live := best != NONE).all():
                coded[rows[~live]] = ids[~live]
                rows, ids, scores, at, best = (x[live] for x in (rows, ids, scores, at, best))
            if not len(rows):
                break
            lane, moved = np.arange(len(rows)), place[:-1] > at[:, None]
            ids[lane, at] = best
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            scores[:, :-1] = np.where(moved[:, :-1], scores[:, 1:], scores[:, :-1])
            ids[:, -1] = scores[:, -1] = NONE
            scores[lane, at] = self.rank(best, ids[lane, at + 1])
            lane, at, best = lane[at > 0], at[at > 0], best[at > 0]
            scores[lane, at - 1] = self.rank(ids[lane, at - 1], best)
        kept = coded != NONE
        ends, told = (kept.sum(1).cumsum() * 4).tolist(), coded[kept].tobytes()
        return [told[start:end] for start, end in zip([0, *ends], ends)]

    def window(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties."""
        rank, none = self.ranks.get, NONE
        if len(data) <= 2 * LEAF:  # scoring every pair anew is faster for a few bytes
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                pairs = list(map(add, parts, islice(parts, 1, None)))
                scores = list(map(rank, pairs, repeat(none)))
                best = min(scores)
                if best == none:
                    break
                at = scores.index(best)
                parts[at : at + 2] = (pairs[at],)
            return list(map(self.ranks.__getitem__, parts))
        parts = [data[i : i + 1] for i in range(len(data))]
        scores = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while scores and (best := min(scores)) != none:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = rank(parts[at] + parts[at + 1], none)
            if at:
                scores[at - 1] = rank(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """The pair is its own encoding, so no merge crosses between the two anywhere."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PIECES:
                self.pairs.clear()
            known = self.pairs[left, right] = self.window(self.table[left] + self.table[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            middle = self.window(b"".join(map(self.table.__getitem__, left[-i:] + right[:j])))
            left_ok = i == len(left) or self.fits(left[-i - 1], middle[0])
            right_ok = j == len(right) or self.fits(middle[-1], right[j])
            if left_ok and right_ok:
                return left[:-i] + middle + right[j:]
            i, j = i * (1 if left_ok else 2), j * (1 if right_ok else 2)

    def cut(self, piece: bytes) -> list[bytes]:
        """Leaves of a piece."""
        if len(piece) <= LEAF:
            return [piece]
        middle = len(piece) // 2
        return self.cut(piece[:middle]) + self.cut(piece[middle:])

    def reduce(self, piece: bytes, coded: dict[bytes, bytes]) -> list[int]:
        if len(piece) <= LEAF:
            return array("i", coded[piece]).tolist()
        middle = len(piece) // 2
        return self.join(self.reduce(piece[:middle], coded), self.reduce(piece[middle:], coded))

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece, as bytes of 32-bit integers."""
        told = {p: array("i", [self.ranks[p]]).tobytes() for p in pieces if p in self.ranks}
        open_ = [p for p in pieces if p not in told]
        needed = list(dict.fromkeys(chain.from_iterable(map(self.cut, open_))))
        blocks = (self.leaves(needed[at : at + BLOCK]) for at in range(0, len(needed), BLOCK))
        coded = dict(zip(needed, chain.from_iterable(blocks)))
        for p in open_:
            told[p] = coded[p] if len(p) <= LEAF else array("i", self.reduce(p, coded)).tobytes()
        return [told[p] for p in pieces]

    def encode(self, piece: bytes) -> list[int]:
        return array("i", self.encode_all([piece])[0]).tolist()

    def decode(self, ids) -> bytes:
        level = [b"".join(map(self.table.__getitem__, ids[at : at + 4096])) for at in range(0, len(ids), 4096)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[at : at + 2]) for at in range(0, len(level), 2)]
        return level[0]


def segments(text: str, cut=regex.compile(r"\S(?=\s)")):
    """Parts of a text between which no match of the pattern goes on."""
    at = 0
    while len(text) - at > SEGMENT and (found := cut.search(text, at + SEGMENT)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


class TextEncoder:
    """Splits texts by the pattern and encodes the matches of a group of texts together. Short pieces are remembered in two
    generations: what is used moves to the young one, the old one is forgotten when that is full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tree, self.split = TreeEncoder(ranks), regex.compile(pattern).findall
        self.young, self.old = {}, {}

    def learn(self, pieces: set[str]) -> None:
        """All of the pieces are in the young generation afterwards."""
        if len(self.young) >= PIECES:
            self.young, self.old = {}, self.young
        new = pieces.difference(self.young)
        self.young.update((piece, self.old[piece]) for piece in new if piece in self.old)
        fresh = [piece for piece in new if piece not in self.old]
        self.young.update(zip(fresh, self.tree.encode_all([piece.encode() for piece in fresh])))

    def encode_all(self, texts) -> tuple[bytearray, list[int]]:
        """The ids of all texts, one after the other, as bytes of 32-bit integers, and how many there are at the end of each."""
        values, ends, waiting, size = bytearray(), [0], [], 0

        def finish():
            pieces = set(chain.from_iterable(part for part in waiting if part is not None))
            self.learn(pieces)
            for part in waiting:
                if part is None:
                    ends.append(len(values) // 4)
                else:
                    values.extend(b"".join(map(self.young.__getitem__, part)))
            for piece in pieces:
                if len(piece) > KNOWN:
                    del self.young[piece]
            waiting.clear()

        for text in texts:
            for part in segments(text):
                waiting.append(self.split(part))
                size += len(part)
                if size >= SEGMENT:
                    finish()
                    size = 0
            waiting.append(None)  # the text ends here
        finish()
        return values, ends

    def encode(self, text: str) -> bytes:
        return bytes(self.encode_all([text])[0])


_ENCODERS: dict[int, TextEncoder] = {}  # one per broadcast and worker


def _encoder(shared, pattern: str) -> TextEncoder:
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = TextEncoder(shared.value, pattern)
    return _ENCODERS[shared.id]


class _Shared:
    """A broadcast with a stable id on driver and workers."""

    def __init__(self, broadcast, ident: int):
        self.broadcast, self.id = broadcast, ident

    @property
    def value(self):
        return self.broadcast.value


def _shared_ranks(spark: SparkSession, path: str) -> _Shared:
    broadcast = spark.sparkContext.broadcast(read_ranks(path))
    return _Shared(broadcast, broadcast._jbroadcast.id())


def _id_lists(encoder: TextEncoder, texts: pa.Array) -> pa.ListArray:
    values, ends = encoder.encode_all(text.as_py() or "" for text in texts)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32)))


def _decoded(encoder: TextEncoder, ids: pa.Array) -> pa.Array:
    decode = encoder.tree.decode
    return pa.array((decode(row.values.to_numpy().tolist()) if row.is_valid else b"" for row in ids), pa.binary())


def codec(spark: SparkSession, path: str, pattern: str):
    """(encode, decode): functions of columns; texts to array<int>, array<int> to binary."""
    shared = _shared_ranks(spark, path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _id_lists(_encoder(shared, pattern), texts)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return _decoded(_encoder(shared, pattern), ids)

    once = encode.asNondeterministic()  # else a plan that reads the ids twice would encode twice

    def text_ids(column: Column) -> Column:
        return once(F.coalesce(column, F.lit("")))

    return text_ids, decode


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) per row; one Python worker a task encodes and decodes its ids."""
    shared = _shared_ranks(docs.sparkSession, path)

    @F.arrow_udf("ids array<int>, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        encoder = _encoder(shared, pattern)
        ids = _id_lists(encoder, texts)
        return pa.StructArray.from_arrays([ids, _decoded(encoder, ids)], ["ids", "decoded"])

    coded = both.asNondeterministic()(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), coded.alias("coded"))
    return rows.select("doc_id", "coded.ids", "coded.decoded")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_vocabulary()))
