"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source form one stream: its documents laid end to end in an order that depends on their content only. The stream is
cut into blocks of `BLOCK` words. A source with W words and target t takes t div W whole passes over its blocks and, of one
more pass, the first blocks of a keyed random permutation until t words are reached; the last block may be taken in part. So
every source takes its target to the word, and nobody's word is taken more often than the target over the size, rounded up.

The draws of all sources are dealt to output shards: a tree halves the shards; at each node the left half's number of draws is fixed by
its number of shards, and how many of them come from which source is a multivariate-hypergeometric draw from the node's quotas. So each
shard is a random sample without replacement of all draws, and the quotas are exact at every node. A source's draws are
numbered in permuted order and each shard takes a range of them; inside a shard a second permutation gives the places. Both
permutations are Feistel networks that any task computes for the numbers it holds: nothing is sorted or gathered to shuffle.

What moves: one narrow row per distinct (id, source, size, hash of the text), dealt by hash for running sums of sizes in two levels.
Rows that are equal in these are counted before the shuffle and written out again in pieces afterwards. The table of quotas has
sources x shards numbers, at most `CELLS` (32 MB): more sources make fewer, larger shards. Sources are those for which weights are
given, at most `SOURCES`; more end with an error.

Edge cases: a null text has size 0; a document of size 0 takes nothing. Sources are ordered by code point, null last; a null source
is a source. Targets stop at 2 times their source's size. Ids may be null or repeat; equal rows are told apart by their number only. An
empty table gives no rows. Other columns are not read. Reruns give the same rows however the input is partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5  # words taken over words there are
PASSES = 2  # times that a source's size can be taken
BLOCK = 128  # words
SHARD = 1 << 22  # words that a shard aims at
CELLS = 1 << 22  # bound of sources x shards
SOURCES = 100_000
COPIES = 4_096  # equal rows that are written out at a time
ROWS = 2_000  # rows of a bucket of running sums, on average
GROUP = 1_024  # buckets of a group
SEED = 20_240_611
ORACLE_SQL = None  # a random draw; tested against targets, a plain draw and exact quotas

PIECES = "array<struct<shard:int,place:bigint,draw:bigint,pass:int,first:bigint,words:bigint>>"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, passes: int = PASSES) -> list[float]:
    """Shares of `share` times all sizes by weight; none above `passes` times its size, what is above is shared again."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_ and rest > 0:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * rest >= passes * sizes[i] * whole]
        if not full:
            for i in open_:
                out[i] = weights[i] * rest / whole
            break
        for i in full:
            out[i] = float(passes * sizes[i])
        rest -= sum(passes * sizes[i] for i in full)
        open_ -= set(full)
    return out


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """The places of the numbers `at` (below n) in a keyed permutation of 0 ... n - 1."""
    if n < 2:
        return np.zeros(len(at), np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    rounds = [np.uint64(_key(key, r) | 1) for r in range(6)]

    def once(x):
        left, right = x >> shift, x & mask
        for k in rounds:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * k
            left, right = right, left ^ ((mixed >> np.uint64(29)) & mask)
        return left << shift | right

    x = once(at.astype(np.uint64))
    out = np.flatnonzero(x >= n)
    while len(out):  # walk on until inside; on average fewer than four steps
        x[out] = once(x[out])
        out = out[x[out] >= n]
    return x.astype(np.int64)


def hypergeometric(good: int, bad: int, taken: int, rng: np.random.Generator) -> int:
    """How many of `taken` draws without replacement are good: one uniform number against the sums of all probabilities that
    are not negligible (12 standard deviations around the mode), which any population allows."""
    total = good + bad
    low, high = max(0, taken - bad), min(good, taken)
    if low == high:
        return low
    mode = (taken + 1) * (good + 1) // (total + 2)
    spread = 12 * (taken * (good / total) * (bad / total) * ((total - taken) / max(1, total - 1))) ** 0.5 + 30
    a, b = max(low, int(mode - spread)), min(high, int(mode + spread))
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(taken - k) - np.log(k + 1) - np.log(bad - taken + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    sums = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(sums, rng.random() * sums[-1], side="right").clip(0, b - a))


def split(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) draws of each source in each shard: a tree of multivariate-hypergeometric draws. Sums by source are the
    quotas, sums by shard differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    whole = sum(quotas)
    bound = [whole * i // shards for i in range(shards + 1)]
    nodes = [(0, shards, list(quotas))]
    while nodes:
        first, last, have = nodes.pop()
        if last - first == 1:
            out[first] = have
            continue
        middle = (first + last) // 2
        rng = np.random.default_rng([seed, first, last])
        taken, rest, left = bound[middle] - bound[first], sum(have), []
        for quota in have:
            left.append(hypergeometric(quota, rest - quota, taken, rng))
            rest -= quota
            taken -= left[-1]
        nodes.append((first, middle, left))
        nodes.append((middle, last, [q - x for q, x in zip(have, left, strict=True)]))
    return out


class Plan:
    """What is drawn of each source, and which draws go to which shard."""

    def __init__(self, names: list[str | None], sizes: list[int], weights: list[float], share: float, passes: int, block: int, shard: int, seed: int):
        self.names, self.sizes, self.block, self.seed = names, sizes, block, seed
        self.targets = targets(sizes, weights, share, passes)
        self.blocks = [-(-w // block) for w in sizes]
        self.whole, self.partial, self.rest = [], [], []  # whole passes; blocks and then words of the last pass
        quotas = []
        for s, (w, t) in enumerate(zip(sizes, self.targets, strict=True)):
            want = min(round(t), passes * w)
            whole, left = divmod(want, w) if w else (0, 0)
            n, short = self.blocks[s], (w - 1) % block + 1  # words of the last block
            place = int(permuted(np.array([n - 1]), n, _key(seed, s, whole))[0]) if n else 0
            if left >= place * block + short:
                left += block - short  # the short block is among those taken whole: count it as full
                partial, rest = divmod(left, block)
            elif left >= place * block:
                partial, rest = place, left - place * block
            else:
                partial, rest = divmod(left, block)
            self.whole.append(whole)
            self.partial.append(partial)
            self.rest.append(rest)
            quotas.append(whole * n + partial + (rest > 0))
        shards = max(1, min(-(-sum(quotas) * block // shard), CELLS // max(1, len(names))))
        self.table = split(quotas, shards, seed) if names else np.zeros((1, 0), np.int64)
        self.starts = np.concatenate((np.zeros((1, len(names)), np.int64), np.cumsum(self.table, axis=0)))  # first draw of a source in a shard
        self.before = np.cumsum(self.table, axis=1) - self.table  # draws of earlier sources in a shard
        self.held = self.table.sum(axis=1)

    def places(self, s: int, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, place in it) of the draws of source s."""
        shard = np.searchsorted(self.starts[:, s], draws, side="right") - 1
        at = self.before[shard, s] + draws - self.starts[shard, s]
        place = np.empty(len(draws), np.int64)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(part):
                k = int(shard[part[0]])
                place[part] = permuted(at[part], int(self.held[k]), _key(self.seed, "shard", k))
        return shard, place

    def pieces(self, s: int, offsets: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """(row, shard, place, draw, pass, first word, words) of all pieces of documents of source s, which lie at `offsets` of its stream."""
        n, block = self.blocks[s], self.block
        rows = np.flatnonzero(sizes > 0)
        lows, highs = offsets[rows] // block, (offsets[rows] + sizes[rows] - 1) // block
        counts = highs - lows + 1
        row = np.repeat(rows, counts)
        number = np.repeat(lows, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = np.maximum(offsets[row], number * block)  # in the stream
        until = np.minimum(offsets[row] + sizes[row], (number + 1) * block)
        found = []
        for turn in range(self.whole[s] + (self.partial[s] > 0 or self.rest[s] > 0)):
            place = permuted(number, n, _key(self.seed, s, turn))
            end = until
            if turn == self.whole[s]:
                end = np.where(place < self.partial[s], until, np.where(place == self.partial[s], np.minimum(until, number * block + self.rest[s]), begin))
            keep = end > begin
            draw = turn * n + place[keep]
            shard, at = self.places(s, draw)
            r = row[keep]
            found.append(np.stack((r, shard, at, draw, np.full(len(r), turn), begin[keep] - offsets[r], end[keep] - begin[keep])))
        return found


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, th, copies): distinct documents with their number of words and the number of equal rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("th"))
    return rows.groupBy("doc_id", "source", "size", "th").agg(F.count("*").alias("copies"))


def _running(sized: DataFrame, rows: int, per_bucket: int) -> DataFrame:
    """`sized` with `offset`: the words of the documents before it in its source's stream, whose order is that of hashes."""
    buckets = 1 + rows // per_bucket
    mark = F.xxhash64("doc_id", "source", "size", "th")
    cells = sized.withColumns({"mark": mark, "bucket": F.pmod(mark, F.lit(buckets)), "words": F.col("size") * F.col("copies")})
    sums = cells.groupBy("source", "bucket").agg(F.sum("words").alias("words")).withColumn("part", F.expr(f"bucket div {GROUP}"))
    parts = sums.groupBy("source", "part").agg(F.sum("words").alias("words"))
    so_far = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), so_far(Window.partitionBy("source").orderBy("part")).alias("base"))
    sums = sums.withColumn("inner", so_far(Window.partitionBy("source", "part").orderBy("bucket"))).join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("base") + F.col("inner")).alias("base"))
    inside = so_far(Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size", "th"))
    placed = cells.withColumn("inner", inside).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return placed.select("doc_id", "source", "size", "th", "copies", (F.col("base") + F.col("inner")).alias("offset"))


def _written_out(placed: DataFrame, copies: int) -> DataFrame:
    """One row per row of the input: equal rows lie behind each other in the stream."""
    few, many = placed.where(F.col("copies") <= copies), placed.where(F.col("copies") > copies)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {copies}"))).alias("chunk")
    many = many.select("doc_id", "source", "size", "th", "copies", "offset", chunk).repartition("doc_id", "chunk")
    many = many.select("doc_id", "source", "size", "th", F.least(F.lit(copies), F.col("copies") - F.col("chunk") * copies).alias("copies"), (F.col("offset") + F.col("chunk") * copies * F.col("size")).alias("offset"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    rows = few.unionByName(many).select("doc_id", "source", "size", "th", "offset", each)
    return rows.select("doc_id", "source", "size", "th", (F.col("offset") + F.col("copy") * F.col("size")).alias("offset"))


def _drawn(plan: Plan, schema: str):
    """(doc_id, source, size, th, offset) in; with source_size, target and pieces out."""
    number = {name: s for s, name in enumerate(plan.names)}
    kinds = [("shard", pa.int32()), ("place", pa.int64()), ("draw", pa.int64()), ("pass", pa.int32()), ("first", pa.int64()), ("words", pa.int64())]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            source = np.array([number[x] for x in batch.column(1).to_pylist()])
            sizes, offsets = (batch.column(i).to_numpy() for i in (2, 4))
            found = [np.empty((7, 0), np.int64)]
            for s in np.unique(source):
                own = np.flatnonzero(source == s)
                for cells in plan.pieces(int(s), offsets[own], sizes[own]):
                    cells[0] = own[cells[0]]
                    found.append(cells)
            cells = np.concatenate(found, axis=1)
            cells = cells[:, np.lexsort((cells[5], cells[4], cells[0]))]
            ends = np.searchsorted(cells[0], np.arange(batch.num_rows + 1)).astype(np.int32)
            fields = [pa.array(cells[i + 1]).cast(kind) for i, (_, kind) in enumerate(kinds)]
            pieces = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=[n for n, _ in kinds]))
            own = [pa.array([plan.sizes[s] for s in source], pa.int64()), pa.array([plan.targets[s] for s in source], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own, pieces], names=[*batch.schema.names, "source_size", "target", "pieces"])

    return run


def by_rank(weights: tuple[float, ...] = WEIGHTS) -> Callable[[list[str | None]], list[float]]:
    """Weights that repeat over the ordered sources."""
    return lambda names: [weights[i % len(weights)] for i in range(len(names))]


def mix(
    docs: DataFrame, weights: Callable[[list[str | None]], list[float]] | None = None, share: float = SHARE, passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block: int = BLOCK, shard: int = SHARD, seed: int = SEED, rows: int = ROWS, copies: int = COPIES,
) -> DataFrame:
    """(doc_id, source, size, th, offset, source_size, target, pieces) per row of `docs`: which of its words go to which place of which
    shard. `weights` gives a weight above 0 for each of the ordered sources."""
    sized = materialise(_sized(docs, id_col, text_col, source_col), "sized")
    found = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count("*").alias("rows")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be", "surrogatepass")))
    names = [r.source for r in found]
    plan = Plan(names, [r.words for r in found], (weights or by_rank())(names), share, passes, block, shard, seed)
    placed = _written_out(_running(sized, sum(r.rows for r in found), rows), copies)
    kind = sized.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, size long, th long, offset long, source_size long, target double, pieces {PIECES}"
    return placed.mapInArrow(_drawn(plan, schema), schema)


def shards(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(shard, place, source, doc_ids, text): the mix itself, one row per drawn block, each shard in one partition in the order of its places.
    A block's text is its words joined by one space. Rows that are equal in id, source and text share their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("s"), F.xxhash64(text).alias("h"), text.alias("text"))
    texts = texts.dropDuplicates(["i", "s", "h"])
    rows = mixed.where(F.size("pieces") > 0).join(texts, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("th") == F.col("h")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = rows.withColumn("w", words).select("doc_id", "source", "offset", "w", F.explode("pieces").alias("x"))
    part = F.struct((F.col("offset") + F.col("x.first")).alias("at"), "doc_id", F.concat_ws(" ", F.slice("w", (F.col("x.first") + 1).cast("int"), F.col("x.words").cast("int"))).alias("text"))
    blocks = cut.groupBy("x.shard", "x.place", "source").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    laid = blocks.select("shard", "place", "source", F.col("parts.doc_id").alias("doc_ids"), F.concat_ws(" ", F.col("parts.text")).alias("text"))
    return laid.repartition("shard").sortWithinPartitions("shard", "place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
