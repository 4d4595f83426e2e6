"""Exact top-k inner-product search on an impact-ordered index, score at a time.

Vectors are made of integers, floor(256 x). The rows are dealt into shards of about `VALUES` components. A shard's index has one
posting segment for every dimension and binary digit: the vectors whose component, counted from the dimension's lowest, has that
digit set. Each of a segment's vectors gains the same, digit times query component; it is quantised to half powers of two, the segment's
impact. Segments are processed by descending impact, level by level, for a block of queries side by side (a level's
gains times its segments, as one matrix product). A vector's sum so far plus all positive gains that are still open bounds its
score from above; the k-th best of exactly rescored leaders bounds the answer from below. A query stops only when few
vectors can still reach that value, whatever the rest holds; all that can are rescored exactly. Ties go to the smaller id.

The queries (a stated set) meet every shard, in blocks: each (block, shard) is one task-sized piece of work, and each query
keeps k rows per shard, so what is merged is small. One shard goes first; its k-th best scores are handed to the others as
lower bounds. Nothing is broadcast.

Edge cases: vectors that are null, hold null or non-finite components (also after the multiplication), or have no id take no part.
Missing components of shorter vectors count as 0. Every row is a candidate for every row but itself, rows that share an id
too; each row that asks has its own result. Components too large for exact sums of doubles are scored as Python integers; a score
outside the range of long is reported as its nearest end, ranked by its exact value. Fewer than k candidates give fewer
rows; none give none. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.session import materialise

K = 5
VALUES = 1 << 20  # components in one index
BLOCK = 4096  # queries taken to a shard at a time
ASKED = 64  # queries processed side by side
FIRST = 0.4  # part of the segments, by descending impact, that is processed before the first try to stop
FEW = 16  # a query stops when one vector in so many may still be a member
SCALE = 256
LONG = (1 << 63) - 1
FOUND = "asker long, query_id long, vec_id long, score long, beyond string"


class ImpactIndex:
    """Segments of a shard by dimension and binary digit. `read` and `held` count the segments processed and there, over all queries."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.read, self.held = vectors, 0, 0
        self.low = vectors.min(0)
        above = (vectors - self.low).T.astype(np.int64)
        self.digits = np.arange(max(1, int(above.max()).bit_length()))
        # Row (digit, dimension): the vectors whose component, counted from the dimension's lowest, has that digit set.
        self.segments = ((above[None] >> self.digits[:, None, None]) & 1).astype(np.float32).reshape(-1, len(vectors))

    def top(self, queries: np.ndarray, own: list[np.ndarray], k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (rows, scores) of every vector that may be among the k best (`own` rows left out) and reach its floor, scored exactly."""
        m, n = len(queries), len(self.vectors)
        gain = (queries[:, None, :] * 2.0 ** self.digits[:, None]).reshape(m, -1)
        halves = np.floor(2 * np.log2(np.abs(queries), where=queries != 0, out=np.full(queries.shape, -1e9))).astype(np.int64)
        level = halves[:, None, :] + 2 * self.digits[:, None]
        level = level.reshape(m, -1)
        most = (np.abs(queries) @ (2.0 ** len(self.digits) + np.abs(self.low))).max()
        kind = np.float32 if most < 1 << 24 else np.float64  # sums are exact integers in either
        segments = self.segments.astype(kind, copy=False)
        state = np.repeat((queries @ self.low).astype(kind)[:, None], n, 1)
        found, floors, active = [None] * m, floors.copy(), np.arange(m)
        at = int(FIRST * level.shape[1])
        cut, done = -np.partition(-level, at, axis=1)[:, at], np.full(m, 1 << 60)
        while len(active):
            now = (level[active] >= cut[active, None]) & (level[active] < done[active, None])
            state[active] += np.where(now, gain[active], 0).astype(kind) @ segments
            open_gain = np.where(level[active] < cut[active, None], np.maximum(gain[active], 0), 0).sum(1)
            going = []
            for j, rest in zip(active.tolist(), open_gain.tolist(), strict=True):
                bound = state[j].astype(np.float64) + rest
                bound[own[j]] = -np.inf
                lead = np.argpartition(bound, n - 4 * k)[n - 4 * k :] if n > 4 * k else np.arange(n)
                exact = np.sort(self.vectors[lead[bound[lead] > -np.inf]] @ queries[j])[::-1]
                if len(exact) >= k:
                    floors[j] = max(floors[j], exact[k - 1])
                members = np.flatnonzero((bound >= floors[j]) & (bound > -np.inf))
                if rest and len(members) > max(n // FEW, 4 * k):
                    going.append(j)
                    continue
                found[j] = members, self.vectors[members] @ queries[j]
                self.read += int(np.count_nonzero(level[j] >= cut[j]))
                self.held += level.shape[1]
            active = np.array(going, np.int64)
            done[active] = cut[active]
            cut[active] -= 1
        return found


def integers(vector: Column) -> Column:
    """floor(256 x) of every component, as double; null where the vector takes no part. From 2**53 on a double has no fraction."""
    scaled = F.transform(vector, lambda x: x.cast("double") * SCALE)
    fits = F.forall(scaled, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.when(fits, F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)))


def _matrix(vectors: pa.ChunkedArray, wide: int) -> np.ndarray:
    sizes = pc.list_value_length(vectors).to_numpy()
    ends = np.cumsum(sizes)
    out, flat = np.zeros((len(vectors), wide)), pc.list_flatten(vectors).to_numpy()
    out[np.repeat(np.arange(len(vectors)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


def _exact(rows: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in rows], object).reshape(rows.shape)


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        some, asks = (table.filter(pc.equal(table["asks"], flag)) for flag in (False, True))
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        if not (some.num_rows and asks.num_rows):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        wide = max(1, pc.max(pc.list_value_length(table["v"])).as_py())
        vectors, queries = _matrix(some["v"], wide), _matrix(asks["v"], wide)
        limit = min(2.0**20, np.sqrt(2.0**50 / wide))  # within it, sums of doubles are exact and digits are few
        plain = np.abs(vectors).max(1) <= limit
        small, large = np.flatnonzero(plain), np.flatnonzero(~plain)
        index = ImpactIndex(vectors[small]) if len(small) else None
        big, rest = _exact(vectors[large]), None
        ids, numbers = some["vec_id"].to_numpy(), some["row"].to_numpy()
        floors = asks["floor"].to_numpy()
        out = [[] for _ in names]
        mine = {number: at for at, number in enumerate(numbers[small].tolist())}
        fits = np.abs(queries).max(1) <= limit
        easy = np.flatnonzero(fits) if index is not None else np.empty(0, np.int64)
        askers, met = asks["row"].to_pylist(), {}
        for start in range(0, len(easy), ASKED):
            part = easy[start : start + ASKED]
            own = [np.array([mine[askers[j]]] if askers[j] in mine else [], np.int64) for j in part]
            met.update(zip(part.tolist(), index.top(queries[part], own, k, floors[part]), strict=True))
        for at, (asker, ident) in enumerate(zip(askers, asks["vec_id"].to_pylist(), strict=True)):
            query, found = queries[at], []
            if at in met:
                rows, scores = met.pop(at)
                keep = np.lexsort((ids[small[rows]], -scores))[:k]
                found += [(-int(s), i) for s, i in zip(scores[keep], ids[small[rows[keep]]].tolist(), strict=True)]
            elif len(small):
                rest = _exact(vectors[small]) if rest is None else rest
                found += [(-s, i) for s, i, r in zip(rest @ _exact(query[None])[0], ids[small].tolist(), numbers[small], strict=True) if r != asker]
            if len(large):
                found += [(-s, i) for s, i, r in zip(big @ _exact(query[None])[0], ids[large].tolist(), numbers[large], strict=True) if r != asker]
            for loss, i in sorted(found)[:k]:
                score = max(-LONG - 1, min(LONG, -loss))
                beyond = "" if abs(score) < LONG else f"{10**700 - loss:0701d}"  # its order as text is that of the scores
                for column, value in zip(out, (asker, ident, i, score, beyond), strict=True):
                    column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return run


def search(vectors: DataFrame, asks: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", values: int = VALUES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where `asks` (of the id, as column vec_id) holds, its k best other rows."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vec_col)).alias("v"))
    rows = materialise(rows.where("vec_id IS NOT NULL AND v IS NOT NULL"), "vectors")
    n, q, wide = rows.agg(F.count("*"), F.count(F.when(asks, 1)), F.max(F.size("v"))).first()
    shards, blocks = max(1, -(-n * max(1, wide or 1) // values)), max(1, -(-q // block))
    place = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    every = lambda start, end: F.explode(F.sequence(F.lit(start), F.lit(end - 1)))
    index = rows.select(place(shards).alias("shard"), every(0, blocks).alias("block"), F.lit(False).alias("asks"), "row", "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    queries = rows.where(asks).withColumn("floor", F.lit(float("-inf")))

    def meet(start: int, end: int, queries: DataFrame) -> DataFrame:
        sent = queries.select(every(start, end).alias("shard"), place(blocks).alias("block"), F.lit(True).alias("asks"), "row", "vec_id", "v", "floor")
        held = index.where(F.col("shard").between(start, end - 1))
        return held.unionByName(sent).groupBy("shard", "block").applyInArrow(_search(k), FOUND)

    found = meet(0, 1, queries)
    if shards > 1:
        found = materialise(found, "first")
        reached = found.groupBy("asker").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        # A double may round a long up by a part in 2**52: the bound is lowered by more than that.
        lowered = F.col("least").cast("double") - F.abs(F.col("least").cast("double")) * 2.0**-50 - 1
        floor = reached.where(F.col("n") == k).select(F.col("asker").alias("row"), lowered.alias("floor"))
        told = rows.where(asks).join(floor, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = found.unionByName(meet(1, shards, told))
    best = Window.partitionBy("asker").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}"""
