"""Near-duplicate texts by exact Jaccard similarity of word shingles: groups of texts, one kept of each.

A text is the set of its shingles of five words (lower-cased bytes, split at ASCII white space). Two texts are linked when
the Jaccard similarity of their sets is at least 4/5; a group is a connected component of links. No link is lost:

How links are found. All shingles have one order, the same for every text. Of two sets with similarity t the first
n - ceil(t n) + 1 shingles of both have one in common (prefix filter), so texts meet at the shingles of their prefixes.
At the first shingle that two similar sets share, both have enough shingles left for the overlap that their sizes ask for
(positional filter): a text that has spent too many of its shingles before stays only for smaller partners, and goes where
there are none. So the strongly edited copies of a family, whose own shingles come first, do not meet the family again.
Pairs that meet are compared on their whole sets, but for those whose parity
sketches already prove that they differ too much. In the order frequent shingles come last, so that a common passage seldom
brings texts together; how frequent a shingle is comes from a sample of the texts and steers the work, never the result.
A family of near copies meets at many shingles: first each member is compared only with the two texts of each meeting that
have the fewest shingles of their own before it; pairs that are then in one group already need no comparison, all others that
meet get one.

Edge cases: a null text is an empty text; texts without words are equal; fewer words than a shingle make one shingle. Rows of
equal id and text are one. The smallest id of a group stays, null ids come last, and of several texts under that id one stays.
Rows are decided by (id, text), so texts under one id go or stay on their own. Texts and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.op10_simhash import MARKED, components, keep_one, marked, text_hash
from panelmill.session import materialise, release

SHINGLE = 5
SIMILAR = (4, 5)  # at least 4/5
SEED = 42
SAMPLE = 32  # one text in so many is looked at for frequent shingles
FREQUENT = 3  # sampled texts from which on a shingle is frequent
LISTED = 500_000  # frequent shingles that are told to the workers: the most frequent ones
TEXTS = 1_000  # texts whose prefixes make one part of the shingles, on average
LEAST_CLASSES = 256  # of a sketch
SEEN = 500_000  # texts that a task remembers, so that equal ones are packed once
ORACLE_SQL = None  # no engine-independent XXH64; tested against brute force


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text."""
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts)).view(np.int64))


def _sampled(shingle: int):
    def run(batches):
        for batch in batches:
            parts = [shingles(t.as_py(), shingle) for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *parts]))], names=["s"])

    return run


def _prefixes(shared, parts: int, shingle: int, similar: tuple[int, int]):
    """(th, text) in; the prefixes' (shingle, th, size of the set, shingles before) out, packed: one row for each part of the shingles in a batch."""

    def run(batches):
        (listed, counts), seen = shared.value, set()
        for batch in batches:
            rows, found = [], []
            for th, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if th in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(th)
                own = shingles(text.as_py(), shingle)
                length = len(own) - -(-similar[0] * len(own) // similar[1]) + 1
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
                    often = np.where(listed[at] == own, counts[at], 0)
                    own = own[np.argsort(often, kind="stable")]  # equal ones stay in the order of their hashes
                found.append(own[:length])
                rows.append(np.stack([np.full(length, th), np.full(length, len(own)), np.arange(length)]))
            if not found:
                continue
            found, rows = np.concatenate(found), np.concatenate(rows, axis=1)
            part = ((found.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            found, (keys, sizes, before), part = found[order], rows[:, order], part[order]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            offsets = pa.array(np.append(starts, len(part)).astype(np.int32))
            lists = [found, keys, sizes.astype(np.int32), before.astype(np.int32)]
            columns = [pa.array(part[starts]), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "s", "th", "n", "before"])

    return run


def _meetings(similar: tuple[int, int]):
    """The packed prefixes of a part in; (s, th, n, top, first, second) of every shingle with several texts that may be similar out. A text of n
    shingles can be similar only to texts of at most `top` shingles that have not met it earlier; first and second are the texts it is compared with."""
    p, q = similar

    def run(table: pa.Table) -> pa.Table:
        s, th, n, before = (table[name].combine_chunks().flatten().to_numpy() for name in ("s", "th", "n", "before"))
        order = np.lexsort((th, before, s))
        s, th, n, before = s[order], th[order], n[order].astype(np.int64), before[order].astype(np.int64)
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (th[1:] != th[:-1])
        s, th, n, before = s[new], th[new], n[new], before[new]
        top = (p + q) * (n - before) // p - n  # of the overlap (p + q) * overlap >= p * (n + n of the other)
        group = np.cumsum(np.append(True, s[1:] != s[:-1])[: len(s)]) << 32
        placed = np.sort(group + n)
        partners = np.searchsorted(placed, group + top, "right") - np.searchsorted(placed, group + -(-p * n // q)) - (n <= top)
        s, th, n, top = (x[partners > 0] for x in (s, th, n, top))
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
        sizes = np.diff(np.append(starts, len(s)))
        several, lines = np.repeat(sizes > 1, sizes), np.arange(len(s))
        columns = {"s": s, "th": th, "n": n.astype(np.int32), "top": top.astype(np.int32)}
        for name, centre in (("first", starts), ("second", np.minimum(starts + 1, max(len(s) - 1, 0)))):
            at = np.repeat(centre, sizes)
            idle = (at == lines) | (n > top[at]) | (n[at] > top)
            columns[name] = pa.array(th[at], mask=idle)
        return pa.table(columns).filter(pa.array(several))

    return run


def _compared(shingle: int, similar: tuple[int, int]):
    """(u, v, text of u, text of v) in; the similar (u, v) out."""
    p, q = similar

    def run(batches):
        near = {}  # the sets used last

        def known(key, text):
            if key not in near:
                if len(near) >= 64:
                    near.pop(next(iter(near)))
                near[key] = shingles(text.as_py(), shingle)
            return near[key]

        for batch in batches:
            keep, texts = [], [batch.column(i).cast(pa.binary()) for i in (2, 3)]
            for u, v, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *texts, strict=True):
                x, y = known(u, x), known(v, y)
                size = len(x) + len(y)
                both = min(len(x), len(y))
                if (p + q) * both >= p * size:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append((p + q) * both >= p * size)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sketches(shingle: int):
    """(th, text) in; (th, n, odd) out: odd has for each class of shingles whether their number is odd. There are about twice as many classes
    as shingles, a power of two; the classes of half as many are pairs of these, bit by bit of the first and the second half."""

    def run(batches):
        for batch in batches:
            sizes, bits = [], []
            for text in batch.column(1).cast(pa.binary()):
                own = shingles(text.as_py(), shingle)
                sizes.append(len(own))
                classes = max(LEAST_CLASSES, 1 << (2 * len(own) - 1).bit_length())
                odd = np.bincount(own & (classes - 1), minlength=classes) & 1
                bits.append(np.packbits(odd.astype(bool)).view(np.int64))
            flat = np.concatenate([np.empty(0, np.int64), *bits])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bits)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), lists], names=["th", "n", "odd"])

    return run


def _possible(pairs: DataFrame, sketches: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """`pairs` without those whose sketches prove them too different: sets differ in at least as many shingles as sketches in bits."""
    p, q = similar
    first, second = (sketches.select(F.col("th").alias(k), F.col("n").alias(f"n_{k}"), F.col("odd").alias(f"odd_{k}")) for k in ("u", "v"))
    fewer = F.least(F.size("odd_u"), F.size("odd_v"))
    half = lambda a: F.zip_with(F.slice(a, 1, fewer), F.slice(a, fewer + 1, fewer), lambda x, y: x.bitwiseXOR(y))
    same = lambda a: F.when(F.size(a) > fewer, half(a)).otherwise(F.col(a))  # noqa: E731  sizes within 4/5 differ by one doubling at most
    apart = F.aggregate(F.zip_with(same("odd_u"), same("odd_v"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, b: a + b)
    size = F.col("n_u") + F.col("n_v")
    near = pairs.join(first, "u").join(second, "v").where((p + q) * (size - apart) >= 2 * p * size)
    return near.select("u", "v")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similar: tuple[int, int], name: str) -> DataFrame:
    """The (u, v) of `pairs` that are similar. Only texts that are marked as part of a pair are shuffled."""
    members = pairs.select(F.explode(F.array("u", "v")).alias("th")).distinct()
    held = marked(texts.select("th", "text"), members, "th").where(F.col(f"`{MARKED}`")).join(members, "th", "left_semi")
    held = materialise(held.groupBy("th").agg(F.first("text").alias("text")), "held")
    first, second = held.select(F.col("th").alias("u"), F.col("text").alias("x")), held.select(F.col("th").alias("v"), F.col("text").alias("y"))
    both = pairs.join(second, "v").join(first, "u").select("u", "v", "x", "y")
    found = materialise(both.mapInArrow(_compared(shingle, similar), "u long, v long"), name)
    release(held)
    return found


def groups(texts: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(node, root): the text hash th of each text in (doc_id, th, text) that is similar to another one, and the least of its group."""
    sampled = texts.where(F.pmod("th", F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled(shingle), "s long")
    often = sampled.groupBy("s").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "s").limit(LISTED).toPandas().sort_values("s")
    shared = texts.sparkSession.sparkContext.broadcast((often["s"].to_numpy(np.int64), often["count"].to_numpy(np.int64)))
    parts = 1 + texts.count() // TEXTS
    packed = texts.select("th", "text").mapInArrow(_prefixes(shared, parts, shingle, similar), "part int, s array<long>, th array<long>, n array<int>, before array<int>")
    met = packed.groupBy("part").applyInArrow(_meetings(similar), "s long, th long, n int, top int, first long, second long")
    met = materialise(met, "meetings")

    sketches = texts.select("th", "text").mapInArrow(_sketches(shingle), "th long, n int, odd array<long>")
    sketches = sketches.join(met.select("th").distinct(), "th", "left_semi")
    sketches = materialise(sketches.groupBy("th").agg(F.first("n").alias("n"), F.first("odd").alias("odd")), "sketches")

    tried = met.select("th", F.explode(F.array("first", "second")).alias("centre")).where("centre IS NOT NULL")
    tried = materialise(tried.select(F.least("th", "centre").alias("u"), F.greatest("th", "centre").alias("v")).distinct(), "tried")
    near = materialise(_possible(tried, sketches, similar), "near")
    links = _verified(near, texts, shingle, similar, "links")
    release(near)
    roots = components(links, "first_groups")
    placed = met.join(roots, met.th == roots.node, "left").select("s", "th", "n", "top", F.coalesce("root", "th").alias("root"))
    apart = placed.groupBy("s").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m")).where("a < b AND m > 3").select("s")
    placed = materialise(placed.join(apart, "s"), "apart")
    release(met, roots)
    x, y = placed.alias("x"), placed.alias("y")
    open_pair = (F.col("x.s") == F.col("y.s")) & (F.col("x.th") < F.col("y.th")) & (F.col("x.root") != F.col("y.root"))
    rest = x.join(y, open_pair & (F.col("x.n") <= F.col("y.top")) & (F.col("y.n") <= F.col("x.top")))
    rest = rest.select(F.col("x.th").alias("u"), F.col("y.th").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    rest = materialise(_possible(rest, sketches, similar), "rest")
    release(placed, tried, sketches)
    more = _verified(rest, texts, shingle, similar, "more_links")
    release(rest)
    found = components(links.unionByName(more), "groups")
    release(links, more)
    return found


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Documents with one of each group of similar texts kept."""
    texts = docs.select("doc_id", text_hash().alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    roots = groups(texts, shingle, similar)
    grouped = texts.select("doc_id", "th").join(roots, texts.th == roots.node, "left")
    return keep_one(docs, grouped.select("doc_id", "th", F.coalesce("root", "th").alias("root")))
