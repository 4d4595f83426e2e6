"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has one bit per position that is set in over half the shingle hashes. Two fingerprints are linked when they
differ in at most three bits, and a group is a connected component of links.

How links are found. Of three differing bits one half of the word holds at most one. So each fingerprint emits, for both
halves, every value within half the radius of that half (one bit: 33 variants), keyed by the half and the variant. Linked
fingerprints meet at the plain half value of one of them. Only buckets with such an owner and a second member are kept;
their members are compared by XOR, and a bucket gives a spanning forest of its links, never all its pairs. A bucket with
very many members is dealt again by the bytes of its other half: of four bytes that differ in three bits at most, one is
equal, so no link is lost. Groups come from large-star / small-star rounds over written tables.

Edge cases: a null text is an empty text; texts without words have fingerprint 0 and are linked like any other; fewer
words than a shingle make one shingle. Rows are kept as they are: equal rows give equal rows. A null id takes part in its
group but never names it (a group of null ids only has a null name). An empty table gives an empty result. Other columns
of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.session import materialise, release

SHINGLE = 3
RADIUS = 3
SEED = 42
CHUNK = 65_536  # hashes whose bits are counted at a time
BUCKET = 4_096  # members up to which a bucket is compared as one
ORACLE_SQL = None  # no engine-independent XXH64; tested against brute force


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text, unsigned."""
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row; fp as a signed long."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def spanning_links(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    if len(members) < 12:
        links, rest = [], list(members)
        while rest:
            front = [rest.pop()]
            while front:
                x, kept = front.pop(), []
                for y in rest:
                    if (x ^ y).bit_count() <= radius:
                        links.append((x, y))
                        front.append(y)
                    else:
                        kept.append(y)
                rest = kept
        return links
    links, rest = [], np.array(members, np.uint64)
    while rest.size:
        front, rest = [rest[0]], rest[1:]
        while front and rest.size:
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                links += [(int(x), int(y)) for y in found]
                front += list(found)
    return links


def _bucket_links(batches):
    """Sorted (key, part, fp) rows in; spanning links of each run of equal (key, part) out."""
    held = np.empty((3, 0), np.int64)

    def links(rows):
        edges = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        out = []
        for group in np.split(rows[2], edges):
            if len(group) > 1:
                out += spanning_links(np.unique(group).view(np.uint64).tolist())
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["u", "v"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        if not rows.shape[1]:
            continue
        last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        cut = last[-1] + 1 if last.size else 0  # the last run may go on in the next batch
        if cut:
            yield links(rows[:, :cut])
        held = rows[:, cut:]
    if held.shape[1]:
        yield links(held)


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links of distinct fingerprints `fp` that connect the same groups as all links do."""
    balls = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(m).alias("m")) for h in (0, 1) for m in (0, *(1 << b for b in range(32)))))
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    emitted = distinct.select("fp", F.explode(balls).alias("x")).select(
        "fp",
        F.when(F.col("x.h") == 0, low).otherwise(high.bitwiseOR(F.lit(1 << 32))).bitwiseXOR(F.col("x.m").cast("long")).alias("key"),
        (F.col("x.m") == 0).alias("owner"),
    )
    sizes = emitted.groupBy("key").agg(F.count("*").alias("n"), F.max("owner").alias("owned")).where("owned AND n > 1").select("key", "n")
    other = F.when(F.shiftright("key", 32) == 0, high).otherwise(low)
    parts = F.array(*(F.lit(256 * b).cast("long") + F.shiftright(other, 8 * b).bitwiseAND(F.lit(255)) for b in range(4)))
    # the variants are many times larger than their fingerprints, which Spark cannot know: it must not broadcast them
    dealt = emitted.join(sizes.hint("shuffle_hash"), "key").select("key", F.explode(F.when(F.col("n") > bucket, parts).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"), "fp")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_bucket_links, "u long, v long").distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): every node of an edge list (u, v) with the smallest node of its component."""
    current, seen = materialise(edges.where("u <> v"), name), None
    for _ in range(rounds):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        before, current = current, materialise(small.select("e.u", "e.v").where("u <> v").distinct(), name)
        release(before)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"{name}: not settled after {rounds} rounds")
    table = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    table._folder = current._folder
    return table


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of `docs`."""
    marks = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = components(links(distinct.select("fp")), "groups")
    rooted = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = rooted.join(named, "root").select("fp", "component_id")
    return marks.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


TH, MARKED = "hash of the text", "hash is marked"
MARKS = 1 << 24  # bits in which hashes are marked: at most 262,144 rows that are broadcast, whatever the number of hashes


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def marked(df: DataFrame, hashes: DataFrame, th: str, marks: int = MARKS) -> DataFrame:
    """`df` with the column `MARKED`: whether the hash `th` may occur in the column th of `hashes`; false where it surely does not."""
    words = hashes.select(F.expr(f"pmod(th, {marks}) div 64").alias("word of marks"), F.expr("shiftleft(1L, cast(pmod(th, 64) as int))").alias("bit"))
    words = words.groupBy("word of marks").agg(F.bit_or("bit").alias("bits of marks"))
    there = df.join(F.broadcast(words), F.expr(f"pmod(`{th}`, {marks}) div 64") == F.col("word of marks"), "left")
    hit = F.coalesce(F.expr(f"getbit(`bits of marks`, cast(pmod(`{th}`, 64) as int)) = 1"), F.lit(False))
    return there.withColumn(MARKED, hit).drop("word of marks", "bits of marks")


def keep_one(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """`docs` with one (doc_id, text) of each group kept: the smallest doc_id, nulls last, then the smallest text hash. `grouped`
    has (doc_id, th, root) per row. Decisions are made on ids and hashes; texts are compared nowhere, and only rows whose hash is marked as
    decided on are shuffled."""
    rows = materialise(grouped.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th")
    first = rows.groupBy("root").agg(F.min(order).alias("first"), F.sum("n").alias("members")).where("members > 1").drop("members")
    judged = rows.join(first, "root").select("doc_id", "th", "n", (~order.eqNullSafe(F.col("first"))).alias("gone"))
    decided = materialise(judged.where("gone OR n > 1").select(F.col("doc_id").alias("decided_id"), F.col("th").alias("decided_th"), "gone"), "decided")
    release(rows)
    columns = docs.columns
    hashed = marked(docs.withColumn(TH, text_hash()), decided.select(F.col("decided_th").alias("th")), TH)
    same = hashed.doc_id.eqNullSafe(decided.decided_id) & (hashed[TH] == decided.decided_th)
    untouched, touched = hashed.where(~F.col(f"`{MARKED}`")), hashed.where(F.col(f"`{MARKED}`"))
    once = touched.join(decided, same, "left_anti")
    again = touched.join(decided.where("NOT gone"), same, "left_semi").dropDuplicates(["doc_id", TH])
    return untouched.unionByName(once).unionByName(again).select(*(F.col(f"`{c}`") for c in columns))


def keep_first(docs: DataFrame) -> DataFrame:
    """Documents with one (doc_id, text) of each group kept: the smallest doc_id. Rows without an id are grouped among themselves:
    they never remove a document with an id, nor does one remove them."""
    rows = docs.select(F.struct("doc_id", text_hash().alias("th")).alias("doc_id"), "text")
    root = F.struct("component_id", F.col("doc_id.doc_id").isNull().alias("unnamed")).alias("root")
    return keep_one(docs, near_duplicates(rows).select("doc_id.doc_id", "doc_id.th", root))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
