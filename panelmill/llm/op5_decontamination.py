"""Benchmark decontamination by pigeonhole edit matching.

Items and texts are lower-cased and white space becomes single spaces. An item of m characters may differ from the passage in
k = m // 20 edits. It is cut into k + 1 pieces; a passage within k edits leaves one piece whole, at most k characters away
from its place. All pieces are searched in one pass (Aho-Corasick); each hit opens a window, windows of one item that touch
are merged, and Myers' bit-parallel distance decides each window exactly.

Items are taken in blocks of at most `BLOCK` characters, each broadcast on its own, so what is broadcast has a bound
whatever the number of items; every block sees all texts. A benchmark of one block costs one pass.

Edge cases: null or empty texts match nothing; null items, items without characters and null item ids are left out. Items
of under 20 characters allow no edit. Equal items all count. Rows of `docs` are independent: repeated rows give repeated
results, ties do not arise. Empty tables on either side give no hits, and one clean row per document. Other columns are
not read. Very long texts are searched whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 20  # characters of an item per allowed edit
BLOCK = 2_000_000  # characters of items searched, and broadcast, at a time
FOUND = "array<struct<item_id:bigint,start:int,stop:int,distance:int>>"
ORACLE_SQL = None  # approximate substring search; tested against a plain dynamic program


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def best_end(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best, then first, place where `pattern` ends in `text` within the budget (Myers 1999)."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    get = peq.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
            if score <= budget and (best is None or score < best[0]):
                best = score, at + 1
        ph = ph << 1 & full
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
    return best


class Searcher:
    """Finds items in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: int = RATE):
        ids = defaultdict(list)
        for item, text in items:
            if text:
                ids[text].append(item)
        self.items = [(text, sorted(found), len(text) // rate) for text, found in sorted(ids.items())]
        pieces = defaultdict(list)
        for n, (text, _, budget) in enumerate(self.items):
            cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[text[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, stop, distance) of each passage, in characters of the normalised text."""
        starts = defaultdict(list)
        if not self.items:
            return []
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                starts[n].append(end + 1 - size - offset)
        out = []
        for n, found in starts.items():
            item, ids, budget = self.items[n]
            windows: list[list[int]] = []
            for s in sorted(found):
                a, b = max(0, s - budget), s + len(item) + budget
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], b)
                else:
                    windows.append([a, b])
            for a, b in windows:
                hit = best_end(item, text[a:b], budget)
                if hit:
                    distance, end = hit
                    back = best_end(item[::-1], text[max(0, a + end - len(item) - budget) : a + end][::-1], distance)
                    out += [(i, a + end - back[1], a + end, distance) for i in ids]
        return sorted(out)


def blocks(bench: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about `block` characters; the driver holds one block's ids and texts at a time from a sorted scan."""
    rows = bench.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND trim(text) <> ''").orderBy("item_id", "text")
    out, size = [], 0
    for row in rows.toLocalIterator():
        if size > block:
            yield out
            out, size = [], 0
        out.append((row.item_id, normal(row.text)))
        size += len(row.text)
    if out:
        yield out


class _Block:
    """A broadcast block of items whose searcher each task builds when it first needs it."""

    def __init__(self, shared):
        self.shared, self.searcher = shared, None

    def search(self, text: str):
        if self.searcher is None:
            self.searcher = Searcher(self.shared.value)
        return self.searcher.search(normal(text))


def hits(spark: SparkSession, bench: DataFrame, text: Column, block: int = BLOCK) -> Column:
    """The passages of a text as array<struct<item_id, start, stop, distance>>; one function of the text per block of items."""
    names = ("item_id", "start", "stop", "distance")
    shape = pa.list_(pa.struct([(n, pa.int64() if n == "item_id" else pa.int32()) for n in names]))

    def finder(items):
        held = _Block(spark.sparkContext.broadcast(items))

        @F.arrow_udf(FOUND)
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([[dict(zip(names, h, strict=True)) for h in held.search(t.as_py() or "")] for t in texts], shape)

        return run(F.coalesce(text, F.lit("")))

    found = [finder(items) for items in blocks(bench, block)]
    return F.concat(*found) if found else F.expr(f"cast(array() as {FOUND})")


def passages(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, hits) per row of `docs`."""
    return docs.select(F.col(id_col).alias("doc_id"), hits(docs.sparkSession, bench, F.col(text_col), block).alias("hits"))


def keep_clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Documents without a benchmark passage, all columns; no row is joined or moved."""
    return docs.where(F.size(hits(docs.sparkSession, bench, F.col("text"))) == 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: is it contaminated, how many passages, of which items, and the smallest distance."""
    found = passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_passages"),
        F.array_distinct(F.transform("hits", lambda h: h["item_id"])).alias("item_ids"),
        F.array_min(F.transform("hits", lambda h: h["distance"])).alias("distance"),
    )
