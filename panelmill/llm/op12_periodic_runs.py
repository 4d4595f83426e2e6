"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q and at least max(12, 2 q) words that neither neighbour extends with that period.
All words of a document are one sequence; runs never cross documents.

How runs are found. A suffix automaton of the words is built; its suffix links form a tree whose path from the state of a prefix to
the root holds all suffixes of that prefix. Words are appended in order: the path of the new prefix is accessed as in a link-cut
tree. It falls into segments whose suffixes last ended at the same place, since every earlier access coloured its path with its
end, and then takes the new end as its colour. Where a segment with colour e and longest suffix L is met at end i and i - e <= L,
the suffix overlaps its earlier copy: the words before i hold a square of period i - e, and no smaller period explains it. The
square is extended to both sides to its run. Every run is met: its period's last copy ends at the place one period before.

Most texts repeat little, so only stretches are given to the automaton whose every word lies in a window of 6 words that occurs again
in the document. A run has such windows everywhere: the copies one period apart cover it. Windows are found by 64-bit hashes, where a
collision only makes a stretch longer; the automaton compares words.

Time is about n log n for the words of such stretches, memory about one kilobyte a word of the longest one; documents are dealt by Spark
and each is handled alone, so nothing is shuffled.

Edge cases: a null or empty text has no words and no runs. Rows are independent: repeated rows give equal rows, and an empty table gives
none. Words are whatever stands between ASCII white space, compared byte by byte. Other columns are not read. A null id is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 12  # words of a run
BATCH = 4 << 20  # bytes of kept text that make one batch
ORACLE_SQL = None  # an automaton is not SQL; tested against brute force
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, length of the longest string, state of each prefix); state 0 is the root, links of the root's children are 0."""
    link, length, edges, last, prefixes = [-1], [0], [{}], 0, []
    for w in words:
        state = len(link)
        link.append(0)
        length.append(length[last] + 1)
        edges.append({})
        at = last
        while at >= 0 and w not in edges[at]:
            edges[at][w] = state
            at = link[at]
        if at >= 0:
            target = edges[at][w]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(link)
                link.append(link[target])
                length.append(length[at] + 1)
                edges.append(edges[target].copy())
                link[target] = link[state] = copy
                while at >= 0 and edges[at].get(w) == target:
                    edges[at][w] = copy
                    at = link[at]
        last = state
        prefixes.append(state)
    link[0] = 0
    return link, length, prefixes


class Paths:
    """The link tree as preferred paths, each a splay tree by depth whose top holds the colour of the path (link-cut access)."""

    def __init__(self, link: list[int]):
        n = len(link)
        self.up, self.left, self.right, self.colour = list(link), [0] * n, [0] * n, [-1] * n

    def _splay(self, x: int) -> None:
        """Turns x to the top of its path's tree; the colour moves with the top."""
        up, left, right = self.up, self.left, self.right
        start = x
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                self._turn(p, g)
                self._turn(x, p)
            else:
                self._turn(x, p)
                if inner:
                    self._turn(x, g)
            start = g if inner else p
        if start != x:
            self.colour[x] = self.colour[start]

    def _turn(self, x: int, p: int) -> None:
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child:
            up[child] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[x], up[p] = g, x

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Colours the path from `state` to the root with `end`; (colour before, deepest state) of each segment that had one."""
        met, below, x = [], 0, state
        up, right, colour = self.up, self.right, self.colour
        while x:
            self._splay(x)
            if colour[x] >= 0:
                met.append((colour[x], x))
            if right[x]:
                colour[right[x]] = colour[x]  # what hangs deeper keeps its colour as a path of its own
            right[x] = below
            below, x = x, up[x]
        if below:
            colour[below] = end
        return met


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Number of leading places where two sequences agree, found in growing pieces."""
    n, at, piece = min(len(a), len(b)), 0, 64
    while at < n:
        apart = a[at : at + piece][: n - at] != b[at : at + piece][: n - at]
        if apart.any():
            return at + int(apart.argmax())
        at, piece = at + piece, piece * 4
    return n


def stretch_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of word numbers, by start, then period."""
    link, length, prefixes = automaton(words.tolist())
    paths, reach, found = Paths(link), {}, []
    back = words[::-1]
    n = len(words)
    for end, state in enumerate(prefixes):
        for before, deepest in paths.access(state, end):
            period = end - before
            if period > length[deepest] or reach.get(period, -1) >= end:
                continue
            ahead = _agree(words[end + 1 :], words[before + 1 :])
            behind = _agree(back[n - 1 - end :], back[n - 1 - before :])
            reach[period] = end + ahead
            size = ahead + behind + period
            if size >= max(least, 2 * period):
                found.append((end + ahead - size + 1, size, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def suspects(words: list[bytes], least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the stretches of at least `least` words whose every word lies in a window that occurs again."""
    n, width = len(words), max(1, least // 2)
    if n < least:
        return []
    marks = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    sums = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + (marks[k : k + len(sums)] ^ (marks[k : k + len(sums)] >> np.uint64(29)))
    ordered = np.sort(sums)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    places = np.minimum(np.searchsorted(again, sums), len(again) - 1)
    cover = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again[places] == sums)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    inside = np.concatenate(([0], np.cumsum(cover[:n]) > 0, [0])).astype(np.int8)
    edges = np.diff(inside)
    pairs = zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)
    return [(a, b) for a, b in pairs if b - a >= least]


def runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document's words, by start, then period."""
    found = []
    for a, b in suspects(words, least):
        numbers: dict[bytes, int] = {}
        sequence = np.array([numbers.setdefault(w, len(numbers)) for w in words[a:b]], np.int64)
        found += [(a + s, length, period) for s, length, period in stretch_runs(sequence, least)]
    return found


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stand in no run after its first period."""
    if not found:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) per row of `docs`: all runs by start and period, and the text with every run cut to its first period
    (words joined by one space). `change` may replace the words of a document before they are looked at."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    cells = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, found, texts, size, first = batch.column(0).to_pylist(), [], [], 0, 0
            raw = batch.column(1).cast(pa.binary())
            for row, ident in enumerate(ids):
                words = (raw[row].as_py() or b"").split()  # bytes: only ASCII white space separates
                if change:
                    words = change(ident, words)
                here = runs(words, least)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in here])
                texts.append(b" ".join(kept_words(words, here)))
                size += len(texts[-1])
                if size >= BATCH or row == len(ids) - 1:
                    columns = [batch.column(0).slice(first, len(texts)), pa.array(found, pa.list_(cells)), pa.array(texts, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])
                    found, texts, size, first = [], [], 0, row + 1

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")


def stutter(ident, words: list[bytes]) -> list[bytes]:
    """The words of the contract's documents: those with h % 10 = 0 repeat a period from word a on."""
    n = len(words)
    if ident is None or not n:
        return words
    h = zlib.crc32(str(ident).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digests(collapsed: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest run and the digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("less"), x["start"].alias("start"), x["period"].alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))))
    return collapsed.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(collapse(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=stutter))
