"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if it lies in a string of 100 bytes that also starts earlier: in a document with a smaller id, or earlier in the same
document. Matches never cross documents and are judged on the input.

One suffix array over everything would be one task, so strings are first brought together by content. Every window of 100
bytes names the 32-byte gram in it with the smallest hash, the leftmost of equals; equal windows name the same gram. The
windows of a document that name one gram at one place are neighbours and form a stretch; about one byte in 35 starts one.

1. Stretches are dealt by gram. Equal stretches: all but the first are repeats (each map batch keeps its own first before the
   shuffle). A gram with one distinct stretch is done. These are nearly all, and no text has moved yet.
2. Grams with several distinct stretches are where repeats begin or end. Their bytes are taken from the texts and dealt into cells
   of about a megabyte. In a cell, a suffix array to depth 100 is built by prefix doubling; suffixes in suffix order that agree
   in 100 bytes form a run, and the previous or next smaller position in the run is an earlier match (LPF >= 100).
3. A gram with very many distinct stretches does not fit a cell. Its windows are compared by 128-bit hash instead, first inside
   each batch, then across, where the earliest of each hash is its first.
4. The repeats of a document meet its text once more; the same exchange of texts serves steps 2 and 4.

Edge cases: a null text is empty; texts under 100 bytes are kept whole. Documents are ordered by id, nulls last, then by hash of
the text. Rows equal in id and text are one document and get equal results. An empty table gives no rows. Other columns are
not read. Very long texts are hashed in segments that overlap by 99 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.session import materialise

LENGTH = 100  # bytes of a repeat
GRAM = 32
SEGMENT = 1 << 22  # window starts hashed at a time
CELL = 1_000_000  # bytes of stretches in one suffix array
CROWD = 4_096  # distinct stretches of a gram up to which it goes to a cell
LAST = (1 << 63) - 1  # order of a null id
ORACLE_SQL = None  # tested against brute force

MARKS = "repeat boolean, gram long, body long, did long, doc long, at long, n long"
RUNS = "did long, doc long, at long, n long"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each position."""
    words = np.ndarray(len(data) - 7, "<u8", data.tobytes(), strides=(1,)) if len(data) > 7 else np.empty(0, np.uint64)
    n = len(data) - GRAM + 1
    mixed = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for part in range(0, GRAM, 8):
        mixed ^= words[part : part + n]
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by running minima of blocks from both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, hash of the bytes, first window, number of windows) of each stretch of a text."""
    found = []
    for base in range(0, max(0, len(text) - LENGTH + 1), SEGMENT):
        part = text[base : base + SEGMENT + LENGTH - 1]
        hashes = gram_hashes(np.frombuffer(part, np.uint8))
        places = np.arange(len(hashes), dtype=np.uint64)
        named = sliding_min((hashes & ~np.uint64(0xFFFFFF)) | places, LENGTH - GRAM + 1)
        starts = np.concatenate(([0], np.flatnonzero(named[1:] != named[:-1]) + 1))
        ends = np.concatenate((starts[1:], [len(named)]))
        grams = hashes[(named[starts] & np.uint64(0xFFFFFF)).astype(np.int64)]
        bodies = [xxhash.xxh64_intdigest(part[a : b + LENGTH - 1]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found.append((grams.view(np.int64), np.array(bodies, np.uint64).view(np.int64), starts + base, ends - starts))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))


def _mark(batches):
    """(did, doc, text) in; stretches out, those equal to an earlier one of the batch as repeats."""
    for batch in batches:
        dids, docs, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.binary())
        parts = [stretches(t.as_py()) for t in texts]
        sizes = [len(p[0]) for p in parts]
        gram, body, at, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*parts, strict=True))
        did, doc = np.repeat(dids, sizes), np.repeat(docs, sizes)
        order = np.lexsort((at, doc, did, body, gram))
        gram, body, at, n, did, doc = (x[order] for x in (gram, body, at, n, did, doc))
        again = np.zeros(len(gram), bool)
        again[1:] = (gram[1:] == gram[:-1]) & (body[1:] == body[:-1]) & ((at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (did[1:] != did[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (again, gram, body, did, doc, at, n)], names=[c.split()[0] for c in MARKS.split(", ")])


def suffix_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all window starts of several texts by their first 100 bytes (equal rank: equal bytes), and the index of each
    start's text; starts in text order. Prefix doubling: 8, 16, 32, 64 bytes, then two overlapping halves of 64."""
    joined = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
    sizes = np.array([len(t) for t in texts])
    rank = np.unique(np.ndarray(len(joined) - 7, ">u8", joined.tobytes(), strides=(1,)).astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    for width in (8, 16, 32):
        rank = np.unique(rank[:-width] << np.uint64(32) | rank[width:], return_inverse=True)[1].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes - LENGTH + 1)
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    places = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(sizes - LENGTH + 1)[:-1])), sizes - LENGTH + 1) + offsets[owner]
    return np.unique(rank[places] << np.uint64(32) | rank[places + LENGTH - 64], return_inverse=True)[1], owner


def earlier(rank: np.ndarray) -> np.ndarray:
    """Which starts have an earlier one of equal rank. In suffix order, equal ranks by position, the previous smaller position of
    the same run is the neighbour before; the next smaller one is then no nearer."""
    order = np.argsort(rank, kind="stable")
    seen = np.zeros(len(rank), bool)
    seen[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    return seen


def _as_runs(did, doc, at) -> pa.RecordBatch:
    """Window starts (sorted per document) as runs of neighbours."""
    if len(at):
        cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc) != 0) | (np.diff(did) != 0)) + 1
        firsts, lasts = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(at)]))
        did, doc, at, n = did[firsts], doc[firsts], at[firsts], lasts - firsts
    else:
        n = at
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (did, doc, at, n)], names=["did", "doc", "at", "n"])


def _in_order(table: pa.Table) -> pa.Table:
    """Stretches by document and place, each once: a repeated row of the input brings its stretches twice."""
    table = table.sort_by([("did", "ascending"), ("doc", "ascending"), ("at", "ascending")])
    place = np.stack([table[c].to_numpy() for c in ("did", "doc", "at")])
    return table.filter(pa.array(np.concatenate(([True], (np.diff(place, axis=1) != 0).any(axis=0)))[: table.num_rows]))


def _cell(table: pa.Table) -> pa.Table:
    """The stretches of a cell in; runs of windows with an earlier match out."""
    table = _in_order(table)
    rank, owner = suffix_runs(table["bytes"].to_pylist())
    did, doc, at = (table[c].to_numpy() for c in ("did", "doc", "at"))
    first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    inside = np.arange(len(owner)) - first[owner]
    hit = np.flatnonzero(earlier(rank))
    return pa.Table.from_batches([_as_runs(did[owner[hit]], doc[owner[hit]], at[owner[hit]] + inside[hit])])


def _windows(batches):
    """Stretches of crowded grams in; a hash per window out, one row for each hash of the batch and runs for the others."""
    for batch in batches:
        table = _in_order(pa.Table.from_batches([batch]))
        rows, hashes = [], []
        for did, doc, at, data in zip(*(table[c].to_pylist() for c in ("did", "doc", "at", "bytes")), strict=True):
            for i in range(len(data) - LENGTH + 1):
                rows.append((did, doc, at + i))
                hashes.append(xxhash.xxh128_digest(data[i : i + LENGTH]))
        place = np.array(rows, np.int64).reshape(-1, 3)
        keys = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        seen = earlier(np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)) if len(keys) else np.empty(0, bool)
        runs = _as_runs(*place[seen].T)
        columns = [np.concatenate((a, b)) for a, b in zip((*place[~seen].T, np.ones((~seen).sum(), np.int64)), (c.to_numpy() for c in runs.columns), strict=True)]
        zeros = np.zeros(runs.num_rows, np.int64)
        flag = np.concatenate((np.zeros((~seen).sum(), bool), np.ones(runs.num_rows, bool)))
        # a run needs no partner: it is dealt by its place
        high, low = np.concatenate((keys[~seen, 0], columns[1][len(flag) - len(zeros) :])), np.concatenate((keys[~seen, 1], zeros))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (flag, high, low, *columns)], names=["repeat", "high", "low", "did", "doc", "at", "n"])


def _take(batches):
    """(did, doc, text, wanted) in; the bytes of each wanted stretch out."""
    for batch in batches:
        out = []
        for did, doc, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
            data = text.as_py()
            for w in wanted.as_py():
                out.append((did.as_py(), doc.as_py(), w["at"], w["cell"], data[w["at"] : w["at"] + w["n"] + LENGTH - 1]))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["did", "doc", "at", "cell", "bytes"])


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, did, doc, text): order and key of each document."""
    text, ident = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    return docs.select(ident.alias("doc_id"), F.coalesce(ident.cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(text).alias("doc"), text.alias("text"))


def repeats(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(did, doc, at, n): runs of n window starts from byte `at` whose 100 bytes also start earlier; `rows` as from `documents`."""
    marks = rows.select("did", "doc", "text").mapInArrow(_mark, MARKS)
    gram, equal = Window.partitionBy("gram"), Window.partitionBy("gram", "body").orderBy("did", "doc", "at")
    keyed = marks.withColumn("gram", F.when(F.col("repeat"), F.xxhash64("did", "doc", "at")).otherwise(F.col("gram")))
    live = F.when(~F.col("repeat"), F.col("body"))
    judged = (
        keyed.withColumn("several", F.coalesce(F.min(live).over(gram) < F.max(live).over(gram), F.lit(False)))
        .withColumn("first", F.first(F.when(~F.col("repeat"), F.struct("did", "doc", "at")), ignorenulls=True).over(equal))
        .withColumn("repeat", F.col("repeat") | (F.col("first") != F.struct("did", "doc", "at")))
        .where("repeat OR several")
        .select("repeat", "gram", "did", "doc", "at", "n")
    )
    found = materialise(judged.distinct(), "stretches")
    open_ones = found.where("NOT repeat")
    crowds = open_ones.groupBy("gram").agg(F.count("*").alias("m"), F.sum(F.col("n") + LENGTH - 1).alias("size"))
    total = crowds.where(F.col("m") <= crowd).agg(F.sum("size")).first()[0] or 0
    cells = max(1, -(-total // CELL))
    placed = open_ones.join(crowds.select("gram", "m"), "gram").withColumn("cell", F.when(F.col("m") <= crowd, F.pmod("gram", F.lit(cells))).otherwise(-1))
    wanted = placed.groupBy("did", "doc").agg(F.collect_list(F.struct("at", "n", "cell")).alias("wanted"))
    keys = ["did", "doc"]
    texts = rows.select("did", "doc", "doc_id", "text").repartition(*keys)
    taken = texts.join(wanted, keys).select("did", "doc", "text", "wanted").mapInArrow(_take, "did long, doc long, at long, cell long, bytes binary")
    local = taken.where("cell >= 0").groupBy("cell").applyInArrow(_cell, RUNS)
    runs = found.where("repeat").select("did", "doc", "at", "n").union(local)
    if crowds.where(F.col("m") > crowd).limit(1).count():
        windows = taken.where("cell < 0").select("did", "doc", "at", "bytes").mapInArrow(_windows, "repeat boolean, high long, low long, did long, doc long, at long, n long")
        same = Window.partitionBy("high", "low").orderBy("repeat", "did", "doc", "at")
        first = F.first(F.struct("repeat", "did", "doc", "at")).over(same)
        runs = runs.union(windows.withColumn("first", first).where("repeat OR first <> struct(repeat, did, doc, at)").select("did", "doc", "at", "n"))
    return runs


def _cut(batches):
    """(doc_id, text, runs) in; what remains and the figures out."""
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for text, runs in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            data, at, out, gone, count = text.as_py(), 0, [], 0, 0
            last = -1
            for run in sorted((r["at"], r["at"] + r["n"] + LENGTH - 1) for r in (runs.as_py() or ())):
                a, b = max(run[0], at), run[1]
                if b <= at:
                    continue
                if run[0] > last:
                    count += 1
                out.append(data[at:a])
                gone += b - a
                at = last = b
            out.append(data[at:])
            sizes.append(len(data))
            removed.append(gone)
            spans.append(count)
            kept.append(b"".join(out))
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row; kept as bytes, since a cut may split a character."""
    rows = documents(docs, id_col, text_col)
    keys = ["did", "doc"]
    runs = repeats(rows, crowd).groupBy(*keys).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    texts = rows.select("did", "doc", "doc_id", "text").repartition(*keys)
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    return texts.join(runs, keys, "left").select("doc_id", "text", "runs").mapInArrow(_cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

