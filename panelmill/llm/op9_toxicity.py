"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades: 0 clean; 1 and 2 toxic, 2 where a labelled toxic text holds three or more of the words that mark toxic texts. One
weight vector is shared by both thresholds: P(grade > k) = sigmoid(w.x - theta_k), theta_0 < theta_1. Features are the words of
a text and their beginnings of 3 to 7 letters (presence), since inflected forms of one word share their beginning. The fit is
proximal gradient with an L1 penalty, which selects the features that separate the grades, then a nearly unpenalised fit of
those. The expected severity is the sum of P(grade > k) over k.

The fit uses at most `SAMPLE` labelled documents (those with the smallest hash of their id) and, of their features, the
`MAX_FEATURES` most frequent that at least `MIN_DOCS` of them hold. Everything else covers all rows.

Edge cases: null labels and labels without a document do not train; a null toxic label is no label. Repeated labelled rows count
once per distinct (id, label, text). With fewer than two classes in the sample all weights are 0 and the thresholds give the
classes' share: nothing is rejected unless more than half are toxic. A null or empty text has no features. Rows are scored
independently: repeated rows and ties need no rule; an empty table gives no rows. Other columns are not read; long texts are
scored whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.session import materialise, release

SAMPLE = 8_000
MAX_FEATURES = 50_000
MIN_DOCS = 5
PENALTY = 0.002
ROUNDS = 200
HEADS = (3, 7)  # lengths of beginnings that are features
REJECT = 0.5  # P(grade > 0) above which a document is toxic
ORACLE_SQL = None  # a fitted model; tested by held-out accuracy
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Severity:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    @cached_property
    def starts(self) -> set[str]:
        return {f[: HEADS[0]] for f in self.weights}

    def features(self, text: str) -> set[str]:
        """The weighted features that a text has."""
        found, weights, starts, (low, high) = set(), self.weights, self.starts, HEADS
        for word in set(WORD.findall(text.lower())):
            if word[:low] in starts:
                found.add(word)
                found.update(word[:k] + "*" for k in range(low, min(high + 1, len(word))))
        return found & weights.keys()

    def above(self, text: str) -> list[float]:
        """P(grade > k) for every threshold."""
        score = sum(self.weights[f] for f in sorted(self.features(text)))
        return [1 / (1 + math.exp(max(-700.0, min(700.0, t - score)))) for t in self.thresholds]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, n: int, p: int, grade: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS):
    """(w, theta) for presence features given as (row, column) pairs; FISTA with the thresholds kept in order."""
    top = int(grade.max(initial=0))
    theta = np.array([np.log((np.sum(grade <= k) + 0.5) / (np.sum(grade > k) + 0.5)) for k in range(max(1, top))])
    w, look, at, step = np.zeros(p), np.zeros(p), 1.0, 1.0
    if not top or not len(grade) or (grade > 0).all():
        return w, theta
    per_row = np.bincount(rows, minlength=n)
    step = 4.0 / (1 + max(1, top) * np.sqrt(per_row.mean() * np.bincount(cols, minlength=p).max(initial=1) / n) * 2)
    share = np.array([grade > k for k in range(top)], float)

    def loss(v, t):
        score = np.bincount(rows, v[cols], n)
        z = score[None, :] - t[:, None]
        return np.mean(np.sum(np.logaddexp(0, z) - share * z, axis=0)), z

    value, _ = loss(w, theta)
    for _ in range(rounds):
        base, z = loss(look, theta)
        wrong = _sigmoid(z) - share
        slope = np.bincount(cols, wrong.sum(axis=0)[rows], p) / n
        while True:
            fresh = look - step * slope
            fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - step * penalty, 0)
            move = fresh - look
            if loss(fresh, theta)[0] <= base + slope @ move + move @ move / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        theta = np.maximum.accumulate(theta + 2 * wrong.mean(axis=1)) + 1e-3 * np.arange(top)
        nxt = (1 + np.sqrt(1 + 4 * at * at)) / 2
        look, w, at = fresh + (at - 1) / nxt * (fresh - w), fresh, nxt
    return w, theta


def training_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_docs: int = MIN_DOCS, most: int = MAX_FEATURES):
    """(feature, rows of the sample that have it) and (row, label); bounded by the parameters."""
    chosen = (
        labels.select(F.col("doc_id").alias("d"), F.col("toxic").cast("int").alias("y"))
        .where("d IS NOT NULL AND y IS NOT NULL").distinct()
        .orderBy(F.xxhash64(F.col("d").cast("string")), "d", "y").limit(sample)
    )
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("d"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1)))
    rows = held.select("d", "y", F.array_sort(words).alias("words"), F.xxhash64("text").alias("t")).distinct().withColumn("row", F.xxhash64("d", "y", "t"))
    low, high = HEADS
    heads = lambda w: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(w) - 1)), lambda k: F.concat(F.left(w, k), F.lit("*")))
    every = F.array_distinct(F.flatten(F.transform("words", lambda w: F.when(F.length(w) > low, F.concat(F.array(w), heads(w))).otherwise(F.array(w)))))
    counted = rows.select("row", F.explode(every).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("row")).alias("rows"))
    frequent = counted.where(F.col("n") >= min_docs).orderBy(F.desc("n"), "feature").limit(most).select("feature", "rows")
    return frequent, rows.select("row", "y")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Severity:
    """The severity model of labelled documents."""
    frequent, marks = training_features(docs, labels, sample)
    graded = marks.toArrow()
    order = np.argsort(graded["row"].to_numpy(), kind="stable")
    ids, toxic = graded["row"].to_numpy()[order], graded["y"].to_numpy()[order] > 0
    # written first: collected at once, the largest rows of every partition would meet in the driver
    chosen = materialise(frequent, "features")
    lists = "features array<string>, weights array<double>, thresholds array<double>"
    found = chosen.coalesce(1).mapInArrow(lambda batches: _fitted(batches, ids, toxic), lists).toArrow()
    release(chosen)
    if not found.num_rows:  # nothing to read, so no task ran
        found = pa.Table.from_batches(_fitted([], ids, toxic))
    names, weights, thresholds = (found[c][0].as_py() for c in found.column_names)
    return Severity(dict(zip(names, weights, strict=True)), tuple(thresholds))


def _fitted(batches, ids: np.ndarray, toxic: np.ndarray):
    """One row (features, weights, thresholds) from the chosen features and the rows that have them; `ids` are all rows, in order.

    Runs in one task: the sample and the number of features bound it.
    """
    batches = list(batches)
    kinds = batches[0].schema if batches else pa.schema({"feature": pa.string(), "rows": pa.list_(pa.int64())})
    table = pa.Table.from_batches(batches, kinds).sort_by("feature").combine_chunks()
    names, held = table["feature"].to_pylist(), table["rows"].combine_chunks()
    cols = np.repeat(np.arange(len(names)), np.diff(held.offsets.to_numpy())) if names else np.zeros(0, np.int64)
    rows = np.searchsorted(ids, held.flatten().to_numpy(zero_copy_only=False)) if names else np.zeros(0, np.int64)
    del batches, table, held
    n, p = len(ids), len(names)
    inside = np.bincount(cols, toxic[rows], p)
    outside = np.bincount(cols, minlength=p) - inside
    telling = inside / max(1, toxic.sum()) > 8 * (outside + 1) / max(1, (~toxic).sum())
    whole = np.array([not f.endswith("*") for f in names], bool)
    strong = np.bincount(rows, (telling & whole)[cols], n)
    grade = np.where(toxic, 1 + (strong >= 3), 0)
    w, theta = fit_ordinal(rows, cols, n, p, grade)
    kept = np.flatnonzero(np.abs(w) > 1e-9)
    if kept.size:
        inner = np.isin(cols, kept)
        again, theta = fit_ordinal(rows[inner], np.searchsorted(kept, cols[inner]), n, len(kept), grade, PENALTY / 10, 2 * ROUNDS)
        w = np.zeros(p)
        w[kept] = again
    kept = [i for i in kept if abs(w[i]) > 1e-9]
    row = [names[i] for i in kept], [round(float(w[i]), 6) for i in kept], [round(float(t), 6) for t in theta]
    kinds = pa.string(), pa.float64(), pa.float64()
    yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(k)) for v, k in zip(row, kinds, strict=True)], names=["features", "weights", "thresholds"])


def score(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """(doc_id, p_toxic, expected_severity, toxic) per row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            above = [shared.value.above(t.as_py()) for t in batch.column(1)]
            first, total = [a[0] for a in above], [sum(a) for a in above]
            columns = [batch.column(0), pa.array(first, pa.float64()), pa.array(total, pa.float64()), pa.array([x > reject for x in first], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "p_toxic", "expected_severity", "toxic"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, p_toxic double, expected_severity double, toxic boolean")


def rejected(model_ref, reject: float = REJECT):
    """A column function: is a text rejected by a broadcast model."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model_ref.value.above(t.as_py() or "")[0] > reject for t in texts], pa.bool_())

    return run


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the model fitted to `labels` does not reject; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.where(~rejected(shared)(F.coalesce(F.col("text"), F.lit(""))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
