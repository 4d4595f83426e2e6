import numpy as np

from panelmill.llm import op9_toxicity as op

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = op.fit(docs, train)
    assert len(model.weights) < 500
    rows = op.score(docs, model).join(held.select("doc_id", held.toxic.alias("y")), "doc_id").select("toxic", "y").collect()
    hits = sum(r[0] == bool(r.y) for r in rows)
    caught = sum(r[0] for r in rows if r.y) / sum(r.y for r in rows)
    wrong = sum(r[0] for r in rows if not r.y) / sum(1 - r.y for r in rows)
    assert hits / len(rows) > 0.98 and caught > 0.85 and wrong < 0.01


def test_thresholds_share_weights():
    """A grade that rises with one word and a second one on top is recovered in order."""
    rng = np.random.default_rng(0)
    x = rng.random((600, 3)) < 0.4
    grade = np.where(x[:, 0] & x[:, 1], 2, np.where(x[:, 0], 1, 0))
    rows, cols = np.nonzero(x)
    w, theta = op.fit_ordinal(rows, cols, 600, 3, grade)
    assert theta[0] < theta[1] and w[0] > w[1] > abs(w[2])
    level = ((x @ w)[:, None] > theta).sum(axis=1)
    assert (level == grade).mean() > 0.95


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1), (None, "bad words", 1), (4, "bad " * 100_000, 1)], "doc_id long, text string, TOXIC int")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        model = op.fit(docs, marks)
        assert model.weights == {}
        assert sorted(r.toxic for r in op.score(docs, model).collect()) == [False] * 5
        assert op.keep_clean(docs, marks).count() == 5
    assert op.score(docs.limit(0), model).collect() == []


def test_fit_is_repeatable_and_bounded(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert op.fit(docs, labels) == op.fit(docs.repartition(7), labels.repartition(3))
    assert op.training_features(docs, labels, sample=20)[1].count() <= 20


def test_only_chosen_features_reach_the_driver(spark, monkeypatch):
    from panelmill.session import materialise

    written = []

    def noted(df, name):
        table = materialise(df, name)
        written.append((name, table.count()))
        return table

    monkeypatch.setattr(op, "materialise", noted, raising=False)
    monkeypatch.setattr(op.training_features, "__defaults__", (op.SAMPLE, 2, 5))
    docs = spark.createDataFrame([(i, f"word{'abcdefgh'[i % 8]} common shared {'bad' if i % 3 == 0 else 'good'}") for i in range(40)], "doc_id long, text string")
    op.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic"))
    assert written == [("features", 5)]


def test_features_stay_out_of_the_driver(spark, monkeypatch):
    """The driver gets the row ids and the weights; the lists of rows a feature has are read by the task that fits."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: seen.append(self.columns) or collect(self))
    docs = spark.createDataFrame([(i, f"common {'bad' if i % 3 == 0 else 'good'} word") for i in range(60)], "doc_id long, text string")
    model = op.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic"))
    assert model.weights and all("rows" not in columns for columns in seen)
