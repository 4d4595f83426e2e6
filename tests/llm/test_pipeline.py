"""The pipeline against a plain version of its stages on a small folder of tables with planted cases."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from panelmill.llm import op5_decontamination, op6_pii, op9_toxicity
from tests.llm.test_near_texts import brute as near_brute

SOURCE = "/root/testdata/sf0.001"
ITEM = "the careful archivist counted seventeen copper lanterns beside the northern gate before the evening bell rang twice"


def _encoder():
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of the smallest tables and planted rows; the same labels and one more benchmark item."""
    out = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    planted = [
        (9001, first.text, first.lang, first.source, first.n_chars),
        (9002, "Some words before it, and then: " + ITEM + " and words after it.", "en", "web", 150),
        (9003, "Reach the clerk by mail at clerk@example.org until noon, as the notice on the door says.", "en", "web", 90),
        (9004, None, None, None, None),
    ]
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{SOURCE}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    bench = spark.read.parquet(f"{SOURCE}/benchmark.parquet").select("item_id", "text")
    bench.union(spark.createDataFrame([(99_001, ITEM)], bench.schema)).write.parquet(f"{out}/benchmark.parquet")
    return out


def brute(spark, folder):
    rows = sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: r.doc_id)
    docs = {r.doc_id: r.text or "" for r in rows}
    model = op9_toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    docs = {d: t for d, t in docs.items() if model.above(t)[0] <= op9_toxicity.REJECT}

    roots, ordered = near_brute(list(docs.items()))
    docs = dict(ordered[i] for i in roots)

    items = [(r.item_id, op5_decontamination.normal(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if (r.text or "").strip()]

    def distance(item, text):
        """Least edits of an item against any part of a text, by the plain table."""
        row = list(range(len(item) + 1))
        best = row[-1]
        for c in text:
            last, row[0] = row[:], 0
            for i, x in enumerate(item, 1):
                row[i] = min(last[i] + 1, row[i - 1] + 1, last[i - 1] + (x != c))
            best = min(best, row[-1])
        return best

    def leaked(text):
        """The table is filled only where a part of an item that any match within the budget must hold occurs at all."""
        text = op5_decontamination.normal(text)
        for _, item in items:
            budget = len(item) // op5_decontamination.RATE
            cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
            parts = [item[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            if any(p in text for p in parts) and (item in text or distance(item, text) <= budget):
                return True
        return False

    docs = {d: t for d, t in docs.items() if not leaked(t)}
    encoder, out = _encoder(), []
    frame = spark.read.parquet(f"{folder}/documents.parquet")  # the redaction has a brute-force test of its own
    for d, text in ((r.doc_id, r.text or "") for r in op6_pii.redact(frame.where(frame.doc_id.isin(list(docs)))).collect()):
        tokens = encoder.encode_ordinary(text)
        out.append((d, len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_run_against_plain_stages(spark, folder):
    kept = corpus_pipeline.run(spark, folder)
    assert kept.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = sorted(map(tuple, kept.collect()))
    ids = {r[0] for r in found}
    assert not ids & {9001, 9002} and {9003, 9004} <= ids
    mail = "Reach the clerk by mail at clerk@example.org until noon, as the notice on the door says."
    assert hashlib.sha256(mail.encode()).hexdigest() not in {r[3] for r in found if r[0] == 9003}
    assert found == brute(spark, folder)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SOURCE}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_ids_and_clashing_names(spark, folder, tmp_path):
    """Rows without an id stay unless they copy another text; further columns, also of names the stages use, stay as they are."""
    text = "nobody else has written these words about the old mill by the river down here today"
    rows = [(None, text, 1, "a"), (None, "some other words without an id at all", 2, "b"), (5, text, 3, "c"), (6, None, 4, "d"), (7, "", 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int, th string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "root", "th"], name
    kept = {(r.doc_id, r.text, r.root, r.th) for r in docs.collect()}
    assert kept == {(5, text, 3, "c"), (None, "some other words without an id at all", 2, "b"), (6, None, 4, "d")}
