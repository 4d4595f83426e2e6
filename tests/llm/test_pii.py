import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelmill.llm import op6_pii as op
from tests.oracle import compare, connect

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            number = [int(c) for c in m[0] if c in "0123456789"]
            twice = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(number)))
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda n=number, t=twice: 14 <= len(n) <= 19 and t % 10 == 0,
                "phone": lambda n=number: 10 <= len(n) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def found(spark, texts):
    rows = op.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: [f"{s.kind}:{s.start}:{s.stop}" for s in r.spans if s.kind != "iban"] for r in rows}


def test_query_against_twin(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), folder, "op6", op.query, op.ORACLE_SQL)[0] == "ok"


def test_edge_texts(spark):
    texts = [
        None, "", "a@b.c@d.e_x@y.zz é😀 a@b a@b. a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 007.0255.1.1 1.2.3.4.",
        "4111 1111-1111 1111 4111  1111 1111 1111 4111111111111111-", "+1 (988) 555-2485 +1234567890123456 ++12 34 56 78 901",
        "x\u0001\u0002a@b.c\u0001 4111\u00021111\u00021111\u00021111 4111 1111 1111 1111", "1 " * 50_000, "9" * 2_000, "a" * 200_000 + "@b.c", "1.2.3.4 " * 300,
    ]
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == brute(text or ""), text and text[:60]
    assert found(spark, ["9" * 300_000 + " 1.2.3.4 x@y.zz"])[0] == ["ip:300001:300008", "email:300009:300015"]  # the plain patterns take minutes


def test_random_texts(spark):
    texts = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(alphabet="0123456789+-. ()@ab_é\u0001\u0002", max_size=60))
    def gather(text):
        texts.append(text)

    gather()
    texts += ["4539 1488 0343 6467 " + t for t in texts[:50]]
    got = found(spark, texts)
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_account_numbers_scores_and_masks(spark):
    text = "bank account GB82WEST12345698765432 or GB82WEST12345698765433, mail bob@x.org"
    df = spark.createDataFrame([(1, text, "en", "s", 0), (2, None, "en", "s", 7), (3, "nothing", None, None, 7)], "doc_id long, text string, lang string, source string, n_chars long")
    spans = op.find(df).where("doc_id = 1").first().spans
    assert [(s.kind, text[s.start : s.stop]) for s in spans] == [("iban", "GB82WEST12345698765432"), ("email", "bob@x.org")]
    assert [round(s.score, 2) for s in spans] == [1.0, 0.9]
    rows = {r.doc_id: r for r in op.redact(df).collect()}
    assert rows[1].text == "bank account <IBAN> or GB82WEST12345698765433, mail <EMAIL>" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[3].n_chars == 7
    assert op.redact(df).columns == df.columns


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (op.query(spark, "/root/testdata/sf0.001"), op.redact(docs).select(F.length("text"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_long_runs_of_labels(spark):
    long = "mail a@b" + ".c" * 200_000 + ". x@y.zz"
    assert found(spark, [long, "a@b..c a@b.-c.d..e q.r@s.t.", ".@a.b a.@b.c"]) == {
        0: ["email:5:400008", "email:400010:400016"],
        1: brute("a@b..c a@b.-c.d..e q.r@s.t."),
        2: brute(".@a.b a.@b.c"),
    }


def test_empty_repeated_and_clashing(spark):
    schema = "doc_id long, text string, spans string, spans_ string, __spans int"
    assert op.redact(spark.createDataFrame([], schema)).collect() == [] and op.find(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "write to bob@x.org", "s", "t", 4)] * 3 + [(None, "bob@x.org", None, "u", 5)]
    got = op.redact(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "spans", "spans_", "__spans"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "write to <EMAIL>", "s", "t", 4)] * 3 + [(None, "<EMAIL>", None, "u", 5)], key=str)
