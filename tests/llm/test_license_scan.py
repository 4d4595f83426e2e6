from panelmill.llm import op8_license_scan as op
from tests.oracle import compare, connect


def test_query_against_twin(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), folder, "op8", op.query, op.ORACLE_SQL)[0] == "ok"


def test_sequences_order_and_edge_rows(spark):
    s = op.SENTENCES
    rows = [
        (2, f"{s['bsd_grant']} other words. {s['bsd_source']}"),
        (3, f"{s['mit_short']} More. {s['apache_short']}  {s['mit_short']}"),
        (4, s["mit_grant"].upper().replace(" ", "  ") + "\n\n" + s["mit_notice"]),
        (5, None), (6, ""), (6, ""), (None, "no licence " * 50_000 + ". " + s["cc_by"]), (8, "not " + s["mit_short"]),
        (10, f"{s['bsd_grant']}\n{s['bsd_source']}\n{s['bsd_names']}"), (1, f"{s['bsd_grant']}\n1. {s['bsd_source']}"),
        (9, f"{s['bsd_grant']}\n{s['bsd_source']}\n{s['bsd_grant']}"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, LICENSES int")
    got = {r.doc_id: r.licenses for r in op.scan(df).collect()}
    assert got == {
        1: ["BSD-2-Clause"], 2: [], 3: ["Apache-2.0", "MIT"], 4: ["MIT"], 5: [], 6: [], None: ["CC-BY-4.0"], 8: [], 9: ["BSD-2-Clause"], 10: ["BSD-3-Clause"],
    }
    assert op.scan(df.limit(0)).collect() == []
