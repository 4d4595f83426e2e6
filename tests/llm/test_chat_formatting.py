import hashlib

from panelmill.llm import op1_chat_formatting as op
from tests.oracle import compare, connect


def test_query_against_twin(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), folder, "op1", op.query, op.ORACLE_SQL)[0] == "ok"


def test_edge_rows(spark):
    nasty = r"a\ \\ <s>[INST]x[:]y[+]z[/INST]</s> <\s> [\INST] [" + "\n"
    rows = [
        (1, 2, "assistant", nasty, 9), (1, 1, "user", None, 9), (1, 1, "user", None, 9), (1, 3, "assistant", "", 9), (1, None, None, "first", 9),
        (2, 0, "[:]\n</s>", nasty, 9), (None, 0, "assistant", "lonely", 9), (3, 0, "assistant", "word " * 200_000, 9),
    ]
    rows += [(7, i, "assistant" if i % 5 == 0 else f"r{i % 3}", f"{i}é[+]", 9) for i in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, AT int")
    parts = op.pieces(df)
    got = {r.conv_id: r for r in op.conversations(parts).select("*", op.read_back(op.F.col("formatted")).alias("turns")).collect()}
    assert max(r.n_turns for r in parts.collect()) <= op.CHUNK
    for conv in {r[0] for r in rows}:
        want = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, _, r, x in want]
        assert got[conv].loss == "".join(x for _, _, r, x in want if r == "assistant")
    assert got[1].formatted.count("[/INST]") == 2 and got[1].formatted.count("<s>") == 1  # neighbours of one role share a block
    digest = {r.conv_id: r for r in op.digests(op.conversations(parts)).collect()}[None]
    assert digest.turns_sha256 == hashlib.sha256(b"assistant\nlonely\n").hexdigest()
    assert op.digests(op.conversations(op.pieces(df.limit(0)))).collect() == []


def test_plan_is_native(spark):
    plan = op.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
