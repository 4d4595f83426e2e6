import random

from panelmill.llm import op5_decontamination as op


def plain(item, text, budget):
    """Smallest distance of the item to any substring, by the whole table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best if best <= budget else None


def test_against_whole_table():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 90)))
    items = [(i, op.normal(word())) for i in range(30)] + [(99, "a" * 60), (98, "a" * 60)]
    searcher = op.Searcher(items)
    for _ in range(150):
        text = word() * rng.randint(1, 3)
        for _ in range(rng.randint(0, 2)):
            piece = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(piece) + 1)
                piece[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
            text += "".join(piece)
        text = op.normal(text + rng.choice(["", "a" * 70]))
        got = {}
        for i, start, stop, distance in searcher.search(text):
            got[i] = min(distance, got.get(i, 99))
            assert plain(dict(items)[i], text[start:stop], distance) == distance
        want = {i: d for i, t in items if t and (d := plain(t, text, len(t) // op.RATE)) is not None}
        assert got == want


def test_table(spark):
    folder = "/root/testdata/sf0.001"
    bench = [(r.item_id, op.normal(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {r.doc_id: op.normal(r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: set(r.item_ids) for r in op.query(spark, folder).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        assert {i for i, item in bench if item in t} <= got[d]
    short = [d for d, t in texts.items() if len(t) < 1500][:6]
    for d in short:
        assert got[d] == {i for i, item in bench if plain(item, texts[d], len(item) // op.RATE) is not None}


def test_blocks_and_edge_rows(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away from the hunter"
    docs = spark.createDataFrame(
        [(1, "X " * 30_000 + passage.upper(), 5), (2, None, 5), (3, "", 5), (None, passage.replace("lazy", "lzy"), 5), (4, "the quick brown fox", 5), (4, "the quick brown fox", 5)],
        "doc_id long, text string, HITS int",
    )
    bench = spark.createDataFrame([(7, passage), (8, passage), (9, None), (10, "  "), (None, "the"), (11, "fox jumps")], "item_id long, text string")
    whole = sorted(((r.doc_id, tuple(map(tuple, r.hits))) for r in op.passages(docs, bench).collect()), key=str)
    small = sorted(((r.doc_id, tuple(sorted(map(tuple, r.hits)))) for r in op.passages(docs, bench, block=10).collect()), key=str)
    assert whole == small and {d: {h[0] for h in hits} for d, hits in whole} == {1: {7, 8, 11}, 2: set(), 3: set(), None: {7, 8, 11}, 4: set()}
    assert sorted(r.doc_id for r in op.keep_clean(docs, bench).collect()) == [2, 3, 4, 4]
    assert op.keep_clean(docs, bench.limit(0)).count() == 6 and op.passages(docs.limit(0), bench).collect() == []
