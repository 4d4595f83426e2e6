import random

import pytest

import corpus_pipeline
from panelmill.llm import near_texts as op


def grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """Indices of the kept (id, text): connected components of Jaccard >= 0.8 over all pairs."""
    rows = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in range(len(rows))}, rows


def planted():
    """Families of near copies (also chains), texts with a common passage, and strangers."""
    rng, words = random.Random(5), [f"w{i}" for i in range(3000)]
    passage, rows = " ".join(rng.choices(words, k=40)), []
    for family in range(12):
        text = rng.choices(words, k=rng.randint(6, 200))
        for _ in range(rng.randint(1, 25)):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
        if family % 3 == 0:
            rows += [passage + " " + " ".join(rng.choices(words, k=rng.randint(2, 160))) for _ in range(12)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def kept(df):
    return sorted((r.doc_id, r.text or "") for r in op.keep_first(df).collect())


def test_against_brute_force(spark):
    rows = planted()
    roots, ordered = brute(rows)
    assert len(roots) < len(rows) - 40
    got = kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got == sorted(ordered[i] for i in roots)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_tables_against_brute_force(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text")
    roots, ordered = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert kept(docs) == sorted(ordered[i] for i in roots)


def test_stage_removes_what_three_bits_do_not_reach(spark):
    words = [f"word{i}" for i in range(120)]
    other = words[:60] + ["changed"] + words[61:]  # 5 of 116 shingles differ
    rows = [(4, " ".join(words), "en"), (9, " ".join(other), "en"), (5, "a text of its own with some words", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [4, 5]


def test_rows_of_one_id_are_decided_alone(spark):
    one, two = "a text of some words that is long enough to have shingles", "quite another text with words that nobody else has written down"
    rows = [(3, one), (7, two), (7, one), (None, one), (None, "only here without any id at all"), (8, None), (8, ""), (8, "")]
    assert sorted(((r.doc_id, r.text or "") for r in op.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == sorted(
        [(3, one), (7, two), (None, "only here without any id at all"), (8, "")], key=str
    )
    assert op.keep_first(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_members_far_apart_in_a_family_do_not_meet_as_all_pairs(spark, monkeypatch):
    """Copies with many edits share most shingles with their family but are similar to none of it."""
    rng, words, tried, possible = random.Random(8), [f"w{i}" for i in range(5000)], [], op._possible
    base, rows = rng.choices(words, k=150), []
    for i in range(600):
        text = list(base)
        for at in rng.sample(range(150), i % 10):
            text[at] = f"edit{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    rows.append((600, " ".join(base[:120])))  # shorter: joins the family by its size
    monkeypatch.setattr(op, "_possible", lambda pairs, *rest: tried.append(pairs.count()) or possible(pairs, *rest))
    roots, ordered = brute(rows)
    assert 100 < len(roots) < 500
    assert kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == sorted(ordered[i] for i in roots)
    assert sum(tried) < 10 * len(rows), tried


def test_pairs_of_unequal_sizes_and_of_three_texts_are_all_compared(spark):
    """Each text is a prefix of the next: similar by 0.8 to some that are longer or shorter by up to a quarter."""
    words = [f"n{i}" for i in range(400)]
    rows = [(i, " ".join(words[:n])) for i, n in enumerate([60, 74, 75, 92, 93, 118, 140, 141, 200, 249, 250, 251, 320, 400, 9, 10, 4])]
    roots, ordered = brute(rows)
    assert kept(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(ordered[i] for i in roots)


def test_sample_and_list_of_frequent_shingles_change_no_row(spark, monkeypatch):
    for name, value in (("LISTED", 3), ("SAMPLE", 1), ("FREQUENT", 1), ("SEEN", 2)):
        monkeypatch.setattr(op, name, value)
    roots, ordered = brute(rows := planted())
    assert kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == sorted(ordered[i] for i in roots)
