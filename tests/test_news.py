"""News, pages, replies and dates on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelmill.functions import columns as fn
from panelmill.operators import news

DAY = dt.date(2024, 1, 1)
ALIASES = {"WE": ["delta telecom"], "EAST": ["Eastern Mills"], "BANK": ["Commercial Bank"], "OTHER": []}
SECTORS = {"Telecom": ["WE"], "Consumer": ["EAST", "OTHER"], "Banks": ["BANK"]}


def articles(spark, texts, sentiments=None):
    rows = [(i, t, t, f"u{i}", (sentiments or ["positive"] * len(texts))[i], DAY) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "seq long, title string, text string, url string, sentiment string, dt date")


def test_alias_is_raw_containment(spark):
    got = news.with_tags(articles(spark, ["However, the Eastern Mills rose", "nothing", "COMMERCIAL BANK"]), ALIASES).orderBy("seq").collect()
    # "However" holds "we": the over-match is the rule
    assert [sorted(r["tags"]) for r in got] == [["EAST", "WE"], [], ["BANK"]]


def plain_stock_days(rows):
    """The nested-loop form for one day."""
    score = {"positive": 1, "negative": -1}
    tag = lambda x: {t for t, ws in ALIASES.items() if t.lower() in x.lower() or any(w.lower() in x.lower() for w in ws)}
    mean = lambda v: sum(v) / len(v) if v else 0.0
    out = {}
    for sector, tickers in SECTORS.items():
        for t in tickers:
            direct = [score.get(s, 0) for x, s in rows if t in tag(x)]
            peers = [score.get(s, 0) for x, s in rows if t not in tag(x) and (tag(x) & (set(tickers) - {t}) or sector.lower() in x.lower())]
            out[t] = (mean(direct), mean(peers), len(direct), len(peers))
    return out


def test_stock_day_sentiment_equals_the_loops(spark):
    texts = ["Eastern Mills falls", "OTHER gains while telecom sleeps", "banks and consumer news", "delta telecom signs with Commercial Bank", "plain"]
    moods = ["negative", "positive", "Very Positive", "neutral", None]
    got = {r["ticker"]: r for r in news.stock_day_sentiment(articles(spark, texts, moods), ALIASES, SECTORS).collect()}
    want = plain_stock_days([(x, "positive" if m == "Very Positive" else m) for x, m in zip(texts, moods)])
    assert {k: (r["direct_sentiment"], r["sector_sentiment"], r["direct_count"], r["sector_count"]) for k, r in got.items()} == want


def test_url_dedupe_prefers_longer_then_first(spark):
    rows = [(0, "u", "aa"), (1, "u", "bbbb"), (2, "u", "cccc"), (3, " ", "x"), (4, None, "x"), (5, "v", "")]
    df = spark.createDataFrame(rows, "seq long, url string, text string")
    assert sorted(r["seq"] for r in news.dedupe_url(df).collect()) == [1, 5]


def test_links_cells_and_numbers(spark):
    html = (
        '<nav><a href="/x">One <b>two</b></a><a href="">none</a><a class="c" href="https://o.example/y">Out</a><a href="rel">Rel</a></nav>'
        "<script>var t='</p> 5000';</script><table><tr><td>Euro</td><td>50</td></tr><tr><td>US Dollar</td><td>47.1</td><td> 1,047.70 </td></tr></table>"
        "<p>year 24, price 6,495.5 per gram &amp; more</p>"
    )
    pages = spark.createDataFrame([(1, "http://h.example/a/b?q=1", html), (2, "http://h.example", "<p>no</p>")], "page_id long, url string, html string")
    links = [(r["pos"], r["title"], r["link"]) for r in news.extract_links(pages).orderBy("pos").collect()]
    assert links == [(0, "One two", "http://h.example/x"), (2, "Out", "https://o.example/y"), (3, "Rel", "http://h.example/a/rel")]
    value = {r["page_id"]: r["cell_value"] for r in news.extract_labelled_value(pages, "US Dollar", 2).collect()}
    assert value == {1: 1047.70, 2: None}
    number = {r["page_id"]: r["number"] for r in news.extract_guarded_number(pages, 2000, 10000).collect()}
    assert number == {1: 6495.5, 2: None}


def test_article_text_falls_back(spark):
    page = "<html><title>T &amp; U</title><h1>S</h1><article><p>short</p></article></html>"
    long = "<html><title>T</title><article>" + "<p>word</p>" * 40 + "</article></html>"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", long)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in news.extract_article_text(pages).collect()}
    assert got[1] == "T & U. S" and got[2] == " ".join(["word"] * 40)


def test_replies(spark):
    texts = ['so {"sentiment": "POSITIVE", "reasoning": "r"} end', '{"reasoning": "x"}', "{broken", "no json"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [tuple(r) for r in df.select("i", fn.parse_model_reply("t").alias("r")).orderBy("i").select("r.*").collect()]
    assert got == [("positive", "r"), ("neutral", "x"), ("neutral", "parsing_error"), ("neutral", "parsing_error")]


def test_dates_and_recent(spark):
    rows = [("2024-01-05", None), ("2024-01-05T10:00:00", None), ("soon", "2024-01-04 09:00:00"), ("2024-02-31", "bad"), (None, None)]
    df = spark.createDataFrame(rows, "date string, stamp string")
    day = fn.parse_any_date("date", "stamp")
    assert [r[0] and str(r[0]) for r in df.select(day).collect()] == ["2024-01-05", "2024-01-05", "2024-01-04", None, None]
    cut = F.lit("2024-01-05").cast("date")
    assert news.recent(df, day, cut, False).count() == 2 and news.recent(df, day, cut, True).count() == 4


def test_digest_takes_the_latest(spark):
    a = articles(spark, [f"EAST {i}" for i in range(60)], ["positive"] * 30 + ["negative"] * 30)
    r = news.market_digest(a, ALIASES).filter("ticker = 'EAST'").first()
    assert r["n_articles"] == 50 and r["positive_pct"] == 40.0 and r["headlines"].startswith("- EAST 59\n\n- EAST 58")


def test_lexicon_counts_the_whole_text(spark):
    text = "good " + "filler " * 5000 + "bad, bad"
    r = news.lexicon_sentiment(articles(spark, [text, "GOOD-good"]), {"good": 1, "bad": -1}).orderBy("seq").collect()
    assert [(x["lex_score"], x["lex_label"]) for x in r] == [(-1, "negative"), (2, "positive")]
