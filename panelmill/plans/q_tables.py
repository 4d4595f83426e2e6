"""Scans, sources, sinks (A); projections and filters (B); joins (C)."""

from pyspark.sql import functions as F

from panelmill.functions.columns import parse_any_date, snap
from panelmill.operators import features, models, news, panel, splits
from panelmill.plans import config
from panelmill.plans.registry import query
from panelmill.session import shared_folder
from panelmill.sources import tables as src

BARS = "SELECT ticker, dt, isin, sector, SNAP6(open) AS open, SNAP6(high) AS high, SNAP6(low) AS low, SNAP6(close) AS close, volume FROM bars_v"


def s6(*names):
    return [snap(n).alias(n) for n in names]


def shown(bars):
    return bars.select("ticker", "dt", "isin", "sector", *s6("open", "high", "low", "close"), "volume")


def bars_csv(t):
    return src.write_table(t.bars.select(*[c.split()[0] for c in src.BARS_SCHEMA.split(", ")]), shared_folder(t.spark, "bars") + ".csv", "csv")


@query("a01_read_bars", BARS)
def a01(t):
    return shown(src.read_bars(t.spark, bars_csv(t)))


@query("a02_read_series", "SELECT dt, SNAP6(usd_sell_rate) AS usd_egp, SNAP6(cbe_lending_rate) AS cbe_rate FROM macro_v")
def a02(t):
    path = src.write_table(t.macro.select("dt", "usd_sell_rate", "cbe_lending_rate"), shared_folder(t.spark, "macro") + ".csv", "csv")
    s = src.read_series(
        t.spark, path, "dt date, usd_sell_rate double, cbe_lending_rate double", {"usd_sell_rate": "usd_egp", "cbe_lending_rate": "cbe_rate"}
    )
    return s.select("dt", *s6("usd_egp", "cbe_rate"))


def article_lines(t):
    """Articles as JSON lines, every tenth line cut off."""
    line = F.to_json(F.struct("seq", "title", "text", "url", "sentiment", F.col("dt").cast("string").alias("published")))
    cut = F.when(F.col("seq") % 10 == 0, F.left(line, F.length(line) - 1)).otherwise(line)
    path = shared_folder(t.spark, "articles") + ".jsonl"
    t.articles.select(cut.alias("value")).write.text(path)
    return path


@query("a03_read_articles", "SELECT seq, title, url, sentiment, length(text) AS n_chars, CAST(dt AS VARCHAR) AS published FROM articles_v WHERE seq % 10 <> 0")
def a03(t):
    a = src.read_articles(t.spark, article_lines(t))
    return a.select("seq", "title", "url", "sentiment", F.length("text").cast("long").alias("n_chars"), "published")


@query("a04_read_table", "SELECT 'csv' AS fmt, count(*) AS n, floor(sum(close) * 100 + 0.5) / 100 AS total FROM bars_v UNION ALL SELECT 'jsonl', count(*), floor(sum(close) * 100 + 0.5) / 100 FROM bars_v")
def a04(t):
    schema = "ticker string, dt date, close double"
    out = None
    for ending, fmt in (("csv", "csv"), ("jsonl", "json")):
        path = src.write_table(t.bars.select("ticker", "dt", "close"), f"{shared_folder(t.spark, 'table')}.{ending}", fmt)
        one = src.read_table(t.spark, path, schema).agg(
            F.lit(ending).alias("fmt"), F.count(F.lit(1)).alias("n"), snap(F.sum("close"), 2).alias("total")
        )
        out = one if out is None else out.union(one)
    return out


@query("a05_write_table", "SELECT ticker, dt, SNAP6(close) AS close, volume FROM traded_v")
def a05(t):
    root = shared_folder(t.spark, "clean")
    src.write_table(t.traded.withColumn("year", F.year("dt")), root, raw=(t.folder,), partition_by=("year",))
    return t.spark.read.parquet(root).select("ticker", "dt", snap("close").alias("close"), "volume")


@query("a06_append_rows", "SELECT seq, title, dt FROM articles_v")
def a06(t):
    root = shared_folder(t.spark, "appended")
    a = t.articles.select("seq", "title", "dt")
    src.append_rows(a.filter("dt < DATE '1996-04-01'"), root)
    src.append_rows(a.filter("dt >= DATE '1996-04-01'"), root)
    return t.spark.read.schema("seq long, title string, dt date").json(root)


@query(
    "a07_replace_with_backup",
    """SELECT 'current' AS copy, count(DISTINCT url) AS n FROM articles_v UNION ALL SELECT 'backup', count(*) FROM articles_v""",
)
def a07(t):
    root = shared_folder(t.spark, "store")
    src.replace_with_backup(t.articles, root)
    current, backup = src.replace_with_backup(news.dedupe_url(t.articles), root)
    n = lambda path, name: t.spark.read.parquet(path).agg(F.lit(name).alias("copy"), F.count(F.lit(1)).alias("n"))
    return n(current, "current").union(n(backup, "backup"))


@query("a08_write_key_list", "SELECT ticker FROM training_v GROUP BY ticker HAVING count(*) >= 300")
def a08(t):
    path = src.write_key_list(panel.eligible_keys(t.training, 300), "ticker", shared_folder(t.spark, "keys"))
    return t.spark.read.text(path).withColumnRenamed("value", "ticker")


ANCHOR_SQL = r"""(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>"""


@query(
    "a09_extract_links",
    f"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '{ANCHOR_SQL}', 1) AS h, regexp_extract_all(html, '{ANCHOR_SQL}', 2) AS x FROM pages),
    l AS (SELECT page_id, url, unnest(h) AS href, unnest(x) AS x, unnest(range(len(h))) AS pos FROM a)
    SELECT page_id, pos, trim(regexp_replace(x, '<[^>]*>', '', 'g')) AS title,
      CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), href)
      ELSE concat(CASE WHEN ends_with(regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/|/)?)', 1), '/') THEN regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/|/)?)', 1)
        ELSE concat(regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/|/)?)', 1), '/') END, href) END AS link
    FROM l WHERE pos < 15 AND href <> '' AND trim(regexp_replace(x, '<[^>]*>', '', 'g')) <> ''""",
)
def a09(t):
    return news.extract_links(t.read("pages"))


@query(
    "a10_extract_labelled_value",
    r"""WITH r AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<ul[^>]*>.*?</ul>', 0), lambda x: contains(x, 'the'))[1] AS row FROM pages),
    c AS (SELECT page_id, regexp_extract_all(row, '(?is)<li[^>]*>(.*?)</li>', 1)[3] AS cell FROM r)
    SELECT page_id, replace(trim(regexp_replace(cell, '(?s)<[^>]*>', '', 'g')), ',', '') AS cell_text,
    TRY_CAST(replace(trim(regexp_replace(cell, '(?s)<[^>]*>', '', 'g')), ',', '') AS DOUBLE) AS cell_value FROM c""",
)
def a10(t):
    return news.extract_labelled_value(t.read("pages"), "the", 2, "ul", "li")


def strip_sql(x):
    out = rf"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, text in news.ENTITY_TEXT.items():
        out = f"replace({out}, '{entity}', '{text}')"
    return rf"trim(regexp_replace({out}, '[ \t\r\n]+', ' ', 'g'))"


@query(
    "a11_extract_guarded_number",
    rf"""SELECT page_id, list_filter(list_transform(regexp_extract_all({strip_sql('html')}, '[\d,]+\.?\d*', 0), lambda s: TRY_CAST(replace(s, ',', '') AS DOUBLE)), lambda v: v > 1 AND v < 100000)[1] AS number FROM pages""",
)
def a11(t):
    return news.extract_guarded_number(t.read("pages"), 1, 100000)


@query(
    "a12_extract_article_text",
    f"""WITH x AS (SELECT page_id, {strip_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title,
    {strip_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS summary, {strip_sql("regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)")} AS body FROM pages)
    SELECT page_id, title, CASE WHEN length(body) < 100 THEN concat(title, '. ', summary) ELSE body END AS text FROM x""",
)
def a12(t):
    return news.extract_article_text(t.read("pages"))


MARKET = ["usd_sell_rate", "gold_24k", "cbe_lending_rate", "oil", "vix"]


@query("a13_load_market_frame", "SELECT ticker, dt, SNAP6(close) AS close, " + ", ".join(f"SNAP6({c}) AS {c}" for c in MARKET) + " FROM market_v")
def a13(t):
    return t.market.select("ticker", "dt", *s6("close", *MARKET))


# ------------------------------------------------------------------------------- B


@query("b01_select_available", "SELECT ticker, dt, SNAP6(close) AS close FROM bars_v")
def b01(t):
    return panel.select_available(t.bars, ["ticker", "dt", "rate_spread", "close"]).withColumn("close", snap("close"))


@query("b02_feature_columns", "SELECT ticker, dt, " + ", ".join(f"SNAP6({c}) AS {c}" for c in features.TRAINING_FEATURES) + " FROM training_v")
def b02(t):
    cols = panel.feature_columns(t.training, ["target_buffered", "close"])
    return t.training.select("ticker", "dt", *s6(*cols))


ENDO, EXO = ["cumret_w0", "cumret_w1", "vol_change_w0w1"], ["macro_usd_egp_change", "macro_cbe_lending_rate_level"]


@query("b03_feature_set", "SELECT ticker, dt, " + ", ".join(f"SNAP6({c}) AS {c}" for c in ENDO + EXO) + " FROM samples_v")
def b03(t):
    sets = {"endogenous": ENDO, "exogenous": EXO, "all": ENDO + EXO}
    return t.samples.select("ticker", "dt", *s6(*sets["all"]))


@query("b04_assert_no_forbidden", "SELECT count(*) AS n FROM training_v")
def b04(t):
    return panel.assert_no_forbidden(t.training, features.RAW_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


@query("b05_assert_required", "SELECT count(*) AS n FROM bars_v")
def b05(t):
    return panel.assert_required(t.bars, ["dt", "ticker", "open", "high", "low", "close", "volume"]).agg(F.count(F.lit(1)).alias("n"))


@query("b06_drop_suspended", "SELECT ticker, dt, SNAP6(close) AS close, volume FROM traded_v")
def b06(t):
    return t.traded.select("ticker", "dt", snap("close").alias("close"), "volume")


@query(
    "b07_clip_filter",
    """SELECT ticker, dt, SNAP6(ret) AS ret FROM (SELECT ticker, dt, SNAP9(close / lag(close) OVER (PARTITION BY ticker ORDER BY dt) - 1) AS ret FROM bars_v) WHERE ret BETWEEN -0.5 AND 0.5""",
)
def b07(t):
    r = t.bars.select("ticker", "dt", snap(panel.pct_change("close", 1, panel.by_key()), 9).alias("ret"))
    return panel.clip_filter(r, "ret", -0.5, 0.5).withColumn("ret", snap("ret"))


@query("b08_drop_nulls", "SELECT dt, SNAP6(oil) AS oil, SNAP6(usd_sell_rate) AS usd_sell_rate FROM series_v WHERE oil IS NOT NULL AND usd_sell_rate IS NOT NULL")
def b08(t):
    s = panel.merge_series(t.macro, t.globals).select("dt", *s6("oil", "usd_sell_rate"))
    return s.dropna(subset=["oil", "usd_sell_rate"])


@query("b09_drop_neutral", "SELECT ticker, dt, SNAP6(ratio) AS ratio, target FROM samples_v")
def b09(t):
    return t.samples.select("ticker", "dt", snap("ratio").alias("ratio"), "target")


@query(
    "b10_recent",
    """SELECT seq, 'dated' AS form FROM articles_v WHERE seq % 7 <> 0 AND dt >= DATE '1996-07-12' UNION ALL
    SELECT seq, 'undated kept' FROM articles_v WHERE seq % 7 = 0 OR dt >= DATE '1996-07-12'""",
)
def b10(t):
    a = t.articles.withColumn("published", F.when(F.col("seq") % 7 == 0, "n/a").otherwise(F.col("dt").cast("string")))
    day, cut = parse_any_date("published"), F.lit("1996-07-12").cast("date")
    rows = lambda keep, form: news.recent(a, day, cut, keep).select("seq", F.lit(form).alias("form"))
    return rows(False, "dated").union(rows(True, "undated kept"))


KW = " OR ".join(f"contains(lower(text), '{k.lower()}')" for k in config.KEYWORDS)


@query("b11_match_any_keyword", f"SELECT seq, title FROM articles_v WHERE {KW}")
def b11(t):
    return t.articles.filter(news.match_any_keyword(F.col("text"), config.KEYWORDS)).select("seq", "title")


@query("b12_is_unscored", "SELECT seq, url FROM articles_v WHERE sentiment IS NULL OR sentiment IN ('', 'unknown')")
def b12(t):
    return t.articles.filter(news.is_unscored()).select("seq", "url")


@query("b13_date_between", "SELECT ticker, dt, SNAP6(close) AS close FROM bars_v WHERE dt BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def b13(t):
    return t.bars.filter(F.col("dt").between("1995-01-01", "1995-12-31")).select("ticker", "dt", snap("close").alias("close"))


@query(
    "b14_eligible_keys",
    " UNION ALL ".join(f"SELECT ticker, count(*) AS n, {m} AS min_rows FROM training_v GROUP BY ticker HAVING count(*) >= {m}" for m in (193, 200, 300, 445)),
)
def b14(t):
    n = t.training.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    floors = F.explode(F.array(*[F.lit(m) for m in (193, 200, 300, 445)])).alias("min_rows")
    return n.select("ticker", "n", floors).filter("n >= min_rows")


@query("b15_eligible_baseline", "SELECT ticker, SNAP6(endo_f1) AS endo_f1 FROM report_v WHERE endo_f1 >= 0.25")
def b15(t):
    return models.eligible_baseline(models.compare_feature_sets(t.scores)).select("ticker", snap("endo_f1").alias("endo_f1"))


@query(
    "b16_split_size_guard",
    """SELECT ticker, count(*) AS n_rows, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test
    FROM split_v GROUP BY ticker HAVING count(*) >= 100 AND count(*) FILTER (WHERE split = 'train') >= 50 AND count(*) FILTER (WHERE split = 'val') >= 10 AND count(*) FILTER (WHERE split = 'test') >= 20""",
)
def b16(t):
    return splits.split_size_guard(splits.purged_split(t.samples.select("ticker", "dt")))


@query("b17_valid_article", "SELECT seq FROM articles_v WHERE title IS NOT NULL AND url IS NOT NULL AND sentiment IS NOT NULL")
def b17(t):
    return t.articles.filter(news.valid_article("title", "url", "sentiment")).select("seq")


@query(
    "b18_invalid_price",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE high < low OR close < 0) AS n_invalid, count(*) FILTER (WHERE close < 1000 OR close IS NULL) AS n_low FROM bars_v""",
)
def b18(t):
    return t.bars.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if((F.col("high") < F.col("low")) | (F.col("close") < 0)).alias("n_invalid"),
        F.count_if((F.col("close") < 1000) | F.col("close").isNull()).alias("n_low"),
    )


# ------------------------------------------------------------------------------- C


@query("c01_join_macro", "SELECT ticker, b.dt, SNAP6(close) AS close, SNAP6(usd_sell_rate) AS usd_sell_rate, SNAP6(cbe_lending_rate) AS cbe_lending_rate FROM bars_v b LEFT JOIN macro_v m ON m.dt = b.dt")
def c01(t):
    j = panel.join_macro(t.bars, t.macro.select("dt", "usd_sell_rate", "cbe_lending_rate"))
    return j.select("ticker", "dt", *s6("close", "usd_sell_rate", "cbe_lending_rate"))


@query("c02_merge_series", "SELECT dt, SNAP6(usd_sell_rate) AS usd_sell_rate, SNAP6(oil) AS oil, SNAP6(vix) AS vix FROM series_v")
def c02(t):
    return panel.merge_series(t.macro, t.globals).select("dt", *s6("usd_sell_rate", "oil", "vix"))


@query("c03_align_news_price", "SELECT sector, dt, SNAP6(score) AS score, SNAP6(close) AS close FROM sector_news_v")
def c03(t):
    return t.sector_news.select("sector", "dt", *s6("score", "close"))


# bars of the first suppliers carry the tickers of the tagged entities by position
LINK = "['" + "','".join(config.TICKERS) + "'][CAST(substr(ticker, 2) AS INT) % 8 + 1]"


@query(
    "c04_join_sentiment",
    f"""SELECT b.ticker, b.dt, SNAP6(close) AS close, SNAP6(direct_sentiment) AS direct_sentiment, direct_count, sector_count
    FROM (SELECT *, {LINK} AS entity FROM bars_v) b LEFT JOIN stock_day_v s ON s.dt = b.dt AND s.ticker = b.entity""",
)
def c04(t):
    # one row per day, so the bars are not shuffled; a day has one entry per listed entity
    values = ["direct_sentiment", "direct_count", "sector_count"]
    entry = F.struct(F.col("ticker"), F.struct(*values))
    days = t.stock_days.filter("dt IS NOT NULL").groupBy("dt").agg(F.map_from_entries(F.collect_list(entry)).alias("news"))
    j = panel.join_macro(entity_bars(t), days).withColumn("_day", F.col("news")[F.col("entity")])
    j = j.withColumns({c: F.col(f"_day.{c}") for c in values})
    return j.select("ticker", "dt", *s6("close", "direct_sentiment"), "direct_count", "sector_count")


def entity_bars(t):
    names = F.array(*[F.lit(x) for x in config.TICKERS])
    return t.bars.withColumn("entity", F.element_at(names, (F.substring("ticker", 2, 9).cast("int") % 8 + 1)))


@query(
    "c05_only_new",
    """SELECT ticker, dt FROM bars_v b WHERE NOT EXISTS (SELECT 1 FROM traded_v t WHERE t.ticker = b.ticker AND t.dt = b.dt)""",
)
def c05(t):
    return panel.only_new(t.bars, t.traded, "ticker", "dt").select("ticker", "dt")


@query("c05b_only_new_url", "SELECT seq, url FROM articles_v WHERE url NOT IN (SELECT url FROM articles_v WHERE dt < DATE '1996-03-01')")
def c05b(t):
    return panel.only_new(t.articles, t.articles.filter("dt < DATE '1996-03-01'"), "url").select("seq", "url")


@query("c06_restrict_to", "SELECT ticker, dt, SNAP6(close) AS close FROM bars_v WHERE ticker IN ('S1', 'S7', 'S42')")
def c06(t):
    return panel.restrict_to(t.bars, ["S1", "S7", "S42"]).select("ticker", "dt", snap("close").alias("close"))


@query(
    "c07_asof_macro",
    """SELECT b.ticker, b.dt, SNAP6(r.v) AS cbe_lending_rate, SNAP6(i.v) AS headline_inflation FROM bars_v b
    ASOF LEFT JOIN (SELECT dt, cbe_lending_rate AS v FROM macro_v WHERE cbe_lending_rate IS NOT NULL) r ON b.dt >= r.dt
    ASOF LEFT JOIN (SELECT dt, headline_inflation AS v FROM macro_v WHERE headline_inflation IS NOT NULL) i ON b.dt >= i.dt""",
)
def c07(t):
    j = panel.asof_macro(t.bars.select("ticker", "dt"), t.macro.select("dt", "cbe_lending_rate", "headline_inflation"))
    return j.select("ticker", "dt", *s6("cbe_lending_rate", "headline_inflation"))


@query(
    "c08_effective_lookup",
    "SELECT ticker, dt, rate FROM (SELECT b.ticker, b.dt, s.rate FROM bars_v b ASOF LEFT JOIN steps_v s ON b.dt >= s.eff_date)",
)
def c08(t):
    return panel.effective_lookup(t.bars.select("ticker", "dt"), config.STEPS)


@query(
    "c08b_effective_join",
    "SELECT ticker, dt, rate FROM (SELECT b.ticker, b.dt, s.rate FROM bars_v b ASOF LEFT JOIN steps_v s ON b.dt >= s.eff_date)",
)
def c08b(t):
    steps = t.spark.createDataFrame(config.STEPS, "d string, rate double").select(F.col("d").cast("date").alias("eff_date"), "rate")
    return panel.effective_join(t.bars.select("ticker", "dt"), steps)


@query(
    "c09_after_high_water",
    """WITH e AS (SELECT ticker, max(dt) AS hw FROM bars_v WHERE dt < DATE '1997-01-01' AND ticker <> 'S3' GROUP BY ticker)
    SELECT b.ticker, b.dt, SNAP6(close) AS close FROM bars_v b LEFT JOIN e ON e.ticker = b.ticker WHERE hw IS NULL OR b.dt > hw""",
)
def c09(t):
    old = t.bars.filter("dt < DATE '1997-01-01' AND ticker <> 'S3'")
    return panel.after_high_water(t.bars, old).select("ticker", "dt", snap("close").alias("close"))


@query("c10_date_key_grid", "SELECT DISTINCT a.dt, e.ticker FROM articles_v a CROSS JOIN entity_v e")
def c10(t):
    return panel.date_key_grid(t.articles, config.TICKERS)


@query("c11_tag_entities", "SELECT seq, ticker FROM tags_v")
def c11(t):
    return news.mentions(t.articles, config.ALIASES).select("seq", "ticker")


@query("c12_peer_mentions", "SELECT seq, ticker, sector FROM peer_v")
def c12(t):
    return news.peer_mentions(t.articles, config.ALIASES, config.SECTOR_MAP)


@query(
    "c13_enrich_metadata",
    """WITH c AS (SELECT ticker, max(sector) AS sector FROM bars_v WHERE isin < 'G' GROUP BY ticker),
    f AS (SELECT ticker, concat('static ', max(sector)) AS sector FROM bars_v WHERE isin > 'R' GROUP BY ticker)
    SELECT b.ticker, b.dt, coalesce(c.sector, f.sector, 'N/A') AS sector FROM bars_v b LEFT JOIN c ON c.ticker = b.ticker LEFT JOIN f ON f.ticker = b.ticker""",
)
def c13(t):
    one = lambda rows, v: rows.groupBy("ticker").agg(v.alias("sector"))
    cache = one(t.bars.filter("isin < 'G'"), F.max("sector"))
    fallback = one(t.bars.filter("isin > 'R'"), F.concat(F.lit("static "), F.max("sector")))
    feed = t.bars.select("ticker", "dt", F.lit(None).cast("string").alias("sector"))
    return panel.enrich_metadata(feed, cache, fallback, ["sector"])


@query("c15_align_series", "SELECT sector, dt, SNAP6(d) AS d_close, SNAP6(score) AS score FROM (SELECT sector, dt, score, close - lag(close) OVER (PARTITION BY sector ORDER BY dt) AS d FROM sector_news_v) s WHERE sector IS NOT NULL AND d IS NOT NULL AND score IS NOT NULL")
def c15(t):
    price = t.sector_news.select("sector", "dt", (F.col("close") - F.lag("close").over(panel.by_key("sector"))).alias("d_close"))
    return panel.align_series(price, t.sector_news.select("sector", "dt", "score"), "sector", "dt").select("sector", "dt", *s6("d_close", "score"))
