"""Sorts, limits, top-k (F); set operations (G); scalar functions (H); UDF forms (J)."""

from functools import reduce

from pyspark.sql import functions as F

from panelmill.functions import columns as fn
from panelmill.functions.columns import snap
from panelmill.operators import learners, models, neardup, news, panel, splits, stats
from panelmill.plans import config
from panelmill.plans.q_stats import MI_FEATS, mi_sql
from panelmill.plans.registry import query


def s6(*names):
    return [snap(n).alias(n) for n in names]


@query("f01_order", "SELECT ticker, dt, SNAP6(close) AS close FROM bars_v ORDER BY ticker, dt DESC")
def f01(t):
    return t.bars.select("ticker", "dt", snap("close").alias("close")).orderBy("ticker", F.desc("dt"))


@query("f02_top_k", "SELECT ticker, SNAP6(f1_lift) AS f1_lift, SNAP6(auc_lift) AS auc_lift FROM report_v ORDER BY SNAP9(f1_lift) DESC, ticker LIMIT 5")
def f02(t):
    r = models.compare_feature_sets(t.scores)
    return r.orderBy(F.desc(snap("f1_lift", 9)), "ticker").limit(5).select("ticker", *s6("f1_lift", "auc_lift"))


@query(
    "f02b_bottom_k",
    """SELECT ticker, dt, SNAP6(r) AS daily_return FROM (SELECT ticker, dt, SNAP9(close / lag(close) OVER (PARTITION BY ticker ORDER BY dt) - 1) AS r FROM bars_v)
    WHERE r IS NOT NULL ORDER BY r, ticker, dt LIMIT 3""",
)
def f02b(t):
    r = t.bars.select("ticker", "dt", snap(panel.pct_change("close", 1, panel.by_key()), 9).alias("r")).filter("r IS NOT NULL")
    return r.orderBy("r", "ticker", "dt").limit(3).select("ticker", "dt", snap("r").alias("daily_return"))


@query("f03_top_features", f"WITH {mi_sql(MI_FEATS, 'samples_v', 'target')} SELECT feature, SNAP6(importance) AS importance FROM mi ORDER BY SNAP9(importance) DESC, feature LIMIT 3")
def f03(t):
    mi = stats.mutual_information(t.samples, MI_FEATS, "target").withColumn("importance", snap("importance", 9))
    return mi.orderBy(F.desc("importance"), "feature").limit(3).withColumn("importance", snap("importance"))


@query(
    "f04_first_n_per_group",
    "SELECT lang, seq, url, rank_no FROM (SELECT lang, seq, url, row_number() OVER (PARTITION BY lang ORDER BY dt DESC, seq) AS rank_no FROM articles_v) WHERE rank_no <= 50",
)
def f04(t):
    return news.first_n_per_group(t.articles.select("lang", "seq", "url", "dt"), ["lang"], [F.desc("dt"), F.asc("seq")], 50).drop("dt")


@query(
    "f05_last_n",
    """WITH l AS (SELECT coalesce(sentiment, 'unknown') AS sentiment FROM articles_v ORDER BY dt DESC, seq DESC LIMIT 100)
    SELECT sentiment, count(*) AS n, SNAP6(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM l) * 100) AS pct FROM l GROUP BY sentiment""",
)
def f05(t):
    last = t.articles.select("dt", "seq", F.coalesce("sentiment", F.lit("unknown")).alias("sentiment")).orderBy(F.desc("dt"), F.desc("seq")).limit(100)
    return stats.value_distribution(last, "sentiment")


MISSING = """WITH s AS (SELECT ticker, min(dt) AS f, (SELECT max(dt) FROM bars_v) AS l FROM bars_v GROUP BY ticker),
    c AS (SELECT ticker, CAST(unnest(generate_series({start}, l, INTERVAL 1 DAY)) AS DATE) AS dt FROM s),
    m AS (SELECT ticker, dt FROM c WHERE dayofweek(dt) NOT IN (5, 6) AND NOT EXISTS (SELECT 1 FROM bars_v b WHERE b.ticker = c.ticker AND b.dt = c.dt))"""


@query("f06_worst_gaps", MISSING.replace("{start}", "f") + " SELECT ticker, count(*) AS n_missing FROM m GROUP BY ticker ORDER BY n_missing DESC, ticker LIMIT 10")
def f06(t):
    m = panel.missing_trading_days(t.bars, None).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_missing"))
    return m.orderBy(F.desc("n_missing"), "ticker").limit(10)


# ------------------------------------------------------------------------------- G


@query(
    "g01_union_evolving",
    """SELECT dt, SNAP6(usd_sell_rate) AS usd_sell_rate, NULL::DOUBLE AS oil FROM macro_v UNION ALL SELECT dt, NULL, SNAP6(oil) FROM global_v""",
)
def g01(t):
    return panel.union_evolving(t.macro.select("dt", *s6("usd_sell_rate")), t.globals.select("dt", *s6("oil")))


@query("g02_distinct_rows", "SELECT DISTINCT ticker, sector, isin FROM bars_v")
def g02(t):
    return t.bars.select("ticker", "sector", "isin").distinct()


@query("g03_missing_trading_days", MISSING.replace("{start}", "greatest(f, l - 30)") + " SELECT ticker, dt FROM m")
def g03(t):
    return panel.missing_trading_days(t.bars, 30)


@query(
    "g04_trading_calendar",
    """SELECT dt FROM (SELECT CAST(unnest(generate_series((SELECT min(dt) FROM bars_v), (SELECT max(dt) FROM bars_v), INTERVAL 1 DAY)) AS DATE) AS dt) WHERE dayofweek(dt) NOT IN (5, 6)""",
)
def g04(t):
    span = t.bars.agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    return span.select(F.explode(panel.trading_calendar("a", "b")).alias("dt"))


@query(
    "g05_upsert",
    """SELECT ticker, dt, SNAP6(CASE WHEN dt >= DATE '1997-01-01' THEN close * 2 ELSE close END) AS close FROM bars_v""",
)
def g05(t):
    bars = t.bars.select("ticker", "dt", "close")
    base = bars.filter("dt < DATE '1998-01-01'")
    delta = bars.filter("dt >= DATE '1997-01-01'").withColumn("close", F.col("close") * 2)
    return panel.upsert(base, delta, ["ticker", "dt"]).select("ticker", "dt", snap("close").alias("close"))


@query("g06_combine_feeds", "SELECT seq, title, 'feed' AS origin FROM articles_v UNION ALL SELECT page_id, url, 'page' FROM pages")
def g06(t):
    a = t.articles.select("seq", "title", F.lit("feed").alias("origin"))
    b = t.read("pages").select(F.col("page_id").alias("seq"), F.col("url").alias("title"), F.lit("page").alias("origin"))
    return a.unionByName(b)


@query(
    "g07_dedupe_url",
    "SELECT seq, url, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY length(text) DESC, seq) AS rn FROM articles_v) WHERE rn = 1",
)
def g07(t):
    return news.dedupe_url(t.articles).select("seq", "url", "title")


@query("g08_dedupe_titles")
def g08(t):
    return neardup.dedupe_titles(t.articles).select("seq", "title")


@query("c14_fuzzy_title_matches")
def c14(t):
    # batches small enough that the given tables take several
    return neardup.title_matches(t.articles, first_batch=256)[1].withColumnRenamed("id", "seq")


# ------------------------------------------------------------------------------- H


@query(
    "h01_sentiment_score",
    """SELECT id, CASE WHEN contains(lower(x), 'positive') THEN 1 WHEN contains(lower(x), 'negative') THEN -1 ELSE 0 END::BIGINT AS by_substring,
    CASE x WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END::BIGINT AS by_exact, CASE x WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 END::BIGINT AS by_map
    FROM (SELECT event_id AS id, ['positive', 'Very Positive', 'negative', 'NEGATIVE', 'neutral', 'mixed'][event_id % 6 + 1] AS x FROM events)""",
)
def h01(t):
    labels = F.array(*[F.lit(x) for x in ("positive", "Very Positive", "negative", "NEGATIVE", "neutral", "mixed")])
    df = t.read("events").select(F.col("event_id").alias("id"), F.element_at(labels, (F.col("event_id") % 6 + 1).cast("int")).alias("x"))
    return df.select("id", fn.sentiment_score("x").alias("by_substring"), fn.sentiment_score("x", "exact").alias("by_exact"), fn.sentiment_score("x", "map").alias("by_map"))


@query(
    "h02_article_text",
    """SELECT seq, CASE WHEN seq % 3 = 0 THEN left(concat(coalesce(title, ''), '. ', lang), 500) ELSE left(text, 500) END AS excerpt FROM articles_v""",
)
def h02(t):
    body = F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.col("text"))
    return t.articles.select("seq", fn.article_text("title", "lang", body, 500).alias("excerpt"))


@query("h03_clean_key", "SELECT page_id, translate(url, '.:', '__') AS clean FROM pages")
def h03(t):
    return t.read("pages").select("page_id", fn.clean_key("url").alias("clean"))


@query(
    "h04_parse_any_date",
    """SELECT seq, CASE WHEN seq % 5 = 4 THEN NULL ELSE dt END AS parsed FROM articles_v""",
)
def h04(t):
    d = F.col("dt").cast("string")
    k = F.col("seq") % 5
    df = t.articles.select(
        "seq",
        F.when(k == 0, d).when(k == 1, F.concat(d, F.lit("T10:20:30"))).when(k == 2, F.lit("yesterday")).alias("date"),
        F.when(k == 2, F.concat(d, F.lit(" 08:00:00"))).alias("timestamp"),
        F.when(k == 3, d).otherwise("n/a").alias("published"),
    )
    return df.select("seq", fn.parse_any_date("date", "timestamp", "published").alias("parsed"))


@query("h05_format_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(ts + INTERVAL 2 HOUR AS DATE) AS local_day FROM events")
def h05(t):
    # Cairo is two hours ahead of UTC in January
    return t.ticks.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), fn.local_date("ts", "Africa/Cairo").alias("local_day"))


@query(
    "h06_age_days",
    "SELECT ticker, date_diff('day', max(dt), DATE '1999-01-01') AS age, date_diff('day', max(dt), DATE '1999-01-01') > 5 AS stale FROM bars_v GROUP BY ticker",
)
def h06(t):
    age = fn.age_days("last", F.lit("1999-01-01").cast("date"))
    return stats.last_date_per_key(t.bars).select("ticker", age.alias("age"), (age > 5).alias("stale"))


@query("h07_inf_null_to_zero", "SELECT ticker, dt, SNAP6(coalesce(close / nullif(volume, 0), 0)) AS price_per_share FROM bars_v")
def h07(t):
    return t.bars.select("ticker", "dt", snap(fn.zero_if_null(fn.ratio("close", "volume"))).alias("price_per_share"))


@query("h08_squared_loss", "SELECT ticker, dt, SNAP6((y - p_endo) * (y - p_endo)) AS loss FROM score_v")
def h08(t):
    return t.scores.select("ticker", "dt", snap(fn.squared_loss("y", "p_endo")).alias("loss"))


@query("h09_apply_threshold", "SELECT ticker, dt, CAST(CASE WHEN p_exo >= 0.55 THEN 1 ELSE 0 END AS BIGINT) AS yhat FROM score_v")
def h09(t):
    return t.scores.select("ticker", "dt", fn.apply_threshold("p_exo", F.lit(0.55)).alias("yhat"))


@query(
    "h10_feature_category",
    f"""WITH {mi_sql(MI_FEATS, 'samples_v', 'target')} SELECT feature, CASE WHEN starts_with(feature, 'price_') THEN 'Price' WHEN starts_with(feature, 'tech_') THEN 'Technical'
    WHEN starts_with(feature, 'macro_') THEN 'Macro' ELSE 'Other' END AS category FROM mi""",
)
def h10(t):
    return stats.mutual_information(t.samples, MI_FEATS, "target").select("feature", fn.feature_category("feature").alias("category"))


@query(
    "h11_parse_model_reply",
    """SELECT id, CASE id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS sentiment,
    CASE id % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'flat' ELSE 'parsing_error' END AS reasoning FROM replies_v""",
)
def h11(t):
    return t.replies.select("id", fn.parse_model_reply("text").alias("r")).select("id", "r.*")


@query(
    "h12_parse_aspect_reply",
    """WITH x AS (SELECT id, SNAP6(value / 100) AS v FROM replies_v) SELECT 'fundamentals' AS aspect, count(*) AS n, SNAP6(avg(v)) AS mean_score FROM x
    UNION ALL SELECT 'macro', count(*), SNAP6(avg(-v)) FROM x UNION ALL SELECT 'sentiment', count(*), SNAP6(avg(v / 2)) FROM x UNION ALL SELECT 'geopolitics', count(*) FILTER (WHERE id % 2 = 0), SNAP6(avg(CASE WHEN id % 2 = 0 THEN 0.25::DOUBLE END)) FROM x""",
)
def h12(t):
    v = snap(F.col("value") / 100)
    part = lambda s: F.struct(s.alias("score"), F.lit("note").alias("reasoning"))
    body = F.to_json(
        F.struct(
            F.lit("Positive").alias("general_sentiment"), F.lit("ok").alias("general_reasoning"), F.lit("-").alias("graph_explanation"),
            part(v).alias("fundamentals"), part(-v).alias("macro"), part(v / 2).alias("sentiment"),
            F.when(F.col("id") % 2 == 0, part(F.lit(0.25))).alias("geopolitics"),
        )
    )
    parsed = t.replies.select(fn.parse_aspect_reply(F.concat(F.lit("Answer: "), body, F.lit(" done"))).alias("r"))
    one = parsed.agg(*[F.struct(F.count(f"r.{a}.score").alias("n"), snap(F.avg(f"r.{a}.score")).alias("mean_score")).alias(f"a_{a}") for a in fn.ASPECTS])
    return stats.unpivot(one, list(fn.ASPECTS), "a_", "aspect", "v").select("aspect", "v.*")


@query(
    "h13_tag_sets",
    """WITH s AS (SELECT dt, ticker FROM articles_v a JOIN tags_v t ON t.seq = a.seq) SELECT dt, count(DISTINCT ticker) AS n_tickers,
    bool_or(ticker = 'ERINER') AS has_eriner, bool_or(ticker IN ('THTION', 'ERTION')) AS has_africa FROM s GROUP BY dt""",
)
def h13(t):
    tags = news.with_tags(t.articles, config.ALIASES).select("dt", F.explode("tags").alias("ticker")).groupBy("dt").agg(F.collect_set("ticker").alias("set"))
    return tags.select(
        "dt", F.size("set").cast("long").alias("n_tickers"), F.array_contains("set", "ERINER").alias("has_eriner"),
        F.arrays_overlap("set", F.array(*[F.lit(x) for x in config.SECTOR_MAP["AFRICA"]])).alias("has_africa"),
    )


@query("h14_invert_map", "SELECT b.sector, e.ticker, count(*) AS n_bars FROM bars_v b JOIN entity_v e ON e.sector = b.sector GROUP BY 1, 2")
def h14(t):
    sector_map = F.create_map(*[x for s, ts in config.SECTOR_MAP.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in ts]))])
    return t.bars.select("sector", F.explode(sector_map[F.col("sector")]).alias("ticker")).groupBy("sector", "ticker").agg(F.count(F.lit(1)).alias("n_bars"))


@query("h15_gold_local_from_intl", "SELECT dt, floor(gold_intl / 31.1035::DOUBLE * usd_sell_rate * 100 + 0.5) / 100 AS gold_local FROM series_v")
def h15(t):
    s = panel.merge_series(t.macro, t.globals)
    return s.select("dt", fn.gold_local_from_intl("gold_intl", "usd_sell_rate").alias("gold_local"))


@query("h16_has_news", "SELECT dt, ticker, CAST(CASE WHEN direct_count > 0 THEN 1 ELSE 0 END AS BIGINT) AS has_news FROM stock_day_v")
def h16(t):
    return t.stock_days.select("dt", "ticker", fn.has_news("direct_count").alias("has_news"))


@query(
    "h17_result_rounding",
    "SELECT ticker, floor(train_pos_ratio * 1000 + 0.5) / 1000 AS train_pos_ratio, floor(endo_f1 * 10000 + 0.5) / 10000 AS endo_f1, floor(endo_threshold * 100 + 0.5) / 100 AS endo_threshold FROM report_v",
)
def h17(t):
    return models.rounded_report(models.compare_feature_sets(t.scores)).select("ticker", "train_pos_ratio", "endo_f1", "endo_threshold")


@query("h18_significant", "SELECT ticker, significant FROM report_v")
def h18(t):
    return models.compare_feature_sets(t.scores).select("ticker", "significant")


# ------------------------------------------------------------------------------- J


@query(
    "j01_row_function",
    "SELECT ticker, dt, CASE WHEN ratio > 1.02 THEN 'strong up' WHEN ratio > 1 THEN 'up' WHEN ratio > 0.98 THEN 'down' ELSE 'strong down' END AS trend FROM samples_v",
)
def j01(t):
    r = F.col("ratio")
    return t.samples.select("ticker", "dt", F.when(r > 1.02, "strong up").when(r > 1, "up").when(r > 0.98, "down").otherwise("strong down").alias("trend"))


@query("j02_group_transform", "SELECT ticker, dt, SNAP6(close - avg(close) OVER (PARTITION BY ticker)) AS demeaned FROM bars_v")
def j02(t):
    from pyspark.sql import Window

    return t.bars.select("ticker", "dt", snap(F.col("close") - F.avg("close").over(Window.partitionBy("ticker"))).alias("demeaned"))


@query(
    "j03_grouped_map",
    "SELECT ticker, count(*) - 1 AS n_kept, arg_max(dt, dt) FILTER (WHERE nx IS NOT NULL) AS last_kept FROM (SELECT *, lead(dt) OVER (PARTITION BY ticker ORDER BY dt) AS nx FROM bars_v) GROUP BY ticker",
)
def j03(t):
    before = F.max(F.when(F.col("later").isNotNull(), F.col("dt")))
    kept = t.bars.select("ticker", "dt", F.lead("dt").over(panel.by_key()).alias("later"))
    return kept.groupBy("ticker").agg((F.count(F.lit(1)) - 1).alias("n_kept"), before.alias("last_kept"))


@query(
    "j04_multi_aggregate",
    """SELECT sector, SNAP6(avg(close)) AS close_mean, SNAP6(stddev_samp(close)) AS close_std, SNAP6(min(low)) AS low_min, SNAP6(max(high)) AS high_max, CAST(sum(volume) AS BIGINT) AS volume_sum FROM bars_v GROUP BY sector""",
)
def j04(t):
    return t.bars.groupBy("sector").agg(
        snap(F.avg("close")).alias("close_mean"), snap(F.stddev_samp("close")).alias("close_std"), snap(F.min("low")).alias("low_min"),
        snap(F.max("high")).alias("high_max"), F.sum("volume").alias("volume_sum"),
    )


@query(
    "j05_row_generator",
    """WITH n AS (SELECT ticker, count(*) AS n FROM bars_v GROUP BY ticker), w AS (SELECT unnest([126, 378, 756]) AS size),
    k AS (SELECT ticker, n, size, unnest(generate_series(0, CAST(n AS BIGINT))) AS fold FROM n CROSS JOIN w)
    SELECT ticker, size, fold, size + 4 + fold * 63 AS test_start, size + 4 + fold * 63 + 63 AS test_end FROM k WHERE size + 4 + fold * 63 + 63 <= n""",
)
def j05(t):
    n = t.bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    per_window = [splits.fold_ranges(n, size).withColumn("size", F.lit(size)) for size in learners.WINDOWS.values()]
    return reduce(lambda a, b: a.unionByName(b), per_window)
