"""The same views as `views.Tables`, as DuckDB SQL for the result check."""

from __future__ import annotations

from panelmill.plans import config


def _values(rows: list[tuple]) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


SQL_VIEWS: dict[str, str] = {
    "bars_v": """
WITH px AS (
  SELECT l_suppkey AS sk, CAST(l_shipdate AS DATE) AS dt, l_extendedprice / l_quantity AS p,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS q,
         row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn,
         count(*) OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)) AS n
  FROM lineitem)
SELECT concat('S', CAST(sk AS VARCHAR)) AS ticker, dt, n_name AS isin, r_name AS sector,
       max(CASE WHEN rn = 1 THEN p END) AS open, max(p) AS high, min(p) AS low,
       max(CASE WHEN rn = n THEN p END) AS close, CAST(sum(q) AS BIGINT) AS volume
FROM px JOIN supplier ON s_suppkey = sk JOIN nation ON n_nationkey = s_nationkey
        JOIN region ON r_regionkey = n_regionkey
GROUP BY sk, dt, n_name, r_name""",
    "traded_v": "SELECT * FROM bars_v WHERE volume > 0",
    "macro_v": """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS dt, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
     g AS (SELECT dt, sum(c) AS s, count(*) AS n, max(c) AS mx FROM o GROUP BY dt)
SELECT dt, CAST(s AS DOUBLE) / CAST(n AS DOUBLE) / 100000 AS usd_sell_rate,
       CAST(mx AS DOUBLE) / 1000 AS gold_24k,
       CAST(10 + 2 * (year(dt) - 1995) + CASE WHEN month(dt) > 6 THEN 1 ELSE 0 END AS DOUBLE) AS gasoline_92,
       CASE WHEN day(dt) = 1 THEN 8 + CAST(month(dt) AS DOUBLE) / 4 END AS cbe_lending_rate,
       CASE WHEN day(dt) = 15 THEN 5 + CAST(month(dt) AS DOUBLE) / 2 END AS headline_inflation,
       CAST(100 + 10 * (year(dt) - 1995) AS DOUBLE) AS gdp_usd_billion
FROM g""",
    "global_v": """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS dt, CAST(round(o_totalprice * 100) AS BIGINT) AS c
           FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT dt, CAST(min(c) AS DOUBLE) / 10000 AS oil, CAST(max(c) AS DOUBLE) / 5000 AS gold_intl,
       CAST(sum(c) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 100 AS sp500, CAST(10 + count(*) AS DOUBLE) AS vix
FROM o GROUP BY dt""",
    "macro_feat_v": """
SELECT dt,
       coalesce(usd_sell_rate / lag(usd_sell_rate) OVER w - 1, 0) AS usd_return_daily,
       coalesce(gold_24k / lag(gold_24k) OVER w - 1, 0) AS gold_return_daily,
       coalesce(gasoline_92 / lag(gasoline_92) OVER w - 1, 0) AS gas_return,
       CAST(CASE WHEN abs(coalesce(gasoline_92 / lag(gasoline_92) OVER w - 1, 0)) > 0.001 THEN 1 ELSE 0 END AS BIGINT) AS gas_update_flag,
       coalesce(gdp_usd_billion / nullif(lag(gdp_usd_billion) OVER w, 0) - 1, 0) AS gdp_growth,
       headline_inflation, cbe_lending_rate
FROM macro_v WINDOW w AS (ORDER BY dt)""",
    "series_v": """
SELECT coalesce(m.dt, g.dt) AS dt, m.* EXCLUDE (dt), g.* EXCLUDE (dt) FROM macro_v m FULL JOIN global_v g ON m.dt = g.dt""",
    "series_filled_v": """
SELECT dt, """
    + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
        for c in (
            "usd_sell_rate", "gold_24k", "gasoline_92", "cbe_lending_rate", "headline_inflation", "gdp_usd_billion",
            "oil", "gold_intl", "sp500", "vix",
        )
    )
    + " FROM series_v",
    "market_v": "SELECT b.*, s.* EXCLUDE (dt) FROM bars_v b LEFT JOIN series_filled_v s ON b.dt = s.dt",
    "training_v": """
WITH priced AS (
  SELECT *, open / nullif(close, 0) AS open_close_ratio, high / nullif(low, 0) AS high_low_ratio,
         volume / nullif(avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS volume_relative_20,
         close / lag(close) OVER w - 1 AS price_roc_1, lead(close) OVER w / close - 1 AS next_ret
  FROM traded_v WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
joined AS (
  SELECT p.*, coalesce(usd_return_daily, 0) AS usd_return_daily, coalesce(gold_return_daily, 0) AS gold_return_daily,
         coalesce(gas_return, 0) AS gas_return, coalesce(gas_update_flag, 0) AS gas_update_flag, coalesce(gdp_growth, 0) AS gdp_growth,
         last_value(m.headline_inflation IGNORE NULLS) OVER w AS infl0, last_value(m.cbe_lending_rate IGNORE NULLS) OVER w AS rate0
  FROM priced p LEFT JOIN macro_feat_v m ON p.dt = m.dt
  WINDOW w AS (PARTITION BY ticker ORDER BY p.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
filled AS (
  SELECT *, coalesce(infl0, (SELECT quantile_cont(infl0, 0.5) FROM joined)) AS headline_inflation,
         coalesce(rate0, (SELECT quantile_cont(rate0, 0.5) FROM joined)) AS cbe_lending_rate FROM joined)
SELECT dt, ticker, sector, CAST(CASE WHEN SNAP9(next_ret) > 0.005 THEN 1 ELSE 0 END AS BIGINT) AS target_buffered,
       open_close_ratio, high_low_ratio, volume_relative_20, price_roc_1, usd_return_daily, gold_return_daily, gas_return,
       gas_update_flag, gdp_growth, headline_inflation, cbe_lending_rate, close
FROM filled WHERE next_ret IS NOT NULL AND price_roc_1 IS NOT NULL AND volume_relative_20 IS NOT NULL
  AND open_close_ratio IS NOT NULL AND high_low_ratio IS NOT NULL AND headline_inflation IS NOT NULL AND cbe_lending_rate IS NOT NULL""",
    "lagged_v": """
WITH m AS (
  SELECT dt, usd_sell_rate / lag(usd_sell_rate) OVER w - 1 AS usd_return, gold_24k / lag(gold_24k) OVER w - 1 AS gold_return,
         gasoline_92 / first_value(gasoline_92) OVER w AS gas_index, headline_inflation, cbe_lending_rate
  FROM macro_v WINDOW w AS (ORDER BY dt)),
core AS (
  SELECT *, close / lag(close) OVER w - 1 AS return_t,
         volume / nullif(avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS vol_ratio,
         high / nullif(low, 0) AS high_low_ratio, lead(close) OVER w / close - 1 AS next_ret
  FROM traded_v WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
joined AS (
  SELECT c.*, """
    + ", ".join(
        f"coalesce(last_value(m.{c} IGNORE NULLS) OVER f, 0) AS {c}"
        for c in ("usd_return", "gold_return", "gas_index", "headline_inflation", "cbe_lending_rate")
    )
    + """
  FROM core c LEFT JOIN m ON c.dt = m.dt
  WINDOW f AS (PARTITION BY ticker ORDER BY c.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
mem AS (
  SELECT *, """
    + ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag{k}" for k in (1, 2) for c in ("return_t", "vol_ratio", "gold_return"))
    + """
  FROM joined WINDOW w AS (PARTITION BY ticker ORDER BY dt))
SELECT dt, ticker, sector, CAST(CASE WHEN SNAP9(next_ret) > 0.005 THEN 1 ELSE 0 END AS BIGINT) AS target, close,
       SNAP9(return_t) AS return_t, vol_ratio, high_low_ratio, usd_return, gold_return, gas_index, headline_inflation, cbe_lending_rate,
       return_t_lag1, vol_ratio_lag1, gold_return_lag1, return_t_lag2, vol_ratio_lag2, gold_return_lag2
FROM mem WHERE next_ret IS NOT NULL AND SNAP9(return_t) BETWEEN -0.5 AND 0.5
  AND high_low_ratio IS NOT NULL AND vol_ratio IS NOT NULL AND return_t_lag1 IS NOT NULL AND return_t_lag2 IS NOT NULL
  AND vol_ratio_lag1 IS NOT NULL AND vol_ratio_lag2 IS NOT NULL AND gold_return_lag1 IS NOT NULL AND gold_return_lag2 IS NOT NULL""",
    "samples_all_v": """
WITH m AS (SELECT dt, usd_sell_rate AS usd, cbe_lending_rate AS rate FROM macro_v),
r AS (
  SELECT b.*, coalesce(ln(close / lag(close) OVER w), 0) AS lr, row_number() OVER w AS rn,
         last_value(usd IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS usd_egp,
         last_value(rate IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lending
  FROM bars_v b LEFT JOIN m ON b.dt = m.dt WINDOW w AS (PARTITION BY ticker ORDER BY b.dt)),
f AS (
  SELECT *, count(*) OVER p AS back_rows, count(*) OVER f2 AS fwd_rows, avg(close) OVER p AS p_past, avg(close) OVER f2 AS p_future,
         avg(lr) OVER w0 AS ret_w0_mean, avg(lr) OVER w1 AS ret_w1_mean, stddev_samp(lr) OVER w0 AS ret_w0_std, stddev_samp(lr) OVER w1 AS ret_w1_std,
         avg(volume) OVER w0 AS v0, avg(volume) OVER w1 AS v1,
         coalesce(lag(close, 5) OVER w / lag(close, 9) OVER w - 1, 0) AS cumret_w0, coalesce(close / lag(close, 4) OVER w - 1, 0) AS cumret_w1,
         coalesce(usd_egp / nullif(lag(usd_egp, 5) OVER w, 0) - 1, 0) AS macro_usd_egp_change, lending AS macro_cbe_lending_rate_level, """
    + ", ".join(f"lag(lr, {9 - d}) OVER w AS ret_w0_d{d}, lag(lr, {4 - d}) OVER w AS ret_w1_d{d}" for d in range(5))
    + """
  FROM r WINDOW w AS (PARTITION BY ticker ORDER BY dt), p AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
    w0 AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING),
    w1 AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
    f2 AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT *, SNAP9(p_future / p_past) AS ratio, coalesce(v1 / nullif(v0, 0) - 1, 0) AS vol_change_w0w1
FROM f WHERE back_rows = 10 AND fwd_rows = 5 AND p_past > 0""",
    "samples_v": """
SELECT *, CAST(CASE WHEN ratio > 1 + CAST(0.001 AS DOUBLE) THEN 1 ELSE 0 END AS BIGINT) AS target FROM samples_all_v
WHERE NOT (ratio BETWEEN 1 - CAST(0.001 AS DOUBLE) AND 1 + CAST(0.001 AS DOUBLE))""",
    "split_v": """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS row_no, count(*) OVER (PARTITION BY ticker) AS n_rows FROM samples_v),
a AS (SELECT *, floor(CAST(n_rows AS DOUBLE) * CAST(0.72 AS DOUBLE)) AS tr, floor(CAST(n_rows AS DOUBLE) * CAST(0.08 AS DOUBLE)) AS va FROM s),
g AS (SELECT *, CASE WHEN tr + 5 + va + 5 >= n_rows THEN 0 ELSE 5 END AS gap FROM a)
SELECT *, CASE WHEN row_no <= tr THEN 'train' WHEN row_no <= tr + gap THEN NULL WHEN row_no <= tr + 5 + va THEN 'val'
               WHEN row_no <= tr + 5 + va + gap THEN NULL ELSE 'test' END AS split FROM g""",
    "score_v": """
WITH s AS (SELECT ticker, dt, sector, split, row_no, n_rows, target AS y, SNAP9(ret_w0_mean + ret_w1_mean) AS mom, SNAP9(macro_usd_egp_change) AS usd FROM split_v),
st AS (SELECT ticker, avg(mom) AS mm, SNAP9(stddev_samp(mom)) AS ms, avg(usd) AS um, SNAP9(stddev_samp(usd)) AS us
       FROM s WHERE split = 'train' GROUP BY ticker),
z AS (SELECT s.*, coalesce(SNAP9((mom - mm) / CASE WHEN ms = 0 THEN 1 ELSE ms END), 0) AS zm,
             coalesce(SNAP9((usd - um) / CASE WHEN us = 0 THEN 1 ELSE us END), 0) AS zu FROM s LEFT JOIN st ON s.ticker = st.ticker),
f AS (SELECT ticker, dt, lead(close, 5) OVER (PARTITION BY ticker ORDER BY dt) / close - 1 AS fr FROM bars_v)
SELECT z.ticker, z.dt, sector, split, row_no, n_rows, y, SNAP9(1 / (1 + exp(-zm))) AS p_endo,
       SNAP9(1 / (1 + exp(-(zm + CAST(0.5 AS DOUBLE) * zu)))) AS p_exo, SNAP9(fr) AS fwd_ret
FROM z JOIN f ON z.ticker = f.ticker AND z.dt = f.dt""",
    "articles_v": """
SELECT d.doc_id AS seq, split_part(text, chr(10), 1) AS title, text,
       concat('https://', source, '.example/', CAST(d.doc_id % 450 AS VARCHAR)) AS url, lang,
       CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END AS sentiment,
       DATE '1996-01-01' + CAST(d.doc_id % 200 AS INT) AS dt
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "alias_v": "SELECT * FROM (VALUES "
    + _values([(t, w, s) for t, ws, s in config.ENTITIES for w in [t, *ws]])
    + ") AS t(ticker, alias, sector)",
    "entity_v": "SELECT DISTINCT ticker, sector FROM alias_v",
    "lexicon_v": "SELECT * FROM (VALUES " + _values(list(config.LEXICON.items())) + ") AS t(word, polarity)",
    "steps_v": "SELECT CAST(d AS DATE) AS eff_date, CAST(r AS DOUBLE) AS rate FROM (VALUES " + _values(config.STEPS) + ") AS t(d, r)",
    "tags_v": "SELECT DISTINCT a.seq, e.ticker FROM articles_v a JOIN alias_v e ON contains(lower(a.text), lower(e.alias))",
    "direct_v": "SELECT seq, ticker FROM tags_v",
    "peer_v": """
SELECT DISTINCT a.seq, e.ticker, e.sector FROM articles_v a CROSS JOIN entity_v e
WHERE NOT EXISTS (SELECT 1 FROM tags_v t WHERE t.seq = a.seq AND t.ticker = e.ticker)
  AND (contains(lower(a.text), lower(e.sector)) OR EXISTS (
    SELECT 1 FROM tags_v t JOIN entity_v o ON o.ticker = t.ticker WHERE t.seq = a.seq AND o.sector = e.sector AND o.ticker <> e.ticker))""",
    "scored_v": """
SELECT *, CASE WHEN contains(lower(coalesce(sentiment, '')), 'positive') THEN 1 WHEN contains(lower(coalesce(sentiment, '')), 'negative') THEN -1 ELSE 0 END AS score FROM articles_v""",
    "stock_day_v": """
WITH grid AS (SELECT DISTINCT s.dt, e.ticker, e.sector FROM articles_v s CROSS JOIN entity_v e),
d AS (SELECT s.dt, t.ticker, avg(score) AS m, count(*) AS n FROM scored_v s JOIN direct_v t ON t.seq = s.seq GROUP BY 1, 2),
p AS (SELECT s.dt, t.ticker, avg(score) AS m, count(*) AS n FROM scored_v s JOIN peer_v t ON t.seq = s.seq GROUP BY 1, 2)
SELECT g.dt, g.ticker, g.sector, coalesce(d.m, 0) AS direct_sentiment, coalesce(p.m, 0) AS sector_sentiment,
       coalesce(d.n, 0) AS direct_count, coalesce(p.n, 0) AS sector_count
FROM grid g LEFT JOIN d ON d.dt = g.dt AND d.ticker = g.ticker LEFT JOIN p ON p.dt = g.dt AND p.ticker = g.ticker""",
    "lex_v": """
WITH w AS (SELECT seq, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM articles_v),
h AS (SELECT seq, sum(polarity) AS s FROM w JOIN lexicon_v USING (word) GROUP BY seq)
SELECT a.*, CAST(coalesce(h.s, 0) AS BIGINT) AS lex_score,
       CASE WHEN h.s > 0 THEN 'positive' WHEN h.s < 0 THEN 'negative' ELSE 'neutral' END AS lex_label
FROM articles_v a LEFT JOIN h ON h.seq = a.seq""",
    "sector_day_v": "SELECT sector, dt, SNAP9(avg(close)) AS close FROM bars_v GROUP BY sector, dt",
    "sector_news_v": """
WITH n AS (SELECT ['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'][seq % 5 + 1] AS sector, dt, avg(lex_score) AS score FROM lex_v GROUP BY 1, 2)
SELECT n.sector, n.dt, n.score, s.close FROM n JOIN sector_day_v s ON s.sector = n.sector AND s.dt = n.dt""",
    "auc_v": """
WITH t AS (SELECT * FROM score_v WHERE split = 'test'),
r AS (SELECT ticker, y, rank() OVER (PARTITION BY ticker ORDER BY p_endo) + (count(*) OVER (PARTITION BY ticker, p_endo) - 1) / 2.0::DOUBLE AS re,
             rank() OVER (PARTITION BY ticker ORDER BY p_exo) + (count(*) OVER (PARTITION BY ticker, p_exo) - 1) / 2.0::DOUBLE AS rx FROM t),
c AS (SELECT ticker, sum(CASE WHEN y = 1 THEN re END) AS se, sum(CASE WHEN y = 1 THEN rx END) AS sx, CAST(sum(y) AS DOUBLE) AS p1, CAST(count(*) - sum(y) AS DOUBLE) AS p0 FROM r GROUP BY ticker)
SELECT ticker, (se - p1 * (p1 + 1) / 2) / nullif(p1 * p0, 0) AS endo_auc, (sx - p1 * (p1 + 1) / 2) / nullif(p1 * p0, 0) AS exo_auc FROM c""",
    "dm_v": """
WITH d AS (SELECT ticker, (y - p_endo) * (y - p_endo) - (y - p_exo) * (y - p_exo) AS d FROM score_v WHERE split = 'test'),
a AS (SELECT ticker, count(*) AS n, avg(d) AS db, var_samp(d) / count(*) AS v FROM d GROUP BY ticker)
SELECT ticker, n AS n_test, CASE WHEN n >= 10 AND v > 0 THEN db / sqrt(v) END AS dm FROM a""",
    "report_v": """
WITH th AS (SELECT ticker, SNAP9(quantile_cont(p_endo, 0.4)) AS te, SNAP9(quantile_cont(p_exo, 0.4)) AS tx FROM score_v WHERE split = 'val' GROUP BY ticker),
n AS (SELECT ticker, sector, count(*) AS samples, avg(y) FILTER (WHERE split = 'train') AS train_pos_ratio, count(*) FILTER (WHERE split = 'test') AS n_test FROM score_v GROUP BY ticker, sector),
c AS (SELECT s.ticker,
  CAST(count(*) FILTER (WHERE y = 1 AND p_endo >= te) AS DOUBLE) AS etp, count(*) FILTER (WHERE y = 0 AND p_endo >= te) AS efp, count(*) FILTER (WHERE y = 1 AND p_endo < te) AS efn,
  CAST(count(*) FILTER (WHERE y = 1 AND p_exo >= tx) AS DOUBLE) AS xtp, count(*) FILTER (WHERE y = 0 AND p_exo >= tx) AS xfp, count(*) FILTER (WHERE y = 1 AND p_exo < tx) AS xfn
  FROM score_v s JOIN th ON th.ticker = s.ticker WHERE split = 'test' GROUP BY s.ticker),
m AS (SELECT ticker, coalesce(etp / nullif(etp + efp, 0), 0) AS endo_precision, coalesce(etp / nullif(etp + efn, 0), 0) AS endo_recall, coalesce(2 * etp / nullif(2 * etp + efp + efn, 0), 0) AS endo_f1,
  coalesce(xtp / nullif(xtp + xfp, 0), 0) AS exo_precision, coalesce(xtp / nullif(xtp + xfn, 0), 0) AS exo_recall, coalesce(2 * xtp / nullif(2 * xtp + xfp + xfn, 0), 0) AS exo_f1 FROM c),
r AS (SELECT n.ticker, sector, samples, train_pos_ratio, n.n_test AS test, endo_f1, endo_precision, endo_recall, te AS endo_threshold, endo_auc,
  exo_f1, exo_precision, exo_recall, tx AS exo_threshold, exo_auc, CASE WHEN endo_f1 = 0 THEN 0 ELSE (exo_f1 - endo_f1) / endo_f1 END AS f1_lift,
  exo_auc - endo_auc AS auc_lift, exo_f1 > endo_f1 AS exo_better, SNAP6(dm) AS dm_stat
  FROM n JOIN th ON th.ticker = n.ticker JOIN m ON m.ticker = n.ticker JOIN auc_v a ON a.ticker = n.ticker JOIN dm_v d ON d.ticker = n.ticker)
SELECT *, coalesce(abs(dm_stat) > 1.959964 + (1.959964::DOUBLE ** 3 + 1.959964) / 4 / (test - 1)
  + (5 * 1.959964::DOUBLE ** 5 + 16 * 1.959964::DOUBLE ** 3 + 3 * 1.959964) / 96 / ((test - 1) * (test - 1)) AND dm_stat > 0 AND f1_lift > 0, false) AS significant FROM r""",
    "sweep_v": """
WITH g AS (SELECT ticker, t, p_endo, fwd_ret FROM score_v, (SELECT unnest(generate_series(40, 90)) AS t) WHERE split = 'val' AND fwd_ret IS NOT NULL AND p_endo >= t / 100.0::DOUBLE),
a AS (SELECT ticker, t, avg(CASE WHEN fwd_ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win,
  CASE WHEN count(*) >= 10 AND SNAP9(stddev_pop(fwd_ret)) > 0 THEN SNAP6(avg(fwd_ret) / stddev_pop(fwd_ret) * sqrt(252)) ELSE -999 END AS sharpe FROM g GROUP BY ticker, t),
b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY sharpe DESC, t) AS rn FROM a WHERE sharpe > -999 AND win >= 0.5)
SELECT k.ticker, coalesce(b.t / 100.0::DOUBLE, 0.5) AS threshold, b.sharpe AS best_sharpe FROM (SELECT DISTINCT ticker FROM score_v WHERE split = 'val') k LEFT JOIN b ON b.ticker = k.ticker AND b.rn = 1""",
    "replies_v": """
SELECT event_id AS id, value, props, concat('note ', CASE event_id % 4 WHEN 0 THEN '{"sentiment": "Positive", "reasoning": "up"}'
  WHEN 1 THEN '{"sentiment": "NEGATIVE", "reasoning": "down"}' WHEN 2 THEN '{"reasoning": "flat"}' ELSE '{"sentiment": positive' END, ' end') AS text FROM events""",
    "ticks_v": "SELECT event_id, ts, user_id AS ticker, event_type, value AS price FROM events",
}
SQL_VIEWS["sweep_exo_v"] = SQL_VIEWS["sweep_v"].replace("p_endo", "p_exo")
