"""Inputs of the registered queries, derived lazily from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelmill.functions.columns import snap
from panelmill.operators import features, news, panel, splits
from panelmill.plans import config


class Tables:
    """The tables of one data folder and the views built over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ------------------------------------------------------------------ prices
    @cached_property
    def bars(self) -> DataFrame:
        """One ticker per supplier, one bar per ship day.

        Open and close are arg-min/arg-max over the full line key, which combine map-side:
        a supplier or a day with a third of all lines is reduced before the shuffle.
        """
        line = self.read("lineitem").select(
            "l_suppkey",
            F.col("l_shipdate").cast("date").alias("dt"),
            F.try_divide("l_extendedprice", "l_quantity").alias("p"),
            F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("q"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
        )
        daily = line.groupBy("l_suppkey", "dt").agg(
            F.min_by("p", "seq").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "seq").alias("close"),
            F.sum("q").cast("long").alias("volume"),
        )
        # left-deep, so that each dimension is judged by its own size and never as a product of sizes
        placed = (
            daily.join(self.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        return placed.select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
            "dt", F.col("n_name").alias("isin"), F.col("r_name").alias("sector"), "open", "high", "low", "close", "volume",
        )

    @cached_property
    def traded(self) -> DataFrame:
        return panel.drop_suspended(self.bars)

    # ------------------------------------------------------------------- macro
    @cached_property
    def macro(self) -> DataFrame:
        o = self.read("orders").select(
            F.col("o_orderdate").cast("date").alias("dt"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c")
        )
        g = panel.per_day(o, F.sum("c").alias("s"), F.count(F.lit(1)).alias("n"), F.max("c").alias("mx"))
        y, m, d = F.year("dt"), F.month("dt"), F.dayofmonth("dt")
        return g.select(
            "dt",
            (F.col("s").cast("double") / F.col("n").cast("double") / 100000).alias("usd_sell_rate"),
            (F.col("mx").cast("double") / 1000).alias("gold_24k"),
            (10 + 2 * (y - 1995) + F.when(m > 6, 1).otherwise(0)).cast("double").alias("gasoline_92"),
            F.when(d == 1, 8 + m.cast("double") / 4).alias("cbe_lending_rate"),
            F.when(d == 15, 5 + m.cast("double") / 2).alias("headline_inflation"),
            (100 + 10 * (y - 1995)).cast("double").alias("gdp_usd_billion"),
        )

    @cached_property
    def globals(self) -> DataFrame:
        o = (
            self.read("orders")
            .filter(F.col("o_orderpriority") == "1-URGENT")
            .select(F.col("o_orderdate").cast("date").alias("dt"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
        )
        return panel.per_day(
            o,
            (F.min("c").cast("double") / 10000).alias("oil"),
            (F.max("c").cast("double") / 5000).alias("gold_intl"),
            (F.sum("c").cast("double") / F.count(F.lit(1)).cast("double") / 100).alias("sp500"),
            (10 + F.count(F.lit(1))).cast("double").alias("vix"),
        )

    @cached_property
    def market(self) -> DataFrame:
        """Bars with both macro sources merged, filled forward along the date series."""
        series = panel.merge_series(self.macro, self.globals)
        values = [c for c in series.columns if c != "dt"]
        return panel.join_macro(self.bars, panel.fill_columns(series, values, key=None))

    @cached_property
    def training(self) -> DataFrame:
        """Model-ready rows with ratio, return and macro features and the buffered next-day target."""
        return features.prepare_training(self.bars, self.macro)

    @cached_property
    def lagged(self) -> DataFrame:
        return features.lagged_features(self.bars, self.macro)

    # ------------------------------------------------------------------ scores
    @cached_property
    def samples(self) -> DataFrame:
        """Window samples with one changing and one level macro series, and the five-row forward return."""
        m = self.macro.select("dt", F.col("usd_sell_rate").alias("usd_egp"), "cbe_lending_rate")
        bars = panel.fill_columns(panel.join_macro(self.bars, m), ["usd_egp", "cbe_lending_rate"])
        bars = bars.withColumn("fwd_ret", panel.next_return("close", panel.by_key(), 5))
        return panel.window_samples(bars, changes=("usd_egp",), levels=("cbe_lending_rate",), keep=("fwd_ret",))

    @cached_property
    def scores(self) -> DataFrame:
        """A given score: logistic of standardised momentum, with and without the macro change.

        Samples, split, standardisation and score share the ticker partitioning of the bars: one exchange.
        """
        s = self.samples.select(
            "ticker", "dt", "sector", F.col("target").alias("y"), snap("fwd_ret", 9).alias("fwd_ret"),
            snap(F.col("ret_w0_mean") + F.col("ret_w1_mean"), 9).alias("mom"),
            snap("macro_usd_egp_change", 9).alias("usd"),
        )
        s = splits.purged_split(s)
        train = F.col("split") == "train"
        s = s.withColumns({f"z_{c}": splits.zscore_expr(c, train) for c in ("mom", "usd")})
        logistic = lambda x: snap(1 / (1 + F.exp(-x)), 9)
        return s.select(
            "ticker", "dt", "sector", "split", "row_no", "n_rows", "y",
            logistic(F.col("z_mom")).alias("p_endo"),
            logistic(F.col("z_mom") + F.lit(0.5) * F.col("z_usd")).alias("p_exo"),
            "fwd_ret",
        )

    # -------------------------------------------------------------------- news
    @cached_property
    def articles(self) -> DataFrame:
        d, l = self.read("documents"), self.read("labels")
        return d.join(l, "doc_id", "left").select(
            F.col("doc_id").alias("seq"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            "text",
            F.concat(F.lit("https://"), "source", F.lit(".example/"), (F.col("doc_id") % 450).cast("string")).alias("url"),
            "lang",
            F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "neutral").alias("sentiment"),
            F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 200).cast("int")).alias("dt"),
        )

    @cached_property
    def stock_days(self) -> DataFrame:
        return news.stock_day_sentiment(self.articles, config.ALIASES, config.SECTOR_MAP)

    @cached_property
    def sector_days(self) -> DataFrame:
        """Daily mean close of a sector."""
        return self.bars.groupBy("sector", "dt").agg(snap(F.avg("close"), 9).alias("close"))

    @cached_property
    def sector_news(self) -> DataFrame:
        """Daily sentiment and price per sector, on common days."""
        scored = news.lexicon_sentiment(self.articles, config.LEXICON)
        sectors = F.array(*[F.lit(s) for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")])
        daily = scored.groupBy(
            F.element_at(sectors, (F.col("seq") % 5 + 1).cast("int")).alias("sector"), "dt"
        ).agg(F.avg("lex_score").alias("score"))
        return panel.align_series(daily, self.sector_days, "sector", "dt")

    @cached_property
    def replies(self) -> DataFrame:
        """Model replies around the stored JSON of the events; one in four is malformed."""
        k = F.col("event_id") % 4
        body = (
            F.when(k == 0, F.lit('{"sentiment": "Positive", "reasoning": "up"}'))
            .when(k == 1, F.lit('{"sentiment": "NEGATIVE", "reasoning": "down"}'))
            .when(k == 2, F.lit('{"reasoning": "flat"}'))
            .otherwise(F.lit('{"sentiment": positive'))
        )
        return self.read("events").select(
            F.col("event_id").alias("id"), "value", "props", F.concat(F.lit("note "), body, F.lit(" end")).alias("text")
        )

    @cached_property
    def ticks(self) -> DataFrame:
        return self.read("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("ticker"),
            "event_type", F.col("value").alias("price"),
        )
