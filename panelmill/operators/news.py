"""News operators: page extraction, entity tags, sentiment, stock-day features, URL dedupe, digest.

Alias lists, keywords and word tables are configuration known to the driver, so they become column
expressions evaluated where the article is: no theta join, no article-by-alias cross product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelmill.functions.columns import col, sentiment_score, snap
from panelmill.operators.panel import DATE, KEY

# Patterns of stored pages.
ANCHOR = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
TAG = r"(?s)<[^>]*>"
NUMBER = r"[\d,]+\.?\d*"
ENTITY_TEXT = {"&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&amp;": "&"}


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts, styles and comments out, tags to blanks, entities decoded, blanks collapsed."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, TAG, " ")
    for entity, text in ENTITY_TEXT.items():
        t = F.replace(t, F.lit(entity), F.lit(text))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of a link: scheme kept, root-relative onto the base's host, else below the base folder."""
    host = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike("^https?://"), href)
        .when(href.startswith("/"), F.concat(host, href))
        .otherwise(F.concat(folder, href))
    )


def extract_links(pages: DataFrame, limit: int | None = 15) -> DataFrame:
    """One row per anchor with a link and a title, in page order, `limit` first ones."""
    hrefs = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))
    titles = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2))
    links = pages.select("page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("href"), titles.alias("title"))).alias("pos", "a"))
    if limit:
        links = links.filter(F.col("pos") < limit)
    title = F.trim(F.regexp_replace(F.col("a.title"), TAG, ""))
    out = links.select(
        "page_id", F.col("pos").cast("long").alias("pos"), title.alias("title"),
        resolve_url(F.col("a.href"), F.col("url")).alias("link"), F.col("a.href").alias("href"),
    )
    return out.filter((F.col("href") != "") & (F.col("title") != "")).drop("href")


def extract_labelled_value(pages: DataFrame, label: str, cell: int, row_tag: str = "tr", cell_tag: str = "td") -> DataFrame:
    """Number in the n-th cell of the first row holding `label`; thousands commas dropped, null if not a number."""
    rows = F.regexp_extract_all("html", F.lit(f"(?is)<{row_tag}[^>]*>.*?</{row_tag}>"), F.lit(0))
    hit = F.get(F.filter(rows, lambda r: F.contains(r, F.lit(label))), 0)
    cells = F.regexp_extract_all(hit, F.lit(f"(?is)<{cell_tag}[^>]*>(.*?)</{cell_tag}>"), F.lit(1))
    text = F.replace(F.trim(F.regexp_replace(F.get(cells, cell), TAG, "")), F.lit(","), F.lit(""))
    return pages.select("page_id", text.alias("cell_text"), text.try_cast("double").alias("cell_value"))


def extract_guarded_number(pages: DataFrame, lo: float, hi: float, column: str = "html") -> DataFrame:
    """First number strictly inside (lo, hi) on the page."""
    found = F.regexp_extract_all(strip_tags(F.col(column)), F.lit(NUMBER), F.lit(0))
    values = F.transform(found, lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double"))
    inside = F.filter(values, lambda v: (v > lo) & (v < hi))
    return pages.select("page_id", F.get(inside, 0).alias("number"))


def extract_article_text(pages: DataFrame, min_chars: int = 100) -> DataFrame:
    """Text of the article element; below `min_chars` the title and summary stand in."""
    title = strip_tags(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    summary = strip_tags(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    body = strip_tags(F.regexp_extract("html", r"(?is)<article[^>]*>(.*)</article>", 1))
    staged = pages.select("page_id", title.alias("title"), summary.alias("summary"), body.alias("body"))
    text = F.when(F.length("body") < min_chars, F.concat("title", F.lit(". "), "summary")).otherwise(F.col("body"))
    return staged.select("page_id", "title", text.alias("text"))


def match_any_keyword(text: Column, keywords: list[str]) -> Column:
    """Case-folded containment of any keyword."""
    low = F.lower(text)
    return F.array_contains(F.array(*[F.contains(low, F.lit(k.lower())) for k in keywords]), True)


def tag_entities(text: Column, aliases: dict[str, list[str]]) -> Column:
    """Array of the tickers whose name or alias occurs in the text (case-folded raw containment)."""
    low = F.lower(text)
    hits = []
    for ticker, words in aliases.items():
        found = F.contains(low, F.lit(ticker.lower()))
        for word in words:
            found = found | F.contains(low, F.lit(word.lower()))
        hits.append(F.when(found, F.lit(ticker)))
    return F.array_compact(F.array(*hits))


def with_tags(articles: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    return articles.withColumn("tags", tag_entities(F.col("text"), aliases))


def signals(articles: DataFrame, aliases: dict[str, list[str]], sectors: dict[str, list[str]]) -> DataFrame:
    """(article, ticker, direct, peer) for every ticker of the sector map.

    direct: the article names the ticker. peer: it names another ticker of the sector or the sector
    itself, and not the ticker. Each article expands itself; the factor is the configured ticker count.
    """
    low = F.lower("text")
    entries = []
    for sector, tickers in sectors.items():
        for ticker in tickers:
            direct = F.array_contains("tags", ticker)
            others = [t for t in tickers if t != ticker]
            peer = F.contains(low, F.lit(sector.lower()))
            if others:
                peer = peer | F.arrays_overlap("tags", F.array(*[F.lit(t) for t in others]))
            entries.append(
                F.struct(
                    F.lit(ticker).alias(KEY), F.lit(sector).alias("sector"), direct.alias("direct"), (peer & ~direct).alias("peer")
                )
            )
    tagged = with_tags(articles, aliases)
    keep = [c for c in tagged.columns if c not in ("text", "tags")]
    return tagged.select(*keep, F.explode(F.array(*entries)).alias("_e")).select(*keep, "_e.*")


def peer_mentions(articles: DataFrame, aliases: dict, sectors: dict) -> DataFrame:
    return signals(articles, aliases, sectors).filter("peer").select("seq", KEY, "sector")


def stock_day_sentiment(articles: DataFrame, aliases: dict, sectors: dict, score: Column | None = None) -> DataFrame:
    """Direct and peer sentiment mean and count per (date, ticker), 0 when there is none.

    The rows of one date and ticker combine map-side, and every article carries every ticker, so the
    date-by-ticker grid needs neither a grid join nor a cross product.
    """
    score = sentiment_score(F.coalesce("sentiment", F.lit(""))) if score is None else score
    s = signals(articles.withColumn("score", score), aliases, sectors)
    mean = lambda c: F.coalesce(F.avg(F.when(F.col(c), F.col("score"))), F.lit(0.0))
    return s.groupBy(DATE, KEY, "sector").agg(
        mean("direct").alias("direct_sentiment"),
        mean("peer").alias("sector_sentiment"),
        F.count_if("direct").alias("direct_count"),
        F.count_if("peer").alias("sector_count"),
    )


def lexicon_sentiment(articles: DataFrame, lexicon: dict[str, int]) -> DataFrame:
    """Score = positive minus negative words of the whole text; label by its sign. No shuffle."""
    words = F.split(F.lower("text"), "[^a-z]+")
    count = lambda sign: F.size(F.filter(words, lambda w: w.isin([k for k, v in lexicon.items() if v == sign]))).cast("long")
    out = articles.withColumn("lex_score", count(1) - count(-1))
    label = F.when(F.col("lex_score") > 0, "positive").when(F.col("lex_score") < 0, "negative").otherwise("neutral")
    return out.withColumn("lex_label", label)


def is_unscored(c: str = "sentiment") -> Column:
    return F.col(c).isNull() | F.col(c).isin("", "unknown")


def valid_article(*required: str) -> Column:
    out = F.lit(True)
    for c in required:
        out = out & F.col(c).isNotNull()
    return out


def recent(df: DataFrame, day: Column, cutoff: Column, keep_undated: bool) -> DataFrame:
    """Rows on or after the cut-off; the second form keeps rows without a readable date."""
    late = day >= cutoff
    return df.filter(F.coalesce(late, F.lit(keep_undated)))


def dedupe_url(articles: DataFrame, url: str = "url", text: str = "text", sequence: str = "seq") -> DataFrame:
    """One row per URL: the longest text, the first of equally long ones; rows without a URL go. `first_seq` is the smallest sequence of the
    URL: a later step that orders by text length settles equal lengths by where a URL came first.

    A map-side combined arg-max, so a URL with a third of all rows is reduced before the shuffle.
    """
    key = F.trim(F.col(url))
    rows = articles.filter(key.isNotNull() & (key != ""))
    best = F.struct(F.length(F.coalesce(text, F.lit(""))), -F.col(sequence))
    return (
        rows.groupBy(key.alias("_url"))
        .agg(F.max_by(F.struct(*articles.columns), best).alias("_row"), F.min(sequence).alias("first_seq"))
        .select("_row.*", "first_seq")
    )


def first_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group; Spark cuts each map task to n rows per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank_no", F.row_number().over(w).cast("long")).filter(F.col("rank_no") <= n)


def mentions(articles: DataFrame, aliases: dict) -> DataFrame:
    tagged = with_tags(articles, aliases)
    return tagged.select(*articles.columns, F.explode("tags").alias(KEY))


def market_digest(articles: DataFrame, aliases: dict, n: int = 50, excerpt: int = 500) -> DataFrame:
    """Latest n articles per company: count, percent by sentiment, trimmed headlines in order."""
    label = F.coalesce("sentiment", F.lit("neutral"))
    rows = mentions(articles.withColumn("sentiment", label), aliases).select(
        KEY, DATE, "seq", "sentiment", F.left("text", F.lit(excerpt)).alias("excerpt")
    )
    latest = first_n_per_group(rows, [KEY], [F.desc(DATE), F.desc("seq")], n)
    pct = lambda s: snap(100.0 * F.count_if(F.col("sentiment") == s) / F.count(F.lit(1)), 6)
    heads = F.transform(
        F.array_sort(F.collect_list(F.struct("rank_no", "excerpt"))), lambda x: F.concat(F.lit("- "), x["excerpt"])
    )
    return latest.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_articles"),
        pct("positive").alias("positive_pct"),
        pct("negative").alias("negative_pct"),
        pct("neutral").alias("neutral_pct"),
        F.array_join(heads, "\n\n").alias("headlines"),
    )
