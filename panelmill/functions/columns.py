"""Scalar column functions. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def snap(c: ColumnLike, digits: int = 6) -> Column:
    """Round half up on the binary value, so that engines agree on ties."""
    scale = float(10**digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b as double; null when b is 0 (never an infinity)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def zero_if_null(c: ColumnLike) -> Column:
    """Nulls (and the infinities that `ratio` never makes) become 0."""
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 when true; 0 when false or null."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def sentiment_score(label: ColumnLike, form: str = "substring") -> Column:
    """Score a sentiment label.

    substring: lower-cased containment; exact: case-sensitive equality; map: null on an unknown label.
    """
    c = col(label)
    if form == "substring":
        low = F.lower(c)
        return (
            F.when(F.contains(low, F.lit("positive")), 1)
            .when(F.contains(low, F.lit("negative")), -1)
            .otherwise(0)
            .cast("long")
        )
    known = F.when(c == "positive", 1).when(c == "negative", -1)
    if form == "exact":
        return known.otherwise(0).cast("long")
    return known.when(c == "neutral", 0).cast("long")


def article_text(title: ColumnLike, summary: ColumnLike, body: ColumnLike, limit: int) -> Column:
    """The display excerpt `title. summary` or the body when there is one, trimmed to `limit` characters."""
    lead = F.concat(F.coalesce(col(title), F.lit("")), F.lit(". "), F.coalesce(col(summary), F.lit("")))
    text = F.when(F.length(F.coalesce(col(body), F.lit(""))) > 0, col(body)).otherwise(lead)
    return F.left(text, F.lit(limit))


def clean_key(c: ColumnLike) -> Column:
    return F.translate(col(c), ".:", "__")


def parse_any_date(*candidates: ColumnLike) -> Column:
    """First candidate that parses: ISO stamp with T or blank, or a plain date."""
    parsed = []
    for candidate in candidates:
        c = col(candidate)
        day = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})([T ].*)?$", 1)
        parsed.append(day.try_cast("date"))
    return F.coalesce(*parsed)


def local_date(ts: ColumnLike, zone: str) -> Column:
    """Calendar date of a UTC timestamp in `zone`."""
    return F.to_date(F.from_utc_timestamp(col(ts), zone))


def age_days(newest: ColumnLike, now: ColumnLike) -> Column:
    return F.datediff(col(now), col(newest)).cast("long")


def squared_loss(y: ColumnLike, p: ColumnLike) -> Column:
    d = col(y) - col(p)
    return d * d


def apply_threshold(p: ColumnLike, threshold: ColumnLike) -> Column:
    return flag(col(p) >= col(threshold))


def feature_category(name: ColumnLike) -> Column:
    c = col(name)
    return (
        F.when(c.startswith("price_"), "Price")
        .when(c.startswith("tech_"), "Technical")
        .when(c.startswith("macro_"), "Macro")
        .otherwise("Other")
    )


# Grams per troy ounce.
GRAMS_PER_OUNCE = 31.1035


def gold_local_from_intl(usd_per_ounce: ColumnLike, fx: ColumnLike) -> Column:
    """Local price of a gram, two digits."""
    return snap(col(usd_per_ounce) / F.lit(GRAMS_PER_OUNCE) * col(fx), 2)


def has_news(count: ColumnLike) -> Column:
    return flag(F.coalesce(col(count), F.lit(0)) > 0)


def relative_lift(base: ColumnLike, new: ColumnLike, zero_base: str = "zero", scale: float = 1.0) -> Column:
    """(new - base) / base; a zero base gives 0 or null."""
    lift = F.try_divide(col(new) - col(base), col(base)) * F.lit(scale)
    return F.coalesce(lift, F.lit(0.0)) if zero_base == "zero" else lift


def t_critical_95(df: ColumnLike) -> Column:
    """Two-sided 5 % point of Student t by the Cornish-Fisher series, good from 10 degrees on."""
    z, v = 1.959964, col(df).cast("double")
    first = (z**3 + z) / 4
    second = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    return F.lit(z) + F.lit(first) / v + F.lit(second) / (v * v)


def significant(dm: ColumnLike, n: ColumnLike, lift: ColumnLike) -> Column:
    """Better and significant: |DM| beyond the 5 % point of t with n-1 degrees, DM > 0 and lift > 0."""
    beyond = F.abs(col(dm)) > t_critical_95(col(n) - 1)
    return F.coalesce(beyond & (col(dm) > 0) & (col(lift) > 0), F.lit(False))


def extract_json(text: ColumnLike) -> Column:
    """From the first opening brace to the last closing one."""
    return F.regexp_extract(col(text), r"(?s)\{.*\}", 0)


def parse_model_reply(text: ColumnLike) -> Column:
    """struct(sentiment, reasoning): lower-cased label, neutral + parsing_error when it is not JSON."""
    parsed = F.from_json(extract_json(text), "sentiment string, reasoning string")
    broken = F.try_parse_json(extract_json(text)).isNull()
    return F.struct(
        F.when(broken, "neutral").otherwise(F.lower(F.coalesce(parsed["sentiment"], F.lit("neutral")))).alias("sentiment"),
        F.when(broken, "parsing_error").otherwise(F.coalesce(parsed["reasoning"], F.lit(""))).alias("reasoning"),
    )


# The four aspects of the nested reply.
ASPECTS = ("fundamentals", "macro", "sentiment", "geopolitics")
ASPECT_SCHEMA = (
    "general_sentiment string, general_reasoning string, graph_explanation string, "
    + ", ".join(f"{a} struct<score: double, reasoning: string>" for a in ASPECTS)
)


def parse_aspect_reply(text: ColumnLike) -> Column:
    return F.from_json(extract_json(text), ASPECT_SCHEMA)
