"""Scalar functions on columns: exact fixed-point amounts, keys and hashes, times, classifiers and scores.

All are built-in expressions, so they stay in generated code. Amounts are whole millionths (bigint).
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MILLION = 1_000_000
DAY = 86_400

# Category names and terms of the data model.
TARGET_CATEGORIES = ("sports", "crypto", "weather", "culture", "finance", "geopolitics", "politics")
CATEGORY_ALIASES = {"pop-culture": "culture", "elections": "politics", "economy": "finance", "business": "finance", "world": "geopolitics"}
MARKET_CATEGORIES = ("politics", "elections", "geopolitics", "sports", "crypto", "finance", "economy", "business", "tech", "science", "weather", "culture", "world")
HIGH_PRIOR_TERMS = ("award", "appointment", "court", "geopolitics", "mention", "tech", "company", "business")
MEDIUM_PRIOR_TERMS = ("politics", "political", "fed", "central-bank", "central bank")
SHORT_HORIZON_SLUG = r"(?i)(?:^|-)(?:updown|up-or-down)(?:-|).*5m(?:-|$)"
CRYPTO_WORDS = r"(?i)\b(?:btc|bitcoin|eth|ethereum|sol|solana|xrp|doge|dogecoin|crypto)\b"
UP_OR_DOWN = r"(?i)\bup\s+(?:or|/)\s+down\b"


def first_of(*columns: Column | str) -> Column:
    """The first that is not null."""
    return F.coalesce(*columns)


def decimal_of(c: Column | str, places: int = 18) -> Column:
    """An exact decimal of up to ``places`` places and 38 digits in all, null where the text is none."""
    return (F.col(c) if isinstance(c, str) else c).try_cast(f"decimal(38,{places})")


def millionths(c: Column | str) -> Column:
    """Whole millionths, halves away from zero; null where the value is no number, or none that fits."""
    return (F.round(decimal_of(c), 6) * MILLION).try_cast("bigint")


def optional_millionths(c: Column | str) -> Column:
    """The same where an empty or broken text is no error but a value that is not there."""
    c = F.col(c) if isinstance(c, str) else c
    return millionths(F.nullif(F.trim(c.cast("string")), F.lit("")))


def notional(price: Column | str, size: Column | str) -> Column:
    """Millionths of price x size, rounded once from the unrounded inputs: the price with up to 27 places below 10^11, the
    size with up to 18 below 10^20. With these two types the product's own type has six places, so it is rounded to them
    directly."""
    return (decimal_of(price, 27) * decimal_of(size) * MILLION).try_cast("bigint")


def micro_of_double(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * MILLION).cast("bigint")


def epoch_seconds(c: Column) -> Column:
    """Seconds from text: digits as they are, fractions cut, else ISO-8601 (UTC if no zone is named); null if neither."""
    text = F.trim(c.cast("string"))
    number = text.rlike(r"^[+-]?\d+(\.\d+)?$")
    return F.when(text == "", None).when(number, F.when(number, text).try_cast("decimal(38,9)").cast("bigint")).otherwise(F.unix_timestamp(F.try_to_timestamp(text)))


def canonical_json(*columns: str) -> Column:
    """JSON with the keys in order."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def json_or_text(c: Column) -> Column:
    """Text that parses as JSON in one form, any other as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def string_list(c: Column) -> Column:
    """array<string> of a JSON list; null if it is none."""
    return F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))


def content_hash(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def joined_hash(separator: str, *columns: Column | str) -> Column:
    """SHA-256 of the columns' texts with a separator; nulls count as empty."""
    text = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws(separator, *text), 256)


def fingerprint(*columns: Column | str) -> Column:
    return joined_hash("\u001f", *columns)


def trade_key(source_id: Column, print_: Column) -> Column:
    return F.coalesce(F.nullif(source_id.cast("string"), F.lit("")), print_)


def hash_number(hex_: Column, modulus: int) -> Column:
    """The first 64 bits of a hash modulo a number, without sign trouble."""
    return (F.conv(F.substring(hex_, 1, 16), 16, 10).cast("decimal(20,0)") % modulus).cast("bigint")


def hash_sample(key: Column, numerator: int = 1, denominator: int = 4) -> Column:
    return hash_number(F.sha2(key.cast("string"), 256), denominator) < numerator


def random_rank(seed: int, category: Column, key: Column) -> Column:
    return joined_hash(":", F.lit(str(seed)), category, key)


def admitted(rank: Column, rate_ppm: int) -> Column:
    """Whether a rank of 64 hex digits lies below the rate's part of the whole range, by text order."""
    if rate_ppm >= MILLION:
        return F.lit(True)
    limit = -(-rate_ppm * (1 << 256) // MILLION)
    return rank < F.lit(f"{limit:064x}")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normal_title(c: Column, fold: bool = True) -> Column:
    """Compatibility forms folded (NFKC), lower case, runs of other than letters, digits and _ as one space, trimmed.

    Spark has no function for the folding, so it runs in Arrow batches; without ``fold`` all stays in generated code.
    """
    return F.trim(F.regexp_replace(F.lower(_nfkc(c) if fold else c), r"[^\p{L}\p{N}_]+", " "))


def category_prior(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda terms: reduce(lambda a, b: a | b, [low.contains(t) for t in terms])
    return F.when(has(HIGH_PRIOR_TERMS), "high").when(has(MEDIUM_PRIOR_TERMS), "medium").otherwise("low")


def canonical_category(raw: Column, is_sport: Column | None = None) -> Column:
    value = F.lower(F.trim(raw))
    alias = F.create_map(*[F.lit(x) for kv in CATEGORY_ALIASES.items() for x in kv])
    known = F.coalesce(F.try_element_at(alias, value), value)
    found = F.when(known.isin(*TARGET_CATEGORIES), known)
    return found if is_sport is None else F.when(is_sport, "sports").otherwise(found)


def market_category(event_category: Column, market_category_: Column, tags: Column) -> Column:
    """The event's category, else the market's, else the first known slug or label of the tags (array<struct<slug,label>>)."""
    known = F.flatten(F.transform(tags, lambda t: F.array(F.lower(t["slug"]), F.lower(t["label"]))))
    return F.coalesce(F.lower(F.nullif(event_category, F.lit(""))), F.lower(F.nullif(market_category_, F.lit(""))), F.try_element_at(F.filter(known, lambda x: x.isin(*MARKET_CATEGORIES)), F.lit(1)))


def short_horizon_evidence(slugs: list[Column], titles: list[Column], start: Column, end: Column) -> Column:
    """Why a market is a five-minute up-or-down one: "slug", "title_and_duration" or null. The slugs are tested as one text, with spaces between."""
    joined = lambda xs: F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in xs])
    slug = F.replace(F.lower(joined(slugs)), F.lit("_"), F.lit("-"))
    title = joined(titles)
    by_title = title.rlike(CRYPTO_WORDS) & title.rlike(UP_OR_DOWN) & (end - start).between(120, 600)
    return F.when(slug.contains("updown-5m") | slug.rlike(SHORT_HORIZON_SLUG), "slug").when(by_title, "title_and_duration")


def first_event(events: Column) -> Column:
    """The first of a market's events; null if there is none."""
    return F.try_element_at(events, F.lit(1))


def market_times(start: list[Column], end: list[Column]) -> tuple[Column, Column]:
    """Start and end seconds from the first alias that is not null."""
    return epoch_seconds(F.coalesce(*start)), epoch_seconds(F.coalesce(*end))


def seconds_to_resolution(end: Column, ts: Column) -> Column:
    return end - ts


def reasons(*tokens: Column) -> Column:
    """Tokens joined by ; without the nulls."""
    return F.concat_ws(";", *tokens)


def fetch_id(reason: Column) -> Column:
    """The number of the history fetch that a reason text names."""
    return F.nullif(F.regexp_extract(F.coalesce(reason, F.lit("")), r"(?:^|;)(?:raw_)?history_fetch_id:(\d+)(?:;|$)", 1), F.lit("")).cast("bigint")


def middle(values: Column) -> Column:
    """The median of whole numbers, the mean of the middle two rounded down; null of none."""
    v = F.array_sort(values)
    n = F.size(v)
    both = F.get(v, F.floor((n - 1) / 2).cast("int")).cast("decimal(20,0)") + F.get(v, F.floor(n / 2).cast("int"))
    return F.floor(both / 2).cast("bigint")


def dollars(c: Column) -> Column:
    return c / MILLION


def log10_dollars(c: Column) -> Column:
    return F.when(c > 0, F.log10(dollars(c)))


def latency_ms(observed: Column, ts: Column) -> Column:
    return F.greatest(F.lit(0), observed - ts) * 1000


def edge(won: Column, price_ppm: Column) -> Column:
    return won.cast("int") - dollars(price_ppm)


def scenario_pnl(shares: Column, won: Column, cost: Column) -> Column:
    """Gross P&L of a fill: its shares if won, less what they cost; null if it was not filled or the outcome is unknown."""
    return F.when(shares.isNotNull(), F.when(won, shares - cost).when(~won, -cost))


def buy_share(buy: Column, total: Column) -> Column:
    """The share of purchases in an amount; null without any."""
    return F.when(total > 0, F.coalesce(buy, F.lit(0)) / total)


def needs_book(notional_: Column, score: Column) -> Column:
    """Live trades whose order book is fetched."""
    return (notional_ >= 1000 * MILLION) | F.coalesce(score >= 5, F.lit(False))


def event_of(event_id: Column, event_slug: Column, market: Column) -> Column:
    """The event that a market belongs to: its id, else its slug, else the market itself."""
    return F.coalesce(F.nullif(event_id, F.lit("")), F.nullif(event_slug, F.lit("")), market.cast("string"))


def size_ratio_milli(notional_: Column, median: Column) -> Column:
    wide = notional_.cast("decimal(20,0)") * 1000
    return F.when(median > 0, F.floor(wide / median).cast("bigint"))


def score_components(age: Column, prior_trades: Column, window_complete: Column, notional_: Column, ratio: Column, price: Column, remaining: Column, prior: Column, young: Column) -> Column:
    """array<struct<rule, points>> of the rules that apply."""
    rules = [
        ("wallet_age", F.when(age < 7 * DAY, 3).when(age < 30 * DAY, 2)),
        ("recent_trades", F.when(window_complete & (prior_trades <= 5), 2).when(window_complete & (prior_trades <= 20), 1)),
        ("notional", F.when(notional_ >= 5000 * MILLION, 2).when(notional_ >= 1000 * MILLION, 1)),
        ("size_ratio", F.when(ratio >= 10_000, 2).when(ratio >= 3_000, 1)),
        ("low_price", F.when(price <= 250_000, 1)),
        ("resolves_soon", F.when(remaining.between(0, 7 * DAY), 2).when(remaining.between(0, 30 * DAY), 1)),
        ("category_prior", F.when(prior == "high", 2).when(prior == "medium", 1)),
        ("young_wallets", F.when(young >= 3, 2)),
    ]
    return F.filter(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(p, F.lit(0)).alias("points")) for n, p in rules]), lambda x: x["points"] > 0)


def score_of(components: Column) -> Column:
    return F.aggregate(components, F.lit(0), lambda a, x: a + x["points"])


def score_bucket(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 5, "medium").otherwise("low")


def price_band(ppm: Column) -> Column:
    return F.when(ppm < 100_000, "00-10%").when(ppm < 250_000, "10-25%").when(ppm < 500_000, "25-50%").when(ppm < 750_000, "50-75%").when(ppm < 900_000, "75-90%").otherwise("90-100%")


def percent(n: Column, d: Column) -> Column:
    return F.round(100 * n / F.nullif(d, F.lit(0)), 4)


def gross_pnl(won: Column, price: Column) -> Column:
    return F.when(won, MILLION - price).when(~won, -price)


def fill_shares(notional_: Column, average_price: Column) -> Column:
    return F.when(average_price > 0, F.floor(notional_.cast("decimal(28,0)") * MILLION / average_price).cast("bigint"))


def sample_weight(notional_: Column) -> Column:
    return F.when(notional_ >= 500 * MILLION, 1.0).otherwise(4.0)


def logit(p: Column, clip: float = 0.001) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    return F.ln(q / (1 - q))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of vectors of any length, not rounded; null if one is null or of norm 0."""
    unless_zero = lambda x: F.nullif(x, F.lit(0.0))
    return dot(a, b) / unless_zero(F.sqrt(dot(a, a))) / unless_zero(F.sqrt(dot(b, b)))


def cosine_ppm(a: Column, b: Column) -> Column:
    return F.greatest(F.least(F.round(dot(a, b) * MILLION), F.lit(MILLION)), F.lit(-MILLION)).cast("bigint")


def missing_fields(**conditions: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
