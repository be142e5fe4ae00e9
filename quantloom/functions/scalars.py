"""Column expressions: returns, statistics, tickers, dates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25
SESSIONS_PER_YEAR = 252


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a, b)


def window_return(base: Column, end: Column, annualized: Column, days: Column) -> Column:
    """end / base - 1, or its yearly rate; null unless both are positive, and time has passed for the latter."""
    fine = (base > 0) & (end > 0)
    grown = F.when(fine, end / base)
    years = days / DAYS_PER_YEAR
    return F.when(annualized, F.when(years > 0, F.exp(F.log(grown) / F.when(years > 0, years)) - 1)).otherwise(grown - 1)


def normal_cdf(x: Column) -> Column:
    """Φ, by the complementary error function's continued rational form; absolute error under 1.2e-7 * 1e-0."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = k + t * poly
    erfc = t * F.exp(-z * z + poly)
    return F.when(x >= 0, 1 - erfc / 2).otherwise(erfc / 2)


def ticker(raw: Column) -> Column:
    """Upper case, trimmed, with dots for hyphens and blanks."""
    return F.translate(F.upper(F.trim(raw)), "- ", "..")


def quote_symbol(tick: Column, suffix: Column) -> Column:
    return F.concat(F.translate(tick, ".", "-"), F.coalesce(suffix, F.lit("")))


def identifier_token(isin: Column, figi: Column, tick: Column, mic: Column) -> Column:
    """The best token that an identifier has: figi, then isin, then ticker at its exchange."""
    return (
        F.when(figi.rlike("^BBG[0-9A-Z]{9}$"), F.concat(F.lit("figi:"), figi))
        .when(isin.rlike("^[A-Z]{2}[0-9A-Z]{9}[0-9]$"), F.concat(F.lit("isin:"), isin))
        .when(tick.isNotNull(), F.concat(F.lit("ticker:"), ticker(tick), F.when(mic.isNotNull(), F.concat(F.lit("@"), mic)).otherwise("")))
    )


def token_parts(token: Column) -> Column:
    """struct(scheme, value, mic) of a token."""
    value = F.substring_index(F.regexp_replace(token, "^[a-z]+:", ""), "@", 1)
    mic = F.when(token.contains("@"), F.substring_index(token, "@", -1))
    return F.struct(F.substring_index(token, ":", 1).alias("scheme"), value.alias("value"), mic.alias("mic"))


def issuer_key(isin: Column, figi: Column) -> Column:
    """The issuer's part of an ISIN, or the figi: share classes of one issuer have one key."""
    return F.coalesce(F.when(F.length(isin) >= 8, F.substring(isin, 3, 6)), figi)


def period_date(text: Column) -> Column:
    """A statistical period's date: a year's last day, a month's or quarter's first, or the day itself."""
    quarter = F.concat(F.substring(text, 1, 4), F.lit("-"), F.lpad((3 * F.substring(text, -1, 1).try_cast("int") - 2).cast("string"), 2, "0"), F.lit("-01"))
    return (
        F.when(text.rlike(r"^\d{4}$"), F.try_to_date(F.concat(text, F.lit("-12-31"))))
        .when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(text, F.lit("-01"))))
        .when(text.rlike(r"^\d{4}-?Q[1-4]$"), F.try_to_date(quarter))
        .otherwise(F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)), "yyyy-MM-dd"))
    )


def valid_at(day: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    return (F.col(valid_from) <= day) & (F.col(valid_to).isNull() | (F.col(valid_to) > day))


def content_hash(*values: Column) -> Column:
    """SHA-256 of values joined by bars; null is the text None."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(v.cast("string"), F.lit("None")) for v in values)).cast("binary"), 256)
