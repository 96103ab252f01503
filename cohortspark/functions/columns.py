"""Scalar expressions: numbers, times, hashes and clean-up of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as a double; the session's time zone is UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def to_number(value: Column) -> Column:
    """A double, or null for what is no number or is NaN or infinite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def to_id(value: Column) -> Column:
    """A 64-bit id that may arrive as text such as 30000484.0 or 3e7; null for what is no whole number.

    The way goes through a decimal, as doubles run ids above 2**53 together.
    """
    exact = value.try_cast("decimal(38,18)")
    return F.when(exact == F.floor(exact), exact).try_cast("bigint")


def hash_uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by colons; the same in every run and engine."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_order(seed: int, key: Column) -> Column:
    """Text that puts keys into a reproducible random order."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string")))


def concept_name(name: Column) -> Column:
    """Lower-case letters and digits joined by single underscores; ``unknown`` where nothing is left."""
    plain = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_")
    plain = F.regexp_replace(plain, "^_+|_+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("unknown"))


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` moved into [low, high]; null stays null, infinities become null first."""
    finite = F.when(F.abs(value) != F.lit(float("inf")), value)
    return F.when(finite.isNotNull(), F.least(F.greatest(finite, F.lit(low)), F.lit(high)))


def prorated(amount: Column, observed: Column, original: Column) -> Column:
    """An interval's amount scaled to its observed part; an interval without length counts in full."""
    share = F.try_divide(observed, F.when(original > 0, original))
    within = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))  # these skip nulls, so the null is tested first
    return amount * F.when(share.isNull(), F.lit(1.0)).otherwise(within)


def decimal_rounded(value: Column, digits: int = 3) -> Column:
    """Half-up rounding by way of a decimal, as a double."""
    return value.cast(f"decimal(18,{digits})").cast("double")
