"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in doubles, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def in_base_currency(amount: Column, currency: Column, rate: Column, base: str = "JPY", digits: int | None = 2) -> Column:
    """The amount itself in the base currency; else divided by the rate, null where that is null or zero."""
    value = amount / F.nullif(rate, F.lit(0.0))
    return F.when(currency == base, amount).otherwise(value if digits is None else F.round(value, digits))


def plain_path(path: Column) -> Column:
    """A file URI without its scheme."""
    return F.regexp_replace(path, r"^file:/{0,2}(?=/)", "")


def strip(text: Column) -> Column:
    """Without white space at either end, line feeds included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def slug(text: Column) -> Column:
    """Lower-case letters and digits, with a dash for whatever is between."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def epoch_ms(at: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, null for null."""
    return F.unix_millis(at.cast("timestamp"))


def broadcast_if_small(df: DataFrame, text: str, limit: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its strings in ``text``, which are measured, and 32 bytes a row beside them stay below ``limit``; else with one for a shuffled join."""
    held = df.agg(F.sum(F.octet_length(text) + 32)).first()[0] or 0
    return F.broadcast(df) if held <= limit else df.hint("merge")
